"""Removal of repeated passages with compressed FM-indexes.

A window of ``WINDOW`` consecutive words is repeated if the same words also start
earlier (in a smaller document, or earlier in the same one). To send equal windows
to the same shard, each window is filed under an anchor: the smallest of the hashes
of the ``GRAM``-word sequences inside it. Neighbouring windows share anchors, so a
document becomes a row of regions, each with the windows of one occurrence of an
anchor. Regions of anchors that occur once hold nothing repeated; they are dropped
by a Bloom filter of a bounded size before anything but anchor counts is shuffled.
Anchors with very many occurrences are split: each of their windows becomes a region
filed under its own hash.

A shard holds whole anchor groups. Its index is an FM-index over the different
regions in document order: a suffix array sorted to the depth of a window, its
Burrows-Wheeler transform in a wavelet matrix of packed bits, and occurrence counts.
Symbols are sequences of ``STEP`` words, one text for each of the ``STEP`` phases, so
that a window is ``WINDOW / STEP`` symbols. All windows of the shard's regions are
searched backwards together; the first entry of the interval found is the earliest
occurrence. Occurrences of a region then compare themselves with that by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditgrain.session import store

from .bloom import bloom_of, may_hold
from .common import column, gram_hashes, numbered_texts, span_hashes, table, text_blocks, word_hashes, word_spans

WINDOW = 20
GRAM = 8
STEP = 5
SHARD_WORDS = 400_000
HOT = 2000  # occurrences of an anchor from which it is split, or ...
HOT_SHARE = 1e-6  # ... this share of all: at most 1 / HOT_SHARE anchors are split
NO_ID = np.iinfo(np.int64).max


# ------------------------------------------------------------------ the index


class BitRank:
    """Packed bits with the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Backward search in a sequence of symbols from 1 up; 0 parts its texts.

    ``depth`` is how many symbols suffixes are sorted by, and so the longest
    pattern; suffixes equal to that depth stay in the order of their places.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.size = n
        rank, sorted_by = symbols.astype(np.int64), 1
        while sorted_by < depth:
            ahead = min(sorted_by, depth - sorted_by)
            behind = np.zeros(n, np.int64)
            behind[: n - ahead] = rank[ahead:] + 1
            rank = np.unique(rank * (int(behind.max(initial=0)) + 1) + behind, return_inverse=True)[1].reshape(-1)
            sorted_by += ahead
        self.suffixes = np.argsort(rank, kind="stable")
        transform = symbols[self.suffixes - 1]  # the symbol before; the last one for the whole text
        top = int(symbols.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.levels: list[tuple[int, BitRank, int]] = []
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            bits = (transform >> level) & 1
            zeros = int(n - bits.sum())
            self.levels.append((level, BitRank(bits), zeros))
            transform = np.concatenate([transform[bits == 0], transform[bits == 1]])
        self.begin = np.zeros(top + 1, np.int64)
        fresh = np.flatnonzero(np.diff(transform, prepend=-1))
        self.begin[transform[fresh]] = fresh

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first ``at`` places of the transform."""
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - self.begin[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of each row of symbols, read from its end: the longest matching
        ending and the interval of its suffixes."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        matched = np.zeros(len(patterns), np.int64)
        going = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[going, k]
            known = symbol < len(self.begin)
            going, symbol = going[known], symbol[known]
            lower = self.first[symbol] + self.rank(symbol, low[going])
            upper = self.first[symbol] + self.rank(symbol, high[going])
            found = lower < upper
            going = going[found]
            low[going], high[going] = lower[found], upper[found]
            matched[going] += 1
        return matched, low, high


def phases(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How texts of so many words are written as symbols of ``step`` words.

    For each place of the written text: the word at which its symbol starts, or
    -1 for a parting; and for each word the place of the symbol starting there.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    total = int(counts.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(total) - begins[text]
    starts = np.flatnonzero(offset <= counts[text] - step)
    order = starts[np.lexsort((offset[starts], offset[starts] % step, text[starts]))]
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (np.diff(offset[order]) != step)
    place = np.arange(len(order)) + np.cumsum(new)
    written = np.full(int(place[-1]) + 2 if len(place) else 1, -1, np.int64)
    written[place] = order
    where = np.full(total, -1, np.int64)
    where[order] = place
    return written, where


# ------------------------------------------------------------------ regions of documents


def regions(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The regions of some documents: their text number, first word, windows, anchor and hash,
    first and last byte in the joined texts; and the hash of every window by its first word."""
    words, counts, starts, ends, joined = word_spans(texts)
    size = window - gram + 1
    grams = gram_hashes(words, gram)
    out = {k: np.zeros(0, np.int64) for k in ("text", "start", "windows", "from", "to")}
    out |= {"anchor": np.zeros(0, np.uint64), "hash": np.zeros(0, np.uint64), "joined": joined, "words": words, "spans": (starts, ends)}
    if len(grams) < size:
        return out
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    whole = np.flatnonzero(owner[: len(grams) - size + 1] == owner[window - 1 : window + len(grams) - size])
    if not len(whole):
        return out
    least = np.lib.stride_tricks.sliding_window_view(grams, size).argmin(1)[whole] + whole
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(whole) != 1) | (np.diff(least) != 0)
    at = np.flatnonzero(new)
    first = whole[at]
    many = np.diff(np.append(at, len(whole)))
    last = first + many - 1 + window
    return out | {
        "text": owner[first],
        "start": first - begin[owner[first]],
        "first": first,
        "windows": many,
        "anchor": grams[least[at]],
        "hash": span_hashes(words, first, last),
        "from": starts[first],
        "to": ends[last - 1],
    }


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches, 1 << 23):
            keys, n = np.unique(regions(texts, window, gram)["anchor"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _occurrences(shared, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, hot = shared.value
        for batch, texts in text_blocks(batches):
            found = regions(texts, window, gram)
            keep = may_hold(packed, found["anchor"])
            split = np.isin(found["anchor"], hot)
            yield from _rows(batch, found, np.flatnonzero(keep & ~split), np.flatnonzero(keep & split), window)

    return run


def _rows(batch: pa.RecordBatch, found: dict, plain: np.ndarray, split: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Occurrence rows; the first of each region in this block has its words and their number."""
    if not len(plain) + len(split):
        return
    starts, ends = found["spans"]
    reps = found["windows"][split]
    shift = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    first = np.repeat(found["first"][split], reps) + shift
    single = span_hashes(found["words"], first, first + window) if len(first) else np.zeros(0, np.uint64)
    join = lambda name, more: np.concatenate([found[name][plain], more])
    anchor, region = join("anchor", single), join("hash", single)
    text = join("text", np.repeat(found["text"][split], reps))
    start = join("start", np.repeat(found["start"][split], reps) + shift)
    low, high = join("from", starts[first]), join("to", ends[first + window - 1])
    doc = batch.column("doc_id").fill_null(NO_ID).to_numpy()[text]
    row = column(batch, "row")[text]
    order = np.lexsort((start, row, doc, region))
    new = np.diff(region[order], prepend=~region[order[:1]]) != 0
    n = np.zeros(len(region), np.int64)
    n[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
    joined = found["joined"]
    body = [joined[a:b] if k else None for a, b, k in zip(low.tolist(), high.tolist(), n.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64)), pa.array(region.view(np.int64)), pa.array(doc), pa.array(row), pa.array(start), pa.array(n), pa.array(body, pa.binary())],
        ["anchor", "region", "doc", "row", "start", "n", "body"],
    )


# ------------------------------------------------------------------ shards

SEGMENT = "region long, skip int, windows int, first_doc long, first_row long, first_start long"


def earliest(region: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, bodies: list[bytes], window: int, step: int) -> pa.RecordBatch:
    """For each region of a shard, stretches of its windows with their earliest occurrence.

    A region that occurs once and whose windows are themselves the earliest is left out.
    """
    order = np.lexsort((start, row, doc))
    _, at, same = np.unique(region[order], return_index=True, return_inverse=True)
    times = np.bincount(same.reshape(-1), n[order]).astype(np.int64)
    by_place = np.argsort(at)
    chosen, times = order[at[by_place]], times[by_place]
    words, counts = word_hashes([bodies[i] for i in chosen.tolist()])
    begins = np.cumsum(counts) - counts
    written, where = phases(counts, step)
    grams = np.append(gram_hashes(words, step), np.zeros(step, np.uint64))
    ids = np.unique(grams[written[written >= 0]], return_inverse=True)[1].reshape(-1) + 1
    symbols = np.zeros(len(written), np.int64)
    symbols[written >= 0] = ids
    index = FMIndex(symbols, window // step)
    many = counts - window + 1
    owner = np.repeat(np.arange(len(chosen)), many)
    skip = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    heads = begins[owner] + skip
    pattern = symbols[where[heads[:, None] + np.arange(0, window, step)]]
    matched, low, _ = index.search(pattern)
    if not (matched == window // step).all():
        raise AssertionError("a window of the index was not found in it")
    word = written[index.suffixes[low]]
    which = np.searchsorted(begins, word, side="right") - 1
    shift = word - begins[which]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(which) != 0) | (np.diff(shift) != 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(owner)))
    keep = (times[owner[head]] > 1) | (which[head] != owner[head]) | (shift[head] != skip[head])
    head, length = head[keep], length[keep]
    source = chosen[which[head]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(region[chosen[owner[head]]].view(np.int64)),
            pa.array(skip[head].astype(np.int32)),
            pa.array(length.astype(np.int32)),
            pa.array(doc[source]),
            pa.array(row[source]),
            pa.array(start[source] + shift[head]),
        ],
        ["region", "skip", "windows", "first_doc", "first_row", "first_start"],
    )


def _shards(window: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries come by anchor; a shard ends at the first new anchor beyond its size."""
        held: list[pa.RecordBatch] = []
        size = 0

        def finish():
            joined = pa.Table.from_batches(held)
            take = lambda name: joined[name].to_numpy()
            return earliest(take("region").view(np.uint64), take("doc"), take("row"), take("start"), take("n"), joined["body"].to_pylist(), window, step)

        for batch in batches:
            anchor = column(batch, "anchor")
            cuts = [*(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(anchor)]
            done = 0
            if held and len(anchor) and size >= SHARD_WORDS and held[-1].column("anchor")[-1].as_py() != anchor[0]:
                yield finish()
                held, size = [], 0
            for cut in cuts[:-1]:  # the last group may go on in the next batch
                if size + (cut - done) * WINDOW >= SHARD_WORDS:
                    held.append(batch.slice(done, cut - done))
                    yield finish()
                    held, size, done = [], 0, cut
            if done < len(anchor):
                held.append(batch.slice(done))
                size += (len(anchor) - done) * WINDOW
        if held:
            yield finish()

    return run


# ------------------------------------------------------------------ on tables


def _clean(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            spans = batch.column("spans").to_pylist()
            total, removed, digest, kept = [], [], [], []
            for text, cut in zip(texts, spans, strict=True):
                words = text.split()
                total.append(len(words))
                if cut:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for low, high in cut:
                        edge[low] += 1
                        edge[high] -= 1
                    words = [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """The intervals of words to remove: row and ``spans``, an array of [low, high).

    ``rows`` has doc_id, row (a number of its own for each row) and text.
    """
    spark = rows.sparkSession
    counts = rows.select("text").mapInArrow(_anchors(window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = store(counts.where("n > 1"), "anchors")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = often.where(F.col("n") > max(HOT, HOT_SHARE * total)).select("anchor").toArrow()["anchor"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((bloom_of(often, "anchor"), hot))
    found = store(
        rows.mapInArrow(_occurrences(shared, window, gram), "anchor long, region long, doc long, row long, start long, n long, body binary"),
        "regions",
    )
    entries = found.where("body is not null").repartition("anchor").sortWithinPartitions("anchor")
    segments = entries.mapInArrow(_shards(window, step), SEGMENT)
    before = F.struct("first_doc", "first_row", "first_start") < F.struct(
        "doc", F.col("row").alias("first_row"), (F.col("start") + F.col("skip")).alias("first_start")
    )
    low = F.col("start") + F.col("skip")
    return (
        found.select("region", "doc", "row", "start")
        .join(segments, "region")
        .where(before)
        .groupBy("row")
        .agg(F.collect_list(F.array(low, low + F.col("windows") + (window - 1))).alias("spans"))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text as they are; a NULL text has
    none. Documents shorter than a window lose nothing. A NULL id comes after all
    others; rows of one id count in stored order. ``step`` must divide ``window``,
    ``gram`` must not exceed it.
    """
    if window % step or gram > window:
        raise ValueError("step must divide window, and gram must fit into it")
    rows = numbered_texts(docs)
    spans = repeated_spans(rows, window, gram, step)
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        _clean(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
