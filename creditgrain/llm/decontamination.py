"""Benchmark items inside documents, by size-partitioned MinHash search.

Items fall into classes by the number of their 5-word shingles (up to 8, 16, 32,
...). For a class of size u every document is seen as overlapping windows of 2u
shingles, u apart, so that an item is compared with stretches of about its own
size and a contained item has a Jaccard similarity of 0.19 or more with a window
even at 80 % containment; ``HASHES`` minimum hashes then agree in at least one
place with a chance above 99.8 %. Windows whose hashes cannot be an item's are
dropped in the task by a Bloom filter of a fixed size; the rest meet the items in
a join. Every pair found is verified by the exact share of the item's shingles
that the whole document holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditgrain.session import store

from .common import column, draws, fresh, gram_hashes, id_and_text, mix, numbered, table, text_blocks, word_hashes

WORDS = 5
THRESHOLD = 0.8
HASHES = 32
SMALLEST = 3  # log2 of the smallest class
BLOOM_BITS = 24
_FACTORS = (draws(HASHES, 9) | np.uint64(1)).astype(np.uint32)
_SHIFTS = draws(HASHES, 10).astype(np.uint32)


def grams(words: np.ndarray, ends: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``n``-word shingles of several texts, and where each text's begin (one more at the end)."""
    full = gram_hashes(words, n)
    sizes = np.maximum(counts - n + 1, 0)
    first = np.cumsum(sizes) - sizes
    take = np.arange(int(sizes.sum())) + np.repeat(ends - counts - first, sizes)
    return full[take], np.append(first, sizes.sum())


def keys_of(values: np.ndarray, which: int, width: int, size_class: int) -> np.ndarray:
    """One 64-bit key for a minimum, the hash function, the shingle width and the class."""
    tag = np.uint64((which << 16) | (width << 8) | size_class)
    return mix((values.astype(np.uint64) << np.uint64(24)) | tag)


def cell_minima(hashes: np.ndarray, starts: np.ndarray, which: int) -> np.ndarray:
    return np.minimum.reduceat(hashes * _FACTORS[which] + _SHIFTS[which], starts)


def item_class(size: int) -> int:
    return max(SMALLEST, int(size - 1).bit_length())


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_blocks(batches):
        rows = []
        for item_id, text in zip(batch.column("item_id").to_pylist(), texts, strict=True):
            words, counts = word_hashes([text.lower()])
            width = min(WORDS, int(counts[0]))
            if not width:
                continue
            shingles = np.unique(gram_hashes(words, width))
            kind = item_class(len(shingles))
            short = (shingles >> np.uint64(32)).astype(np.uint32)
            keys = [keys_of(cell_minima(short, np.zeros(1, np.int64), i), i, width, kind)[0] for i in range(HASHES)]
            rows.append((item_id, width, kind, shingles.view(np.int64), np.array(keys).view(np.int64)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "width", "kind", "shingles", "keys"]
        )


def bloom_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def _bloom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits that the keys of a task set, as bytes of the filter that aren't 0."""
    held = np.zeros(1 << BLOOM_BITS, bool)
    for batch in batches:
        for places in bloom_places(column(batch, "key").view(np.uint64)):
            held[places] = True
    packed = np.packbits(held)
    used = np.flatnonzero(packed)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed[used].astype(np.int32))], ["place", "bits"])


def window_keys(texts: list[bytes], kinds: list[tuple[int, int]], bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of the minima of all windows that the filter lets through."""
    words, counts = word_hashes([t.lower() for t in texts])
    ends = np.cumsum(counts)
    numbers, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for width in sorted({w for w, _ in kinds}):
        full, first = grams(words, ends, counts, width)
        if not len(full):
            continue
        short = (full >> np.uint64(32)).astype(np.uint32)
        sizes = np.diff(first)
        for kind in sorted(k for w, k in kinds if w == width):
            cells = (sizes + (1 << kind) - 1) >> kind
            owner = np.repeat(np.arange(len(texts)), cells)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
            starts = first[owner] + (at << kind)
            joined = np.flatnonzero(owner[:-1] == owner[1:])
            for i in range(HASHES):
                low = cell_minima(short, starts, i)
                both = low.copy()
                both[joined] = np.minimum(low[joined], low[joined + 1])
                found = keys_of(both, i, width, kind)
                one, two = bloom_places(found)
                hit = np.flatnonzero(bloom[one] & bloom[two])
                numbers.append(owner[hit])
                keys.append(found[hit])
    return np.concatenate(numbers), np.concatenate(keys)


def _windows(kinds: list[tuple[int, int]], packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch, texts in text_blocks(batches):
            number, key = window_keys(texts, kinds, bloom)
            if len(key):
                pairs = np.unique(np.column_stack([number, key.view(np.int64)]), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["doc_id", "key"]
                )

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            widths, wanted = batch.column("width").to_pylist(), batch.column("shingles")
            shares = []
            for k, (text, width) in enumerate(zip(texts, widths, strict=True)):
                words, _ = word_hashes([text.lower()])
                item = np.asarray(wanted[k].values).view(np.uint64)
                shares.append(np.isin(item, gram_hashes(words, width)).mean())
            good = np.flatnonzero(np.array(shares) >= threshold - 1e-9)
            rows = batch.select(["doc_id", "item_id"]).take(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.array(shares)[good], pa.float64())], ["doc_id", "item_id", "containment"]
            )

    return run


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each (doc_id, item_id) where the document holds enough of the item, with the share.

    A-Z count as a-z. An item of fewer than five words is one shingle of all its
    words; one without words or text is in no document. Documents and items
    without an id are not reported. Repeated rows give one row with the largest
    share. Either table may be empty.
    """
    wanted = items.where("item_id is not null").select(
        F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    known = store(
        wanted.distinct().mapInArrow(_items, "item_id long, width int, kind int, shingles array<long>, keys array<long>"), "items"
    )
    kinds = [(r[0], r[1]) for r in known.select("width", "kind").distinct().collect()]  # at most 5 x 30
    keys = known.select("item_id", F.explode("keys").alias("key"))
    bits = keys.select("key").mapInArrow(_bloom, "place int, bits int").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    packed = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for batch in bits.toArrow().to_batches():  # at most 2 MB of bits
        packed[column(batch, "place")] = column(batch, "bits")
    source = id_and_text(docs).where("doc_id is not null")
    hits = source.mapInArrow(_windows(kinds, packed.tobytes()), "doc_id long, key long")
    pairs = store(hits.join(keys, "key").select("doc_id", "item_id").distinct(), "candidates")
    return (
        source.join(pairs, "doc_id")
        .join(known.select("item_id", "width", "shingles"), "item_id")
        .select("doc_id", "item_id", "text", "width", "shingles")
        .mapInArrow(_verify(threshold), "doc_id long, item_id long, containment double")
        .groupBy("doc_id", "item_id")
        .agg(F.max("containment").alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item was found.

    Rows and items are numbered, so those without an id or with a repeated one are judged
    by their own text.
    """
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    numbers = store(items.select("text").distinct().withColumn("item_id", F.monotonically_increasing_id()), "items")
    found = contained_items(rows.select(F.col(row).alias("doc_id"), "text"), numbers, threshold)
    return rows.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
