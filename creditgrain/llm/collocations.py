"""Phrases whose words stand together more often than chance, by set-oriented mining (SETM).

An occurrence relation has a row for each place where a phrase of k words stands:
(piece, position, phrase), sorted by piece and position. It is stored, a record for each
block of text: positions as steps, phrases as numbers into the block's own list of keys.
Positions leave a gap after every piece, so neighbouring ones always share a piece.

R1 comes from the texts. Then, for k = 2, 3, ...:

1. Merge-join the relation of k - 1 words with itself by piece and adjacent position: a
   phrase of k words is one of k - 1 words and the one that starts a word later. Both are
   sorted and of one block, so the join needs no shuffle.
2. Group and count: occurrences are counted in the block, then by ``CELL_BITS`` of a hash of
   the phrase, which is all that most phrases are shuffled as. Only phrases in cells of
   ``support`` occurrences are counted once more by (left, right), the keys of the two
   parts, and that count decides. Frequent phrases stay in a table with the counts of all
   their beginnings and endings, which they have from their parts.
3. Semi-join the occurrences with the frequent phrases before the next length: by a Bloom
   filter that grows with their number up to ``MAX_BITS``. What it lets through wrongly
   costs time and no result, as only exact counts decide.

A key is a 64-bit hash of language and word, or of the keys of two parts. If two words or
two frequent phrases had one key, all is mined again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditgrain.session import discard, store

from .common import column, mix, table, text_blocks, word_spans

SUPPORT = 100
LONGEST = 5
PERCENT = 100
TOP = 2000
UNKNOWN = "und"
BLOCK = 1 << 21  # bytes of text in a block
CELL_BITS = 40
HELD = 1 << 20
LEAST_BITS, MAX_BITS = 20, 30  # log2 of the filter's size, 128 MB at most
BITS_EACH = 16
RANKED = 100_000  # candidates ranked by one task at first

_PARTS = np.zeros(256, bool)
_PARTS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_BREAKS = _PARTS.copy()
_BREAKS[[9, 32]] = True


class SameKey(Exception):
    """Two words or two phrases have one key."""


# ------------------------------------------------------------------ words of texts


def salted(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix(keys + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def joined_key(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + salted(right, salt))


def word_places(langs: list[str], texts: list[bytes], salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of every word: its key, position and text number, first and last byte in the joined texts."""
    hashes, counts, starts, ends, joined = word_spans([t.lower() for t in texts], _BREAKS)
    tags = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
    tag = np.array([tags[lang] for lang in langs], np.uint64)
    text = np.repeat(np.arange(len(texts)), counts)
    # A gap for each word before which a part ends: marks up to its start.
    marks = np.cumsum(_PARTS[np.frombuffer(joined, np.uint8)])[starts]
    position = np.arange(len(starts)) + np.cumsum(np.diff(marks, prepend=-1) > 0)
    return salted(hashes ^ tag[text], salt), position, text, starts, ends, joined


def _counted_words(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, BLOCK):
            langs = batch.column("lang").to_pylist()
            keys, _, text, starts, ends, joined = word_places(langs, texts, salt)
            found, at, n = np.unique(keys, return_index=True, return_counts=True)
            words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[k] for k in text[at].tolist()], pa.string()),
                    pa.array(found.view(np.int64)),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(n),
                ],
                ["lang", "key", "word", "n"],
            )

    return run


# ------------------------------------------------------------------ occurrence relations


class Filter:
    """Bits of the keys of frequent phrases; ``size`` is the log2 of their number."""

    def __init__(self, packed: np.ndarray, size: int):
        self.packed, self.size = packed, size

    @staticmethod
    def places(keys: np.ndarray, size: int) -> list[np.ndarray]:
        keys, mask = mix(keys), np.uint64((1 << size) - 1)
        return [(x & mask).astype(np.int64) for x in (keys, keys >> np.uint64(33))]

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> Filter:
        size = min(MAX_BITS, max(LEAST_BITS, (n * BITS_EACH).bit_length()))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.concatenate(cls.places(column(batch, "key").view(np.uint64), size))
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.left_shift(1, bits & 63))], ["place", "bits"])

        words = keys.select("key").mapInArrow(places, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
        packed = np.zeros(1 << (size - 6), np.int64)
        for batch in words.toArrow().to_batches():  # at most 2 ** (MAX_BITS - 6) rows
            packed[column(batch, "place")] = column(batch, "bits")
        return cls(packed.view(np.uint8), size)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        one, two = self.places(keys, self.size)
        return ((self.packed[one >> 3] >> (one & 7)) & (self.packed[two >> 3] >> (two & 7)) & 1).astype(bool)


RELATION = "places long, steps binary, phrases binary, which binary"


def record(position: np.ndarray, keys: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    """A block's occurrences as a row of the relation; steps above 2 ** 32 can't be."""
    kind = np.uint16 if len(keys) <= 1 << 16 else np.uint32
    return pa.RecordBatch.from_arrays(
        [
            pa.array([len(position)], pa.int64()),
            pa.array([np.diff(position, prepend=0).astype(np.uint32).tobytes()], pa.binary()),
            pa.array([keys.tobytes()], pa.binary()),
            pa.array([which.astype(kind).tobytes()], pa.binary()),
        ],
        ["places", "steps", "phrases", "which"],
    )


def kept_record(position: np.ndarray, keys: np.ndarray, which: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    """The record of the occurrences whose key is kept; ``keep`` is by key."""
    number = np.cumsum(keep) - 1
    good = np.flatnonzero(keep[which])
    return record(position[good], keys[keep], number[which[good]])


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, keys, which) of each record."""
    for batch in batches:
        for k in range(len(batch)):
            steps, phrases, which = (batch.column(name)[k].as_buffer() for name in ("steps", "phrases", "which"))
            keys = np.frombuffer(phrases, np.uint64)
            yield np.cumsum(np.frombuffer(steps, np.uint32).astype(np.int64)), keys, np.frombuffer(which, np.uint16 if len(keys) <= 1 << 16 else np.uint32).astype(np.int64)


def neighbours(position: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join: positions followed by the next one, with both phrases."""
    at = np.flatnonzero(np.diff(position) == 1)
    return position[at], which[at], which[at + 1]


def _first_relation(shared, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, BLOCK):
            words, position, *_ = word_places(batch.column("lang").to_pylist(), texts, salt)
            keys, which = np.unique(words, return_inverse=True)
            yield kept_record(position, keys, which.reshape(-1), shared.value.holds(keys))

    return run


def pairs(position: np.ndarray, keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the joined phrases, the keys of their two parts for each different one, and which one it is."""
    at, left, right = neighbours(position, which)
    codes, number = np.unique(left * max(1, len(keys)) + right, return_inverse=True)
    return at, keys[codes // max(1, len(keys))], keys[codes % max(1, len(keys))], number.reshape(-1)


def _counted_cells(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for position, keys, which in records(batches):
            _, left, right, number = pairs(position, keys, which)
            cell = joined_key(left, right, salt) >> np.uint64(64 - CELL_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.bincount(number, minlength=len(left)))], ["key", "n"])

    return run


def summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different (left, right) once, with the sum of its counts."""
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.ones(len(order), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return left[at], right[at], np.add.reduceat(n[order], at) if len(at) else n


def _counted_pairs(shared, salt: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the task's blocks together, packed into a row for each bucket of phrases;
        beyond ``HELD`` phrases what there is."""

        def rows(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            bucket = (joined_key(left, right, salt) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            lines = np.column_stack([left, right, n.astype(np.uint64)])[order]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][cuts]), pa.array([part.tobytes() for part in np.split(lines, cuts[1:])][: len(cuts)], pa.binary())], ["bucket", "lines"]
            )

        none = np.zeros(0, np.uint64)
        held = (none, none, np.zeros(0, np.int64))
        for position, keys, which in records(batches):
            _, left, right, number = pairs(position, keys, which)
            good = np.flatnonzero(shared.value.holds(joined_key(left, right, salt) >> np.uint64(64 - CELL_BITS)))
            found = (left[good], right[good], np.bincount(number, minlength=len(left))[good])
            held = summed(*[np.concatenate(x) for x in zip(held, found, strict=True)])
            if len(held[0]) > HELD:
                yield rows(*held)
                held = (none, none, np.zeros(0, np.int64))
        yield rows(*held)

    return run


def _frequent_pairs(salt: int, support: int):
    def run(bucket: pa.Table) -> pa.Table:
        """The phrases of a bucket that occur often enough, counted over all tasks."""
        lines = np.frombuffer(b"".join(bucket.column("lines").to_pylist()), np.uint64).reshape(-1, 3)
        left, right, n = summed(lines[:, 0], lines[:, 1], lines[:, 2].astype(np.int64))
        often = n >= support
        left, right = left[often], right[often]
        key = joined_key(left, right, salt)
        return pa.table([*[pa.array(x.view(np.int64)) for x in (left, right, key)], pa.array(n[often])], ["left", "right", "key", "a"])

    return run


def _next_relation(shared, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for position, keys, which in records(batches):
            at, left, right, number = pairs(position, keys, which)
            key = joined_key(left, right, salt)
            yield kept_record(at, key, number, shared.value.holds(key))

    return run


# ------------------------------------------------------------------ frequent phrases


def _one_each(frequent: DataFrame) -> int:
    """Rows of a table of frequent phrases; their keys must differ."""
    n, keys = frequent.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    if n != keys:
        raise SameKey
    return n


def _mined(rows: DataFrame, support: int, longest: int, salt: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words, and the words of each language."""
    context = rows.sparkSession.sparkContext
    words = store(
        rows.mapInArrow(_counted_words(salt), "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("a")),
        "words",
    )
    if words.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where("words > 1").limit(1).count():
        raise SameKey
    totals = store(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    counts = F.array("a")
    frequent = [
        store(words.where(F.col("a") >= support).select("key", "lang", "a", F.array("word").alias("words"), counts.alias("begins"), counts.alias("ends")), "phrases")
    ]
    discard(words)
    relation = None
    for k in range(2, longest + 1):
        n = _one_each(frequent[-1])
        if not n:
            break
        held = context.broadcast(Filter.of(frequent[-1], n))
        made = rows.mapInArrow(_first_relation(held, salt), RELATION) if relation is None else relation.mapInArrow(_next_relation(held, salt), RELATION)
        # Small row groups, so that no reader holds many blocks at once.
        following = store(made, "occurrences", compression="zstd", **{"parquet.block.size": 1 << 23})
        if relation is not None:
            discard(relation)
        relation = following
        cells = relation.mapInArrow(_counted_cells(salt), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        cells = store(cells.where(F.col("n") >= support).select("key"), "cells")
        many = cells.count()
        crowded = context.broadcast(Filter.of(cells, many))
        # Each task has a line for a crowded cell at most, but for false hits: so many lines a bucket.
        buckets = 1 + many * relation.rdd.getNumPartitions() // HELD
        grouped = (
            relation.mapInArrow(_counted_pairs(crowded, salt, buckets), "bucket int, lines binary")
            .groupBy("bucket")
            .applyInArrow(_frequent_pairs(salt, support), "left long, right long, key long, a long")
        )
        part = frequent[-1]
        left = part.select(F.col("key").alias("left"), "lang", "words", "begins")
        right = part.select(F.col("key").alias("right"), F.element_at("words", -1).alias("last"), "ends")
        more = lambda name, value: F.array_append(name, F.col(value))
        frequent.append(
            store(
                grouped.join(left, "left")
                .join(right, "right")
                .select("key", "lang", "a", more("words", "last").alias("words"), more("begins", "a").alias("begins"), more("ends", "a").alias("ends"), "left", "right"),
                "phrases",
            )
        )
        discard(cells)
        held.unpersist()
        crowded.unpersist()
    if relation is not None:
        discard(relation)
    _one_each(frequent[-1])
    return frequent, totals


def _cuts(k: int) -> Column:
    """(score, cut, l, r) of the cut that counts: the lowest score, then the earliest cut.

    Decimals of 38 digits hold 1000 * a * n for up to 10^15 words and 10^19 occurrences.
    """
    cuts = []
    for j in range(1, k):
        l, r = F.col("begins")[j - 1], F.col("ends")[k - j - 1]
        score = F.expr(
            f"(1000BD * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div "
            f"(cast(begins[{j - 1}] as decimal(19,0)) * cast(ends[{k - j - 1}] as decimal(19,0)))"
        )
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    longest: int = LONGEST,
    percent: int = PERCENT,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
    ranked: int = RANKED,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top`` phrases.

    Words are lower-cased (A-Z) and don't cross ``.,;:!?`` or line ends. ``a`` counts the
    phrase, ``l`` and ``r`` its two parts at the cut of the lowest score 1000 * a * n / (l * r),
    rounded down; ``n`` all words of the language. Phrases that mostly stand inside a longer
    frequent one (``percent`` of their occurrences) are left out: if a phrase does in one
    longer by two words, it does in the one between, so the next length decides. Ties of score
    go to larger ``a``, then by the bytes of the phrase. A NULL language is ``und``, a NULL
    text empty; repeated rows count each time; no words or no frequent phrases give no rows.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    salt = 0
    while True:
        try:
            frequent, totals = _mined(rows, support, longest, salt)
            break
        except SameKey:
            salt += 1
    scored = None
    for k in range(2, len(frequent) + 1):
        phrases = frequent[k - 1]
        if k < len(frequent):
            over = frequent[k]
            inside = over.select(F.explode(F.array("left", "right")).alias("key"), F.col("a").alias("over")).groupBy("key").agg(F.max("over").alias("over"))
            phrases = phrases.join(inside, "key", "left").where(F.coalesce(F.col("over") * 100 < F.col("a") * percent, F.lit(True)))
        lines = phrases.join(totals, "lang").withColumn("best", _cuts(k))
        lines = lines.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
        scored = lines if scored is None else scored.union(lines)
    if scored is None:
        return rows.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    scored = store(scored, "scored")
    discard(*frequent, totals)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salts = 1 + scored.count() // ranked
    # The best of each share first, so that no task orders all phrases of a language.
    share = F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("share")
    first = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    best = first.where(F.col("rank") <= top).drop("share", "rank")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_WORDS = ", ".join(f"lead(word, {j}) over piece as w{j}" for j in range(1, LONGEST))
_PHRASES = "\nunion all ".join(
    f"select lang, {k} as k, [word{''.join(f', w{j}' for j in range(1, k))}] as words, count(*) as a from o "
    + (f"where w{k - 1} is not null " if k > 1 else "")
    + f"group by lang, word{''.join(f', w{j}' for j in range(1, k))}"
    for k in range(1, LONGEST + 1)
)
ORACLE = f"""
with texts as (
  select row_number() over () as doc, coalesce(lang, '{UNKNOWN}') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (
  select doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece,
    generate_subscripts(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]'), 1) as part from texts),
words as (
  select doc, part, lang, unnest(found) as word, generate_subscripts(found, 1) as place
  from (select doc, part, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as found from pieces)),
o as materialized (select lang, word, {_WORDS} from words window piece as (partition by doc, part order by place)),
n as (select lang, count(*) as n from words group by lang),
f as materialized (select * from ({_PHRASES}) where a >= {SUPPORT}),
cuts as (
  select f.lang, f.k, f.words, f.a, n.n, l.a as l, r.a as r, cut,
    (1000 * f.a::hugeint * n.n::hugeint) // (l.a::hugeint * r.a::hugeint) as score
  from f join n using (lang), range(1, {LONGEST}) g(cut), f l, f r
  where f.k > 1 and cut < f.k and l.lang = f.lang and l.words = f.words[1:cut] and r.lang = f.lang and r.words = f.words[cut + 1:]),
best as (
  select * from cuts qualify row_number() over (partition by lang, words order by score, cut) = 1),
kept as (
  select * from best b where not exists (
    select 1 from f longer where longer.lang = b.lang and longer.k > b.k and 100 * longer.a >= {PERCENT} * b.a
      and contains(' ' || array_to_string(longer.words, ' ') || ' ', ' ' || array_to_string(b.words, ' ') || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(words, ' ')) as rank,
  array_to_string(words, ' ') as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept qualify rank <= {TOP}
"""
