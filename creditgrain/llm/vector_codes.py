"""Compression of vectors to one code byte a part, with Orchard's search for the nearest entry.

Components become integers and vectors are cut into equal parts, each with a codebook of
at most 256 entries. Codebooks start as the parts of the vectors with the smallest ids; in
each round all parts are assigned to their nearest entry and every used entry becomes the
floored mean of its parts.

The nearest entry of a part is found as by Orchard: for every entry there is a list of all
entries by their distance from it. A search starts at some entry and walks its list. An
entry that is nearer to the part becomes the new best, and the search jumps to its list;
entries met before are marked and not measured again. It stops where the list passes twice
the best distance: by the triangle inequality nothing beyond can be nearer, or as near.
Integers make all of that exact, and ties go to the lower index. The searches of a block
of vectors run side by side, each in its own list at its own place.

Rounds exchange sums and counts by entry, never vectors, so a table of any size is read
once a round, and codebooks (at most 256 entries a part) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditgrain.session import store

from .common import table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096  # vectors searched side by side
LARGEST = 1 << 26  # of an integer component, so that no squared distance of 2,000 places passes 63 bits
SHARES = 32  # into which the vectors of a label are dealt for the join with its sum


class BadVector(ValueError):
    """A vector of another length than the rest, or with components too large to be exact."""


# ------------------------------------------------------------------ search


@dataclass
class Codebook:
    """Entries of one part with every entry's neighbours in order of distance."""

    entries: np.ndarray  # (entries, places)
    lists: np.ndarray  # (entries, entries): entry numbers, the nearest first, ties by number
    reach: np.ndarray  # (entries, entries): squared distances in that order
    line: np.ndarray  # sums of components, ascending
    by_line: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        apart = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        lists = np.argsort(apart, 1, kind="stable")
        sums = entries.sum(1)
        by_line = np.argsort(sums, kind="stable")
        return cls(entries, lists, np.take_along_axis(apart, lists, 1), sums[by_line], by_line)

    def start(self, parts: np.ndarray) -> np.ndarray:
        """An entry to start from: one whose sum of components is about the part's."""
        at = np.searchsorted(self.line, parts.sum(1))
        return self.by_line[np.minimum(at, len(self.line) - 1)]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part's nearest entry, and its squared distance."""
        n = len(parts)
        best = self.start(parts)
        least = ((parts - self.entries[best]) ** 2).sum(1)
        met = np.zeros((n, len(self.entries)), bool)
        met[np.arange(n), best] = True
        place = np.zeros(n, np.int64)
        going = np.arange(n)
        while len(going):
            here = best[going]
            # Where the list passes twice the best distance, the search is over.
            open_ = self.reach[here, place[going]] <= 4 * least[going]
            going, here = going[open_], here[open_]
            entry = self.lists[here, place[going]]
            place[going] += 1
            new = np.flatnonzero(~met[going, entry])
            who, entry = going[new], entry[new]
            met[who, entry] = True
            apart = parts[who] - self.entries[entry]
            apart = np.einsum("ij,ij->i", apart, apart)
            nearer = (apart < least[who]) | ((apart == least[who]) & (entry < best[who]))
            jump = who[nearer]
            best[jump], least[jump], place[jump] = entry[nearer], apart[nearer], 0
            going = going[place[going] < len(self.entries)]
        return best, least


# ------------------------------------------------------------------ vectors of a batch


def integers(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and their components as integers; they must be equally long."""
    lists = vectors.cast(pa.list_(pa.float64()))
    lengths = pc.list_value_length(lists).fill_null(-1).to_numpy()
    flat = lists.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    present = np.maximum(lengths, 0)
    row = np.repeat(np.arange(len(lengths)), present)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) > 0
    keep = (lengths >= 0) & ~bad
    width = lengths[keep][:1]
    if (lengths[keep] != width).any():
        raise BadVector(f"vectors of {np.unique(lengths[keep]).tolist()} components in one table")
    scaled = np.floor(values[keep[row]] * scale)
    if (np.abs(scaled) > LARGEST).any():
        raise BadVector(f"a component is beyond {LARGEST // scale} in size")
    return np.flatnonzero(keep), scaled.astype(np.int64).reshape(len(lengths[keep]), -1 if len(scaled) else 0)


def part_of(matrix: np.ndarray, k: int, parts: int) -> np.ndarray:
    width = matrix.shape[1] // parts
    return matrix[:, k * width : (k + 1) * width]


def check_width(width: int, wanted: int, parts: int) -> None:
    if width != wanted or width % parts:
        raise BadVector(f"a vector has {width} components; the first has {wanted}, to be cut into {parts} parts")


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The kept rows of each block with their integers."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            piece = batch.slice(at, BLOCK)
            rows, matrix = integers(piece.column("vector"), scale)
            if len(rows):
                check_width(matrix.shape[1], width, parts)
                yield piece.take(pa.array(rows)), matrix


def _firsts(scale: int, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch the kept vectors with the smallest ids."""
        for batch in batches:
            rows, matrix = integers(batch.column("vector"), scale)
            ids = batch.column("vec_id").take(pa.array(rows))
            order = np.lexsort((*matrix.T[::-1], pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))[:wanted]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(order)), pa.array(list(matrix[order]), pa.list_(pa.int64()))], ["vec_id", "values"]
            )

    return run


def _sums(shared, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each part and entry: how many parts were assigned to it, and their sums."""
        width, books = shared.value
        places = width // len(books)
        count = [np.zeros(len(b.entries), np.int64) for b in books]
        total = [np.zeros((len(b.entries), places), np.int64) for b in books]
        for _, matrix in _blocks(batches, scale, width, len(books)):
            for k, book in enumerate(books):
                part = part_of(matrix, k, len(books))
                entry, _ = book.nearest(part)
                order = np.argsort(entry, kind="stable")
                cuts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                count[k] += np.bincount(entry, minlength=len(book.entries))
                total[k][entry[order][cuts]] += np.add.reduceat(part[order], cuts, axis=0)
        for k in range(len(books)):
            used = np.flatnonzero(count[k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), k, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(count[k][used]),
                    pa.array(list(total[k][used]), pa.list_(pa.int64())),
                ],
                ["part", "entry", "n", "sums"],
            )

    return run


def _codes(shared, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, books = shared.value
        for batch, matrix in _blocks(batches, scale, width, len(books)):
            code = np.zeros((len(matrix), len(books)), np.uint8)
            error = np.zeros(len(matrix), np.int64)
            for k, book in enumerate(books):
                code[:, k], apart = book.nearest(part_of(matrix, k, len(books)))
                error += apart
            text = code.tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                    pa.array(error),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return run


# ------------------------------------------------------------------ on tables


def first_vectors(rows: DataFrame, entries: int, scale: int) -> np.ndarray:
    """The integers of the kept vectors with the smallest ids (NULL last, then by components)."""
    least = (
        rows.select("vec_id", "vector")
        .mapInArrow(_firsts(scale, entries), "vec_id long, values array<long>")
        .orderBy(F.col("vec_id").asc_nulls_last(), "values")
        .limit(entries)
        .collect()  # at most ``entries``
    )
    if len({len(r["values"]) for r in least}) > 1:
        raise BadVector("the first vectors differ in length")
    return np.array([r["values"] for r in least], np.int64).reshape(len(least), -1 if least else 0)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` rounds over all vectors."""
    context = rows.sparkSession.sparkContext
    first = first_vectors(rows, entries, scale)
    check_width(first.shape[1], first.shape[1], parts)
    books = [part_of(first, k, parts) for k in range(parts)]
    places = first.shape[1] // parts
    for _ in range(rounds if len(first) else 0):
        shared = context.broadcast((first.shape[1], [Codebook.of(b) for b in books]))
        sums = (
            rows.select("vector")
            .mapInArrow(_sums(shared, scale), "part int, entry int, n long, sums array<long>")
            .groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(places)])
        )
        books = [b.copy() for b in books]
        for r in sums.collect():  # at most a row an entry
            books[r.part][r.entry] = [r[f"s{j}"] // r.n for j in range(places)]
        shared.unpersist()
    return books


def decode(codes: list[str], books: list[np.ndarray]) -> np.ndarray:
    """The integers that codes stand for."""
    numbers = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(-1, len(books))
    return np.concatenate([book[numbers[:, k]] for k, book in enumerate(books)], 1)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept vector; and the codebooks.

    Vectors that are NULL or hold a NULL, NaN or infinite component are left out. Repeated
    ids are vectors of their own, NULL ids come last. ``label_error`` is the sum of errors over
    equal labels, NULL labels together. An empty table has no codebooks and gives no rows.
    Kept vectors of different lengths, of a length that ``parts`` doesn't divide, or with
    components beyond ``LARGEST / scale`` raise ``BadVector``. ``entries`` is at most 256.
    The table is read once for the first vectors, once a round and once for the codes, so it
    has to give the same rows each time.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")
    )
    context = rows.sparkSession.sparkContext
    books = train(rows, parts, entries, rounds, scale)
    if not len(books[0]):
        empty = T.StructType().add("vec_id", "long").add("label", rows.schema["label"].dataType)
        for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string")):
            empty = empty.add(name, kind)
        return rows.sparkSession.createDataFrame([], empty), books
    shared = context.broadcast((sum(b.shape[1] for b in books), [Codebook.of(b) for b in books]))
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = store(rows.mapInArrow(_codes(shared, scale), schema), "codes")
    # A label with a third of all rows is joined in shares, each with the label's sum.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    dealt = coded.withColumn("share_", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SHARES)).cast("int"))
    joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("share_") == F.col("share")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))[0].drop("label")


def _oracle() -> str:
    """The same by comparing every part with every entry."""

    def nearest(k: int) -> str:
        return f"""
select key, part, v, arg_min(e, d) as e, min(d) as d from (
  select key, p.part, p.v, c.e as e, list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint * 256 + c.e as d
  from parts p join book{k} c using (part)) group by key, part, v"""

    steps = [
        f"""whole as (
  select vec_id, label, list_transform(embedding, lambda x: floor(x::double * {SCALE})::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        "kept as materialized (select row_number() over (order by vec_id, v) as key, * from whole)",
        f"""parts as materialized (
  select key, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] as v from kept, range({PARTS}) g(part))""",
        f"book0 as materialized (select part, key - 1 as e, v from parts where key <= {ENTRIES})",
    ]
    for k in range(ROUNDS):
        steps.append(f"found{k} as materialized ({nearest(k)})")
        steps.append(f"""means{k} as materialized (
  select part, e, list(m order by place) as v from (
    select part, e, place, floor(sum(v[place]) / count(*))::bigint as m
    from found{k}, range(1, 1 + (select max(len(v)) from parts)) g(place) group by part, e, place) group by part, e)""")
        steps.append(f"book{k + 1} as materialized (select part, e, coalesce(m.v, b.v) as v from book{k} b left join means{k} m using (part, e))")
    steps.append(f"found{ROUNDS} as materialized ({nearest(ROUNDS)})")
    steps.append(f"""coded as (
  select key, string_agg(printf('%02x', e), '' order by part) as code, sum((d - e) // 256)::bigint as error from found{ROUNDS} group by key)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(v, ','), ',' order by part, e)) from book{ROUNDS}) as codebooks_sha256
from kept join coded using (key)"""


ORACLE = _oracle()
