"""Exact dedup over an extendible-hash index kept in shared files.

The directory maps the leading bits of a 64-bit text hash to buckets. It starts
as one bucket; a bucket that holds more than ``capacity`` rows is split on its
next bit, doubling the directory whenever a split goes deeper than it. Buckets
are key ranges: every bucket belongs to one task, which reads its entries in key
order, chains the different texts of a key and tells them apart by their bytes.

Copies are pre-aggregated before the shuffle (one entry for each text among
``HELD_BYTES`` of different ones), so a group with a third of all rows reaches its
owner as a few entries. The directory is built from at most ``2**max_depth`` counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditgrain.session import store

from .common import fresh, numbered, numbered_texts, release, table, text_blocks

CAPACITY = 2048
MAX_DEPTH = 16
HELD_BYTES = 1 << 22  # of different texts among which a task looks for copies
ENTRY = pa.schema(
    [
        ("bucket", pa.int32()),
        ("key", pa.int64()),
        ("body", pa.binary()),
        ("best_id", pa.int64()),
        ("best_row", pa.int64()),
        ("size", pa.int64()),
    ]
)
SLOT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("key", pa.int64()),
        ("chain", pa.int32()),
        ("sha", pa.string()),
        ("keep_id", pa.int64()),
        ("keep_row", pa.int64()),
        ("group_size", pa.int64()),
    ]
)


def directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> np.ndarray:
    """Bucket number of each hash prefix; the length is a power of two.

    ``counts`` has the rows of each prefix of ``max_depth`` bits. A bucket at
    full depth stays whole however full it is: its entries are streamed.
    """
    cells = np.zeros(1 << max_depth, np.int64)
    for prefix, n in counts.items():
        cells[prefix] = n
    sums = np.concatenate([[0], np.cumsum(cells)])
    depth, local = 0, [(0, 0)]  # (depth of the bucket, its prefix)
    done = []
    while local:
        bits, prefix = local.pop()
        low, high = prefix << (max_depth - bits), (prefix + 1) << (max_depth - bits)
        if sums[high] - sums[low] > capacity and bits < max_depth:
            depth = max(depth, bits + 1)
            local += [(bits + 1, 2 * prefix + 1), (bits + 1, 2 * prefix)]
        else:
            done.append((bits, prefix))
    slots = np.zeros(1 << depth, np.int32)
    for number, (bits, prefix) in enumerate(done):
        slots[prefix << (depth - bits) : (prefix + 1) << (depth - bits)] = number
    return slots


def _entries(slots: np.ndarray):
    shift = np.uint64(64 - max(1, int(len(slots)).bit_length() - 1))
    whole = len(slots) == 1

    def entries(found: dict[bytes, list]) -> pa.RecordBatch:
        values = list(found.values())
        key = np.array([v[0] for v in values], np.int64)
        bucket = np.zeros(len(key), np.int32) if whole else slots[(key.view(np.uint64) >> shift).astype(np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket),
                pa.array(key),
                pa.array(list(found), pa.binary()),
                pa.array([v[1] for v in values], pa.int64()),
                pa.array([v[2] for v in values], pa.int64()),
                pa.array([v[3] for v in values], pa.int64()),
            ],
            schema=ENTRY,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        held_bytes = 0
        for batch, texts in text_blocks(batches):
            keys = batch.column("key").to_pylist()
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for text, key, doc_id, row in zip(texts, keys, ids, rows, strict=True):
                held = found.get(text)
                if held is None:
                    found[text] = [key, doc_id, row, 1]
                    held_bytes += len(text)
                    continue
                held[3] += 1
                if _later(doc_id, row, held[1], held[2]):
                    held[1:3] = doc_id, row
            if held_bytes > HELD_BYTES:
                yield entries(found)
                found, held_bytes = {}, 0
        yield entries(found)
        release()

    return run


def _later(doc_id, row, than_id, than_row) -> bool:
    """Order of the rows of a group: NULL ids first, then by id; rows of one id as they are stored."""
    left = (doc_id is not None, doc_id or 0, row)
    return left > (than_id is not None, than_id or 0, than_row)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Build the buckets of one owner from entries in (bucket, key) order."""

    def finish(chain: dict[bytes, list], at: tuple) -> list[tuple]:
        return [
            (*at, k, hashlib.sha256(body).hexdigest(), *held)
            for k, (body, held) in enumerate(chain.items())
        ]

    at, chain, out = None, {}, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(len(ENTRY))]
        for bucket, key, body, best_id, best_row, size in zip(*columns, strict=True):
            if (bucket, key) != at:
                if at is not None:
                    out += finish(chain, at)
                at, chain = (bucket, key), {}
            held = chain.get(body)  # the bytes are compared, not only the key
            if held is None:
                chain[body] = [best_id, best_row, size]
                continue
            held[2] += size
            if _later(best_id, best_row, held[0], held[1]):
                held[:2] = best_id, best_row
        yield _slots(out)
        out = []
    if at is not None:
        yield _slots(finish(chain, at))
    release()


def _slots(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(SLOT)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, SLOT, strict=True)], schema=SLOT
    )


def build_index(keyed: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index as a stored table: a row for each different text.

    ``keyed`` has doc_id, text, key and row. Columns: bucket, key, chain (place
    among the texts with that key), sha, keep_id, keep_row, group_size.
    """
    prefix = F.shiftrightunsigned("key", 64 - max_depth)
    counts = {r[0]: r[1] for r in keyed.groupBy(prefix.alias("p")).count().collect()}
    slots = directory(counts, capacity, max_depth)
    entries = keyed.mapInArrow(
        _entries(slots), "bucket int, key bigint, body binary, best_id bigint, best_row bigint, size bigint"
    )
    owned = (
        entries.repartition("bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(
            _own,
            "bucket int, key bigint, chain int, sha string, keep_id bigint, keep_row bigint, group_size bigint",
        )
    )
    return store(owned, "hash-index")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
    row_col: str | None = None,
) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, row
    (its number: that of ``row_col``, or as ``common.numbered`` gives it).

    Texts are equal when their bytes are. NULL texts are empty ones. The row with
    the largest id stays; of repeated rows with that id one stays (the last
    stored). A NULL id is smaller than any other. Empty tables give no rows.
    """
    rows = numbered_texts(docs, id_col, text_col, row_col)
    keyed = rows.withColumn("key", F.xxhash64("text"))
    index = build_index(keyed, capacity, max_depth)
    found = keyed.select("doc_id", "row", "key", F.sha2("text", 256).alias("sha"))
    return found.join(index.drop("chain"), ["key", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "row",
    )


def one_of_each_text(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_dedup`` keeps."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    kept = exact_dedup(rows, row_col=row).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket", "row")


ORACLE = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
