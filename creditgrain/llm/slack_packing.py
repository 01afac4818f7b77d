"""Packing of token sequences by minimum bin slack.

Documents become pieces of at most ``SIZE`` tokens: only longer ones are cut. How
many pieces there are of each length is all that the packing needs to know, at most
``SIZE`` numbers however large the corpus, so it is planned on the driver:

For each bin the largest length left is put in, and subset sums of what is left are
kept as bits of an integer, one shift for each length and power of two of its count,
until the bin's room is among them or all lengths are in. The fullest sum is traced
back to a combination of lengths. It is removed as often as the counts allow, so a
corpus of a billion pieces needs as many steps as one of some thousands.

The plan is a small table: for each length, which bins take how many of it and at
which offset. Pieces of a length are numbered without gathering them: in blocks of
hashed ids, each starting after the exact counts of the blocks before. A piece's
number and length then say its bin and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditgrain.session import store

from .common import column, id_and_text, release, table, text_blocks
from .token_records import TEXT_BYTES, VOCABULARY, encode

SIZE = 2048
END_ID = 0
BLOCK_ROWS = 200_000  # pieces numbered by one task at a time


# ------------------------------------------------------------------ the plan


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length, by subset sums, so that the sum is as near to ``room``
    from below as any can be. Lengths are tried from the longest."""
    reached, mask = 1, (1 << (room + 1)) - 1
    steps = []  # (length, copies, sums reached before them)
    for length in sorted((n for n in counts if 0 < n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reached))
            reached |= (reached << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + copies
            total -= length * copies
    return chosen


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths with how often each bin takes them), by minimum bin slack.

    ``counts`` has the pieces of each length from 1 to ``size``. Every step uses up a
    length or leaves fewer of it than a bin takes, so there are some thousand steps at most.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        chosen = fullest(left, size - first)
        left[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        bins = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        out.append((bins, chosen))
    return out


def places(planned: list[tuple[int, dict[int, int]]], size: int = SIZE) -> dict[str, np.ndarray]:
    """The plan by length: entries sorted by ``from``, which is (length, number of the
    length's first piece that goes here) as one integer; the rest says where to."""
    rows, first_bin, taken = [], 0, dict.fromkeys(range(size + 1), 0)
    for bins, chosen in planned:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.append((length, taken[length], first_bin, chosen[length], offset))
            taken[length] += bins * chosen[length]
            offset += length * chosen[length]
        first_bin += bins
    rows.sort()
    length, number, bin_, each, offset = np.array(rows, np.int64).reshape(-1, 5).T
    return {"from": (length << 48) + number, "number": number, "bin": bin_, "each": each, "offset": offset}


# ------------------------------------------------------------------ on tables


def _pieces(tokenizer: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            packed, kind = encode(texts, tokenizer, end_id)
            owner, piece, start, length, crc = [], [], [], [], []
            for k, data in enumerate(packed):
                ids = np.frombuffer(data, kind).astype("<u4")
                for number, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    owner.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release()

    return run


def cut_pieces(
    docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _pieces(path, end_id, size), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            number = column(batch, "number")
            at = np.searchsorted(known["from"], (column(batch, "length") << 48) + number, side="right") - 1
            beyond = number - known["number"][at]
            each = known["each"][at]
            offset = known["offset"][at] + beyond % each * column(batch, "length")
            columns = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"]).columns
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(known["bin"][at] + beyond // each), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, size: int = SIZE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``pieces`` has doc_id, piece, start, length (1 to ``size``) and ids_crc32 and is stored,
    as several jobs read it. Sequences are numbered from 0; a sequence's pieces fill it from
    0 without gaps. Equal lengths are dealt in an order of hashed ids. NULL and repeated ids
    are pieces like others; no pieces give no sequences.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    blocks = 1 << max(0, (total // block_rows).bit_length())
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int").alias("block")
    # counted once, for the plan and for the places: a row a length and block
    cells = store(pieces.groupBy("length", block).agg(F.count(F.lit(1)).alias("n")), "cells")
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size``
    shared = spark.sparkContext.broadcast(places(plan(counts, size), size))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # of one row a block
    starts = cells.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (
        pieces.withColumn("block", block)
        .withColumn("place", F.row_number().over(inside))
        .join(starts, ["length", "block"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place") - 1).alias("number"))
    )
    return numbered.mapInArrow(
        _placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL text is an empty one, whose piece is the end id alone. NULL and repeated ids
    are documents of their own. An empty table gives no rows; other columns don't matter.
    """
    return pack(store(cut_pieces(docs, size, tokenizer, end_id), "pieces"), size)


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", TEXT_BYTES))
