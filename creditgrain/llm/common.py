"""What the operators share: table access, Arrow blocks, word and n-gram hashes.

Every operator selects the columns it needs first, so extra columns of any name
do no harm, and treats a NULL text as an empty one unless it says otherwise.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditgrain.session import store

BLOCK_BYTES = 1 << 21
ARROW_BYTES = 1 << 24


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may not have it; once for a session."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")  # the driver serves it
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, batch_bytes: int = ARROW_BYTES) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)  # long texts: fewer rows a batch
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone; a missing text is empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


FILE_ROWS = 40  # log2 of the rows that a file may have
LISTED_FILES = 100_000  # so many paths are broadcast


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row in a column ``name``, the same in every later job.

    A number by partition would change with the splits of the files, which follow the cores
    that Spark has when it plans a job. Rows of a table just read from parquet files are
    numbered by file (in the order of the paths) and place in it. Any other table is stored
    once with its numbers.
    """
    spark = docs.sparkSession
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return store(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    path, place = fresh(docs, "path"), fresh(docs, "place")
    meta = docs.metadataColumn("_metadata")
    placed = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(place))
    paths = sorted(r[0] for r in placed.select(path).distinct().collect())  # the driver has listed the files anyway
    first = spark.createDataFrame([(p, k << FILE_ROWS) for k, p in enumerate(paths)], f"`{path}` string, `{name}` long")
    if len(paths) <= LISTED_FILES:
        first = F.broadcast(first)
    return placed.join(first, path).select(*docs.columns, (F.col(name) + F.col(place)).alias(name))


def numbered_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` as in ``id_and_text`` and ``row``: the column ``row_col`` if named, else new numbers."""
    if row_col is None:
        row_col = fresh(docs, "row")
        plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
        docs = numbered(docs if plain else docs.select(id_col, text_col), row_col)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(row_col).alias("row")
    )


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_blocks(
    batches: Iterable[pa.RecordBatch], size: int = BLOCK_BYTES, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches holding about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        start = held = 0
        for i, length in enumerate(pc.binary_length(texts).to_pylist()):
            if held and held + length > size:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += length
        if start < len(texts):
            yield batch.slice(start), texts.slice(start).to_pylist()


def release() -> None:
    """Give back what a task's large arrays held: the worker's next task may be of another kind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


# ------------------------------------------------------------------ hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (one to one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draws(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = draws(256, 1)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            _powers[k] = np.cumprod(powers)
    return _powers


def word_spans(texts: list[bytes], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` in order, words per text, and where
    they start and end in the joined texts, which come last. Other ``breaks`` (by byte, the
    line feed among them) part words elsewhere."""
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined, np.uint8)
    space = breaks[buffer]
    turns = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = turns[::2], turns[1::2]
    powers, inverse = _power_tables(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * powers[: len(buffer)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)
    return hashes, np.diff(upto, prepend=0), starts, ends, joined


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and words per text of ``word_spans``."""
    return word_spans(texts)[:2]


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start up to its end."""
    powers, inverse = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; as many as there are positions with ``n`` words left."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for j in range(1, n):
        out *= _GRAM
        out += words[j : j + count]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingle hashes of each text, sorted, and the set sizes.

    A text with fewer words has its whole sequence as one shingle; one without
    words has none. Upper-case A-Z counts as lower case.
    """
    words, counts = word_hashes([t.lower() for t in texts])
    ends = np.cumsum(counts)
    full = gram_hashes(words, n)
    sets = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= n:
            sets.append(np.unique(full[end - count : end - n + 1]))
        elif count:
            sets.append(gram_hashes(words[end - count : end], count))
        else:
            sets.append(full[:0])
    return (np.concatenate(sets) if sets else full[:0]), np.array([len(s) for s in sets], np.int64)
