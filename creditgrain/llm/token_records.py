"""Token ids in length-delimited binary records, with a separate offset index.

A record is: its payload's length (unsigned 64-bit, little endian), the masked
CRC-32 of those eight bytes (unsigned 32-bit), the payload, the masked CRC-32 of
the payload. The payload is the document's id (signed 64-bit), the bytes of a
token (one byte: 2 or 4) and the ids, little endian. Masking rotates a checksum
right by 15 bits and adds 0xA282EAD8.

The index file of a record file has two unsigned 64-bit integers for each record:
its offset and its length in bytes, so any order of reads can seek.

Files are written under names of their own; the manifest, built from the results
of the tasks that count, says which of them hold data. Files of lost or repeated
tasks are never read.
"""

from __future__ import annotations

import string
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditgrain.session import new_shared_path, store

from .common import id_and_text, release, table, text_blocks

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHED_BYTES = 1 << 27  # of words and their ids, about, that a worker remembers before it starts anew
ENTRY_BYTES = 200  # of a word besides its text and ids
TOGETHER = 20_000  # words encoded as one text, or in one call
TEXT_BYTES = 1 << 22  # a batch that an executor hands to Python; it is held several times over there
MARKS = string.punctuation.encode()
HEAD = struct.Struct("<QI")
START = struct.Struct("<?qB")  # the id is missing, the id, bytes of a token
MANIFEST = "part long, first_id long, path string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    """CRC-32 of the bytes, rotated right by 15 bits and shifted by a constant."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


# ------------------------------------------------------------------ encoding


class _Words(dict):
    """Ids of a word as packed integers; words already met aren't encoded again.

    The vocabulary drops white space before any merge, so a text's ids are those
    of its words one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

        kinds = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(kinds.values()) + 1, bool)
        self.ends_word[[i for token, i in kinds.items() if token.endswith("</w>")]] = True

    def learn(self, words: Iterable[bytes]) -> list[bytes]:
        """Ids of the words; those that aren't known yet are encoded.

        A word of letters is one run of merges and ends with the one token that ends
        a word, so such words are encoded together; ASCII marks after it are a run of their own.
        """
        words = list(words)
        had = len(self)
        known = [*map(self.get, words)]
        missing = [k for k, ids in enumerate(known) if ids is None]
        new = [words[k] for k in missing]
        bodies = [w.rstrip(MARKS) for w in new]
        plain = [b.decode("utf-8", "replace").isalpha() for b in bodies]
        letters = list({b for b, alone in zip(bodies, plain, strict=True) if alone and b not in self})
        if letters:
            joined = [b" ".join(letters[k : k + TOGETHER]).decode() for k in range(0, len(letters), TOGETHER)]
            found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.concatenate([np.array(part.ids, self.kind) for part in found])
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(letters):
                data, width = ids.tobytes(), ids.itemsize
                bounds = [0, *(cuts * width).tolist()]
                self.update(zip(letters, [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))
        rest = []
        for k, word, body, alone in zip(missing, new, bodies, plain, strict=True):
            ids = self.get(body) if alone else None
            if ids is None:
                rest.append(k)
                continue
            if len(body) < len(word):
                run = word[len(body) :]
                if run not in self:
                    self[run] = self.one_by_one([run])[0]
                ids = self[word] = ids + self[run]
            known[k] = ids
        for k, ids in zip(rest, self.one_by_one([words[k] for k in rest]), strict=True):
            known[k] = self[words[k]] = ids
        self.held += ENTRY_BYTES * (len(self) - had) + sum(len(words[k]) + len(known[k]) for k in missing)
        return known

    def one_by_one(self, words: list[bytes]) -> list[bytes]:
        out = []
        for k in range(0, len(words), TOGETHER):  # what the tokenizer tells of a word is far larger than its ids
            texts = [w.decode("utf-8", "replace") for w in words[k : k + TOGETHER]]
            out += [np.array(found.ids, self.kind).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def forget(self) -> None:
        self.clear()
        self.held = 0


_loaded: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path]


def encode(texts: list[bytes], path: str, end_id: int = END_ID) -> tuple[list[bytes], str]:
    """Packed ids of each text with the end id, and their type.

    Texts that hold one of the vocabulary's added tokens, which are looked for before
    words are, are encoded whole.
    """
    memo = _words(path)
    lower = [t.lower() for t in texts]  # the vocabulary is of lower case
    whole = [k for k, t in enumerate(lower) if any(token in t for token in memo.added)]
    for k in whole:
        lower[k] = b""
    lower = pa.array(lower, pa.binary()).view(pa.string())
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().view(pa.binary()).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if memo.held > CACHED_BYTES:
        memo.forget()
    memo[b""] = b""  # before and after white space at the ends of a text
    # Ids of each distinct word, and of the end, one after the other; then those of the texts.
    width = np.dtype(memo.kind).itemsize
    known = [*memo.learn(words), np.array([end_id], memo.kind).tobytes()]
    lengths = np.fromiter(map(len, known), np.int64, len(known)) // width
    first = np.cumsum(lengths) - lengths
    bounds = split.offsets.to_numpy()
    order = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:] - bounds[0], len(words))
    sizes = lengths[order]
    upto = np.cumsum(sizes)
    places = np.repeat(first[order] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
    data = np.frombuffer(b"".join(known), memo.kind)[places].tobytes()
    ends = (upto[order == len(words)] * width).tolist()
    packed = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    if whole:
        for k, ids in zip(whole, memo.one_by_one([texts[k] for k in whole]), strict=True):
            packed[k] = ids + packed[k]
    return packed, memo.kind


# ------------------------------------------------------------------ writing


def frames(ids: list, packed: list[bytes], width: int) -> list[bytes]:
    """A record for each document."""
    bodies = [START.pack(i is None, i or 0, width) + p for i, p in zip(ids, packed, strict=True)]
    lengths = [struct.pack("<Q", len(b)) for b in bodies]
    return [
        b"".join([n, struct.pack("<I", masked(n)), b, struct.pack("<I", masked(b))])
        for n, b in zip(lengths, bodies, strict=True)
    ]


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        at = records = tokens = 0
        first = None
        with system.open_output_stream(f"{name}.rec") as out, system.open_output_stream(f"{name}.idx") as index:
            for batch, texts in text_blocks(batches):
                packed, kind = encode(texts, tokenizer, end_id)
                width = np.dtype(kind).itemsize
                ids = batch.column("doc_id").to_pylist()
                framed = frames(ids, packed, width)
                sizes = np.array([len(f) for f in framed], np.int64)
                ends = at + np.cumsum(sizes)
                out.write(b"".join(framed))
                index.write(np.column_stack([ends - sizes, sizes]).astype("<u8").tobytes())
                at = int(ends[-1])
                records += len(ids)
                tokens += sum(map(len, packed)) // width
                if first is None and any(i is not None for i in ids):
                    first = next(i for i in ids if i is not None)
        release()
        if records:
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "first_id": pa.array([first], pa.int64()), "path": [f"{name}.rec"], "records": [records], "tokens": [tokens], "bytes": [at]}
            )

    return run


def write_records(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the documents in ascending id order; returns the manifest.

    The manifest has a row for each file: part, first_id, path, records, tokens,
    bytes and ``start``, the ids in all files before it. NULL ids come first and
    rows of one id stand in the order of their texts. ``folder`` must be shared by
    all executors. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_shared_path(spark, "token-records")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = id_and_text(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = (
        rows.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write(folder, tokenizer or public_tokenizers.path(VOCABULARY), end_id), MANIFEST)
    )
    manifest = store(written, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


# ------------------------------------------------------------------ reading


class BrokenRecord(ValueError):
    pass


def parse_frames(data: bytes, index: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """Ids and token ids of the frames that start at ``index[:, 0]``; checks every checksum."""
    bodies = []
    for at, size in index.tolist():
        length, check = HEAD.unpack_from(data, at)
        body = data[at + HEAD.size : at + size - 4]
        if check != masked(data[at : at + 8]) or length != len(body):
            raise BrokenRecord(f"record at {at}: wrong length")
        if int.from_bytes(data[at + size - 4 : at + size], "little") != masked(body):
            raise BrokenRecord(f"record at {at}: wrong checksum")
        bodies.append(body)
    ids, tokens = [], []
    for body in bodies:
        missing, doc_id, width = START.unpack_from(body)
        ids.append(None if missing else doc_id)
        tokens.append(np.frombuffer(body, f"<u{width}", offset=START.size))
    return ids, tokens


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_stream(name[:-4] + ".idx") as stream:
                index = np.frombuffer(stream.read(), "<u8").reshape(-1, 2).astype(np.int64)
            with system.open_input_file(name) as stream:
                k = 0
                while k < len(index):
                    stop = max(k + 1, int(np.searchsorted(index[:, 0], index[k, 0] + (1 << 22))))
                    base, size = int(index[k, 0]), int(index[stop - 1].sum())
                    data = stream.read_at(size - base, base)
                    shifted = index[k:stop] - np.array([base, 0])
                    ids, tokens = parse_frames(data, shifted)
                    counts = np.array([len(t) for t in tokens], np.int64)
                    starts = start + np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, pa.int64()),
                            pa.array(starts),
                            pa.array(counts),
                            pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(counts.sum())
                    k = stop
    release()


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record in the files of a manifest."""
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select(
        F.when(F.col("path").startswith("/"), F.concat(F.lit("file://"), "path")).otherwise(F.col("path")).alias("uri"), "start"
    )
    return files.repartition(parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(table(spark, sf_dir, "documents", TEXT_BYTES)))
