"""Language-model scores by logistic mixing of hashed-context bit predictors.

A byte is coded as eight binary decisions. For each, one predictor per context
(the last 0 to 5 bytes, and the bytes of the present word) looks up how often the
bit was 0 and 1 there: counts in a hash table of a fixed size, addressed by context
and by the bits of the byte so far. The predictors' log odds are added with weights
that a gate selects (longest context seen before, bits so far), learned online by
gradient steps; the mixed probability is then refined by an adaptive map from (bits
so far, its log odds) to the share of ones observed there. A text's score is the sum
of the log10 probabilities of all bits of its bytes and of an end mark.

Everything is learned from all training documents. What is learned depends on a
byte and the five before it only, so the corpus is first counted by such windows;
tables, weights and map are learned from the counted windows, a window's own
occurrence left out.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditgrain.session import store

from .common import column, crc_fold, id_and_text, mix, table, text_blocks, word_hashes

ORDER = 5  # bytes of context
CONTEXTS = ORDER + 2
SLOT_BITS = 20  # slots of a predictor
BINS = 33  # of the adaptive map, by log odds from -8 to 8
COMMON = 2e-6  # at most 1 / COMMON words are this frequent: those are broadcast
END_WORD = np.uint64(0x5851F42D4C957F2D)
BLOCK = 6 << 20
TASKS = 12  # whose weights are averaged
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xC2B2AE3D27D4EB4F)
_LOG = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts and their end marks: the byte and the five before it, as one number.

    Also how many there are of each text.
    """
    stream = np.frombuffer(b"".join(bytes(ORDER) + t + b"\xff" for t in texts), np.uint8)
    out = np.zeros(len(stream) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        out <<= np.uint64(8)
        out |= stream[j : len(out) + j]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    own = np.ones(len(out) + ORDER, bool)
    starts = np.cumsum(sizes + ORDER) - sizes  # where each text's first byte stands
    for j in range(1, ORDER + 1):
        own[starts - j] = False
    return out[own[ORDER:]], sizes


def contexts(windows: np.ndarray) -> list[np.ndarray]:
    """A 64-bit hash of each predictor's context."""
    past = windows >> np.uint64(8)
    found = [np.zeros(len(past), np.uint64)]
    found += [past & np.uint64((1 << (8 * k)) - 1) for k in range(1, ORDER + 1)]
    word, inside = np.zeros(len(past), np.uint64), np.ones(len(past), bool)
    for j in range(ORDER):
        byte = (past >> np.uint64(8 * j)) & np.uint64(255)
        inside &= byte > 32
        word |= np.where(inside, byte << np.uint64(8 * j), np.uint64(0))
    return [mix(c + np.uint64(k << 56)) for k, c in enumerate([*found, word])]


def bits_of(windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of the byte, the highest first: (bits so far with a leading 1, the bit)."""
    byte = (windows & np.uint64(255)).astype(np.int64)
    for k in range(8):
        yield (byte | 256) >> (8 - k), (byte >> (7 - k)) & 1


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return ((context + node.astype(np.uint64) * _NODE) * _MULTIPLY >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class MixedModel:
    """Counts (zeros in the upper 16 bits, ones in the lower), gated weights, adaptive map."""

    counts: np.ndarray  # CONTEXTS x slots, uint32
    weights: np.ndarray  # gates x inputs
    refine: np.ndarray | None = None  # 256 x BINS: log odds

    @staticmethod
    def start(counts: np.ndarray) -> MixedModel:
        return MixedModel(counts, np.full(((CONTEXTS + 1) * 256, CONTEXTS + 1), 0.3, np.float32))

    def inputs(self, hashed: list[np.ndarray], node: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The predictors' log odds and the gate. With ``bit``, one occurrence of it is left out."""
        x = np.ones((len(node), CONTEXTS + 1), np.float32)
        seen = np.zeros(len(node), np.int64)
        for k, context in enumerate(hashed):
            packed = self.counts[k][slots(context, node)]
            zeros, ones = (packed >> 16).astype(np.int64), (packed & 0xFFFF).astype(np.int64)
            if bit is not None:
                zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
            x[:, k] = _LOG[ones] - _LOG[zeros]
            seen += (zeros + ones) > 0
        return x, seen * 256 + node

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -8, 8)

    def log_odds(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        mixed = self.mixed(x, gate)
        if self.refine is None:
            return mixed
        place = (mixed + 8) * ((BINS - 1) / 16)
        low = np.minimum(place.astype(np.int64), BINS - 2)
        part = place - low
        refined = self.refine[node, low] * (1 - part) + self.refine[node, low + 1] * part
        return (mixed + refined) / 2

    def learn(self, windows: np.ndarray, counts: np.ndarray, batch: int = 2048, rate: float = 0.02) -> None:
        """Online: a gradient step of the gated weights after every batch of windows and bit."""
        for k in range(0, len(windows), batch):
            part = windows[k : k + batch]
            hashed, weight = contexts(part), np.minimum(counts[k : k + batch], 255).astype(np.float32)
            for node, bit in bits_of(part):
                x, gate = self.inputs(hashed, node, bit)
                error = (bit - 1 / (1 + np.exp(-self.mixed(x, gate)))) * weight
                total = np.bincount(gate, weight, len(self.weights)).astype(np.float32)
                used = np.flatnonzero(total)
                order = np.argsort(gate, kind="stable")
                cuts = np.searchsorted(gate[order], used)
                step = np.add.reduceat((error[:, None] * x)[order], cuts, axis=0) / total[used][:, None]
                self.weights[used] += rate * step

    def observe(self, windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For the adaptive map: weighted (all, ones) by bits so far and nearest bin of the log odds."""
        out = np.zeros((2, 256 * BINS))
        hashed = contexts(windows)
        for node, bit in bits_of(windows):
            x, gate = self.inputs(hashed, node, bit)
            cell = node * BINS + np.rint((self.mixed(x, gate) + 8) * ((BINS - 1) / 16)).astype(np.int64)
            out[0] += np.bincount(cell, counts, out.shape[1])
            out[1] += np.bincount(cell, counts * bit, out.shape[1])
        return out

    def set_map(self, observed: np.ndarray) -> None:
        """Observed shares, drawn towards no change by a weight of 8 occurrences."""
        every, ones = observed.reshape(2, 256, BINS)
        unchanged = 1 / (1 + np.exp(-np.linspace(-8, 8, BINS)))
        share = (ones + 8 * unchanged) / (every + 8)
        self.refine = np.log(share / (1 - share)).astype(np.float32)

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """The cost of each window's byte in bits."""
        out = np.zeros(len(windows))
        for k in range(0, len(windows), 1 << 15):
            part = windows[k : k + (1 << 15)]
            hashed = contexts(part)
            for node, bit in bits_of(part):
                x, gate = self.inputs(hashed, node, None)
                odds = self.log_odds(x, gate, node)
                out[k : k + len(part)] += np.logaddexp(0, np.where(bit == 1, -odds, odds))
        return out / np.log(2)


def packed_up(value: object) -> bytes:
    """Compressed: most slots of a small corpus are empty."""
    return zlib.compress(pickle.dumps(value), 1)


def unpacked(data: bytes) -> object:
    return pickle.loads(zlib.decompress(data))


# ------------------------------------------------------------------ counting


def _tally(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values, np.bincount(codes, minlength=len(values))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and windows (kind 1) of each block of training texts."""
    for _, texts in text_blocks(batches, BLOCK):
        lower = [t.lower() for t in texts]
        words, _ = word_hashes(lower)
        found = [_tally(*pd.factorize(words)), _tally(*pd.factorize(windows_of(lower)[0]))]
        found[0] = (np.append(found[0][0], END_WORD), np.append(found[0][1], len(texts)))
        for kind, (keys, n) in enumerate(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                ["kind", "key", "n"],
            )


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zeros and ones in each slot, from counted windows."""
    size = 1 << SLOT_BITS
    zeros, ones = np.zeros((CONTEXTS, size)), np.zeros((CONTEXTS, size))
    for batch in batches:
        windows, n = column(batch, "key").view(np.uint64), column(batch, "n").astype(np.float64)
        hashed = contexts(windows)
        for node, bit in bits_of(windows):
            for k, context in enumerate(hashed):
                at = slots(context, node)
                np.add.at(zeros[k], at, n * (1 - bit))
                np.add.at(ones[k], at, n * bit)
    for k in range(CONTEXTS):
        used = np.flatnonzero(zeros[k] + ones[k])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((used + k * size).astype(np.int32)),
                pa.array(zeros[k][used].astype(np.int64)),
                pa.array(ones[k][used].astype(np.int64)),
            ],
            ["slot", "zeros", "ones"],
        )


def _weights(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = MixedModel.start(unpacked(model.value).counts), 0
        for batch in batches:
            n = column(batch, "n")
            mine.learn(column(batch, "key").view(np.uint64), n)
            seen += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([seen], pa.int64()), pa.array([mine.weights.tobytes()])], ["seen", "weights"]
        )

    return run


def _observations(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = unpacked(model.value)
        total = np.zeros((2, 256 * BINS))
        for batch in batches:
            total += mine.observe(column(batch, "key").view(np.uint64), column(batch, "n"))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["cells"])

    return run


def fit_mixing(windows: DataFrame) -> MixedModel:
    """Tables, weights and map from counted windows (key, n).

    Brought to the driver: the slots in use, at most CONTEXTS * 2**SLOT_BITS, and
    two small arrays from each of a bounded number of tasks.
    """
    context = windows.sparkSession.sparkContext
    sums = (
        windows.mapInArrow(_tables, "slot int, zeros long, ones long")
        .groupBy("slot")
        .agg(F.sum("zeros").alias("a"), F.sum("ones").alias("b"))
    )
    scale = F.least(F.lit(1.0), F.lit(65535.0) / F.greatest("a", "b"))  # counters have 16 bits
    packed = sums.select("slot", (F.ceil(F.col("a") * scale) * 65536 + F.ceil(F.col("b") * scale)).alias("v"))
    flat = np.zeros(CONTEXTS << SLOT_BITS, np.uint32)
    cells = packed.select("slot", F.when(F.col("v") >= 2**31, F.col("v") - 2**32).otherwise(F.col("v")).cast("int").alias("v"))
    for batch in cells.toArrow().to_batches():
        flat[column(batch, "slot")] = column(batch, "v").view(np.uint32)
    model = MixedModel.start(flat.reshape(CONTEXTS, -1))
    spread = windows.repartition(TASKS, "key")
    shared = context.broadcast(packed_up(model))
    found = spread.mapInArrow(_weights(shared), "seen long, weights binary").collect()
    shared.destroy()
    total = sum(r.seen for r in found)
    if total:
        model.weights = sum(
            np.frombuffer(r.weights, np.float32).reshape(model.weights.shape) * np.float32(r.seen / total) for r in found
        )
    shared = context.broadcast(packed_up(model))
    found = spread.mapInArrow(_observations(shared), "cells binary").collect()
    shared.destroy()
    model.set_map(sum((np.frombuffer(r.cells) for r in found), np.zeros(2 * 256 * BINS)))
    return model


# ------------------------------------------------------------------ scoring


def _score(shared, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common, common_n = unpacked(shared.value)
        for batch, texts in text_blocks(batches, BLOCK):
            lower = [t.lower() for t in texts]
            codes, values = pd.factorize(windows_of(lower)[0])
            cost = model.bits(values)[codes]
            sizes = np.array([len(t) + 1 for t in texts])
            bits = np.add.reduceat(cost, np.cumsum(sizes) - sizes)
            words, counts = word_hashes(lower)
            owner = np.repeat(np.arange(len(texts)), counts)
            codes, values = pd.factorize(words)
            place = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
            hit = common[place] == values if len(common) else np.zeros(len(values), bool)
            logs = np.where(hit, np.log10((common_n[place] if len(common) else place) + 1.0), 0.0)
            rows = column(batch, "row")
            known = np.bincount(owner, hit[codes], len(texts)) if len(words) else np.zeros(len(texts))
            base = np.bincount(owner, logs[codes], len(texts)) if len(words) else np.zeros(len(texts))
            base -= counts * np.log10(total + distinct + 1.0)
            yield _out(row=rows, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n=counts, known=known.astype(np.int64), base=base, bits=bits)
            rare = np.flatnonzero(~hit[codes]) if len(words) else np.zeros(0, np.int64)
            if len(rare):
                pairs, values_of = pd.factorize(owner[rare] * np.int64(len(values)) + codes[rare])
                n = np.bincount(pairs)
                yield _out(row=rows[values_of // len(values)], word=values[values_of % len(values)].view(np.int64), n=n)

    return run


KINDS = {
    "row": pa.int64(),
    "doc_id": pa.int64(),
    "held_out": pa.bool_(),
    "word": pa.int64(),
    "n": pa.int64(),
    "known": pa.int64(),
    "base": pa.float64(),
    "bits": pa.float64(),
}


def _out(**columns) -> pa.RecordBatch:
    size = len(columns["row"])
    arrays = []
    for name, kind in KINDS.items():
        value = columns.get(name)
        arrays.append(pa.nulls(size, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, list(KINDS))


def mixing_scores(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits.

    Texts are lower-cased (A-Z). A NULL text is empty: one token, the end. A NULL id
    counts as empty text in the fold. Without training documents every bit has
    probability 1/2 under the counts, and the base score is 0 for each token.
    """
    context = docs.sparkSession.sparkContext
    rows = (
        id_and_text(docs)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("held_out", crc_fold(F.col("doc_id"), modulus) == held)
    )
    counted = store(
        rows.where(~F.col("held_out")).select("text").mapInArrow(_gather, "kind tinyint, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n")),
        "corpus-counts",
    )
    words, windows = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    model = fit_mixing(windows)
    frequent = words.where((F.col("n") > max(1.0, COMMON * total)) & (F.col("key") != int(END_WORD))).toArrow()
    keys = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = context.broadcast(packed_up((model, keys[order], frequent["n"].to_numpy()[order])))
    scored = store(
        rows.mapInArrow(
            _score(shared, total, distinct),
            "row long, doc_id long, held_out boolean, word long, n long, known long, base double, bits double",
        ),
        "scored",
    )
    shared.destroy()
    ends = words.where(F.col("key") == int(END_WORD)).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rare = (
        scored.where("word is not null")
        .select("row", F.col("word").alias("key"), F.col("n").alias("times"))
        .join(words, "key")
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("plus"))
    )
    end = float(np.log10((ends + 1) / (total + distinct + 1)))
    none = F.lit(0)
    return (
        scored.where("word is null")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            (F.col("n") + 1).alias("n_tokens"),
            (F.col("known") + F.coalesce("more", none) + (1 if ends else 0)).alias("n_known"),
            F.lit(int(total)).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("plus", F.lit(0.0)) + end).alias("base_score"),
            (F.col("bits") * -float(np.log10(2))).alias("score"),
            "bits",
        )
    )


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_scores(table(spark, sf_dir, "documents"))
