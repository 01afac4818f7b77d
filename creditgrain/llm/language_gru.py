"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into consecutive pieces of ``PIECE`` bytes; the network reads every
piece forwards and backwards and gives each byte a probability for each language
from both states there. A document's probabilities are the means over all of its
bytes. It is trained in numpy by backpropagation through time on pieces of a
bounded sample of labelled documents (``SAMPLE`` of each language, those with the
smallest hash of their id, ``PIECES`` pieces of each spread over the whole text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, id_and_text, table, text_blocks

SAMPLE = 250
PIECES = 6
TRAIN_PIECE = 64
PIECE = 256
HIDDEN = 8
COLUMNS = 1024
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def squash(x: np.ndarray) -> np.ndarray:
    """x divided by 1 + its size, in place: between -1 and 1, and cheaper than tanh."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``squash`` where it is ``y``."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Direction:
    """A GRU cell: what each byte adds to its three parts, and what the state adds.

    Parts: update gate, reset gate, candidate; ``byte`` is 3 x 256 x H, ``state``
    3 x H x H. A gate is half of 1 + squash.
    """

    byte: np.ndarray
    state: np.ndarray

    def run(self, x: np.ndarray, alive: np.ndarray, backwards: bool = False) -> np.ndarray:
        """States at each place, T x B x H. Columns of ``x`` (T x B bytes) come by
        falling length: place t belongs to the first ``alive[t]`` of them."""
        hidden = self.state.shape[-1]
        (byte_z, byte_r, byte_c), (state_z, state_r, state_c) = self.byte, self.state
        h = np.zeros((x.shape[1], hidden), np.float32)
        out = np.zeros((*x.shape, hidden), np.float32)
        places = range(len(x) - 1, -1, -1) if backwards else range(len(x))
        for t in places:
            n = alive[t]
            old, now = h[:n], x[t, :n]
            z = old @ state_z
            z += byte_z.take(now, axis=0, mode="clip")
            r = old @ state_r
            r += byte_r.take(now, axis=0, mode="clip")
            c = old @ state_c
            squash(r)
            r += 1
            r *= c
            r *= 0.5
            r += byte_c.take(now, axis=0, mode="clip")
            c = squash(r)
            squash(z)
            z += 1
            z *= 0.5
            old -= c
            old *= z
            old += c
            out[t, :n] = old
        return out

    def learn(self, x: np.ndarray, states: np.ndarray, back: np.ndarray) -> Direction:
        """Backpropagation through time: the gradient, given that of each state."""
        byte, state = np.zeros_like(self.byte), np.zeros_like(self.state)
        carried = np.zeros_like(states[0])
        for t in range(len(x) - 1, -1, -1):
            old = states[t - 1] if t else np.zeros_like(states[0])
            to_z, to_r = (squash(self.byte[k][x[t]] + old @ self.state[k]) for k in (0, 1))
            z, r, inner = (to_z + 1) / 2, (to_r + 1) / 2, old @ self.state[2]
            c = squash(self.byte[2][x[t]] + r * inner)
            d = back[t] + carried
            dc = d * (1 - z) * slope(c)
            dz = d * (old - c) * slope(to_z) / 2
            dr = dc * inner * slope(to_r) / 2
            carried = d * z
            for k, (at_byte, at_state) in enumerate(((dz, dz), (dr, dr), (dc, dc * r))):
                np.add.at(byte[k], x[t], at_byte)
                state[k] += old.T @ at_state
                carried += at_state @ self.state[k].T
        return Direction(byte, state)


@dataclass
class LanguageModel:
    languages: list[str]
    ahead: Direction
    behind: Direction
    read_ahead: np.ndarray  # H x K
    read_behind: np.ndarray
    bias: np.ndarray

    def positions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities for each byte: K x T x B; ``x`` is T x B, columns by falling length."""
        alive = np.searchsorted(-lengths, -np.arange(len(x)), side="left")
        forward, backward = self.ahead.run(x, alive), self.behind.run(x, alive, backwards=True)
        hidden, k = forward.shape[-1], len(self.languages)
        scores = self.read_ahead.T @ forward.reshape(-1, hidden).T
        scores += self.read_behind.T @ backward.reshape(-1, hidden).T
        scores += self.bias[:, None]
        scores -= scores.max(0)
        np.exp(scores, out=scores)
        scores /= scores.sum(0)
        return scores.reshape(k, *x.shape)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each document; zeros for an empty one."""
        cuts = [(d, k) for d, t in enumerate(texts) for k in range(0, len(t), PIECE)]
        out = np.zeros((len(texts), len(self.languages)))
        if not cuts:
            return out
        doc, start = np.array(cuts).T
        size = np.array([len(t) for t in texts])
        lengths = np.minimum(size[doc] - start, PIECE)
        order = np.argsort(-lengths, kind="stable")
        doc, start, lengths = doc[order], start[order], lengths[order]
        data = np.frombuffer(b"".join(texts) + bytes(PIECE), np.uint8)
        base = (np.cumsum(size) - size)[doc] + start
        for k in range(0, len(doc), COLUMNS):
            part = slice(k, k + COLUMNS)
            steps = np.arange(lengths[part][0])[:, None]
            p = self.positions(data[base[part] + steps], lengths[part])
            np.add.at(out, doc[part], (p * (steps < lengths[part])).sum(1).T)
        return out / np.maximum(size, 1)[:, None]


def train(pieces: list[bytes], labels: list[str], steps: int = 240, batch: int = 128, rate: float = 0.03, seed: int = 2) -> LanguageModel:
    """Adam on the mean cross-entropy of all positions. Needs one piece at least."""
    draw = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k, h = len(languages), HIDDEN
    small = lambda *shape: draw.normal(0, 0.2, shape).astype(np.float32)
    weights = [small(3, 256, h), small(3, h, h), small(3, 256, h), small(3, h, h), small(h, k), small(h, k), np.zeros(k, np.float32)]
    x = np.array([np.frombuffer(p.ljust(TRAIN_PIECE, b" ")[:TRAIN_PIECE], np.uint8) for p in pieces]).T
    target = np.array([languages.index(s) for s in labels])
    groups = [np.flatnonzero(target == i) for i in range(k)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        rows = draw.choice(groups[0], batch) if k == 1 else np.concatenate([draw.choice(g, -(-batch // k)) for g in groups])
        xs, n = x[:, rows], len(rows)
        model = LanguageModel(languages, Direction(*weights[:2]), Direction(*weights[2:4]), *weights[4:])
        alive = np.full(len(xs), n)
        f, b = model.ahead.run(xs, alive), model.behind.run(xs, alive, backwards=True)[::-1]
        scores = f @ weights[4] + b[::-1] @ weights[5] + weights[6]
        p = np.exp(scores - scores.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(n), target[rows]] -= 1
        p /= p.shape[0] * n
        ahead = model.ahead.learn(xs, f, p @ weights[4].T)
        behind = model.behind.learn(xs[::-1], b, (p @ weights[5].T)[::-1])
        flat = p.reshape(-1, k)
        gradients = [ahead.byte, ahead.state, behind.byte, behind.state, f.reshape(-1, h).T @ flat, b[::-1].reshape(-1, h).T @ flat, flat.sum(0)]
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, gradients, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return LanguageModel(languages, Direction(*weights[:2]), Direction(*weights[2:4]), *weights[4:])


# ------------------------------------------------------------------ on tables


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_blocks(batches):
        labels, ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
        rows = []
        for doc_id, label, text in zip(ids, labels, texts, strict=True):
            if LETTER.search(text.decode("utf-8", "replace")):
                starts = {int(s) for s in np.linspace(0, max(len(text) - TRAIN_PIECE, 0), PIECES)}
                rows += [(doc_id, label, text[s : s + TRAIN_PIECE]) for s in sorted(starts)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "lang", "piece"])


def training_pieces(docs: DataFrame, sample: int = SAMPLE) -> pa.Table:
    """At most ``sample * PIECES`` pieces for each language, in a fixed order."""
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2)
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).drop("n")
    rows = id_and_text(docs).join(chosen, "doc_id").select("doc_id", "lang", "text")
    return rows.mapInArrow(_pieces, "doc_id long, lang string, piece binary").toArrow().sort_by(
        [("doc_id", "ascending"), ("piece", "ascending"), ("lang", "ascending")]
    )


def _label(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, 1 << 20):
            known = np.array([bool(LETTER.search(t.decode("utf-8", "replace"))) for t in texts])
            if model is None:
                labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p = model.documents([t if k else b"" for t, k in zip(texts, known, strict=True)])
                labels = [model.languages[i] if k else UNKNOWN for i, k in zip(p.argmax(1), known, strict=True)]
                score = np.clip(p.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def language_of(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (mean probability).

    Learns from documents with a language whose id isn't in fold 2 of 4. Texts
    that are NULL or without a letter get ``und`` and 0; so do all texts when
    nothing can be learned.
    """
    found = training_pieces(docs, sample)
    model = train(found["piece"].to_pylist(), found["lang"].to_pylist()) if len(found) else None
    rows = id_and_text(docs).withColumn("held_out", crc_fold(F.col("doc_id"), 4) == 2)
    return rows.mapInArrow(_label(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))
