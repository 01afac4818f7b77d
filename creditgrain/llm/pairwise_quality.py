"""Quality by pairwise ranking (Bradley-Terry).

A document's score is a linear function of features of its whole text. The
weights are those for which sigmoid(score of A - score of B) best predicts that A
is preferred to B, over pairs of a good and a bad labelled document: logistic
loss on the difference of the two feature vectors. The cut between good and bad
is a quantile of the scores of the labelled documents: the share of bad ones. It
is the exact quantile over all labelled documents of the training folds.

Only the weights are learned from a bounded sample (``SAMPLE`` rows of each label,
those with the smallest hash of their id); every document is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, id_and_text, table, text_blocks

SAMPLE = 1500
PAIRS = 40_000
ACCEPT = 0.7
_KINDS = np.zeros(256, np.int64)
for _k, _bytes in enumerate([b"\t\n\v\f\r ", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?"]):
    _KINDS[list(_bytes)] = _k + 1
_KINDS[128:] = 6
FEATURES = (
    "log_bytes log_words new_words top_word same_as_last new_pairs new_lines line_words "
    "space lower upper digit mark wide symbol word_length longest compressed entropy "
    "shouted_words odd_words doubled_marks stops"
).split()


def features(text: bytes) -> list[float]:
    """Length, repetition, character mix and compressibility of a text; all finite, also if empty."""
    words = text.split()
    n, m = len(text), len(words)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KINDS[data], minlength=7) / max(n, 1)
    byte = np.bincount(data, minlength=256) / max(n, 1)
    byte = byte[byte > 0]
    lengths = [len(w) for w in words]
    pairs = set(zip(words, words[1:], strict=False))
    plain = sum(c for w, c in counts.items() if w.strip(b".,;:'\"()-?!").isalpha() or max(w) > 127)
    return [
        np.log1p(n),
        np.log1p(m),
        len(counts) / max(m, 1),
        max(counts.values(), default=0) / max(m, 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(m - 1, 1),
        len(pairs) / max(m - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(m / max(len(lines), 1)),
        *kinds[1:].tolist(),
        kinds[0],
        sum(lengths) / max(m, 1),
        np.log1p(max(lengths, default=0)),
        len(zlib.compress(text, 1)) / max(n, 1) if n else 1.0,
        float(-(byte * np.log2(byte)).sum()) if n else 0.0,
        sum(c for w, c in counts.items() if len(w) > 2 and w.isupper()) / max(m, 1),
        1 - plain / max(m, 1),
        (text.count(b"!!") + text.count(b"??") + text.count(b"##")) / max(m, 1),
        (text.count(b".") + text.count(b"\n")) / max(m, 1),
    ]


def design(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class PairwiseModel:
    """score = (expanded features) @ weights; ``cut`` is where good begins."""

    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standard scores and their excess beyond a low and a high quantile."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        low, high = self.knots
        return np.hstack([z, np.maximum(low - z, 0), np.maximum(z - high, 0)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def probability(self, x: np.ndarray, accept: float = ACCEPT) -> np.ndarray:
        """0 to 1, rising with the raw score; ``accept`` at the cut."""
        t = np.clip(self.slope * (self.raw(x) - self.cut) + np.log(accept / (1 - accept)), -700, 700)
        return 1 / (1 + np.exp(-t))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 5) -> PairwiseModel:
    """Fit the weights on random (good, bad) pairs by Newton steps.

    With one label only there are no pairs: all weights are 0 and every document
    gets the same score, on the side of that label.
    """
    spread = x.std(0) if len(x) else np.zeros(len(FEATURES))
    model = PairwiseModel(
        x.mean(0) if len(x) else np.zeros(len(FEATURES)),
        np.where(spread > 1e-9, spread, 1.0),
        np.zeros((2, len(FEATURES))),
        np.zeros(3 * len(FEATURES)),
        0.0,
        1.0,
    )
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        model.cut = 0.0 if len(better) or not len(x) else 1.0
        return model
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    model.knots = np.quantile(z, [0.1, 0.9], axis=0)
    e = model.expand(x)
    draw = np.random.default_rng(seed)
    difference = e[draw.choice(better, pairs)] - e[draw.choice(worse, pairs)]
    w = model.weights
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) / pairs + penalty * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / pairs
        w = w - np.linalg.solve(curve + penalty * np.eye(len(w)), gradient)
    model.weights = w
    scores = model.raw(x)
    # The quantile of the bad share; halfway between the scores on its two sides.
    model.cut = float(np.sort(scores)[len(worse) - 1 : len(worse) + 1].mean())
    below, above = scores[scores < model.cut], scores[scores >= model.cut]
    # Scale: the middles of the two sides are 4 apart.
    gap = (np.median(above) if len(above) else 0) - (np.median(below) if len(below) else 0)
    model.slope = float(4 / gap) if gap > 1e-9 else 1.0
    return model


def training_ids(labels: DataFrame) -> DataFrame:
    """The distinct doc_id and quality of the labels outside the held-out fold."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2)
    )
    return ids.distinct()


def smallest_hashes(ids: DataFrame, per_label: int) -> DataFrame:
    """The rows of ``ids`` up to the hash range that holds the ``per_label``-th hash of their label.

    Ranges are counted first, so that of each label at most ``per_label`` rows and
    those of one range in 65,536 are left to rank.
    """
    part = F.shiftright(F.xxhash64("doc_id"), 48)
    counts = ids.groupBy("quality", part.alias("part")).count().collect()
    keep = F.lit(False)
    for label in (0, 1):
        seen, last = 0, None
        for r in sorted((r for r in counts if r["quality"] == label), key=lambda r: r["part"]):
            if seen >= per_label:
                break
            seen, last = seen + r["count"], r["part"]
        if last is not None:
            keep = keep | ((F.col("quality") == label) & (part <= last))
    return ids.where(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, text and quality of at most ``per_label`` documents of each label."""
    first = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = smallest_hashes(training_ids(labels), per_label).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_label).drop("n")
    return docs.join(F.broadcast(chosen), "doc_id")  # ids only, at most 2 * per_label


def sort_keys(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the finite ``values``."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)  # + 0.0: no negative zero
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def values_at(keys: DataFrame, ranks: list[int]) -> np.ndarray:
    """The values at ``ranks`` (from 0) of column ``key``, made by ``sort_keys``.

    Each of four rounds counts the next 16 bits of the keys that begin like those
    wanted, so that only counts reach the driver and ties need no care.
    """
    begins, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):
        rows = keys if shift == 48 else keys.where(F.shiftright("key", shift + 16).isin(sorted(set(begins))))
        counts = sorted((r["digit"], r["count"]) for r in rows.groupBy(F.shiftright("key", shift).alias("digit")).count().collect())
        for i, begin in enumerate(begins):
            for digit, count in counts:
                if shift < 48 and digit >> 16 != begin:
                    continue
                if left[i] < count:
                    begins[i] = digit
                    break
                left[i] -= count
    found = np.array(begins, np.int64)
    return (found ^ ((found >> 63) & np.int64(2**63 - 1))).view(np.float64)


def set_cut(model: PairwiseModel, docs: DataFrame, labels: DataFrame) -> PairwiseModel:
    """``model`` with cut and slope from the scores of all labelled training documents.

    Documents are scored where they lie; only ids and scores are joined to the labels.
    """

    def run(batches):
        for batch, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sort_keys(model.raw(design(texts))))], ["doc_id", "key"]
            )

    training = id_and_text(docs).where(F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2))
    scored = training.mapInArrow(run, "doc_id long, key long").join(training_ids(labels), "doc_id")
    scored = scored.select("quality", "key").persist()
    try:
        sizes = {r["quality"]: r["count"] for r in scored.groupBy("quality").count().collect()}
        bad, good = sizes.get(0, 0), sizes.get(1, 0)
        if not bad or not good:
            return model
        # The scores on both sides of the cut, and the two middle ones of each side.
        ranks = [bad - 1, bad, (bad - 1) // 2, bad // 2, bad + (good - 1) // 2, bad + good // 2]
        at = values_at(scored, ranks)
    finally:
        scored.unpersist()
    # The quantile of the bad share; halfway between the scores on its two sides.
    model.cut = float(at[:2].mean())
    # Scale: the middles of the two sides are 4 apart.
    gap = at[4:].mean() - at[2:4].mean()
    model.slope = float(4 / gap) if gap > 1e-9 else 1.0
    return model


def _score(model: PairwiseModel, accept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            x = design(texts)
            score = model.probability(x, accept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score),
                    pa.array((score >= accept).astype(np.int32)),
                    pa.array(model.raw(x)),
                ],
                ["doc_id", "held_out", "score", "predicted", "rank_score"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> PairwiseModel:
    """Fit the weights on the labelled sample and the cut on all labelled documents.

    Features are taken in the tasks, numbers only come to the driver.
    """

    def take(batches):
        for batch, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(list(design(texts)), pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"],
            )

    rows = (
        labelled_sample(id_and_text(docs), labels, per_label)
        .select("doc_id", "quality", "text")
        .mapInArrow(take, "doc_id long, quality int, x array<double>")
        .toArrow()
        .sort_by("doc_id")
    )
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return set_cut(fit(x, rows["quality"].to_numpy()), docs, labels)


def pairwise_quality(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, rank_score.

    NULL texts count as empty. Documents whose id falls in fold 2 of 4 teach
    nothing. Without usable labels all scores are equal and count as good.
    """
    model = train(docs, labels, per_label)
    rows = id_and_text(docs).withColumn("held_out", crc_fold(F.col("doc_id"), 4) == 2)
    return rows.mapInArrow(
        _score(model, accept), "doc_id long, held_out boolean, score double, predicted int, rank_score double"
    )


def accepted(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``accept``."""
    model = train(docs, labels, per_label)

    def run(batches):
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column("text").fill_null("")], ["text"])
            good = [model.probability(design(texts), accept) >= accept for _, texts in text_blocks([text])]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return docs.mapInArrow(run, docs.schema)


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
