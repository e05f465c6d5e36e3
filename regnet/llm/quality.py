"""Quality classifier by Bradley-Terry pairwise ranking.

Document scores are linear in features of the whole text: square roots of the frequencies of byte 2- and 3-grams,
hashed to BUCKETS, and a few plain statistics of repetition and length; none has a threshold. Weights are learned
from preference pairs (a document labelled 1 beats one labelled 0) by logistic loss on the feature differences, on
the driver, over a bounded sample of labelled documents (MAX_TRAIN). The cut is the quantile of the training scores
at the share of label 0; it maps to score 0.5. Every document is then scored in one pass without a shuffle.

Defined cases: null or empty text has the features of an empty text and gets a score; null labels and labels
without a document are left out; without both labels all scores are 0.5; repeated rows get equal scores; null ids
are not held out; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: At most about so many labelled documents are collected to fit the model (4 kB each); pairs drawn from them.
MAX_TRAIN, PAIRS = 20_000, 60_000
RIDGE, NEWTON_STEPS, CG_STEPS = 1e-2, 12, 60
BUCKETS, GRAMS = 1024, (2, 3)
#: Grams of a short text say less: their features are taken as if so many average grams stood beside them.
PRIOR_GRAMS = 32
#: Bytes of a text that are hashed at a time, and texts that are scored at a time: bounds of a task's memory.
SLICE, TEXTS = 1 << 20, 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_counts(data: np.ndarray, n: int) -> np.ndarray:
    """How often the n-grams of data fall into each bucket."""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(data) - n + 1, SLICE):
        part = data[at : at + SLICE + n - 1].astype(np.uint64)
        code = np.full(len(part) - n + 1, n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | part[i : len(part) - n + 1 + i]
        bucket = (code * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        counts += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
    return counts


def _statistics(text: str) -> list[float]:
    """Of repetition and length: distinct words, words like the one before, the commonest word, distinct lines, words, word length."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, length = max(len(words), 1), float(np.log1p(len(words)))
    top = Counter(words).most_common(1)[0][1] if words else 0
    return [len(set(words)) / n, sum(map(eq, words, words[1:])) / n, top / n, len(set(lines)) / max(len(lines), 1), length, length * length / 10, sum(map(len, words)) / n / 10]


def features(text: str | None) -> np.ndarray:
    """Of the whole text; the last one is the number of bytes."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    grams = sum(_gram_counts(data, n) / max(len(data) - n + 1, 1) for n in GRAMS)
    return np.array([*np.sqrt(grams), *_statistics(text), len(data)], np.float32)


N_FEATURES = len(features("a")) - 1


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features with mean 0 and scale 1; those of grams are drawn towards the mean in short texts."""
    z = x[:, :-1] - mean
    z /= scale
    np.clip(z, -8, 8, out=z)
    z[:, :BUCKETS] *= (x[:, -1] / (x[:, -1] + PRIOR_GRAMS))[:, None]
    return z


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            part = b.slice(at, TEXTS)
            x = [features(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(x, pa.binary())], ["quality", "x"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 5) -> dict:
    """Weights, means, scales, cut and slope, from labels outside the held-out third."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    share = min(1.0, max_train / max(rows.count(), 1))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), 1_000_000) < round(share * 1e6))  # about max_train rows: small enough to broadcast
    got = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("quality", "text").filter(F.col("quality").isin(0, 1))
    got = got.mapInArrow(lean(_features, TEXTS), "quality int, x binary").toArrow()
    order = pc.sort_indices(got, [("quality", "ascending"), ("x", "ascending")]).to_numpy()  # the draw mustn't depend on the order in which rows came
    quality, x = got.column("quality").to_numpy()[order], np.empty((len(got), N_FEATURES + 1), np.float32)
    for i, k in enumerate(order):
        x[i] = np.frombuffer(got.column("x")[k].as_buffer(), np.float32)
    del got
    return learned(x, quality, seed)


def learned(x: np.ndarray, quality: np.ndarray, seed: int) -> dict:
    """The model of features and labels: Newton's method on the ridged pairwise logistic loss, steps by conjugate gradients."""
    model = {"w": np.zeros(N_FEATURES, np.float32), "mean": np.zeros(N_FEATURES, np.float32), "scale": np.ones(N_FEATURES, np.float32), "cut": 0.0, "slope": 1.0}
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    if len(good) == 0 or len(bad) == 0:
        return model
    model["mean"], model["scale"] = x[:, :-1].mean(0), np.maximum(x[:, :-1].std(0), 1e-6)
    z = standard(x, model["mean"], model["scale"])
    rng, n = np.random.default_rng(seed), len(z)
    better, worse = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)

    def back(c: np.ndarray) -> np.ndarray:
        """The sum of c times the feature differences, without making the differences."""
        return (np.bincount(better, c, n) - np.bincount(worse, c, n)).astype(np.float32) @ z / PAIRS

    w = np.zeros(N_FEATURES)
    for _ in range(NEWTON_STEPS):
        s = z @ w.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(s[better] - s[worse], -30, 30)))
        step, r = np.zeros(N_FEATURES), -(back(p - 1) + RIDGE * w)
        d = r.copy()
        for _ in range(CG_STEPS):
            if r @ r < 1e-12:
                break
            v = z @ d.astype(np.float32)
            h = back(p * (1 - p) * (v[better] - v[worse])) + RIDGE * d
            a = (r @ r) / (d @ h)
            step, after = step + a * d, r - a * h
            d, r = after + (after @ after) / (r @ r) * d, after
        w = w + step
    s = z @ w.astype(np.float32)
    spread = float(np.median(s[good]) - np.median(s[bad]))
    return model | {"w": w.astype(np.float32), "cut": float(np.quantile(s, len(bad) / n)), "slope": 4.0 / max(spread, 1e-6)}


def scores(texts: list[str | None], model: dict) -> np.ndarray:
    out = np.zeros(len(texts))
    for at in range(0, len(texts), TEXTS):
        z = standard(np.stack([features(t) for t in texts[at : at + TEXTS]]), model["mean"], model["scale"])
        # row by row, so that equal texts get equal scores wherever they stand
        out[at : at + TEXTS] = (z * model["w"]).sum(1, dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (out - model["cut"]), -500, 500)))


def _score(model: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column("text").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + [pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    docs = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = docs.mapInArrow(lean(_score(model), TEXTS), f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _keep(model: object, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column("text").to_pylist(), model.value)
            yield b.filter(pa.array(s >= threshold))

    return run


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """documents without those that the classifier rejects. Columns stay as they are."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    return documents.mapInArrow(lean(_keep(model, threshold), TEXTS), documents.schema)
