"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import fields, give, hold, small_batches
from pagewright.llm.ngrams import code_points, hashed, letters

BINS, SIZES, SHAPES = 1 << 12, (1, 2, 3), 9


def shape(text: str) -> np.ndarray:
    """What n-grams don't show: shares of kinds of characters, repetition, word and line lengths; each about 0 to 1."""
    c = code_points(text)
    words, lines = text.split(), text.split("\n")
    n, w = max(1, len(c)), max(1, len(words))
    ascii_ = c[c < 128]
    low = ((ascii_ >= 97) & (ascii_ <= 122)).sum()
    up = ((ascii_ >= 65) & (ascii_ <= 90)).sum()
    letter = letters()[c].sum()
    return np.array([
        letter / n, up / n * 2, low / n, ((ascii_ >= 48) & (ascii_ <= 57)).sum() / n * 4,
        (n - letter - np.isin(c, (32, 10, 46, 44)).sum()) / n * 3,
        len(set(words)) / w / max(0.05, min(1.0, 3 / w**0.4)) / 4, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w * 2,
        len(set(lines)) / len(lines), min(1.0, len(c) / w / 20),
    ])


def terms(text: str | None) -> np.ndarray:
    """Term counts damped by a logarithm, of unit length, then the shape numbers (of a null text: those of an empty one)."""
    text = text or ""
    counts = np.bincount(hashed(code_points(text), SIZES, BINS), minlength=BINS)
    x = np.log1p(counts)
    return np.concatenate([x, shape(text)]).astype(np.float32)


@dataclass
class QualityModel:
    idf: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled, of unit length
    labels: np.ndarray
    neighbours: int
    sharpness: float
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        y = weigh(x, self.idf, self.mean, self.scale) @ self.axes
        return y / np.linalg.norm(y, axis=1, keepdims=True).clip(1e-9)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; exact cosines, in blocks."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(texts), block):
            e = self.embed(np.stack([terms(t) for t in texts[i : i + block]]))
            cos = e @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.take_along_axis(cos, near, axis=1).clip(1e-3).astype(np.float64) ** self.sharpness
            out[i : i + block] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return out.clip(0, 1)


def weigh(x: np.ndarray, idf: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    grams = x[:, :BINS] * idf
    grams = grams / np.linalg.norm(grams, axis=1, keepdims=True).clip(1e-9)
    return np.hstack([grams, ((x[:, BINS:] - mean) / scale).clip(-4, 4) * 0.15]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", on: str = "doc_id", most: int = 4096, dimensions: int = 48, neighbours: int = 15, sharpness: float = 8.0) -> QualityModel:
    """Learn the labels of `labels` (joined by `on`) from the texts of `docs`.

    Rows without label or key are left out; of repeated labels the largest counts, of documents with one key the least
    text; null texts count as empty. Document
    frequencies are counted over all of `docs`. The axes (randomised singular value decomposition) and the voting
    vectors come from a sample of about `most` labelled keys, those with the smallest hashes: the bound that makes the
    keys and the vectors small enough to broadcast. Without any labelled text every score is 0.5.
    """
    small_batches(docs.sparkSession)
    labelled = labels.where(F.col(on).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(on).alias("_on")).agg((F.max(label) > 0).cast("int").alias("_y"))
    n_labelled = labelled.count()
    mixed = F.shiftrightunsigned(F.xxhash64(F.lit(5), "_on"), 11) / F.lit(float(1 << 53))
    sample = labelled.where(mixed <= min(1.0, most / max(1, n_labelled)))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(on).alias("_doc"))

    def count(batches):
        df, n = np.zeros(BINS, np.int64), 0
        for b in batches:
            for t in b["_text"]:
                df[np.unique(hashed(code_points(t), SIZES, BINS))] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bin": np.append(at, -1), "df": np.append(df[at], n)})

    df, n = np.zeros(BINS), 0
    for r in rows.select("_text").mapInPandas(count, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect():
        if r["bin"] < 0:
            n = r["df"]
        else:
            df[r["bin"]] = r["df"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    empty = np.zeros(0, np.float32)

    def vectors(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["_y"], "x": [terms(t).astype(np.float16).tobytes() for t in b["_text"]]})

    chosen = rows.join(F.broadcast(sample), F.col("_doc") == F.col("_on")).groupBy("_on").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y")).select("_text", "_y")
    got = sorted((bytes(r["x"]), r["y"]) for r in chosen.mapInPandas(vectors, "y int, x binary").collect())
    if not got:
        return QualityModel(idf, empty, empty, np.zeros((BINS, 0)), np.zeros((0, 0)), empty, neighbours, sharpness, 0.5)
    x = np.stack([np.frombuffer(b, np.float16) for b, _ in got]).astype(np.float32)
    y = np.array([v for _, v in got], np.float64)
    mean, scale = x[:, BINS:].mean(axis=0), x[:, BINS:].std(axis=0).clip(0.02)
    a = weigh(x, idf, mean, scale)
    q = np.linalg.qr(a @ np.random.default_rng(3).standard_normal((a.shape[1], dimensions + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    axes = np.linalg.svd(q.T @ a, full_matrices=False)[2][:dimensions].T
    model = QualityModel(idf, mean, scale, axes.astype(np.float32), np.zeros((0, 0)), y, neighbours, sharpness, float(y.mean()))
    model.vectors = model.embed(x).astype(np.float32)
    return model


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score and predicted to `df`. One pass, no shuffle; null texts count as empty, texts are taken whole, equal
    texts have equal scores. Columns of these names, in any case, are replaced; all others stay, whatever their names."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(texts)), dtype="float64")

    kept = fields(df, "score", "predicted")
    scored = hold(df, kept, score(F.col(text)).alias("score"))
    return scored.select(*give(kept), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
