"""Language identification: the nearest of several TF-IDF centroids per language by cosine, with rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import fields, give, hold, small_batches
from pagewright.llm.ngrams import hashed, only_letters, term_counts

BINS, SIZES = 1 << 13, (1, 2, 3)
MOST_LANGUAGES = 1_000  # what one model is meant for at most: four centroids of 64 KB each a language


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and unit-length TF-IDF weights; both empty if the text has no letter."""
    codes = only_letters(text or "")
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0)
    at, tf = term_counts(hashed(codes, SIZES, len(idf)), len(idf))
    w = tf * idf[at]
    return at, w / max(np.linalg.norm(w), 1e-12)


@dataclass
class LanguageModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # rows of unit length
    idf: np.ndarray
    reject_below: dict[tuple[str, int], float] = field(default_factory=dict)  # by language and class of length

    def nearest(self, text: str | None) -> tuple[str, float, int]:
        """(language, cosine in 0..1, class of length). `und`, 0 and -1 for null, for no letter, or without a model."""
        at, w = vector(text, self.idf)
        if not len(at) or not self.langs:
            return "und", 0.0, -1
        cos = self.centroids[:, at] @ w
        best = int(np.argmax(cos))
        return self.langs[best], float(np.clip(cos[best], 0, 1)), length_class(len(text))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine in 0..1, rejected). `und`, 0 and rejected for null, for no letter, or without a model."""
        lang, score, size = self.nearest(text)
        return lang, score, size < 0 or score < self.reject_below.get((lang, size), 0.0)


#: Classes of length: up to 64 characters, up to 128, ... and all above 8,192.
CLASSES = 9


def length_class(chars: int) -> int:
    return min(CLASSES - 1, max(0, (chars - 1).bit_length() - 6))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit rows by cosine; deterministic for a given order of rows."""
    rng, centers = np.random.default_rng(seed), [x.mean(axis=0)]
    while len(centers) < min(k, len(x)):  # next: far from all before, as in k-means++
        far = 1 - np.max(x @ (np.array(centers) / np.linalg.norm(centers, axis=1, keepdims=True).clip(1e-12)).T, axis=1)
        far = far.clip(0)
        if far.sum() <= 1e-9:
            break
        centers.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(centers)
    for _ in range(rounds):
        c = c / np.linalg.norm(c, axis=1, keepdims=True).clip(1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.linalg.norm(c, axis=1, keepdims=True).clip(1e-12)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 800, centroids: int = 4, slack: float = 0.8, quantile: float = 0.01) -> LanguageModel:
    """Learn from all rows with text and language.

    Document frequencies are counted over every row. The centroids are clustered from a sample of about `per_language`
    distinct texts of each language (the bound; those with the smallest hashes; copies count once), a language in a task. A document is
    rejected if its cosine is below `slack` times a low quantile of the cosines of all learning rows of its language and
    class of length that are nearest to their own language; a class without such rows takes the limit of the next
    shorter one that has some, or if there is none half of the limit of the shortest that has some. Null languages or texts, and texts without a letter, are left out; an empty table gives a
    model that knows no language. The model has `centroids` rows for each language; more than MOST_LANGUAGES are refused.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).where("_text is not null and _lang is not null")

    def count(batches):
        df, n = np.zeros(BINS, np.int64), 0
        for b in batches:
            for t in b["_text"]:
                codes = only_letters(t)
                if len(codes):
                    df[np.unique(hashed(codes, SIZES, BINS))] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bin": np.append(at, -1), "df": np.append(df[at], n)})

    counted = rows.select("_text").mapInPandas(count, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(BINS), 0
    for r in counted:
        if r["bin"] < 0:
            n = r["df"]
        else:
            df[r["bin"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1

    # Copies count once: a language with few texts and very many copies of one is learned from all of its texts.
    mixed = F.xxhash64(F.lit(11), "_text")
    sizes = rows.groupBy(F.col("_lang").alias("_of")).agg(F.approx_count_distinct(mixed, 0.02).alias("_n"))
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53))
    sample = rows.join(F.broadcast(sizes), F.col("_lang") == F.col("_of")).where(share * F.col("_n") <= per_language).select("_text", "_lang").distinct()
    shared = spark.sparkContext.broadcast(idf)

    def cluster(own: pd.DataFrame) -> pd.DataFrame:
        """The centroids of one language from its sample."""
        found = [(at, w) for at, w in (vector(t, shared.value) for t in sorted(own["_text"])) if len(at)]
        x = np.zeros((len(found), BINS), np.float32)
        for i, (at, w) in enumerate(found):
            x[i, at] = w
        c = spherical_kmeans(x, centroids) if found else x
        return pd.DataFrame({"lang": pd.Series([own["_lang"].iloc[0]] * len(c), dtype=object), "i": range(len(c)), "c": pd.Series([v.astype("<f4").tobytes() for v in c], dtype=object)})

    got = sorted(sample.groupBy("_lang").applyInPandas(cluster, "lang string, i int, c binary").collect(), key=lambda r: (r["lang"], r["i"]))
    model = LanguageModel([r["lang"] for r in got], np.array([np.frombuffer(r["c"], "<f4") for r in got]).reshape(len(got), BINS), idf)
    if not model.langs:
        return model
    learned = spark.sparkContext.broadcast(model)

    @F.pandas_udf("near string, score double, size int")
    def near(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([learned.value.nearest(t) for t in texts], columns=["near", "score", "size"])

    own = rows.select("_lang", near("_text").alias("_x")).where(F.col("_lang") == F.col("_x.near"))
    limits = {}
    for r in own.groupBy("_lang", "_x.size").agg(F.percentile_approx("_x.score", quantile, 1000).alias("limit")).collect():  # CLASSES rows a language
        limits[r["_lang"], r["size"]] = slack * r["limit"]
    for name in sorted(set(model.langs)):
        last = min((k, x) for (la, k), x in limits.items() if la == name)[1] / 2 if any(la == name for la, _ in limits) else 0.0
        for k in range(CLASSES):
            last = limits.get((name, k), last)
            model.reject_below[name, k] = last
    return model


def identify_languages(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to `df`. One pass, no shuffle; texts are taken whole.

    Null and empty texts, and texts without a letter, get `und`, 0 and rejected; ties go to the first centroid; repeated
    rows are judged alike. Columns of the added names, in any case, are replaced; all others stay, whatever their names.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    kept = fields(df, "lang_pred", "score", "rejected")
    said = hold(df, kept, predict(F.col(text)).alias("said"))
    return said.select(*give(kept), "said.lang_pred", "said.score", "said.rejected")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text modulo `of` (null id: null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % of
