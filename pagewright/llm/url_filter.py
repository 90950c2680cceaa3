"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fields, give, hold

#: (verdict, host, path prefix). A rule fits its host and all subdomains; the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labelled_urls(path: str | Path = Path(__file__).with_name("labelled_urls.tsv")) -> list[tuple[str, int]]:
    """The small labelled table used where a caller brings none: (url, 1 = block), invented hosts of many kinds."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()[1:]
    return [(url, int(label)) for label, _, url in (line.partition("\t") for line in lines)]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_url(url: str | None) -> tuple[str, str]:
    """The same split for single strings (training rows)."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    for c in "?#":
        path = path.partition(c)[0]
    return host.translate(str.maketrans(UPPER, LOWER)), path


def features(host: str, path: str, bins: int, sizes: Sequence[int] = (3, 4, 5)) -> np.ndarray:
    """Bins of the character n-grams of host and path; each n-gram counts once, by which part it stands in."""
    out = set()
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            out.update(zlib.crc32(f"{part}{text[i : i + n]}".encode()) % bins for i in range(len(text) - n + 1))
    return np.fromiter(sorted(out), dtype=np.int64, count=len(out))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    threshold: float

    def probability(self, host: str, path: str) -> float:
        x = features(host, path, len(self.weights))
        z = self.bias + (self.weights[x].sum() / np.sqrt(len(x)) if len(x) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def train(rows: Iterable[tuple[str | None, int | None]], bins: int = 1 << 14, l2: float = 0.01, steps: int = 400, rate: float = 2.0, threshold: float = 0.5) -> UrlModel:
    """Full-batch gradient descent on a small table. Rows without url or label are left out; without rows nothing is blocked."""
    data = [(features(*split_url(u), bins), y) for u, y in rows if u is not None and y is not None]
    if not data:
        return UrlModel(np.zeros(bins), -1.0, threshold)
    y = np.array([float(y > 0) for _, y in data])
    row = np.repeat(np.arange(len(data)), [len(x) for x, _ in data])
    col = np.concatenate([x for x, _ in data])
    val = np.repeat([1 / np.sqrt(max(1, len(x))) for x, _ in data], [len(x) for x, _ in data])
    w, b = np.zeros(bins), 0.0
    for _ in range(steps):
        z = b + np.bincount(row, val * w[col], len(data))
        g = (1 / (1 + np.exp(-z)) - y) / len(data)
        w -= rate * (np.bincount(col, val * g[row], bins) + l2 / len(data) * w)
        b -= rate * g.sum()
    return UrlModel(w, float(b), threshold)


def judge_urls(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None, labelled: Iterable[tuple[str | None, int | None]] | None = None) -> DataFrame:
    """Adds host, path, rule, block_score and verdict to `df`. The model is the given one, or learned from `labelled`
    rows (url, 1 = block; a small table, `labelled_urls` if none is given).

    A null or empty url, or one without `://`, has an empty host and path: no rule fits, the model decides. Long urls are
    taken whole. Of rules of equal length the last given wins; a score of exactly the threshold blocks. Repeated rows are judged alike. An empty table gives an
    empty table. Columns of the added names, in any case, are replaced; all others stay, whatever their names.
    """
    model = model or train(labelled_urls() if labelled is None else labelled)
    weights, bias, threshold = df.sparkSession.sparkContext.broadcast(model.weights), model.bias, model.threshold

    @F.pandas_udf("double")
    def block_score(host: pd.Series, path: pd.Series) -> pd.Series:
        m = UrlModel(weights.value, bias, threshold)
        return pd.Series([m.probability(h, p) for h, p in zip(host, path, strict=True)], dtype="float64")

    kept = fields(df, "host", "path", "rule", "block_score", "verdict")
    rows = hold(df, kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest ends outermost
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("block_score", block_score("host", "path"))
    method = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(*give(kept), "host", "path", "rule", "block_score", F.coalesce("ruled", method).alias("verdict"))
