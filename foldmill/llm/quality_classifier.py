"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Statistics of whole texts feed small decision trees grown on labelled rows; the
paths of the trees become conjunctive rules; a lasso logistic regression
(proximal gradient) keeps a few of them with weights; those are compiled into a
Spark column expression over the statistics. Training fits on a bounded sample
of labelled rows, the ``max_rows`` with the smallest hash of the id (all, where
there are fewer); scoring covers every row.

Results by case: null and empty texts have zero statistics and a score like any
other; repeated rows score alike; without usable labels, or with one class only,
the score is the share of label 1 smoothed by one of each (0.5 for no labels);
a doc_id labelled more than once counts with its lowest label, one that several
rows have with one of them; an empty table gives no rows; other columns may have
any names; very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.llm._shared import as_bytes, table

#: Names of the statistics, in order. None of them depends on id, language tag, source or labels.
STATS = ["log_words", "word_len", "symbols", "upper", "digits", "marks", "pipes", "bangs", "high", "lines", "line_words", "dup_lines", "distinct_words", "top_word", "repeat_pairs", "capital_words", "short_words", "long_word"]


def text_stats(text: bytes) -> list[float]:
    """Values of STATS for one whole text; shares lie between 0 and 1."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = int(hist.sum() - hist[[9, 10, 11, 12, 13, 32]].sum())
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    sizes = list(map(len, words))
    return [
        math.log1p(n), solid / n, int(hist[[35, 36, 37, 38, 42, 60, 62, 124]].sum()) / solid, int(hist[65:91].sum()) / letters,
        int(hist[48:58].sum()) / solid, int(hist[[33, 44, 46, 58, 59, 63]].sum()) / solid, int(hist[124]) / n, int(hist[33]) / n,
        int(hist[128:].sum()) / solid, math.log1p(len(lines)), math.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        len(seen) / n, max(seen.values()) / n, 1 - pairs / max(1, n - 1), sum(w[:1].isupper() for w in words) / n,
        sum(s <= 2 for s in sizes) / n, math.log1p(max(sizes)),
    ]


def with_stats(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs`` in a struct, so that no name clashes) and the statistics of every row, as columns named as in STATS."""
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            cols = list(zip(*(text_stats(t or b"") for t in as_bytes(batch.column(1))))) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in cols)], names=["row", *STATS])

    schema = own.select("row").schema
    for s in STATS:
        schema = schema.add(s, "double")
    return own.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, text, label of ``docs`` from the folds for learning: those of at most ``max_rows`` labels, so small enough to broadcast. A doc_id may have many rows."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(own), "doc_id")


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, rng, tries: int) -> list[tuple[tuple[int, bool, float], ...]]:
    """Paths of a tree that splits by Gini impurity; a step is (statistic, above, threshold)."""
    paths = []

    def node(rows, path, left):
        if path:
            paths.append(path)
        if not left or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (0.0, None)
        total, ones = w[rows].sum(), (w * y)[rows].sum()
        for f in rng.choice(x.shape[1], tries, replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.04, 0.96, 24))):
                up = v > t
                if 5 <= up.sum() <= len(rows) - 5:
                    a, b = w[rows][up].sum(), (w * y)[rows][up].sum()
                    gain = b * b / a + (ones - b) ** 2 / (total - a) - ones * ones / total
                    if gain > best[0]:
                        best = (gain, (f, t, up))
        if best[1]:
            f, t, up = best[1]
            node(rows[up], (*path, (int(f), True, float(t))), left - 1)
            node(rows[~up], (*path, (int(f), False, float(t))), left - 1)

    node(rng.integers(0, len(y), len(y)), (), depth)
    return paths


def matches(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


@dataclass
class RuleModel:
    """A bias and weighted conjunctive rules over STATS."""

    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]

    def column(self) -> Column:
        """The score, between 0 and 1, as an expression over the columns of with_stats()."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for f, above, t in rule:
                test &= (F.col(STATS[f]) > t) if above else (F.col(STATS[f]) <= t)
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((matches(x, r) * v for r, v in self.rules), np.zeros(len(x))))))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, steps: int = 800, seed: int = 7) -> RuleModel:
    """Rules from ``trees`` trees on bootstrap rows, weighted by lasso logistic regression."""
    prior = (y.sum() + 1) / (len(y) + 2)
    flat = RuleModel(float(np.log(prior / (1 - prior))), [])
    if len(y) < 40 or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rules = sorted({r for _ in range(trees) for r in grow(x, y, balance, depth, rng, max(4, x.shape[1] // 3))})
    m = np.stack([matches(x, r) for r in rules], 1).astype(float)
    _, first = np.unique(np.packbits(m.astype(bool), axis=0), axis=1, return_index=True)
    first = np.sort(first)
    rules, m = [rules[i] for i in first], m[:, first]
    spread = m.std(0)
    keep = spread > 0
    rules, m, spread = [r for r, k in zip(rules, keep) if k], m[:, keep], spread[keep]
    mean = m.mean(0)
    z = (m - mean) / spread
    step = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + 1e-9)
    v = u = np.zeros(z.shape[1])
    b = bu = flat.bias
    t = 1.0
    for _ in range(steps):  # FISTA
        err = 1 / (1 + np.exp(-(z @ u + bu))) - y
        nv = u - step * (z.T @ err) / len(y)
        nv = np.sign(nv) * np.maximum(np.abs(nv) - step * penalty, 0)
        nb, nt = bu - 4 * err.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, bu = nv + (t - 1) / nt * (nv - v), nb + (t - 1) / nt * (nb - b)
        v, b, t = nv, nb, nt
    weights = v / spread
    return RuleModel(float(b - (weights * mean).sum()), [(r, float(wt)) for r, wt in zip(rules, weights) if abs(wt) > 1e-6])


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000) -> RuleModel:
    """Learns ``label`` from the folds for learning, on at most ``max_rows`` labelled documents: of rows with the same id the one with the least statistics, chosen before anything is collected."""
    sample = with_stats(labelled(docs, labels, label, max_rows))
    one = sample.groupBy(F.col("row.doc_id").alias("doc_id")).agg(F.first("row.label").alias("label"), F.min(F.struct(*STATS)).alias("x"))
    got = one.select("doc_id", "label", "x.*").toPandas()
    got = got.sort_values(["doc_id", *STATS], kind="stable")
    return fit_rules(got[STATS].to_numpy(float), (got["label"].to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    own = with_stats(docs.select("doc_id", "text")).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), model.column().alias("score"))
    return own.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that the model accepts, in one scan."""
    return with_stats(docs).where(model.column() >= threshold).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
