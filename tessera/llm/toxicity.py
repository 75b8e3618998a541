"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w x): one weight vector for all ordered thresholds. Features are present or not: words
(letter runs, folded to lower case), beginnings of words, and beginnings whose share of all words reaches one of SHARES, as
insults are inflected and joined to other stems. Those features of the labelled texts are used that mark toxic or clean
texts by the z-score of their smoothed log odds, at most MAX_FEATURES of them. The fit takes at most MAX_LABELLED labelled
rows, by the order of a hash of their id, however many rows an id has; this bound is a parameter. What reaches the driver is the selected features and,
for each labelled text, the numbers of those it has.

Labels here are binary, so grades are made of them: 0 clean, 1 toxic, 2 toxic with at least the median number of features
that mark toxic texts. Any other integer grades from 0 can be given instead.

Edge cases: a null or empty text has no features and gets the grade of such texts; labels that are null or have no document
are left out, of repeated labels the highest counts, and equal rows of one id count once; without labels of both kinds every text is clean with severity 0;
repeated rows and ids give a row each; an empty table gives an empty result; other columns are left out by ``score`` and
kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, col, cut, id_and_text

MAX_LABELLED, MAX_FEATURES, LEAST_TEXTS, LEAST_Z = 12_000, 4096, 3, 3.0
L2, ROUNDS, RATE, SEED = 1e-4, 400, 0.1, 5
WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS, SHARES = (4, 5, 6, 7), (0.004, 0.008, 0.016, 0.03)


def features(text: str | None, known: set[str] | dict | None = None) -> set[str]:
    """All features of a text, or of beginnings only those in known."""
    if not text:
        return set()
    words = Counter(WORDS.findall(text.lower()))
    begin: Counter = Counter()
    for word, n in words.items():
        for k in BEGINNINGS:
            if len(word) <= k:
                break
            start = word[:k] + "*"
            if known is None or start in known:
                begin[start] += n
    total = sum(words.values())
    return {*words, *begin, *(f"{b}{s:g}" for b, n in begin.items() for s in SHARES if n >= s * total)}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Ordinal:
    """weights by word; thresholds, ascending, one fewer than grades."""

    weights: dict[str, float]
    thresholds: list[float]
    begun: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.begun = {f[: f.index("*") + 1] for f in self.weights if "*" in f}

    def at_least(self, text: str | None) -> list[float]:
        """The probability of each grade from 1 on, or a higher one."""
        x = sum(self.weights[f] for f in features(text, self.begun) & self.weights.keys())
        return [float(sigmoid(x - t)) for t in self.thresholds]


def fit_grades(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int, l2: float = L2, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on all rows. rows: the features each row has."""
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.array([i for r in rows for i in r], np.int64)
    above = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    params = np.concatenate((np.zeros(n_features), start[:1], gaps))
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows_at = np.arange(len(rows))
    for t in range(1, rounds + 1):
        w, first, steps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        theta = first + np.concatenate(([0.0], np.cumsum(steps)))
        x = np.bincount(who, w[what], len(rows))
        s = sigmoid(np.concatenate((theta, [np.inf]))[grades] - x)
        below = np.where(grades > 0, sigmoid(np.concatenate(([0.0], theta))[grades] - x), 0.0)
        p = np.maximum(s - below, 1e-12)
        g_x = (s + below - 1) / len(rows)
        g_w = np.bincount(what, g_x[who], n_features) - l2 * w
        d_theta = np.zeros((len(rows), n_grades + 1))
        d_theta[rows_at, grades + 1] += s * (1 - s) / p
        d_theta[rows_at, grades] -= below * (1 - below) / p
        g_theta = d_theta[:, 1:n_grades].mean(axis=0)
        g = np.concatenate((g_w, [g_theta.sum()], np.array([g_theta[k:].sum() * steps[k - 1] for k in range(1, n_grades - 1)])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:n_features], params[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(params[n_features + 1 :]))))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """doc_id, label and text of at most bound labelled texts, kept in the checkpoint folder. Equal rows count as one."""
    chosen = labels.select(col(id_col).alias("label_id"), col(label_col).cast("int").alias("label")).dropna().groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id").limit(bound)
    texts = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    # An id can have any number of rows: they are bounded by themselves, before any text is moved.
    keys = texts.select("doc_id", "mark").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "label", F.col("mark").alias("label_mark")).distinct()
    keys = keys.orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id", "label_mark").limit(bound)
    rows = texts.join(F.broadcast(keys), (F.col("doc_id") == F.col("label_id")) & (F.col("mark") == F.col("label_mark")))
    return cut(rows.groupBy("doc_id", "mark", "label").agg(F.first("text").alias("text")).drop("mark"))


def featured(rows: DataFrame, number: dict[str, int] | None = None) -> DataFrame:
    """doc_id, label and the features of each text; if number is given, the numbers of those it has."""
    kind, item = dict(rows.dtypes)["doc_id"], "string" if number is None else "int"

    def make():
        begun = None if number is None else {f[: f.index("*") + 1] for f in number if "*" in f}

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = (features(t.as_py(), begun) for t in batch["text"])
            lists = [sorted(f) for f in found] if number is None else [sorted(number[x] for x in f if x in number) for f in found]
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(lists, pa.list_(pa.string() if number is None else pa.int32()))], ["doc_id", "label", "has"])

        return apply

    return arrow_map(rows, make, f"doc_id {kind}, label int, has array<{item}>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = MAX_LABELLED) -> Ordinal:
    """The model for labels 0 (clean) and above; binary labels become three grades."""
    rows = labelled(docs, labels, id_col, text_col, label_col, bound)
    totals = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    if not n1 or not n0:
        return Ordinal({}, [60.0, 61.0])
    toxic = F.sum((F.col("label") > 0).cast("long"))
    counts = featured(rows).select("label", F.explode("has").alias("word")).groupBy("word").agg(toxic.alias("a"), (F.count("*") - toxic).alias("b")).filter(F.col("a") + F.col("b") >= LEAST_TEXTS)
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(n) - F.col(c) + 0.5))
    # The variance of log odds: one over each of the four counts.
    variance = sum((1 / (x + 0.5) for x in (F.col("a"), F.lit(n1) - F.col("a"), F.col("b"), F.lit(n0) - F.col("b"))), F.lit(0.0))
    z = (odds("a", n1) - odds("b", n0)) / F.sqrt(variance)
    best = counts.withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").limit(MAX_FEATURES)
    chosen = [(r["word"], r["z"]) for r in best.select("word", "z").collect()]
    number = {w: i for i, (w, _) in enumerate(chosen)}
    kept = featured(rows, number).orderBy("doc_id").collect()
    has, grades = [r["has"] for r in kept], np.array([r["label"] for r in kept])
    if grades.max() == 1:
        marks = np.array([sum(chosen[i][1] > 0 for i in h) for h in has])
        grades = np.where((grades > 0) & (marks >= max(1, np.median(marks[grades > 0]))), 2, grades)
    n_grades = max(2, int(grades.max()) + 1)
    w, theta = fit_grades(has, grades, len(chosen), n_grades)
    return Ordinal({word: float(x) for (word, _), x in zip(chosen, w)}, [float(t) for t in theta])


def score(df: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_toxic (grade 1 or above), p_severe (the highest grade), expected_severity, grade (the likeliest), toxic."""
    rows = id_and_text(df, id_col, text_col)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = np.array([model.at_least(t.as_py()) for t in batch["text"]]).reshape(batch.num_rows, len(model.thresholds))
            each = np.column_stack((np.ones(len(p)), p)) - np.column_stack((p, np.zeros(len(p))))
            arrays = [p[:, 0], p[:, -1], p.sum(axis=1), each.argmax(axis=1).astype(np.int32), p[:, 0] >= 0.5]
            return pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, arrays)], ["doc_id", "p_toxic", "p_severe", "expected_severity", "grade", "toxic"])

        return apply

    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, make, f"doc_id {kind}, p_toxic double, p_severe double, expected_severity double, grade int, toxic boolean")


def drop_toxic(df: DataFrame, model: Ordinal, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """df without the rows whose probability of grade 1 or above is at least at."""
    place = df.columns.index(text_col)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([model.at_least(t.as_py())[0] < at for t in batch.column(place)], pa.bool_()))

        return apply

    return arrow_map(df, make, df.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` graded by a model of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
