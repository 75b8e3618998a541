"""Quality rules: text statistics, and robust multivariate outliers by the minimum covariance determinant.

DataFrame functions only. Each text gives counts; four transformed statistics form its vector: the mean word length (drawn
towards PRIOR in short texts) and the square roots of the rates of symbols, of repeated lines and of words in repeated
windows. Per language and source, location and scatter are those of the three quarters of texts that lie most closely
together. Concentration steps find them, from two starts, medians with the spread of the middle halves and mean with
covariance: distances to the estimate, the closest three quarters, their mean and covariance, and again while the
determinant falls. Of each group's estimates that of the least determinant counts. A text is kept if its squared Mahalanobis
distance is at most ``CUT``.

All steps are grouped sums, with a histogram of log distances in place of a sort, so a hot language or source is summed
where its rows lie. Each text counts in three groups: its language and source, its language, and all. Texts of groups under
``LEAST_ROWS`` are measured by the estimate of their language over all its texts, those of small languages by that of all.
FLOORS are added to the standard deviations, as most texts have rates of exactly zero; they bound from below what can be
rejected: symbols alone above 7 % of characters, repeated lines alone above two thirds. Repeated windows alone are left to
the base rule.

Edge cases: a null or empty text has no words, fails the base rule and is not kept; null languages and sources form groups
of their own; repeated rows and ids give a row each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, col, cut, id_and_text

SHARE, LEAST_ROWS = 0.75, 50
FALL = 1e-3  # a step counts if it lowers the log determinant by more
CUT = 23.51  # the 0.9999 quantile of chi-square with four degrees of freedom
FLOORS = (0.25, 0.055, 0.17, 0.17)
PRIOR, PRIOR_WORDS = 5.0, 20
LOG_BINS = 32  # bins of the distance histogram a unit of log distance
BROADCAST_GROUPS = 20_000
X = ("x0", "x1", "x2", "x3")
ESTIMATE = (*(f"m{i}" for i in range(len(X))), *(f"l{i}{j}" for i in range(len(X)) for j in range(i + 1)))
ALL = "all"


def covered_words() -> Column:
    """Words covered by windows that occur twice or more, from ``_sorted``: the windows' hashes and places, sorted."""
    same = lambda x, k: F.coalesce(F.get(F.col("_sorted"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    begin = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, begin, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text column without nulls."""
    t = F.col(text)
    df = df.withColumn("_words", F.array_remove(F.split(t, SPACES, -1), ""))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    df = df.withColumn("_hashed", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<long>")))
    unlike = F.size(F.array_distinct("_hashed")) == F.size("_hashed")
    in_order = F.array_sort(F.transform("_hashed", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(~unlike, in_order))
    counts = {
        "n_words": F.size("_words"), "word_chars": F.length(F.regexp_replace(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")), "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered_words()),
    }
    return df.withColumns({k: c.cast("long") for k, c in counts.items()}).drop("_words", "_lines", "_hashed", "_sorted")


def vector() -> dict[str, Column]:
    rate = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    mean = (F.col("word_chars") + PRIOR * PRIOR_WORDS) / (F.col("n_words") + PRIOR_WORDS)
    return dict(zip(X, (mean, rate("n_symbols", "word_chars"), rate("n_dup_lines", "n_lines"), rate("n_repeat_words", "n_words"))))


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def consistency(share: float = SHARE, dof: int = len(X)) -> float:
    """What the scatter of the closest share of normal data must be multiplied by."""
    low, high = 0.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < share else (low, mid)
    return share / chi2_cdf(low, dof + 2)


def factored(stats: DataFrame) -> DataFrame:
    """Adds l00 ... l33, the Cholesky factor of the scatter v00 ... v33, and log_det, the log of its determinant."""
    for i in range(len(X)):
        for j in range(i + 1):
            rest = F.col(f"v{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            stats = stats.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(len(X))), F.lit(0.0))
    return stats.select("grp", log_det.alias("log_det"), *ESTIMATE)


def with_distance(rows: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the estimate of grp, by forward substitution; null without one."""
    out = rows.join(F.broadcast(stats) if few else stats, "grp", "left")
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(X))), F.lit(0.0))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def scatter(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and covariance by group, the covariance times factor and with the floors added."""
    aggregates = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
    for i in range(len(X)):
        for j in range(i + 1):
            floor = FLOORS[i] ** 2 if i == j else 0.0
            aggregates.append((F.covar_pop(X[i], X[j]) * factor + floor).alias(f"v{i}{j}"))
    return rows.groupBy("grp").agg(*aggregates)


def from_medians(rows: DataFrame) -> DataFrame:
    """Medians, and scatters from the middle halves."""
    quartiles = rows.groupBy("grp").agg(*(F.percentile_approx(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.lit(1000)).alias(f"q{i}") for i, x in enumerate(X)))
    columns = [F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(len(X))]
    for i in range(len(X)):
        sd = (F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349
        columns += [(sd * sd + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"v{i}{j}") for j in range(i + 1)]
    return quartiles.select("grp", *columns)


def concentrated(rows: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """One step: the estimates from the share of each group's rows that is closest to stats."""
    far = with_distance(rows, stats.drop("log_det"), few).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * LOG_BINS))
    w = Window.partitionBy("grp")
    bins = far.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    run = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    edge = run.filter(F.col("upto") >= F.ceil(F.col("all") * SHARE)).groupBy("grp").agg(F.min("bin").alias("edge"))
    close = far.join(F.broadcast(edge) if few else edge, "grp").filter("bin <= edge")
    return factored(scatter(close, consistency()))


def fit(rows: DataFrame, few: bool) -> DataFrame:
    """A factored estimate for each grp of rows (columns grp, x0 ... x3), which must be cheap to read again.

    Both starts go through the same steps side by side, as groups of their own.
    """
    starts = {"m|": from_medians(rows), "c|": scatter(rows, 1.0)}
    first = reduce(DataFrame.unionByName, (df.withColumn("grp", F.concat(F.lit(name), "grp")) for name, df in starts.items()))
    each = rows.withColumn("grp", F.explode(F.array(*(F.concat(F.lit(name), "grp") for name in starts))))
    # The determinant of a start is of other rows than the steps'; the first step's is the first that can fall.
    now = cut(concentrated(each, factored(first), few))
    active, open_ = each, True
    while open_:
        later = concentrated(active, now, few).select("grp", *(F.col(c).alias(f"_{c}") for c in ("log_det", *ESTIMATE)))
        falls = F.coalesce(F.col("_log_det") < F.col("log_det") - FALL, F.lit(False))
        both = cut(now.join(later, "grp", "left").withColumn("falls", falls))
        now = both.select("grp", *(F.when(F.col("falls"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("log_det", *ESTIMATE)))
        going = both.filter("falls").select("grp")
        active, open_ = each.join(F.broadcast(going) if few else going, "grp", "left_semi"), going.limit(1).count()
    least = F.min_by(F.struct(*ESTIMATE), "log_det").alias("s")
    return cut(now.groupBy(F.expr("substring(grp, 3)").alias("grp")).agg(least).select("grp", "s.*"))


def with_groups(rows: DataFrame, usable: Column) -> tuple[DataFrame, bool]:
    """Adds fine and coarse, the names of a text's groups, and grp, the first of fine, coarse and all with enough usable rows;
    also whether groups are few."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    named = rows.withColumn("fine", F.concat(part("lang"), F.lit("/"), part("source"))).withColumn("coarse", part("lang"))
    sizes = cut(named.groupBy("fine", "coarse").agg(F.count(F.when(usable, 1)).alias("n")))
    few = sizes.count() <= BROADCAST_GROUPS
    whole = sizes.groupBy("coarse").agg(F.sum("n").alias("coarse_n"))
    grp = F.when(F.col("n") >= LEAST_ROWS, F.col("fine")).when(F.col("coarse_n") >= LEAST_ROWS, F.col("coarse")).otherwise(ALL)
    table = sizes.join(whole, "coarse").select(F.col("fine").alias("_fine"), grp.alias("grp"))
    return named.join(F.broadcast(table) if few else table, F.col("fine") == F.col("_fine")).drop("_fine"), few


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut_at: float = CUT) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared; null where there is no estimate) and kept."""
    named = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), *(col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))))
    rows = statistics(id_and_text(named, "doc_id", "text", "lang", "source")).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut(rows.withColumns(vector()).withColumn("base_failed", failed))
    sound, few = with_groups(rows, ~F.col("base_failed"))
    # A text counts in all its groups, whichever of them it is measured by.
    fine = sound.filter("not base_failed").select(F.explode(F.array("fine", "coarse", F.lit(ALL))).alias("grp"), *X)
    stats = fit(cut(fine), few)
    out = with_distance(sound, stats, few)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cut_at)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` judged."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
