"""Mixing sources to target weights: capped water-filling over sources, seeded whole and fractional repetitions.

``water_fill`` finds each source's target: a total is shared by weight; a source whose share is above ``max_epochs`` times
its size is clamped there, and the excess is shared anew among the others by weight until none is above. The loop keeps one
row per source and fetches three sums a round.

``take`` turns targets into repetitions: with e = target / size, every document is taken floor(e) times whole; what then
lacks is met by documents in a seeded order, whole as long as they fit, and the document at the border is taken in part.
The order goes by the id, then by the text, then by the row's own number, so that rows of one id and equal rows are ordered
too. The border is found by histograms of the order, ten bits at a time, so that no source is ever sorted in one task.

Edge cases: a null text counts 0 words; a null source is a source of its own; a source of size 0 has target 0; rows of one
id, or without id, are taken one by one like any others (which of quite equal rows is taken is open, how many is not); an
empty table gives an empty result; other columns are kept by ``repeat`` and left out by ``mix``. Documents without words are
repeated like their source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, WORD, col, cut

EPOCHS, SHARE, WEIGHTS, SEED = 2.0, 1.5, (3.0, 1.0, 2.0), 17
DIGITS = 10  # bits of the seeded order that one histogram resolves

#: Up to so many sources, their targets are broadcast; beyond, joins shuffle and adaptive execution splits hot sources.
BROADCAST_SOURCES = 20_000
#: Up to so many rows of border cells are broadcast; a source can have CELL_ROWS of them.
BROADCAST_EDGES = 200_000
PLACES, CELL_ROWS = 52, 1000  # bits of a place; rows a border cell may have
KEYS = ("k0", "k1", "k2")  # places of a row by its id, its text and its number


def hinted(small: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(small) if few else small


def word_count(text: Column) -> Column:
    """Number of words: breaks of white space in the trimmed text, plus one."""
    bare = F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """sources has size, weight and any keys, a row a source; adds target. What cannot be placed, all being at their limit, is left out."""
    state = cut(sources.select("*", (F.col("size") * F.lit(max_epochs)).alias("_cap"), (F.col("size") <= 0).alias("_full")))
    while True:
        placed, open_weight = state.agg(F.sum(F.when(F.col("_full"), F.col("_cap"))), F.sum(F.when(~F.col("_full"), F.col("weight")))).first()
        level = max(0.0, total - (placed or 0.0)) / open_weight if open_weight else 0.0
        share = F.col("weight") * F.lit(level)
        above = ~F.col("_full") & (share > F.col("_cap"))
        if not open_weight or not state.filter(above).limit(1).count():
            return state.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(share, F.col("_cap")))).drop("_cap", "_full")
        state = cut(state.withColumn("_full", F.col("_full") | above))


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """Adds rank, from 0, by code point with null last; a distributed sort, then numbering by partition."""
    spark, schema = sources.sparkSession, sources.schema.add("rank", "long")
    numbered = sources.orderBy(F.col(key).asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return spark.createDataFrame(numbered, schema)


def seeded(seed: int, *keys: Column) -> Column:
    """A place in the seeded order: 52 bits of an MD5 digest, so that other engines can follow it."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def numbered(df: DataFrame, columns: list[Column], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """columns, and for each row uid, doc_id, source, size and mark, a hash of the text; kept, so that uid stays as it is."""
    text = col(text_col).cast("string")
    own = [F.monotonically_increasing_id().alias("uid"), col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("mark")]
    return cut(df.select(*columns, *own))


def places(seed: int) -> list[Column]:
    """The keys of the seeded order."""
    by_text = seeded(seed, F.col("doc_id"), F.col("mark"))
    return [seeded(seed, F.col("doc_id")).alias("k0"), by_text.alias("k1"), F.shiftrightunsigned(F.xxhash64("uid"), 64 - PLACES).alias("k2")]


@dataclass
class Cell:
    """Where a source's border lies: in the rows that agree with low0, low1, ... in the keys before the level, and in that
    level's key but for its last ``top`` bits."""

    level: int
    top: int

    def holds(self) -> Column:
        exact = [F.col(KEYS[i]) == F.col(f"low{i}") for i in range(self.level)]
        return reduce(Column.__and__, exact, F.shiftright(KEYS[self.level], self.top) == F.shiftright(f"low{self.level}", self.top))

    def after(self) -> Column:
        """Whether a row comes before the cell."""
        out = F.shiftright(KEYS[self.level], self.top) < F.shiftright(f"low{self.level}", self.top)
        for i in reversed(range(self.level)):
            out = (F.col(KEYS[i]) < F.col(f"low{i}")) | ((F.col(KEYS[i]) == F.col(f"low{i}")) & out)
        return out


@dataclass
class Plan:
    """How sources are taken. rules: a row a source, with source_size, target, whole, lack and, where there is a border, the
    first places of its cell (low0 ...); edges: (uid, part) for rows of border cells, part the words to take of one more
    repetition."""

    rules: DataFrame
    edges: DataFrame
    cell: Cell
    few: bool
    seed: int


def plan(docs: DataFrame, targets: DataFrame, seed: int) -> Plan:
    """docs: uid, doc_id, source, size and mark, a row a document, cheap to read again. targets: source, source_size, target."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    lack = (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")
    goals = cut(targets.withColumn("whole", whole).withColumn("lack", lack))
    few = goals.count() <= BROADCAST_SOURCES
    at = docs.select(F.col("source").alias("_s"), "uid", F.col("size").alias("_n"), *places(seed))
    same_source = F.col("_s").eqNullSafe(F.col("source"))
    # Narrow down to each source's border cell. low: its first place, before: words of all places below it.
    lows = [f"low{i}" for i in range(len(KEYS))]
    border = goals.select("source", "lack", F.lit(0).cast("long").alias("before"), *(F.lit(0).cast("long").alias(x) for x in lows))
    cell = Cell(0, PLACES)
    while True:
        shift = max(0, cell.top - DIGITS)
        inside = at.join(hinted(border, few), same_source).filter(cell.holds())
        counted = inside.groupBy("source", "lack", "before", *lows, F.shiftright(KEYS[cell.level], shift).alias("cell")).agg(F.sum("_n").alias("n"), F.count("*").alias("rows"))
        w = Window.partitionBy("source").orderBy("cell")
        run = counted.withColumn("to", F.col("before") + F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
        here = run.filter((F.col("from") <= F.col("lack")) & (F.col("lack") < F.col("to")))
        own = lows[cell.level]
        found = cut(here.select("source", "lack", F.col("from").alias("before"), *(F.shiftleft("cell", shift).alias(x) if x == own else x for x in lows), "rows"))
        border, cell = found.drop("rows"), Cell(cell.level, shift)
        if (found.agg(F.max("rows")).first()[0] or 0) <= CELL_ROWS or (not shift and cell.level == len(KEYS) - 1):
            break
        if not shift:
            cell = Cell(cell.level + 1, PLACES)
    # In the border cell a running sum decides.
    inside = at.join(hinted(border, few), same_source).filter(cell.holds())
    seen = F.col("before") + F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy(*KEYS, "uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.least(F.col("_n"), F.greatest(F.lit(0), F.col("lack") - seen))
    edges = cut(inside.select("uid", part.cast("long").alias("part")))
    rules = goals.join(border.select(F.col("source").alias("_s"), *lows), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return Plan(cut(rules), edges, cell, few, seed)


def take(docs: DataFrame, how: Plan) -> DataFrame:
    """docs (of ``numbered``) with source_size, target, whole (repetitions in full) and part (words of one more).

    Rows are not shuffled where sources are few: all but those of border cells are decided by their source and place alone.
    """
    rules = hinted(how.rules.withColumnRenamed("source", "_s"), how.few)
    edges = hinted(how.edges.select(F.col("uid").alias("_uid"), F.col("part").alias("_part")), how.edges.count() <= BROADCAST_EDGES)
    found = docs.withColumns(dict(zip(KEYS, places(how.seed)))).join(rules, F.col("source").eqNullSafe(F.col("_s")))
    found = found.join(edges, F.col("uid") == F.col("_uid"), "left")
    below = F.when(F.col("low0").isNull(), F.col("lack") > 0).otherwise(how.cell.after())
    part = F.coalesce("_part", F.when(below, F.col("size")).otherwise(0))
    lows = [f"low{i}" for i in range(len(KEYS))]
    return found.withColumn("part", part.cast("long")).drop(*KEYS, *lows, "_s", "_uid", "_part", "lack")


def make_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = EPOCHS, seed: int = SEED) -> Plan:
    """The plan for docs (of ``numbered``).

    Sources by code point, null last, have the given weights in turn; together they share ``share`` times all words.
    """
    sources = ranked(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    total = share * (docs.agg(F.sum("size")).first()[0] or 0)
    filled = water_fill(sources.select("source", F.col("source_size").alias("size"), weight.alias("weight")), total, max_epochs)
    return plan(docs.select("uid", "doc_id", "source", "size", "mark"), filled.select("source", F.col("size").alias("source_size"), "target"), seed)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole, part. Options as in ``make_plan``."""
    docs = numbered(df, [], id_col, text_col, source_col)
    return take(docs, make_plan(docs, **options)).drop("uid", "mark")


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """df as mixed: a row for every repetition; one that is taken in part has its first words, joined by blanks."""
    names = df.columns
    docs = numbered(df, [F.struct(*(col(c).alias(f"c{i}") for i, c in enumerate(names))).alias("row")], id_col, text_col, source_col)
    copies = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>")))
    each = take(docs, make_plan(docs, **options)).select("row", "size", F.explode(copies).alias("words"))
    text = F.col("row")[f"c{names.index(text_col)}"]
    words = F.array_remove(F.split(text, SPACES, -1), "")
    cut_text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(text)
    return each.select(*((cut_text if c == text_col else F.col("row")[f"c{i}"]).alias(c) for i, c in enumerate(names)))


def op4_mixture(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to weights 3, 1, 2 in turn, 150 % of all words, two epochs at most."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), steps AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS placed,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources
), clamped AS (
  SELECT *, source_size = 0 OR weight * ((total - placed) / open_weight) > cap AS is_full FROM steps
), level AS (
  SELECT (max(total) - coalesce(sum(cap) FILTER (is_full), 0)) / sum(weight) FILTER (NOT is_full) AS level FROM clamped
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(weight * level, cap) END AS target,
         CASE WHEN source_size > 0 THEN floor((CASE WHEN is_full THEN cap ELSE least(weight * level, cap) END) / source_size) ELSE 0 END::BIGINT AS whole
  FROM clamped, level
), ordered AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, round(t.target)::BIGINT - t.whole * t.source_size AS lack,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, lack - seen)))::BIGINT AS taken FROM ordered
"""
