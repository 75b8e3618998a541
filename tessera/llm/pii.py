"""PII: regular expressions propose spans, checksums confirm them, context words adjust the score. DataFrame functions only.

Each kind has a pattern, a test that gives a base score or drops the match, and context words; one of them within
``CONTEXT`` characters before the match adds ``BONUS``. Spans that reach ``LEAST`` are found. The four base kinds reach it
by themselves; card numbers of 13 to 15 digits and social security numbers only with context.

Edge cases: a null or empty text has no spans; repeated rows and ids give a row each; an empty table gives an empty result;
other columns are left out by ``find_pii`` and kept by ``redact``. Spans of different kinds may overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import spans
from tessera.llm.common import col, id_and_text

CONTEXT, BONUS, LEAST = 48, 0.35, 0.5


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def with_length(d: Column, low: int, high: int, worth: float) -> Column:
    return F.when(F.length(d).between(low, high), F.lit(worth))


def octets(match: Column) -> Column:
    """Whether all dotted parts are at most 255; parts of any length are compared without leading zeros."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(match, "\\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def mod_97(match: Column) -> Column:
    """Whether the account number, its first four signs moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    bare = F.upper(F.regexp_replace(match, " ", ""))
    turned = F.concat(F.substring(bare, 5, 60), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    signs = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(signs, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.length(bare).between(15, 34) & (rest == 1)


#: kind: (pattern, quick test for texts worth searching, base score of a match, context words). Base kinds first, in order.
KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", lambda t: t.contains("@"), lambda m: F.lit(0.9), "mail|contact|write"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: F.when(octets(m), F.lit(0.6)), r"\bip\b|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda m: F.when(F.call_function("luhn_check", digits(m)), with_length(digits(m), 16, 19, 0.8)), "card|visa|credit|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: with_length(digits(m), 8, 15, 0.6), r"phone|\btel|call|mobile|fax"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{3}"), lambda m: F.when(mod_97(m), F.lit(0.9)), "iban|account|bank"),
    "short_card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda m: F.when(F.call_function("luhn_check", digits(m)), with_length(digits(m), 13, 15, 0.3)), "card|visa|credit|amex"),
    "ssn": (r"[0-9-]+", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: F.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~m.rlike("^(000|666|9)|-00-|-0000$"), F.lit(0.3)), r"\bssn\b|social security"),
}
BASE = ("email", "ip", "card", "phone")
#: \b in the above means a boundary of ASCII words, which Java's own does not.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def at_runs(pattern: str, signs: str) -> str:
    """The same matches of a pattern that begins with a run of signs, found in linear time.

    Where the pattern fails at one place of a run it fails at all later ones, as what must follow is the same. So it is tried
    only where a run begins or where the last match ended, and the run is never given back.
    """
    run = f"[{signs}]+"
    if not pattern.startswith(run):
        raise ValueError(pattern)
    return rf"(?:(?<![{signs}])|\G)[{signs}]++{pattern[len(run) :]}"


#: Where a kind's pattern would try each place of a long run, the way that the search takes in its place.
SEARCH = {"email": at_runs(KINDS["email"][0], "A-Za-z0-9._%+-").replace("[A-Za-z0-9-]+", "[A-Za-z0-9-]++"), "ip": at_runs(KINDS["ip"][0], "0-9").replace("[0-9]+)", "[0-9]++)")}


def with_spans(df: DataFrame, text: str, kinds: tuple[str, ...] = tuple(KINDS), least: float = LEAST) -> DataFrame:
    """Adds a column ``_<kind>`` of spans for each kind. Rows whose text is null have no spans."""
    for kind in kinds:
        pattern, maybe, base, words = KINDS[kind]
        pattern, words = SEARCH.get(kind, pattern).replace(r"\b", BOUNDARY), words.replace(r"\b", BOUNDARY)
        bonus = lambda before, words=words: F.when(F.lower(before).rlike(words), F.lit(BONUS)).otherwise(F.lit(0.0))
        df = spans.find(df, text, f"_{kind}", kind, pattern, maybe, base, bonus, CONTEXT, least)
    return df


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id and, for every kind, an array column of that name with the spans: kind, start, end, score."""
    found = with_spans(id_and_text(df, id_col, text_col), "text", least=least)
    return found.select("doc_id", *(F.col(f"_{k}").alias(k) for k in KINDS))


def redact(df: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """df with every span of every kind in text_col replaced by the kind in square brackets; a null text stays null."""
    names = df.columns
    inner = df.select(F.struct(*(col(c).alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    found = with_spans(inner, "text", least=least).withColumn("all", F.concat(*(F.col(f"_{k}") for k in KINDS)))
    clean = F.when(F.size("all") == 0, F.col("row")[f"c{names.index(text_col)}"]).otherwise(spans.masked(F.col("text"), F.col("all")))
    return found.select(*((clean if c == text_col else F.col("row")[f"c{i}"]).alias(c) for i, c in enumerate(names)))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all of ``documents``."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, all_ = (reduce(F.concat, (F.col(k) for k in kinds)) for kinds in (BASE, KINDS))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(spans.joined(base), 256).alias("base_sha256"),
        spans.joined(all_).alias("spans"), F.array_join(F.transform(all_, lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


#: By kind, for OP5_SQL: the base score of match s, null if it fails. Patterns and context words are those of KINDS.
SQL_SCORES = {
    "email": "0.9",
    "ip": "CASE WHEN list_aggregate([length(ltrim(p, '0')) < 4 AND CASE WHEN length(ltrim(p, '0')) < 4 THEN ('0' || ltrim(p, '0'))::INT <= 255 ELSE false END FOR p IN string_split(s, '.')], 'bool_and') THEN 0.6 END",
    "card": "CASE WHEN luhn AND length(d) BETWEEN 16 AND 19 THEN 0.8 END",
    "phone": "CASE WHEN length(d) BETWEEN 8 AND 15 THEN 0.6 END",
    "iban": "CASE WHEN length(replace(s, ' ', '')) BETWEEN 15 AND 34 AND rest = 1 THEN 0.9 END",
    "short_card": "CASE WHEN luhn AND length(d) BETWEEN 13 AND 15 THEN 0.3 END",
    "ssn": "CASE WHEN regexp_full_match(s, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(s, '^(000|666|9)|-00-|-0000$') THEN 0.3 END",
}


def sql() -> str:
    """The query as DuckDB SQL: matches are placed by the lengths of the pieces between them."""
    found = []
    for k, (kind, (pattern, *_)) in enumerate(KINDS.items()):
        p = pattern.replace("++", "+")  # possessive where nothing follows, so greedy is the same
        pieces = f"SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d"
        found.append(f"SELECT doc_id, text, {k} AS k, '{kind}' AS kind, unnest(list_zip(m, g[1:len(m)], range(len(m)))) AS z FROM ({pieces})")
    worth = " ".join(f"WHEN '{kind}' THEN {score}" for kind, score in SQL_SCORES.items())
    words = " ".join(f"WHEN '{kind}' THEN '{x[3]}'" for kind, x in KINDS.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)
    joined = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY k, a)"
    digit = "substr(reverse(d), i::INT + 1, 1)::INT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
placed AS (
  SELECT doc_id, text, k, kind, z[1] AS s, sum(length(z[1]) + length(z[2])) OVER (PARTITION BY doc_id, k ORDER BY z[3])::BIGINT AS e FROM found
),
parts AS (
  SELECT *, e - length(s) AS a, regexp_replace(s, '[^0-9]', '', 'g') AS d, CASE WHEN kind = 'iban' THEN
    array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END FOR c IN string_split(substr(replace(s, ' ', ''), 5) || left(replace(s, ' ', ''), 4), '')], '') END AS n
  FROM placed
),
checked AS (
  SELECT *, greatest(1, a - {CONTEXT} + 1) AS f,
    CASE WHEN kind LIKE '%card' THEN list_sum([CASE WHEN i % 2 = 0 THEN {digit} ELSE {digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END FOR i IN range(length(d))]) % 10 = 0 END AS luhn,
    (((left(n, 30)::HUGEINT % 97)::VARCHAR || substr(n, 31, 30))::HUGEINT % 97)::VARCHAR || substr(n, 61) AS tail
  FROM parts
),
scored AS (
  SELECT *, CASE kind {worth} END + CASE WHEN regexp_matches(lower(substr(text, f, a - f + 1)), CASE kind {words} END) THEN {BONUS} ELSE 0.0 END AS score
  FROM (SELECT *, tail::HUGEINT % 97 AS rest FROM checked)
),
spans AS (
  SELECT doc_id, {counts}, {joined} FILTER (k < {len(BASE)}) AS base, {joined} AS spans, string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY k, a) AS scores
  FROM scored WHERE score >= {LEAST} GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN spans USING (doc_id)
"""


OP5_SQL = sql()
