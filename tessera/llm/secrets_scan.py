"""Secret scans: strong patterns, and multipart credentials linked by an interval join within scopes.

Strong spans (assigned secrets, access keys, long hex strings) are found by themselves. Weak candidates - account names,
tokens of high entropy, endpoints - count only where complementary parts co-occur: each span's scope reaches ``SCOPE``
characters to either side, spans of each role are joined by overlap of scopes, and a weak secret needs an identifier or an
endpoint there, a weak identifier or an endpoint a secret. The join is a search in sorted intervals, so a text with many
candidates takes n log n steps. A weak span that overlaps a strong one is dropped.

Edge cases: a null or empty text has no spans; repeated rows and ids give a row each; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, id_and_text
from tessera.llm.spans import joined

SCOPE, ENTROPY = 200, 3.6
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(r"""\b(?:user(?:name|id)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|ftps?|ssh|s3|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""", re.IGNORECASE | re.ASCII)

Span = tuple[int, int, int]  # start, end, number of the kind


def entropy(s: str) -> float:
    """Bits a character, by the string's own counts."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def strong(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


class Scopes:
    """Intervals of one role, to be asked whether any lies within reach of another."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, *_ in spans]
        self.furthest = list(accumulate((e for _, e, _ in spans), max))

    def near(self, start: int, end: int, reach: int) -> bool:
        i = bisect_right(self.starts, end + reach)
        return i > 0 and self.furthest[i - 1] >= start - reach


def weak(text: str, found: list[Span], reach: int) -> list[Span]:
    """Weak spans with their complement in reach."""
    ends = [(m.start(), m.end(), 5) for m in ENDPOINT.finditer(text)] if "://" in text else []
    ids = [(m.start(), m.end(), 3) for m in WEAK_ID.finditer(text)] if ":" in text or "=" in text else []
    if not ends and not ids and not found:
        return []
    secrets = []
    if ends or ids or any(k == 1 for *_, k in found):  # a weak secret needs one of these
        for m in WEAK_SECRET.finditer(text):
            s = m[0]
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= ENTROPY:
                secrets.append((m.start(), m.end(), 4))
    taken = Scopes(found)
    free = lambda spans: [x for x in spans if not taken.near(x[0] + 1, x[1] - 1, 0)]
    in_url = Scopes(ends)
    ids, ends, secrets = free(ids), free(ends), [x for x in free(secrets) if not in_url.near(x[0] + 1, x[1] - 1, 0)]
    secret = Scopes([x for x in found if x[2] != 1] + secrets)
    other = Scopes([x for x in found if x[2] == 1] + ids + ends)
    return [x for x in secrets if other.near(*x[:2], reach)] + [x for x in ids + ends if secret.near(*x[:2], reach)]


def scan(text: str, reach: int = SCOPE) -> list[Span]:
    """All spans of a text by start, then kind."""
    found = strong(text)
    return sorted(found + weak(text, found, reach), key=lambda x: (x[0], x[2], x[1]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = SCOPE) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then kind; code points from 0, end exclusive."""
    rows = id_and_text(df, id_col, text_col)

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in scan(t.as_py(), reach)] for t in batch["text"]]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

        return apply

    return arrow_map(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all of ``documents``."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def either_case(pattern: str) -> str:
    """pattern with each letter outside brackets and escapes in both cases, ASCII only."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() and not inside else c)
        i += 1
    return "".join(out).replace(r"\[xX]20", r"\x20")


def sql() -> str:
    """The query as DuckDB SQL; runs of a class in place of lookarounds, and joins of intervals by document."""
    quote = lambda p: p.replace("'", "''")
    patterns = {
        "assign": either_case(ASSIGN.pattern), "access": ACCESS.pattern, "hex": HEX.pattern, "weak_id": either_case(WEAK_ID.pattern),
        "weak_secret": "[A-Za-z0-9+/_=-]+", "endpoint": either_case(ENDPOINT.pattern).replace(r"\s", r"\x09-\x0D\x20"),
    }
    found = []
    for k, kind in enumerate(KINDS):
        p = quote(patterns[kind])
        pieces = f"SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d"
        found.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(list_zip(m, g[1:len(m)], range(len(m)))) AS z FROM ({pieces})")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)
    joined = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k, e)"
    near = lambda x, y, by: f"{y}.doc_id = {x}.doc_id AND {y}.a <= {x}.e + {by} AND {y}.e >= {x}.a - {by}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
placed AS (
  SELECT doc_id, k, kind, z[1] AS s, sum(length(z[1]) + length(z[2])) OVER (PARTITION BY doc_id, k ORDER BY z[3])::BIGINT AS e FROM found
),
shaped AS (
  SELECT doc_id, k, kind, s, e - length(s) AS a, e FROM placed WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(s, '{quote(patterns["assign"])}', 2)) >= 6
    WHEN 'access' THEN length(s) >= 20
    WHEN 'weak_secret' THEN regexp_full_match(s, '[A-Za-z0-9+/_-]{{20,128}}={{0,2}}') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')
      AND list_sum([length(s) - length(replace(s, c, '')) FOR c IN list_distinct(string_split(s, ''))]) = length(s)
      AND -list_sum([(length(s) - length(replace(s, c, ''))) / length(s)::DOUBLE * log2((length(s) - length(replace(s, c, ''))) / length(s)::DOUBLE) FOR c IN list_distinct(string_split(s, ''))]) >= {ENTROPY}
    ELSE true END
),
strong AS (SELECT * FROM shaped WHERE k < {len(BASE)}),
free AS (
  SELECT x.* FROM shaped x WHERE k >= {len(BASE)}
    AND NOT EXISTS (SELECT 1 FROM strong y WHERE {near("x", "y", -1)})
    AND NOT (kind = 'weak_secret' AND EXISTS (SELECT 1 FROM shaped y WHERE y.kind = 'endpoint' AND {near("x", "y", -1)}))
),
parts AS (SELECT *, kind IN ('assign', 'hex', 'weak_secret') AS secret FROM (FROM strong UNION ALL FROM free)),
linked AS (
  SELECT x.* FROM parts x WHERE k < {len(BASE)} OR EXISTS (SELECT 1 FROM parts y WHERE y.secret <> x.secret AND {near("x", "y", SCOPE)})
),
spans AS (SELECT doc_id, {counts}, {joined} FILTER (k < {len(BASE)}) AS base, {joined} AS spans FROM linked GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (doc_id)
"""


OP9_SQL = sql()
