"""WARC: Merkle fixity audit.

Pages become WARC records, and records, in the order that tasks read them, archives of at most ``RECORDS`` records; no row is
shuffled for it. ``read_warc`` reads archives that are files. A replica is a table of records with their archive, number and
offset range. Each record's digest is hashed with its offsets, and ``FANOUT`` ordered neighbours' hashes with their level
and offset range to a node, up to the archive's root. ``audit`` compares two replicas' roots and fetches, level by level,
only the children of nodes that differ; at the leaves it has located the damage.

Edge cases: a record whose bytes agree at other offsets is ``moved``; a null address or body is empty; a record whose bytes are null in a replica is ``missing``, one that only the
other replica has is ``extra``, and an archive that only one has is all missing or all extra; repeated rows and ids are
records each; an empty table gives an empty audit; other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, col, cut, ship

RECORDS, FANOUT = 1024, 16
LEVELS = 3  # FANOUT ** LEVELS covers RECORDS with room to spare


def warc_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """id and record, the bytes of a response record."""
    url, body = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (url_col, body_col))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(url, 256),
                    F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return df.select(col(id_col).alias("id"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def parse_warc(data: bytes | None) -> list[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of every whole record; stops where the bytes cease to be WARC."""
    out, at = [], 0
    while data and (m := re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n").match(data, at)):
        headers = dict(line.split(": ", 1) for line in m[1].decode("utf-8", "replace").split("\r\n") if ": " in line)
        size = headers.get("Content-Length", "")
        if not size.isdigit() or data[m.end() + int(size) : m.end() + int(size) + 4] != b"\r\n\r\n":
            break
        end = m.end() + int(size)
        out.append((at, end + 4 - at, headers, data[m.end() : end]))
        at = end + 4
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """id (the target address), file, seq, start, end and record of the whole records in the files that path names, and url
    and body. Files that begin like gzip are unpacked, offsets being those of the unpacked bytes; a file is read whole by one
    task, so archives should be of the usual size of a gigabyte or less."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = content.as_buffer().to_pybytes()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for seq, (start, n, headers, body) in enumerate(parse_warc(data)):
                    url = headers.get("WARC-Target-URI")
                    rows.append((url, path, seq, start, start + n, data[start : start + n], url, body))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["id", "file", "seq", "start", "end", "record", "url", "body"]) if rows else None

        return apply

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return arrow_map(files, make, "id string, file string, seq long, start long, end long, record binary, url string, body binary")


def lay_out(records: DataFrame, most: int = RECORDS) -> DataFrame:
    """id, file, seq, start, end and record: consecutive records of a task in archives of at most most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, seq, at = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for x in batch["record"]:
                if seq == most:
                    number, seq, at = number + 1, 0, 0
                n = len(x.as_buffer()) if x.is_valid else 0
                rows.append((f"{task:07d}-{number:07d}", seq, at, at + n))
                seq, at = seq + 1, at + n
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns, batch["record"]], ["id", "file", "seq", "start", "end", "record"])

    ship(records)
    return records.mapInArrow(run, f"id {dict(records.dtypes)['id']}, file string, seq long, start long, end long, record binary")


def leaves(replica: DataFrame) -> DataFrame:
    """replica with digest, the SHA-256 of each record (null if its bytes are), in place of the bytes."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests = [hashlib.sha256(x.as_buffer()).hexdigest() if x.is_valid else None for x in batch["record"]]
            return pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "file", "seq", "start", "end")), pa.array(digests, pa.string())], ["id", "file", "seq", "start", "end", "digest"])

        return apply

    return arrow_map(replica.select("id", "file", "seq", "start", "end", "record"), make, f"id {dict(replica.dtypes)['id']}, file string, seq long, start long, end long, digest string")


def tree(found: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """All nodes over leaves: file, level (0: leaves), node, start, end, digest and, of leaves, content, the record's own digest.

    Groups hold at most fanout rows.
    """
    hashed = lambda k, what: F.sha2(F.concat_ws(":", F.lit(str(k)), F.col("node").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), what), 256)
    level = found.select("file", F.lit(0).alias("level"), F.col("seq").alias("node"), "start", "end", F.coalesce("digest", F.lit("missing")).alias("content"))
    level = level.withColumn("digest", hashed(0, F.col("content")))
    out = level
    for k in range(1, levels + 1):
        parts = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy("file", F.expr(f"node div {fanout}").alias("up")).agg(F.min("start").alias("start"), F.max("end").alias("end"), parts.alias("parts"))
        level = level.withColumn("node", F.col("up")).withColumn("digest", hashed(k, F.array_join(F.col("parts.digest"), ",")))
        level = level.select("file", F.lit(k).alias("level"), "node", "start", "end", F.lit(None).cast("string").alias("content"), "digest")
        out = out.unionByName(level)
    return out


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Leaves that differ between two trees: file, seq, start, end, status. The trees must be cheap to read again."""
    bad: DataFrame | None = None
    for k in range(levels, -1, -1):
        a, b = (t.filter(F.col("level") == k) for t in (ours, theirs))
        if bad is not None:
            a, b = (t.join(bad.select("file", F.col("node").alias("up")), (t["file"] == bad["file"]) & (F.expr(f"node div {fanout}") == F.col("up")), "left_semi") for t in (a, b))
        b = b.select(*(F.col(c).alias(f"_{c}") for c in ("file", "node", "start", "end", "content", "digest")))
        both = a.join(b, (F.col("file") == F.col("_file")) & (F.col("node") == F.col("_node")), "full_outer").filter(~F.col("digest").eqNullSafe(F.col("_digest")))
        pick = lambda c: F.coalesce(c, f"_{c}").alias(c)
        gone = lambda c: F.col(c).isNull() | (F.col(c) == "missing")
        status = F.when(gone("_content"), "missing").when(gone("content"), "extra").when(F.col("content") == F.col("_content"), "moved").otherwise("corrupt")
        bad = cut(both.select(pick("file"), pick("node"), pick("start"), pick("end"), status.alias("status")))
    return bad.withColumnRenamed("node", "seq")


def damaged(records: DataFrame, seed: int = 7) -> DataFrame:
    """A replica for drills: of 256 records one has a byte changed, one has lost its bytes and one is said to lie seven bytes
    further on, by a digest of seed and id."""
    mark = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 2)
    text = F.col("record").cast("string")
    changed = F.concat(F.substring(text, 1, 9), F.lit("X"), F.expr("substring(cast(record as string), 11)")).cast("binary")
    shift = F.when(mark == "02", F.lit(7)).otherwise(F.lit(0))
    records = records.withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift)
    return records.withColumn("record", F.when(mark == "00", changed).when(mark == "01", F.lit(None).cast("binary")).otherwise(F.col("record")))


def op10_fixity(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` as records of a store, audited against a damaged replica: each record's digest and what was found of it."""
    store = lay_out(warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    found = cut(leaves(store))
    bad = audit(cut(tree(found)), cut(tree(leaves(damaged(store)))))
    at = bad.select(F.col("file").alias("_file"), F.col("seq").alias("_seq"), "status")
    joined = found.join(at, (F.col("file") == F.col("_file")) & (F.col("seq") == F.col("_seq")), "left")
    return joined.select(F.col("id").alias("page_id"), (F.col("end") - F.col("start")).alias("record_bytes"), F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


#: The drill is done anew, and statuses follow from comparing the two replicas' records.
OP10_SQL = r"""
WITH records AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || sha256(coalesce(url, '')) || '>' || chr(13) || chr(10) || 'Content-Type: text/html'
    || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    substr(md5('7:' || coalesce(page_id::VARCHAR, '')), 1, 2) AS mark
  FROM pages
), replicas AS (
  SELECT page_id, record, CASE mark WHEN '00' THEN left(record, 9) || 'X' || substr(record, 11) WHEN '01' THEN NULL ELSE record END AS copy,
    CASE mark WHEN '02' THEN 7 ELSE 0 END AS further
  FROM records
)
SELECT page_id, octet_length(encode(record))::BIGINT AS record_bytes, sha256(record) AS record_sha256,
  CASE WHEN copy IS NULL THEN 'missing' WHEN sha256(copy) <> sha256(record) THEN 'corrupt' WHEN further <> 0 THEN 'moved' ELSE 'ok' END AS status
FROM replicas
"""
