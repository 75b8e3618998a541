"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, as all word-based operators here understand it; the class is ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """The top-level column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, under fixed names, so that extra columns of any name do no harm.

    A null text becomes the empty text.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return df.select(col(id_col).alias("doc_id"), text.alias("text"), *(col(c).alias(c) for c in more))


def ship(df: DataFrame) -> None:
    """Send this package to the executors, once a session, so that they need not have it installed."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_tessera_shipped", False):
        top = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as folder:
            package = Path(folder, "package", top.name)
            shutil.copytree(top, package, ignore=shutil.ignore_patterns("__pycache__"))
            # The archive outlives this call: executors fetch it from the driver as they start.
            sc.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp(), "tessera")), "zip", package.parent))
        sc._tessera_shipped = True


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with one function made per task; a None result emits nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if batch.num_rows and (out := apply(batch)) is not None:
                yield out

    ship(df)
    return df.mapInArrow(run, schema)


#: Of a join's keys at most so many count as hot.
HOT_KEYS = 2000


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left with right's columns but n by key, without left's rows that right has no key for.

    right has one row a key and n, a long: how many rows of left have that key; total is at least the sum of n. Keys of more
    than a HOT_KEYS-th of total, which are fewer than HOT_KEYS, are broadcast, so that none gathers in a task; the others
    are shuffled. left is read twice and should be cheap to read.
    """
    hot = F.col("n") * HOT_KEYS > total
    top, rest = right.filter(hot).drop("n"), right.filter(~hot).drop("n")
    cold = left.join(F.broadcast(top.select(key)), key, "left_anti").join(rest, key)
    return left.join(F.broadcast(top), key).unionByName(cold)


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z folded and everything else as it is."""
    return text.encode("utf-8", "surrogatepass").lower()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in spark.checkpoint.dir, which driver and executors share, and cut its lineage there; survives the loss
    of executors. A session without that folder is refused unless it is local, where any folder is shared."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)
