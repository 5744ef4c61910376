"""Helpers that every operator shares: table loading, private names, lineage cuts, time as integers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of every column that an operator makes for itself and drops again.
PRIVATE = "__tl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables; zone-less timestamps are read as UTC, so the session has to run in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken, name: str) -> str:
    """``name``, with as many underscores appended as it takes to differ from every name in ``taken`` (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def ident(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (the latter is UTC)."""
    return F.unix_micros((ident(c) if isinstance(c, str) else c).cast("timestamp"))


def div(a: Column, b: Column) -> Column:
    """The quotient of two 64-bit integers without its fraction; exact, unlike a division by way of doubles."""
    return F.call_function("div", a, b)


def _shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in ``spark.checkpoint.dir``. Only a session that runs in one
    process (local runs and tests) gets a temporary folder where that is unset; on a cluster, whose machines don't
    share such a folder, it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidelog-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, for tables that are written and read again."""
    return f"{_shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows. It is a plain count, added up in every task; a limit would send up to
    the bound from every partition to one task first."""
    return df.count() <= bound


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
