"""Results to files, and events to the store."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import ident
from tidelog.functions.values import number_text


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as the text of a CSV cell: null is empty, bytes are base64, lists JSON; a text that a spreadsheet
    would take for a formula gets an apostrophe in front."""

    def cell(f: T.StructField) -> Column:
        c, kind = ident(f.name), f.dataType
        if isinstance(kind, T.StringType):
            return F.when(c.rlike(r"^[=+\-@\t\r\n']"), F.concat(F.lit("'"), c)).otherwise(c)
        if isinstance(kind, T.BinaryType):
            return F.base64(c)
        if isinstance(kind, T.BooleanType):
            return c.cast("string")
        if isinstance(kind, T.FloatType | T.DoubleType):
            return number_text(c)
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
            return F.to_json(c, {"ignoreNullFields": "false"})
        return c.cast("string")

    return df.select(*[F.coalesce(cell(f), F.lit("")).alias(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, *, header: bool = True) -> None:
    """A folder of CSV files."""
    csv_cells(df).write.mode("overwrite").csv(path, header=header, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_rows(df: DataFrame, *, typed_integers: bool = False) -> DataFrame:
    """One column ``value`` with a JSON object per row; nulls are written. With ``typed_integers``, 64-bit integers are
    objects of type and text, which readers that know only doubles can't spoil."""

    def cell(f: T.StructField) -> Column:
        c = ident(f.name)
        if typed_integers and isinstance(f.dataType, T.LongType | T.DecimalType):
            return F.when(c.isNotNull(), F.struct(F.lit("sint64" if isinstance(f.dataType, T.LongType) else "decimal").alias("type"), c.cast("string").alias("value")))
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        if isinstance(f.dataType, T.BinaryType):
            return F.base64(c)
        return c

    return df.select(F.to_json(F.struct(*[cell(f).alias(f.name) for f in df.schema]), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, **options) -> None:
    """A folder of files with a JSON object per line."""
    json_rows(df, **options).write.mode("overwrite").text(path)


class EventStore:
    """Events in a folder by batch, index and month of event time.

    A batch is written under its token and replaces what that token wrote before, so a retried append changes
    nothing. Expired events vanish from reads; ``purge`` rewrites what still holds them. An index lies in folders of
    its own, named by a digest of its name, so that it can be dropped without touching others.
    """

    def __init__(self, spark: SparkSession, path: str, time: str = "_time"):
        self.spark, self.path, self.time = spark, path.rstrip("/"), time

    def append(self, events: DataFrame, token: str) -> None:
        if not token or not token.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a token consists of letters, digits, - and _")
        # folders' names begin with a letter, so that no reader takes them for numbers
        part = F.concat(F.lit("i-"), F.md5(F.coalesce(ident("index").cast("string"), F.lit("")).cast("binary"))) if "index" in events.columns else F.lit("all")
        rows = events.withColumn("part", part).withColumn("month", F.date_format(ident(self.time), "yyyy-MM"))
        rows.write.mode("overwrite").partitionBy("part", "month").parquet(f"{self.path}/batch=b-{token}")

    def _stored(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def read(self, now: Column | None = None) -> DataFrame:
        """All events that haven't expired; a store without any batch can't be read."""
        df = self._stored()
        if "expires_at" in df.columns:
            df = df.where(F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now)))
        return df

    def delete_index(self, index: str, into: str, tenant: str | None = None) -> EventStore:
        """A new store without an index's events (of one tenant, if given). The old one is left for readers at work."""
        gone = F.col("index") == index
        if tenant is not None:
            gone = gone & (F.col("tenant_id") == tenant)
        return self._rewrite(self._stored().where(~F.coalesce(gone, F.lit(False))), into)

    def drop_index(self, index: str) -> int:
        """Removes an index's folders from every batch, here and now, and nothing else; gives their number. Dropping
        again removes nothing. Readers at work on the index will fail."""
        digest = hashlib.md5(index.encode()).hexdigest()
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/part=i-{digest}")
        files = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [x.getPath() for x in files.globStatus(pattern) or []]
        for folder in folders:  # one per batch
            files.delete(folder, True)
        return len(folders)

    def purge(self, into: str, now: Column | None = None) -> EventStore:
        """A new store without expired events."""
        return self._rewrite(self.read(now), into)

    def _rewrite(self, df: DataFrame, into: str) -> EventStore:
        into = into.rstrip("/")
        df.write.mode("overwrite").partitionBy("batch", "part", "month").parquet(into)
        return EventStore(self.spark, into, self.time)


__all__ = ["EventStore", "csv_cells", "json_rows", "write_csv", "write_json_lines"]
