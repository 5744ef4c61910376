"""Results kept to be read page by page."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import ident
from tidelog.operators.ordering import NUMBER, numbered
from tidelog.plans.engine import Session
from tidelog.plans.errors import DataError


class Retained:
    """The rows of a search, numbered in their established order and kept in a folder.

    A page is a range of numbers, which the reader finds by the files' own statistics; nothing is sorted or skipped
    again. Cursors are opaque and signed: one that was changed, or belongs to other results, is refused.
    """

    MOST = 10_000  # rows of one page

    def __init__(self, spark: SparkSession, path: str, secret: bytes):
        self.spark, self.path, self.secret = spark, path.rstrip("/"), secret
        self.columns = [c for c in spark.read.parquet(self.path).columns if c != NUMBER]

    @classmethod
    def keep(cls, session: Session, path: str, secret: bytes, source: str, *args, **options) -> Retained:
        """Runs a search and keeps its rows in ``path``."""
        rel = session.relation(source, *args, **options)
        numbered(rel).df.select(NUMBER, *[ident(c) for c in rel.public]).write.mode("overwrite").parquet(path)
        return cls(session.spark, path, secret)

    def _sign(self, body: bytes) -> bytes:
        return hmac.new(self.secret, self.path.encode() + b"\0" + body, hashlib.sha256).digest()[:16]

    def cursor(self, after: int) -> str:
        """The cursor of the page that begins behind row ``after``."""
        body = json.dumps({"after": after}).encode()
        return base64.urlsafe_b64encode(self._sign(body) + body).decode()

    def _after(self, cursor: str) -> int:
        try:
            data = base64.urlsafe_b64decode(cursor.encode())
            good = hmac.compare_digest(data[:16], self._sign(data[16:]))
            after = json.loads(data[16:])["after"] if good else None
        except (ValueError, KeyError):
            after = None
        if not isinstance(after, int):
            raise DataError("the cursor isn't one of these results")
        return after

    def page(self, size: int = 100, cursor: str | None = None) -> tuple[DataFrame, str]:
        """Up to ``size`` rows from a cursor on, in order, and the cursor of what follows; the last page is short."""
        if not 1 <= size <= self.MOST:
            raise DataError(f"a page has 1 to {self.MOST} rows")
        after = 0 if cursor is None else self._after(cursor)
        rows = self.spark.read.parquet(self.path).where(F.col(NUMBER).between(F.lit(after + 1), F.lit(after + size)))
        return rows.orderBy(NUMBER).select(*[ident(c) for c in self.columns]), self.cursor(after + size)
