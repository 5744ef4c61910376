"""One form for texts that look the same but are written with different characters.

A transducer is compiled once per process from rules and a small fixed table. Its sources are single code points
(widths, spaces, invisible signs, look-alike letters) and sequences of a base with what attaches to it (accents,
vowel signs, jamo); each is mapped to the characters that it looks like. It runs once over a text, cluster by cluster:
the cluster's characters are replaced, its accents put in canonical order, and from the base on the longest sequence
in the table is taken. The table is checked when it is built: no source may have two targets, no target may be
rewritten again, and a mapping must keep case, accents and digits, so texts that differ in those stay apart.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import PRIVATE, cut, ident

#: Cyrillic and Greek letters and the Latin ones of the same look, in the same order.
LOOK_ALIKES = (
    ("АВЕКМНОРСТУХІЈЅԚԜҮѴ", "ABEKMHOPCTYXIJSQWYV"),
    ("аеорсухіјѕһԁԛԝѵӏ", "aeopcyxijshdqwvl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("οϲϳν", "ocjv"),
)

#: Format characters that do show, and others that don't though their category doesn't say so.
VISIBLE_FORMATS = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

_LAST = 0x30000


def _marks(text: str) -> str:
    return "".join(sorted(c for c in unicodedata.normalize("NFD", text) if unicodedata.combining(c)))


def _code_points() -> Iterator[str]:
    return map(chr, sorted({*range(0x80, 0xD800), *range(0xE000, _LAST), *INVISIBLE}))


class Transducer:
    """The compiled mapping: ``table`` holds every source, code points and sequences; ``apply`` rewrites a text."""

    def __init__(self, look_alikes=LOOK_ALIKES):
        letters: dict[str, str] = {}
        for sources, targets in look_alikes:
            for a, b in zip(sources, targets, strict=True):
                self._add(letters, a, b)
        self.table: dict[str, str] = {}
        self._parts: dict[str, str] = {}  # what a character looks like, taken apart into bases and accents
        self._class: dict[str, int] = {}  # accents and whatever else follows a base, with their canonical class
        for ch in _code_points():
            kind = unicodedata.category(ch)
            if kind == "Cn" and ord(ch) not in INVISIBLE:
                continue
            if ord(ch) in INVISIBLE or (kind == "Cf" and ord(ch) not in VISIBLE_FORMATS):
                look = ""
            elif kind == "Zs":
                look = " "
            else:
                look = unicodedata.normalize("NFKD", ch)
                if look[:1] == " " and len(look) > 1:  # a spacing accent is a sign by itself
                    look = ch
                look = "".join([letters.get(c, c) for c in look])
                if unicodedata.combining(ch):
                    self._class[ch] = unicodedata.combining(ch)
                apart = unicodedata.normalize("NFD", ch)
                if len(apart) > 1 and unicodedata.normalize("NFC", apart) == ch and unicodedata.normalize("NFKD", ch) == apart:
                    self._add_sequences("".join([letters.get(c, c) for c in apart]))
            if look != ch:
                self._parts[ch] = look
                whole = unicodedata.normalize("NFC", look)
                if whole != ch:
                    self._add(self.table, ch, whole)
        self._longest = max(map(len, self.table))
        attached = {ch for ch, look in self._parts.items() if not look or look[0] in self._class} | set(self._class)
        self._attached = frozenset(attached)
        self._run = re.compile("[^\\x00-\\x7f]+")  # ASCII has no source of its own and is skipped in stretches
        self._cluster = re.compile(f"[\\s\\S][{re.escape(''.join(sorted(attached)))}]*")  # a base with what is attached to it
        self._known: dict[str, str] = {}
        self._check(letters)

    @staticmethod
    def _add(table: dict[str, str], source: str, to: str) -> None:
        if table.setdefault(source, to) != to:
            raise ValueError(f"{source!r} is mapped to both {table[source]!r} and {to!r}")

    def _add_sequences(self, apart: str) -> None:
        """A base with its accents, and the same with some of them already joined to the base."""
        to = unicodedata.normalize("NFC", apart)
        for c in apart[1:]:
            self._class.setdefault(c, unicodedata.combining(c))
        for joined in range(1, len(apart)):
            source = unicodedata.normalize("NFC", apart[:joined]) + apart[joined:]
            if source != to:
                self._add(self.table, source, to)

    def _check(self, letters: dict[str, str]) -> None:
        for source, to in self.table.items():
            if any(c in self.table for c in to):
                raise ValueError(f"{source!r} becomes {to!r}, which is rewritten again")
        for source, to in letters.items():
            if source.isupper() != to.isupper() or source.isdigit() != to.isdigit() or _marks(source) != _marks(to):
                raise ValueError(f"{source!r} and {to!r} differ in case, digit or accent")

    def _ordered(self, follow: str) -> str:
        """Accents in canonical order; what has class 0 stays where it is."""
        out: list[str] = []
        run: list[str] = []
        for c in follow:
            if self._class.get(c, 0):
                run.append(c)
            else:
                out += [*sorted(run, key=self._class.__getitem__), c]
                run = []
        return "".join(out + sorted(run, key=self._class.__getitem__))

    def _joined(self, base: str, follow: str) -> str:
        """The longest sequence in the table from the base on; then accents behind one that no sequence has."""
        follow = self._ordered(follow) if len(follow) > 1 else follow
        for n in range(min(len(follow), self._longest - 1), 0, -1):
            to = self.table.get(base + follow[:n])
            if to is not None:
                base, follow = to, follow[n:]
                break
        rest: list[str] = []
        last = 0  # class of the accent before; none can pass one of class 0 or of its own
        for c in follow:
            to = self.table.get(base + c) if not rest or last < self._class[c] else None
            if to is None:
                rest.append(c)
                last = self._class[c] if self._class[c] and last < 256 else 256
            else:
                base = to
        return base + "".join(rest)

    def _cluster_form(self, cluster: str) -> str:
        if len(cluster) == 1:
            return self.table.get(cluster, cluster)
        look = "".join([self._parts.get(c, c) for c in cluster])
        out, at = [], 0
        while at < len(look):
            end = at + 1
            while end < len(look) and look[end] in self._class:
                end += 1
            if end == at + 1:
                out.append(look[at])
            elif look[at] in self._class:  # accents without a base, at the start of a text
                out.append(self._ordered(look[at:end]))
            else:
                out.append(self._joined(look[at], look[at + 1 : end]))
            at = end
        return "".join(out)

    def _rewrite(self, run: str) -> str:
        got = self._known.get(run)
        if got is None:
            got = "".join(map(self._cluster_form, self._cluster.findall(run)))
            if len(run) <= 32 and len(self._known) < 100_000:
                self._known[run] = got
        return got

    def apply(self, text: str) -> str:
        """The form of a text. ASCII texts are their own form."""
        if text.isascii():
            return text
        out, at = [], 0
        for m in self._run.finditer(text):
            start = m.start()
            if start > at and text[start] in self._attached:
                start -= 1  # the ASCII character before it is its base
            out += (text[at:start], self._rewrite(text[start : m.end()]))
            at = m.end()
        return "".join(out) + text[at:]


@functools.cache
def transducer() -> Transducer:
    """The transducer of this process."""
    return Transducer()


def form(text: str | None) -> str | None:
    """The one form of a text; null stays null."""
    return None if text is None else transducer().apply(sys.intern(text) if len(text) < 64 else text)


def _udf(f, kind):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        rewrite = transducer().apply
        return pd.Series([None if t is None else f(rewrite(t)) for t in texts], dtype=object)

    return run


def form_column(text: Column) -> Column:
    """The one form of every text of a column: whole texts, nulls stay null, empty texts empty."""
    return _udf(lambda x: x, T.StringType())(text)


def digest_column(text: Column) -> Column:
    """A 16-byte digest of every text's form. Only the digest leaves the worker."""
    return _udf(lambda x: hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest(), T.BinaryType())(text)


def with_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """All columns of ``df`` and the form of the column ``text``; a column of the name ``out`` is replaced."""
    return df.withColumn(out, form_column(ident(text)))


#: Members of one spelling that one task pairs; a spelling with more is split.
MEMBERS = 100_000


def _classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per document digests of its form and of its text as written, computed once: 32 bytes each are all that is kept."""
    return cut(df.where(ident(text).isNotNull()).select(ident(doc_id).alias("doc_id"), digest_column(ident(text)).alias("form"), F.unhex(F.md5(ident(text))).alias("written")))


def look_alike_classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: ``doc_id``, ``form_id`` (the smallest id among the documents of its form), ``text_id``
    (the smallest among those with the identical text), ``n_docs`` of the form and ``n_texts``, its different
    spellings. Documents without text have nulls and counts of 1."""
    rows = _classes(df, doc_id, text)
    texts = rows.groupBy("form", "written").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("c"))
    forms = texts.groupBy("form").agg(F.min("text_id").alias("form_id"), F.sum("c").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    single = F.col("n_docs") == 1
    # documents alone in their form, most of them, need no second meeting; the others meet their class, split by salt
    some = texts.join(forms.where(~single), "form").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / MEMBERS))))
    lone = forms.where(single).select(F.col("form_id").alias("doc_id"), "form_id", F.col("form_id").alias("text_id"), "n_docs", "n_texts")
    members = _salted(rows, texts)
    found = members.join(some, ["form", "written", "salt"]).select("doc_id", "form_id", "text_id", "n_docs", "n_texts").unionByName(lone)
    none = df.where(ident(text).isNull()).select(ident(doc_id).alias("doc_id"), F.lit(None).cast("long").alias("form_id"), F.lit(None).cast("long").alias("text_id"), F.lit(1).cast("long").alias("n_docs"), F.lit(1).cast("long").alias("n_texts"))
    return found.unionByName(none)


def _salted(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents with the part of their spelling that they belong to: 0, unless it has more than ``MEMBERS``."""
    # one row per MEMBERS documents at most
    large = texts.where(F.col("c") > MEMBERS).select("form", "written", F.floor((F.col("c") - 1) / MEMBERS).alias("last"))
    return rows.join(F.broadcast(large), ["form", "written"], "left").select("form", "written", "doc_id", F.pmod(F.xxhash64("doc_id"), F.coalesce("last", F.lit(0)) + 1).alias("salt"))


def look_alike_pairs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every two documents that look the same and differ in characters: ``doc_id_a < doc_id_b``.

    Identical texts are classes: pairs are formed between the classes of a form and then between their members, so
    however many copies a text has, copies are never compared with each other, and a class of more than ``MEMBERS`` is
    split over several tasks. Null texts look like nothing; empty texts look the same and are identical, so they form
    no pair. An empty table gives none.
    """
    rows = _classes(df, doc_id, text)
    texts = rows.groupBy("form", "written").agg(F.count(F.lit(1)).alias("c"))
    several = texts.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    few = texts.join(several, "form", "left_semi").select("form", "written", F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / MEMBERS)).alias("salts"))
    a, b = few.withColumnsRenamed({"written": "wa", "salts": "sa"}), few.withColumnsRenamed({"written": "wb", "salts": "sb"})
    pairs = a.join(b, "form").where("wa < wb")
    members = _salted(rows, texts).join(few.select("form", "written", F.explode("salts").alias("salt")), ["form", "written", "salt"], "left_semi")
    left = members.select("form", F.col("written").alias("wa"), F.col("salt").alias("sa"), F.col("doc_id").alias(PRIVATE + "x"))
    right = members.select("form", F.col("written").alias("wb"), F.col("salt").alias("sb"), F.col("doc_id").alias(PRIVATE + "y"))
    both = pairs.withColumn("sa", F.explode("sa")).join(left, ["form", "wa", "sa"]).withColumn("sb", F.explode("sb")).join(right, ["form", "wb", "sb"])
    x, y = F.col(PRIVATE + "x"), F.col(PRIVATE + "y")
    return both.select(F.least(x, y).alias("doc_id_a"), F.greatest(x, y).alias("doc_id_b"))
