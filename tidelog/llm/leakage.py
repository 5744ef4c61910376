"""Evaluation texts inside training texts, by spaced seeds.

A seed is a mask over a window of words: the words at its holes are ignored, the others are hashed together. Windows
of both sides with equal hashes are hits. A few masks with holes in different places find passages in which single
words were replaced, and every run of at least a window's length without any replacement. Around each hit the
words of document and item are then compared position by position, with the replacements allowed.

The corpus is read once. A filter made from the items' hashes, of a size that their number calls for up to a bound,
lets a worker drop nearly every window at once; only hits, and the stretch of words around them, leave it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import PRIVATE, cut, ident, rows_at_most
from tidelog.llm.lookalike import form

#: The masks; 1 counts, 0 is ignored. The window is 12 words, the shortest run that is a leak. Every inner
#: word is a hole of some mask, so one replaced word is found wherever it stands.
MASKS = ("110110110111", "111011011011", "101111011101", "111101101111")

#: log2 of the filter's bits, at least and at most (2 and 32 MB). Sixteen bits a window let one window in seventy pass by
#: chance; with more than 16 million windows more do, which costs time and changes no result.
FILTER_BITS = (24, 28)

#: Item windows are broadcast up to this many rows (some 20 MB), and with them the items' words, of which there can't be
#: many more than windows; beyond it both sides are shuffled, and what many documents carry is spread by document.
BROADCAST_ROWS = 500_000
SPLIT = 16

#: Words of documents that a worker hashes at a time.
CHUNK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text: the longest runs of letters and digits of its form, without case."""
    return _WORD.findall(form(text).casefold())


class _Hashes(dict):
    """64-bit hashes by word, kept for the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word."""
    if not text:
        return np.empty(0, np.uint64)
    found = words(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


@functools.cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window under a mask: a sum of the counted words' hashes times factors by position, mixed."""
    count = len(hashes) - len(mask) + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    factors, total = _factors(len(mask)), np.full(count, len(mask) + 31 * int(mask, 2), np.uint64)
    for i, sign in enumerate(mask):
        if sign == "1":
            total += hashes[i : i + count] * factors[i]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x9FB21C651E98DF25)
    return total ^ (total >> np.uint64(28))


def _filter_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(2**bits - 1)).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Ids of texts, the word hashes of all of them in a row, and where each text's words begin and the last one's end."""
    ids, parts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            parts.append(word_hashes(text))
            size += len(parts[-1])
            if size >= CHUNK_WORDS:
                yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                ids, parts, size = [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.where(ident(id_col).isNotNull() & ident(text).isNotNull()).select(ident(id_col).cast("long").alias("id"), ident(text).cast("string").alias("text"))


def _windows(df: DataFrame, id_col: str, text: str, masks: Sequence[str]) -> DataFrame:
    """``id, mask, pos, h`` for every window of every text under every mask."""
    span = len(masks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, bounds in _chunks(batches):
            text_of = np.repeat(np.arange(len(ids)), np.diff(bounds))
            at = np.arange(len(flat))
            at = at[at + span <= bounds[text_of + 1]]  # windows within one text
            for m, mask in enumerate(masks):
                if len(at):
                    cols = (np.array(ids, np.int64)[text_of[at]], np.full(len(at), m, np.int32), (at - bounds[text_of[at]]).astype(np.int32), seed_hashes(flat, mask)[at].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["id", "mask", "pos", "h"])

    return _texts(df, id_col, text).mapInArrow(run, "id long, mask int, pos int, h long")


def filter_bits(windows: int) -> int:
    """log2 of the bits of a filter for so many windows."""
    return min(max(FILTER_BITS[0], (16 * windows).bit_length()), FILTER_BITS[1])


def _filter(windows: DataFrame, bits: int) -> np.ndarray:
    """One bit per filter place, packed. It reaches the driver in words of 64 bits: at most 2^bits / 64 rows."""
    low = F.col("h").bitwiseAND(F.lit(2**bits - 1))
    high = F.shiftrightunsigned("h", 64 - bits)
    got = windows.select(F.explode(F.array(low, high)).alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("b"),
    ).toPandas()
    packed = np.zeros(2**bits // 64, np.uint64)
    packed[got["w"].to_numpy()] = got["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return packed


def _passes(h: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    a, b = _filter_places(h, bits)
    return ((packed[a >> 6] >> (a & 63).astype(np.uint64)) & (packed[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _hit_stretches(docs: DataFrame, doc_id: str, text: str, masks: Sequence[str], packed, bits: int) -> DataFrame:
    """Stretches of documents around windows that pass the filter: ``doc_id, start, ws`` (word hashes) and ``hits``
    (mask, position within the stretch, hash)."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("ws", T.ArrayType(T.LongType())),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("mask", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("h", T.LongType())]))),
    ])
    span = len(masks[0])
    hit_type = pa.struct([("mask", pa.int32()), ("pos", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, bounds in _chunks(batches):
            found: list[tuple[int, int, int]] = []
            for m, mask in enumerate(masks):
                h = seed_hashes(flat, mask)
                at = np.flatnonzero(_passes(h, packed.value, bits))
                text_of = np.searchsorted(bounds, at, side="right") - 1
                at = at[at + span <= bounds[text_of + 1]]  # windows within one text
                found += [(p, m, x) for p, x in zip(at.tolist(), h[at].view(np.int64).tolist())]
            found.sort()
            out: tuple[list, list, list, list] = ([], [], [], [])
            i = 0
            while i < len(found):
                doc = int(np.searchsorted(bounds, found[i][0], side="right")) - 1
                first, last = int(bounds[doc]), int(bounds[doc + 1])
                end = i + 1
                while end < len(found) and found[end][0] <= found[end - 1][0] + 2 * span and found[end][0] < last:
                    end += 1
                start, stop = max(first, found[i][0] - span), min(last, found[end - 1][0] + 2 * span)
                out[0].append(ids[doc])
                out[1].append(start - first)
                out[2].append(flat[start:stop].view(np.int64))
                out[3].append([{"mask": m, "pos": p - start, "h": h} for p, m, h in found[i:end]])
                i = end
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(hit_type))], names=["doc_id", "start", "ws", "hits"])

    return _texts(docs, doc_id, text).mapInArrow(run, schema)


def longest_overlap(a: np.ndarray, b: np.ndarray, shift: int, allowed: int) -> tuple[int, int]:
    """The longest stretch without and with up to ``allowed`` differing words, where word i + shift of ``a`` stands
    against word i of ``b``. A stretch begins and ends with equal words."""
    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
    if hi <= lo:
        return 0, 0
    same = a[lo + shift : hi + shift] == b[lo:hi]
    gaps = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    exact = int((np.diff(gaps) - 1).max())
    if not allowed:
        return exact, exact
    best = 0
    equal = np.flatnonzero(same)
    if len(equal):
        reach = min(allowed, len(gaps) - 2)
        for i in range(len(gaps) - 1 - reach):
            first = equal[np.searchsorted(equal, gaps[i] + 1)] if np.searchsorted(equal, gaps[i] + 1) < len(equal) else None
            last = equal[np.searchsorted(equal, gaps[i + reach + 1]) - 1] if np.searchsorted(equal, gaps[i + reach + 1]) else None
            if first is not None and last is not None and last >= first:
                best = max(best, int(last - first + 1))
    return exact, best


def _item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([word_hashes(t).view(np.int64) for t in texts])

    return items.where(ident(item_id).isNotNull() & ident(text).isNotNull()).select(ident(item_id).cast("long").alias("item_id"), hashes(ident(text).cast("string")).alias("iw"))


def find_leaks(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    masks: Sequence[str] = MASKS, substitutions: int = 1,
) -> DataFrame:
    """Document and item pairs that share a passage: ``doc_id, item_id, exact_words, similar_words`` - the longest
    common run of words, and the longest with up to ``substitutions`` words replaced.

    Every common run of at least the window's 12 words is found, every such passage with one replaced word, and passages
    with more of them where some mask fits between the replacements. Words are compared by their look and without case. Null ids or texts, empty texts
    and texts shorter than a window share nothing; an empty table on either side gives no rows; identical documents
    are each reported. Other columns are ignored.
    """
    spark = docs.sparkSession
    index = cut(_windows(items, item_id, item_text, masks))  # hashed once
    n_windows = index.count()
    bits = filter_bits(n_windows)
    packed = spark.sparkContext.broadcast(_filter(index, bits))
    stretches = cut(_hit_stretches(docs, doc_id, doc_text, masks, packed, bits))  # only what surrounds hits
    hits = stretches.select("doc_id", "start", F.explode("hits").alias("x")).select("doc_id", "start", F.col("x.mask").alias("mask"), F.col("x.pos").alias("dpos"), F.col("x.h").alias("h"))
    item_words = _item_words(items, item_id, item_text).where(F.size("iw") >= len(masks[0]))
    few = n_windows <= BROADCAST_ROWS

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        if few:
            return left.join(F.broadcast(right), on)
        left = left.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SPLIT)))
        return left.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))), [*on, "salt"])

    lined_up = meet(hits, index, ["mask", "h"]).select("doc_id", "start", F.col("id").alias("item_id"), (F.col("dpos") - F.col("pos")).alias("shift")).groupBy("doc_id", "start", "item_id").agg(F.collect_set("shift").alias("shifts"))

    @F.pandas_udf(T.StructType([T.StructField("exact", T.IntegerType()), T.StructField("similar", T.IntegerType())]))
    def overlap(ws: pd.Series, iw: pd.Series, shifts: pd.Series) -> pd.DataFrame:
        got = []
        for a, b, s in zip(ws, iw, shifts):
            a, b = np.asarray(a), np.asarray(b)
            both = [longest_overlap(a, b, int(x), substitutions) for x in s]
            got.append((max(x for x, _ in both), max(x for _, x in both)))
        return pd.DataFrame(got, columns=["exact", "similar"])

    rows = meet(lined_up.join(stretches.select("doc_id", "start", "ws"), ["doc_id", "start"]), item_words, ["item_id"])
    rows = rows.select("doc_id", "item_id", overlap("ws", "iw", "shifts").alias(PRIVATE + "o"))
    span = len(masks[0])
    return rows.groupBy("doc_id", "item_id").agg(F.max(PRIVATE + "o.exact").alias("exact_words"), F.max(PRIVATE + "o.similar").alias("similar_words")).where(f"similar_words >= {span}")
