"""A mixture of sources at target shares, with small sources repeated at most so often.

Budgets run down a tree, domain - language - source. At every node the node's tokens are divided among its children
by weight; a child that can't give its part gives what it has, and its siblings make up for it in proportion to
their weights. Only what a whole node lacks is passed on to that node's own siblings. Each leaf then gives the first
tokens of its documents in a seeded order, epoch by epoch. Texts are whole: the one that crosses a leaf's budget is
taken or left by a seeded draw, in proportion to the part of it that fits, so that many small leaves come out right
together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import PRIVATE, ident, rows_at_most

#: Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Slots of the seeded order within an epoch; one slot of a leaf is ordered in one task.
SLOTS = 4096


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import base64

    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of ``df`` but the text, and the number of the text's tokens; 0 for null or empty texts.

    ``vocabulary`` is the path of a file of merge ranks. It is read on the driver and sent to the workers, which need
    no copy of it. Whole texts are counted. A column of the name ``out`` is replaced.
    """
    with open(vocabulary, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary's size doesn't grow with the data
    kept = [c for c in df.columns if c not in (text, out)]
    rows = df.select(*[ident(c) for c in kept], ident(text).cast("string").alias(PRIVATE + "text"))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*kept, out])

    return rows.mapInArrow(run, schema)


def leaf_stats(docs: DataFrame, targets: DataFrame, *, doc_id: str, tokens: str, text_key: str, levels: Sequence[str], source: str) -> tuple[DataFrame, DataFrame]:
    """(texts, leaves). ``texts``: one row per different text of a source that has a target - ``levels``, ``rep``
    (the smallest document id with it), ``tokens``, ``copies``. ``leaves``: per combination of levels ``all_tokens``
    (copies counted), ``tokens`` (each text once), ``weight``, ``max_repeats``, and a leaf without tokens for every
    source that has no document. The last level is the source."""
    target = targets.where(ident("source").isNotNull()).groupBy(ident("source").alias(PRIVATE + "s")).agg(F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("r"))
    rows = docs.join(target.select(PRIVATE + "s"), ident(source) == F.col(PRIVATE + "s"), "left_semi").select(
        *[ident(x) for x in levels], ident(doc_id).alias("doc"), ident(tokens).alias("n"), ident(text_key).alias("key"),
    )
    others = [x for x in levels if x != source]
    texts = rows.groupBy(ident(source), "key").agg(F.min(F.struct("doc", *[ident(x) for x in others])).alias("m"), F.max("n").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    texts = texts.select(*[ident(x) if x == source else F.col("m")[x].alias(x) for x in levels], F.col("m.doc").alias("rep"), "tokens", "copies")
    sums = texts.groupBy(*[ident(x) for x in levels]).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))
    leaves = target.join(sums, F.col(PRIVATE + "s") == ident(source), "left")
    whole = Window.partitionBy(PRIVATE + "s")  # the languages of one source
    part = F.when(F.sum("tokens").over(whole) > 0, F.col("tokens") / F.sum("tokens").over(whole)).otherwise(1.0 / F.count(F.lit(1)).over(whole))
    leaves = leaves.select(
        *[F.col(PRIVATE + "s").alias(x) if x == source else ident(x) for x in levels], F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("all_tokens", F.lit(0)).alias("all_tokens"),
        (F.col("w") * part).alias("weight"), F.col("r").alias("max_repeats"),
    )
    return texts, leaves


def _fill(nodes: DataFrame, parent: Sequence[str], amount: str, out: str) -> DataFrame:
    """Divides the parent's ``amount`` among its children by weight, none beyond its capacity.

    In the order of capacity per weight, children are full as long as the level that the others would get is above
    theirs; the first that isn't sets the level for itself and all after it. One window per parent.
    """
    group = Window.partitionBy(*[ident(x) for x in parent]) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    w = group.orderBy(ratio.asc_nulls_last(), *[ident(c) for c in nodes.columns if c not in ("cap", "weight", amount)]).rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("before_cap", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(w), F.lit(0.0))).withColumn("rest", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(w), F.lit(0.0)))
    rows = rows.withColumn("level", F.when((F.col("weight") > 0) & (F.col("rest") > 0), F.greatest(F.lit(0.0), (F.col(amount) - F.col("before_cap")) / F.col("rest")))).withColumn("ratio", ratio)
    rows = rows.withColumn("at", F.min_by(F.col("level"), F.when(F.col("ratio") > F.col("level"), F.col("ratio"))).over(group))
    full = F.col("at").isNull() | (F.col("ratio") <= F.col("at"))
    return rows.withColumn(out, F.when(F.col("weight") > 0, F.when(full, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("at")))).otherwise(0.0)).drop("before_cap", "rest", "level", "ratio", "at")


def budgets(leaves: DataFrame, levels: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """The leaves with ``goal`` (all tokens), ``target`` (the leaf's part by weight alone), ``cap`` (its tokens times
    its repeats) and ``budget`` (what it is to give). Budgets add up to the goal unless all sources together can't.
    ``tokens`` names the column of what a leaf has: each text once, or ``all_tokens`` with copies counted."""
    leaves = leaves.withColumn("cap", (ident(tokens) * F.col("max_repeats")).cast("double"))
    goal = leaves.agg(F.sum("all_tokens").cast("double").alias("goal"), F.sum("weight").alias("all_weight"), F.sum("cap").alias("all_cap"))
    rows = leaves.crossJoin(F.broadcast(goal))  # one row
    rows = rows.withColumn("target", F.when(F.col("all_weight") > 0, F.col("goal") * F.col("weight") / F.col("all_weight")).otherwise(0.0))
    given = rows.withColumn("give", F.least("goal", "all_cap"))
    for depth in range(1, len(levels) + 1):
        node, parent = [*levels[:depth]], [*levels[: depth - 1]]
        # a node's own row, made from its leaves, gets its part of what its parent has
        sums = given.groupBy(*[ident(x) for x in node]).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.max("give").alias("give"))
        part = _fill(sums, parent, "give", "part").select(*[ident(x).alias(f"{PRIVATE}{i}") for i, x in enumerate(node)], "part")
        on = functools.reduce(Column.__and__, [ident(x).eqNullSafe(F.col(f"{PRIVATE}{i}")) for i, x in enumerate(node)])
        given = given.drop("give").join(part, on).drop(*[f"{PRIVATE}{i}" for i in range(depth)]).withColumnRenamed("part", "give")
    return given.withColumnRenamed("give", "budget").drop("all_weight", "all_cap")


def short_sources(budgeted: DataFrame, source: str) -> DataFrame:
    """The sources whose budgets stay below their targets: ``source``. A node gets at least its part by weight, and
    what siblings lack on top, so only a leaf that is full can stay below; its source's other leaves are as full."""
    sums = budgeted.groupBy(ident(source).alias("source")).agg(F.sum("budget").alias("budget"), F.sum("target").alias("target"))
    return sums.where(F.col("budget") < F.col("target") * F.lit(1 - 1e-9)).select("source")  # sums of doubles


def select_prefix(texts: DataFrame, budgeted: DataFrame, levels: Sequence[str], seed: int = 17) -> DataFrame:
    """The chosen texts, one row per use: ``levels, rep, epoch, tokens``.

    An epoch orders a leaf's texts by a hash of seed, epoch and document id; a leaf gives whole texts from the front
    of its epochs as long as they fit its budget, and the next one with the chance that the rest of the budget is of
    it. Sums per slot of the order find the slot in which the budget ends, and only that slot is put in exact order,
    so a leaf with most of the texts isn't sorted in one task. No epochs are made that the budget can't reach.
    """
    names = [f"{PRIVATE}{i}" for i in range(len(levels))]
    plan = budgeted.where("budget > 0 and tokens > 0").select(*[ident(x).alias(n) for x, n in zip(levels, names)], "budget", F.least(F.col("max_repeats"), F.ceil(F.col("budget") / F.col("tokens"))).cast("int").alias("reps"))
    on = functools.reduce(Column.__and__, [ident(x).eqNullSafe(F.col(n)) for x, n in zip(levels, names)])
    if rows_at_most(plan, 100_000):
        plan = F.broadcast(plan)  # one row per leaf, counted
    uses = texts.join(plan, on).where("reps > 0 and tokens > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)))
    order = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("rep"))
    uses = uses.withColumn("order", order).withColumn("slot", F.shiftrightunsigned("order", 52).cast("int"))
    uses = uses.withColumn("slot", F.col("epoch") * SLOTS + F.col("slot"))
    slots = uses.groupBy(*names, "slot", "budget").agg(F.sum("tokens").alias("t"))
    leaf = Window.partitionBy(*names).orderBy("slot")  # at most SLOTS rows an epoch
    slots = slots.withColumn("upto", F.sum("t").over(leaf))
    last = slots.where("upto > budget").groupBy(*names).agg(F.min(F.struct("slot", (F.col("budget") - F.col("upto") + F.col("t")).alias("left"))).alias("l"))
    last = last.select(*[F.col(n).alias(n + "l") for n in names], F.col("l.slot").alias("last_slot"), F.col("l.left").alias("left"))
    on = functools.reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(n + "l")) for n in names])
    if rows_at_most(last, 100_000):
        last = F.broadcast(last)
    marked = uses.join(last, on, "left")
    cols = [*[ident(x) for x in levels], F.col("rep"), F.col("epoch"), F.col("tokens")]
    whole = marked.where("last_slot is null or slot < last_slot").select(*cols)
    w = Window.partitionBy(*names).orderBy("order", "rep")  # one slot of a leaf
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("edge"), F.col("epoch"), F.col("rep")), F.lit(2**30)) / F.lit(float(2**30))
    fits = (F.col("upto") <= F.col("left")) | (draw < (F.col("left") - F.col("upto") + F.col("tokens")) / F.col("tokens"))  # below 0 behind the crossing text
    part = marked.where("slot = last_slot").withColumn("upto", F.sum("tokens").over(w)).where(fits).select(*cols)
    return whole.unionAll(part)


def shares(budgeted: DataFrame, chosen: DataFrame, source: str) -> DataFrame:
    """Per source what it was to give and what it gives: ``source, target_share, tokens, max_repeats, is_short,
    chosen_tokens, chosen_texts, most_uses, share``."""
    want = budgeted.groupBy(ident(source).alias("source")).agg(F.sum("target").alias("target"), F.max("goal").alias("goal"), F.sum("all_tokens").alias("tokens"), F.max("max_repeats").alias("max_repeats"))
    got = chosen.groupBy(ident(source).alias("source")).agg(F.sum("tokens").alias("chosen_tokens"), F.count(F.lit(1)).alias("chosen_texts"), (F.max("epoch") + 1).alias("most_uses"))
    whole = chosen.agg(F.sum("tokens").alias("chosen"))
    rows = want.join(got, "source", "left").fillna(0, ["chosen_tokens", "chosen_texts", "most_uses"]).crossJoin(F.broadcast(whole))  # one row
    return rows.select(
        "source", (F.col("target") / F.col("goal")).alias("target_share"), "tokens", "max_repeats", (F.col("tokens") * F.col("max_repeats") < F.col("target")).alias("is_short"),
        "chosen_tokens", "chosen_texts", "most_uses", F.when(F.col("chosen") > 0, F.col("chosen_tokens") / F.col("chosen")).alias("share"),
    )
