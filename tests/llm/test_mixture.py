import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixture

LEVELS = ("domain", "lang", "source")


def fill(children, amount):
    """Water level by brute force: children are (weight, capacity)."""
    got = [0.0] * len(children)
    live = {i for i, (w, _) in enumerate(children) if w > 0}
    left = amount
    while live and left > 1e-9:
        weight = sum(children[i][0] for i in live)
        full = {i for i in live if got[i] + left * children[i][0] / weight >= children[i][1] - 1e-12}
        if not full:
            for i in live:
                got[i] += left * children[i][0] / weight
            return got
        # those that are full first give what they have, the others share again
        for i in full:
            left -= children[i][1] - got[i]
            got[i] = children[i][1]
        live -= full
    return got


def brute(leaves, amount, depth=0):
    if depth == 3:
        return {leaves[0]["key"]: amount}
    groups = {}
    for leaf in leaves:
        groups.setdefault(leaf["key"][depth], []).append(leaf)
    names = list(groups)
    parts = fill([(sum(x["weight"] for x in groups[n]), sum(x["cap"] for x in groups[n])) for n in names], amount)
    out = {}
    for n, p in zip(names, parts):
        out |= brute(groups[n], p, depth + 1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_brute_force(spark, seed):
    r = random.Random(seed)
    leaves, rows = [], []
    for d in range(3):
        for g in range(r.randrange(1, 4)):
            for s in range(r.randrange(1, 5)):
                key = (f"d{d}", f"l{g}", f"s{d}{s}")
                t, w, reps = r.choice([0, r.randrange(1, 2000)]), r.choice([0.0, r.random() * 5]), r.randrange(1, 4)
                leaves.append({"key": key, "weight": w, "cap": float(t * reps)})
                rows.append((*key, t, t, w, reps))
    df = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, all_tokens long, weight double, max_repeats int")
    got = {(x["domain"], x["lang"], x["source"]): x["budget"] for x in mixture.budgets(df, LEVELS).collect()}
    goal = min(float(sum(x[3] for x in rows)), sum(x["cap"] for x in leaves))
    want = brute(leaves, goal)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6), k


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(1)
    docs = []
    for i in range(900):
        source = r.choice(["big"] * 8 + ["small", "mid", "none", None])
        docs.append((i, source, r.choice(["en", "de", None]), " ".join(r.choices(["alpha", "beta", "gamma"], k=r.randrange(0, 40))) if r.random() > 0.02 else None, "x"))
    docs += [(1000 + i, "small", "en", "one text again and again", "x") for i in range(30)]
    targets = spark.createDataFrame([("big", 2.0, 1), ("small", 5.0, 3), ("mid", 2.0, 2), ("gone", 1.0, 4)], "source string, target_weight double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string, weight string").withColumn("domain", F.lit("all")).withColumn("lang", F.coalesce("lang", F.lit("und")))
    counted = mixture.count_tokens(df.withColumn("key", F.md5("text")), "text")
    texts, leaves = mixture.leaf_stats(counted, targets, doc_id="doc_id", tokens="n_tokens", text_key="key", levels=LEVELS, source="source")
    leaves = leaves.fillna({"domain": "all", "lang": "und"})
    plan = mixture.budgets(leaves, LEVELS)
    return docs, counted, texts.cache(), plan.cache()


def test_selection_keeps_budgets_and_repeats(mixed):
    docs, counted, texts, plan = mixed
    chosen = mixture.select_prefix(texts, plan, LEVELS)
    rows = chosen.collect()
    reps = {"big": 1, "small": 3, "mid": 2, "gone": 4}
    text_of = {d[0]: d[3] for d in docs}
    uses = {}
    for x in rows:
        uses[x["source"], text_of[x["rep"]]] = uses.get((x["source"], text_of[x["rep"]]), 0) + 1
    assert all(n <= reps[s] for (s, _), n in uses.items())
    taken = {}
    for x in rows:
        k = (x["domain"], x["lang"], x["source"])
        taken[k] = taken.get(k, 0) + x["tokens"]
    for p in plan.collect():
        t = taken.get((p["domain"], p["lang"], p["source"]), 0)
        assert abs(t - p["budget"]) < 45 and t <= p["cap"]  # the longest text
    assert sorted(map(tuple, mixture.select_prefix(texts, plan, LEVELS).collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, mixture.select_prefix(texts, plan, LEVELS, seed=5).collect())) != sorted(map(tuple, rows))


def test_small_leaves_come_out_right_together(spark):
    rows = [(f"d{i}", "en", "s", i, 10, 1) for i in range(2000)]  # every leaf is one text of which half fits
    texts = spark.createDataFrame(rows, "domain string, lang string, source string, rep long, tokens long, copies long")
    plan = texts.selectExpr("domain", "lang", "source", "tokens", "5D AS budget", "1 AS max_repeats")
    chosen = mixture.select_prefix(texts, plan, LEVELS)
    assert chosen.agg(F.sum("tokens")).first()[0] == pytest.approx(10_000, rel=0.1)


def test_short_sources(spark):
    r = random.Random(3)
    rows = [(f"d{r.randrange(3)}", f"l{r.randrange(2)}", f"s{i % 7}", r.randrange(0, 900) if i % 7 else 0) for i in range(60)]
    rows = [(*k, sum(x[3] for x in rows if x[:3] == k)) for k in {x[:3] for x in rows}]
    weight, reps = {f"s{i}": 1.0 + i % 3 * 2 for i in range(7)}, {f"s{i}": 1 + i % 2 for i in range(7)}
    have = {s: sum(x[3] for x in rows if x[2] == s) for s in weight}
    leaves = [(*x, x[3], weight[x[2]] * (x[3] / have[x[2]] if have[x[2]] else 1 / sum(y[2] == x[2] for y in rows)), reps[x[2]]) for x in rows]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, all_tokens long, weight double, max_repeats int")
    goal, total = sum(have.values()), sum(weight.values())
    want = {s for s in weight if have[s] * reps[s] < goal * weight[s] / total}
    assert {x["source"] for x in mixture.short_sources(mixture.budgets(df, LEVELS, "all_tokens"), "source").collect()} == want and 0 < len(want) < 7


def test_shares_report(mixed):
    _, _, texts, plan = mixed
    got = {x["source"]: x for x in mixture.shares(plan, mixture.select_prefix(texts, plan, LEVELS), "source").collect()}
    assert set(got) == {"big", "small", "mid", "gone"} and sum(x["share"] for x in got.values()) == pytest.approx(1)
    assert got["gone"]["is_short"] and got["gone"]["chosen_tokens"] == 0 and got["small"]["is_short"] and got["small"]["most_uses"] == 3 and got["big"]["most_uses"] == 1
    assert got["small"]["target_share"] == pytest.approx(0.5)


def test_counts_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "hello " * 50_000, 5)], "id long, text string, n_tokens int")
    got = {x["id"]: x["n_tokens"] for x in mixture.count_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 49_000


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, n_tokens long, key string")
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 3.0, 1), ("b", None, None)], "source string, target_weight double, max_repeats int")
    texts, leaves = mixture.leaf_stats(docs, targets, doc_id="doc_id", tokens="n_tokens", text_key="key", levels=LEVELS, source="source")
    plan = mixture.budgets(leaves, LEVELS)
    assert {(x["source"], x["budget"]) for x in plan.collect()} == {("a", 0.0), ("b", 0.0)} and mixture.select_prefix(texts, plan, LEVELS).collect() == []
