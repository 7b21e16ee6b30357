"""Expected shares of a sample against the targets."""

import random

import pytest

from quillspark.llm import mixing


def table(spark, seed=6, uneven=20):
    rnd = random.Random(seed)
    rows = [(f"s{a}", f"l{b}", f"t{c}", rnd.randint(50, 5000) * (1 + uneven * (c == 0))) for a in range(5) for b in range(3) for c in range(3)]
    return rows, spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def goals(rows, at, temper=mixing.TEMPER, lift=mixing.LIFT):
    own = {}
    for r in rows:
        own[r[at]] = own.get(r[at], 0) + r[3]
    total, powers = sum(own.values()), sum(n**temper for n in own.values())
    share = {v: n**temper / powers for v, n in own.items()}
    high = {v for v in own if share[v] > lift * own[v] / total}
    rest = (1 - sum(lift * own[v] / total for v in high)) / sum(share[v] for v in own if v not in high)
    return {v: lift * own[v] / total if v in high else share[v] * rest for v in own}


def test_the_sample_meets_the_targets(spark):
    rows, cells = table(spark)
    out = mixing.calibrated(mixing.rake(cells)).cache()
    got = out.collect()
    drawn = sum(r["probability"] * r["tokens"] for r in got)
    assert max(r["probability"] for r in got) == 1 and 0 < drawn
    for at, margin in enumerate(mixing.MARGINS):
        for v, goal in goals(rows, at).items():
            share = sum(r["probability"] * r["tokens"] for r in got if r[margin] == v) / drawn
            assert share == pytest.approx(goal, rel=1e-6)
        for r in mixing.shares(out, margin).collect():
            assert r["attained"] == pytest.approx(r["target"], rel=1e-6)
    out.unpersist()


def test_rare_values_are_lifted_at_most_so_far(spark):
    rows = [("big", "l", "t", 1_000_000), ("tiny", "l", "t", 10), ("small", "l", "t", 50_000)]
    out = {r["source"]: r for r in mixing.calibrated(mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"))).collect()}
    total = sum(r["probability"] * r["tokens"] for r in out.values())
    assert out["tiny"]["probability"] * 10 / total == pytest.approx(2 * 10 / 1_050_010, rel=1e-6) and total > 400_000


def test_documents_of_the_sample(spark):
    """Of many documents of equal length the drawn ones have the targets' shares, up to chance."""
    rnd = random.Random(2)
    rows = [(i, "word " * 20, rnd.choices("abc", [70, 25, 5])[0], rnd.choices(["en", "de"], [9, 1])[0]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = mixing.sample(docs).collect()
    for at, margin in ((2, "source"), (3, "lang")):
        for v, goal in goals([(r[2], r[3], "prose", 20) for r in rows], at - 2).items():
            assert sum(r[margin] == v for r in kept) / len(kept) == pytest.approx(goal, rel=0.15)
