"""Operator 8: statistics by brute force, learned lists."""

import math
import random
import re
from collections import Counter

import pytest
from dupescope.llm import quality
from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "a b c a b c a b c", "  x\t\x0b y\x0c\r\nx y\n\nx y\n x y", "a a a a", "a a a", "é🙂 é🙂 é🙂 | <é>", " x \x1cy", "w " * 30000]
    texts += ["".join(rng.choice("ab \n#é\r") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "a b", 1)]
    got = {r.doc_id: tuple(r)[1:6] for r in quality.statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    rule = quality.Rule((quality.Condition("mean_chars", True, 3.0), quality.Condition("n_words", False, 80.0)))
    plan = quality.judged(docs, [rule])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_learned_list():
    rng = random.Random(3)
    rows = []
    for _ in range(900):
        r = {n: rng.random() for n in quality.FEATURES}
        rows.append((r, r["symbols_per_word"] > 0.8 or (r["mean_chars"] < 0.3 and r["upper_share"] > 0.7)))
    rules = quality.learn(rows)
    caught = [any(rule.holds(r) for rule in rules) for r, _ in rows]
    assert sum(c and not y for c, (_, y) in zip(caught, rows, strict=True)) < 15
    assert sum(c and y for c, (_, y) in zip(caught, rows, strict=True)) > 0.9 * sum(y for _, y in rows)
    assert quality.learn([]) == [] and quality.learn([(r, False) for r, _ in rows]) == []


def test_order_decides(spark):
    c = quality.Condition("n_words", True, 2.0)
    docs = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    kept = quality.statistics(docs).select("doc_id", quality.verdict([quality.Rule((c,), bad=False), quality.Rule((quality.Condition("n_words", True, 0.0),))]).alias("k"))
    assert {r.doc_id: r.k for r in kept.collect()} == {1: True, 2: False}


def test_whole_query(spark):
    data = "/root/testdata/sf0.01"
    got = quality.op8_quality_rules(spark, data).join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality"), "doc_id")
    r = {(x.quality, x.base_failed): x.k for x in got.groupBy("quality", "base_failed").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert r[1, False] > 0.99 and r[0, False] < 0.2 and r[0, True] == 0 and r[1, True] == 0


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 0), (1, 1)]])
def test_nothing_to_learn_from(spark, labels):
    docs = spark.createDataFrame([(1, "a " * 60), (2, None)], "doc_id long, text string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality.judged(docs, quality.learn(quality.labelled(docs, frame, 10))).collect()} == {1: False, 2: False}


def test_grown_conditions_have_the_most_gain():
    """FOIL gain of each candidate by its formula: covered bad rows times the rise of log2 of the (smoothed) share of bad ones."""
    rng = random.Random(5)
    rows = [({n: rng.random() for n in quality.FEATURES}, False) for _ in range(240)]
    rows = [(r, r["mean_chars"] < 0.35 and r["upper_share"] > 0.5 or rng.random() < 0.05) for r, _ in rows]
    covered = rows
    for c in quality.grow(rows, 3):
        share = lambda part: (sum(y for _, y in part) + 0.5) / (len(part) + 1)
        gains = []
        for other in quality.candidates(covered):
            part = [x for x in covered if (x[0][other.feature] >= other.threshold) == other.above]
            gains.append((sum(y for _, y in part) * (math.log2(share(part)) - math.log2(share(covered))), str(other)))
        mine = next(g for g, name in gains if name == str(c))
        assert mine == pytest.approx(max(gains)[0]) and mine > 0
        covered = [x for x in covered if c.holds(x[0])]


def test_the_conditional_expression_equals_the_rules(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "Bcd", "#", "é|", "long-word-here", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    features = quality.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_words > 0")
    rows = features.select("doc_id", *(F.expr(e).alias(n) for n, e in quality.FEATURES.items())).collect()
    rules = []
    for k in range(6):
        r = rng.choice(rows)
        names = rng.sample(list(quality.FEATURES), 2)
        rules.append(quality.Rule(tuple(quality.Condition(n, rng.random() < 0.5, float(r[n])) for n in names), bad=k % 2 == 0))
    got = {r.doc_id: r.k for r in features.select("doc_id", quality.verdict(rules).alias("k")).collect()}
    for r in rows:
        values = {n: float(r[n]) for n in quality.FEATURES}
        first = next((rule for rule in rules if rule.holds(values)), None)
        assert got[r.doc_id] == (first is None or not first.bad)
