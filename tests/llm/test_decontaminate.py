"""Operator 9: templates, slots, coverage, special rows."""

import random
import re

import duckdb
import pytest
from dupescope.llm import decontaminate

QUESTION = "If John has 5 apples and gives Mary 3 apples, how many apples does John have left at the end?"


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.matches(d, b).collect()}, d, b


def test_slots(spark):
    docs = [
        (1, f"Intro. {QUESTION} More.", 0), (2, QUESTION.replace("John", "Peter Pan").replace("Mary", "Anna").replace("5", "5,000").replace("3", "seven"), 0),
        (3, QUESTION.replace("John", "Peter", 1).replace("Mary", "Anna"), 0), (4, None, 0), (5, "", 0), (6, QUESTION.lower(), 0), (7, "How many apples are there?", 0), (None, QUESTION, 0), (1, f"Intro. {QUESTION} More.", 0), (8, QUESTION.upper(), 0),
    ]
    got, d, b = run(spark, docs, [(10, QUESTION), (11, None), (12, ""), (13, "two words"), (None, QUESTION)])
    assert set(got) == {(i, 10) for i in (1, 2, 6, 8)}
    assert got[1, 10].exact and not got[2, 10].exact and got[2, 10].coverage == 1
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 7]


def test_parts_and_short_items(spark):
    words = "the quick brown fox jumps over a lazy dog while seven green birds watch from their high old tree near our house".split()
    item = " ".join(words)
    docs = [(1, " ".join(words[:8]), 0), (2, "x " + " ".join(words[:17]) + " y", 0), (3, "what is the capital city", 0), (4, "the capital", 0), (5, " ".join(words[:9]) + " odd " + " ".join(words[9:]), 0)]
    got, *_ = run(spark, docs, [(1, item), (2, "What is the capital city")])
    assert set(got) == {(2, 1), (3, 2), (5, 1)}


STARTS = "Maria has 12 red apples. Maria gives 5 apples to Jonas. Maria then buys 7 more apples. How many apples does Maria have now?"
SPEAKERS = "Mr. Smith has 4 boats.\nSmith sells 2 boats to Ann Lee.\nLee paints her boats. How many boats do Mr. Smith and Ann Lee own?"


def test_names_that_begin_sentences(spark):
    other = lambda t, a, b: t.replace("Maria", a).replace("Jonas", b).replace("12", "40").replace("5", "9").replace("7", "eight")
    docs = [
        (1, other(STARTS, "Anna", "Peter"), 0), (2, "Question: " + other(STARTS, "Anna", "Peter Pan") + " Anna left.", 0), (3, other(STARTS, "Anna Lee", "Peter"), 0), (4, other(STARTS, "Anna", "Peter").replace("Anna then", "Peter then"), 0),
        (5, SPEAKERS.replace("Smith", "Jones").replace("Ann Lee", "Bob Ray").replace("Lee", "Ray").replace("4", "6"), 0),
    ]
    got, *_ = run(spark, docs, [(1, STARTS), (2, SPEAKERS)])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 2)}
    assert got[1, 1].coverage == 1 and not got[1, 1].exact


def test_items_of_many_slots(spark):
    item = "Add 3 kg, 5 kg, 7 kg and 9 kg, then divide by 4."
    other = item.replace("3", "13").replace("5", "21").replace("7", "6.5").replace("9", "30").replace("4", "2")
    docs = [(1, f"Task: {other} Done.", 0), (2, "1 kg 2 kg 3 kg 4 kg 5 kg 6 kg", 0), (3, "It holds 21 kg and 30 kg, then divide by 2 again.", 0), (4, other.replace("kg and", "g and"), 0), (5, item, 0)]
    got, *_ = run(spark, docs, [(1, item), (2, "3 kg 5 kg 7 kg 9 kg 4 kg")])
    assert set(got) == {(1, 1), (5, 1)} and got[1, 1].coverage == 1


def test_long_texts_ties_and_clashing_columns(spark):
    filler = "plain words go on and on without any question at all " * 20_000
    docs = [(1, filler + QUESTION + filler, 5), (2, filler, 5), (3, QUESTION, 5), (3, QUESTION, 5)]
    got, d, b = run(spark, docs, [(1, QUESTION), (2, QUESTION), (2, QUESTION)])  # two items of one text tie
    assert set(got) == {(i, j) for i in (1, 3) for j in (1, 2)} and all(r.exact and r.coverage == 1 for r in got.values())
    clash = d.selectExpr("doc_id", "text", "item_id", "1 AS h", "2 AS family", "3 AS total")
    kept = decontaminate.drop_contaminated(clash, b)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [2]


def brute_template(text):
    """Typed tokens of a text whose sentences begin with common words: names, numbers and units by rule."""
    out = []
    for w in re.findall(r"[A-Za-z]+|[.?!]|\d+", text):
        if w in ".?!":
            out.append(None)
        elif w.isdigit():
            out.append(("#", w))
        elif w.lower() in decontaminate.UNITS:
            out.append(("u", w.lower()))
        elif w[0].isupper() and out and out[-1] is not None:
            out.append(("@", w.lower()))
        else:
            out.append((w.lower(), ""))
    return [t for t in out if t is not None]


def test_template_windows_by_brute_force(spark):
    """Every document against every item: all alignments, slots filled one to one, windows of eight with four literals."""
    rng = random.Random(11)
    names, units = ["Anna", "Bob", "Carl", "Dora", "Emil"], ["kg", "miles", "hours"]
    verbs = "then quickly buys sells gives takes holds moves carries finds".split()

    def question(r):
        parts = [f"the clerk saw {r.choice(names)} who {r.choice(verbs)} {r.randint(2, 99)} {r.choice(units)} of {r.choice(verbs)} goods near the old town" for _ in range(r.randint(1, 2))]
        return ". ".join(parts) + "?"

    items = [(i, question(rng)) for i in range(12)]
    docs = []
    for i, q in items:
        swap = dict(zip(names, rng.sample(names, 5), strict=True))
        exchanged = re.sub("|".join(names), lambda m: swap[m[0]], re.sub(r"\d+", lambda m: str(int(m[0]) + 100), q))  # noqa: B023
        docs += [(10 * i, exchanged, 0), (10 * i + 1, q.replace("clerk", "man").replace("goods", "cloth").replace("old", "new"), 0), (10 * i + 2, question(rng), 0)]
    expected = set()
    for d, text, _ in docs:
        t = brute_template(text)
        for i, q in items:
            s = brute_template(q)
            covered = set()
            for shift in range(-len(s), len(t)):
                hits = [a for a in range(len(s) - 7) if 0 <= a + shift <= len(t) - 8 and [x[0] for x in s[a : a + 8]] == [x[0] for x in t[a + shift : a + shift + 8]] and sum(x[0] not in "#u@" for x in s[a : a + 8]) >= 4]
                pairs = {(s[a + k], t[a + shift + k]) for a in hits for k in range(8) if s[a + k][0] in "#u@"}
                if len({x for x, _ in pairs}) == len(pairs):
                    covered |= set(hits)
            if 2 * len(covered) >= len(s) - 7:
                expected.add((d, i))
    got, *_ = run(spark, docs, items)
    assert set(got) == expected and len(expected) >= 12


def test_empty_tables(spark):
    assert run(spark, [], [(1, QUESTION)])[0] == {} and run(spark, [(1, QUESTION, 0)], [])[0] == {}


@pytest.mark.parametrize("data", ["/root/testdata/sf0.01"])
def test_planted_items(spark, data):
    flat = lambda t: " ".join(decontaminate.TOKEN.sub(lambda m: m[0] if m[0].isalnum() else " ", t).lower().split())
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    expected = {(d, i) for d, t in docs for i, q in items if flat(q) in flat(t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op9_decontamination(spark, data).collect()}
    assert got == expected and expected
