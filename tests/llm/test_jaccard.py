"""Operator 10 against brute force; trees against all pairs; components."""

import random
import re

import numpy as np
import pytest
from dupescope.llm import common, components, jaccard


def shingle_set(text):
    """Distinct 5-word shingles as tuples, by the contract; nothing of the operator is used."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in parent}, {i: len(s) for i, s in sets}


def corpus(seed, n_bases=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, at = [], 0
    for _ in range(n_bases):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((at, " ".join(text)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one two"), (at + 4, "ONE\ttwo"), (at + 5, "one two three"), (at + 6, rows[0][1].upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(jaccard, "SPLIT", 3)
        monkeypatch.setattr(jaccard, "LARGE", 4)  # second prefixes, and blocks dealt out over several tasks
    rows = corpus(seed)
    expected, sizes = brute(rows)
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def triples(n=40):
    """C is a frequent passage and 10 own shingles, A is C and 20 shingles that E quotes: A and C are linked, by blocks of two only."""
    rows = []
    frequent, other = [f"f{i}" for i in range(74)], [f"g{i}" for i in range(74)]
    for k in range(n):
        c = frequent + [f"c{k}x{i}" for i in range(10)]
        quoted = [f"q{k}x{i}" for i in range(20)]
        rows += [(3 * k, " ".join(c)), (3 * k + 1, " ".join(c + quoted)), (3 * k + 2, " ".join(other + c[-4:] + quoted))]
    return rows


def windows_of_one_sequence(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    return [(i, " ".join(words[b : b + rng.randint(40, 110)])) for i, b in enumerate(rng.randrange(400) for _ in range(70))]


@pytest.mark.parametrize("rows", [triples(), windows_of_one_sequence()])
def test_links_by_blocks_of_two(spark, rows):
    expected, _ = brute(rows)
    assert {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == expected


def groups_of_five(n=600, seed=8):
    """In each group a and b link at exactly 8 of 10 shingles; three more share a phrase with one of them and none of it with another."""
    rng = random.Random(seed)
    ids = list(range(5 * n))
    rng.shuffle(ids)
    rows, expected = [], {}
    for k in range(n):
        word = iter(f"w{k}x{i}" for i in range(200))
        take = lambda m: [next(word) for _ in range(m)]  # noqa: B023, E731
        core = take(12)  # 8 shingles
        a, b = [*core, *take(1)], [*take(1), *core]
        others = [take(4) + rng.choice([a, b])[i : i + 5] + take(4) for i in rng.sample(range(8), 3)]
        five = sorted(ids[5 * k : 5 * k + 5])
        if rng.random() < 0.7:  # the others are the hubs
            mine = [five[3], five[4], *five[:3]]
        else:
            mine = rng.sample(five, 5)
        rows += [(i, " ".join(t)) for i, t in zip(mine, [a, b, *others], strict=True)]
        expected |= {i: i for i in mine} | dict.fromkeys(mine[:2], min(mine[:2]))
    return rows, expected


def test_links_between_sets_that_prefer_other_hubs(spark):
    rows, expected = groups_of_five()
    small, _ = brute(rows[:250])
    assert all(small[i] == expected[i] for i in small)  # groups have words of their own
    got = {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_a_frequent_shingle_that_no_batch_shows(spark, monkeypatch):
    """A line in every document, too sparse for the first pass to notice: second prefixes."""
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    monkeypatch.setattr(jaccard, "LARGE", 20)
    rng = random.Random(6)
    line = [f"line{i}" for i in range(12)]
    rows = []
    for i in range(60):
        own = [f"d{i}x{k}" for k in range(30)]
        rows += [(2 * i, " ".join(own + line)), (2 * i + 1, " ".join([*own[: rng.choice([30, 28, 20])], *line, "end"]))]
    expected, _ = brute(rows)
    assert {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == expected


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100_000])), (3, " ".join(words[:90_000])), (4, "w1 " * 100_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (119_996, 1), 2: (99_996, 1), 3: (89_996, 1), 4: (1, 4)}


def test_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, 5), (1, text, 5), (2, text, 5), (None, text, 5), (7, "b c d e f g", 5), (7, text, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.linked(docs).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (7, 1), (7, 1)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1]


def test_empty(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_threshold_is_exact(spark):
    base = [f"x{i}" for i in range(54)]  # 50 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:44])), (3, " ".join(base[:43]) + " q"), (4, " ".join([f"y{i}" for i in range(13)])), (5, " ".join([f"y{i}" for i in range(11)]))]
    expected, _ = brute(rows)  # 40 of 50 links, 39 of 51 doesn't
    assert expected[2] == 1
    assert {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == expected


@pytest.mark.parametrize("seed", range(4))
def test_trees_lose_no_pair(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = []
    for _ in range(20):
        base = rng.choice(pool, rng.integers(5, 400), replace=False)
        sets += [np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.03, 0.1]), rng.choice(pool, len(base)), base)) for _ in range(rng.integers(1, 12))]
    ids = np.arange(len(sets))
    planes = [jaccard.signature(x) for x in sets]
    sizes = np.array([len(x) for x in sets])
    groups = ids % 7
    side = (ids % 2).astype(np.int8)
    for which in (None, side):
        found = {(min(a, b), max(a, b)) for p, q in jaccard.block_pairs(ids, sizes, planes, groups, which) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
        for i in ids:
            for j in ids[:i]:
                both = len(np.intersect1d(sets[i], sets[j]))
                if both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both) and groups[i] != groups[j] and (which is None or which[i] != which[j]):
                    assert (j, i) in found
        assert len(found) < len(ids) ** 2 / 8


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}


def test_only_the_result_stays_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """Three numbers and an id a document: bitmaps, prefixes, pairs and rounds are gone."""
    rows = corpus(3)
    monkeypatch.setattr(common, "shared_dir", lambda _, name: f"{tmp_path}/{name}")
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    (left,) = [p for run in tmp_path.iterdir() for p in run.iterdir()]
    assert left.name.endswith("-found") and got.count() == len(rows)
