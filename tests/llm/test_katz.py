"""Operator 3 against a brute-force Katz model."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from dupescope.llm import common, katz


def good_turing(n):
    """Katz's discounts of counts 1 to 5 from the counts of counts 1 to 6: r* = (r + 1) n_(r + 1) / n_r, rescaled so that counts above 5 keep theirs."""
    absolute = [(r - 0.5) / r for r in range(1, 6)]
    if 0 in n:
        return absolute
    cut = 6 * n[5] / n[0]
    if cut >= 1:
        return absolute
    d = [((r + 1) * n[r] / n[r - 1] / r - cut) / (1 - cut) for r in range(1, 6)]
    return d if all(0 < x < 1 for x in d) else absolute


def brute(docs, order):
    """doc_id -> (n_tokens, n_known, N, base, score), and the model as a function."""
    begin, end = "<b>", "<e>"
    cut = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").replace("\x0b", " ").replace("\x0c", " ").split()] + [end]
    grams = defaultdict(Counter)
    history = defaultdict(Counter)
    for i, t, out in docs:
        if not out:
            s = [begin] * (order - 1) + cut(t)
            for p in range(order - 1, len(s)):
                for k in range(1, order + 1):
                    grams[k][tuple(s[p - k + 1 : p + 1])] += 1
                    history[k][tuple(s[p - k + 1 : p])] += 1
    n_all, types = sum(grams[1].values()), len(grams[1])
    d = {}
    for k in range(1, order + 1):
        n = Counter(grams[k].values())
        d[k] = good_turing([n[r] for r in range(1, 7)])
    mass = lambda k, c: c - 0.1 if c > 5 else d[k][c - 1] * c
    followers = {k: defaultdict(list) for k in range(2, order + 1)}
    for k in followers:
        for g in grams[k]:
            followers[k][g[:-1]].append(g)
    unknown = 1 - sum(mass(1, c) for c in grams[1].values()) / n_all if n_all else 1.0

    def p(k, g):
        if k == 1:
            c = grams[1][g]
            return mass(1, c) / n_all if c else unknown
        c, h = grams[k][g], history[k][g[:-1]]
        if c:
            return mass(k, c) / h
        return (alpha(k, g[:-1]) if h else 1.0) * p(k - 1, g[1:])

    def alpha(k, ctx):
        f = followers[k][ctx]
        return (1 - sum(mass(k, grams[k][g]) / history[k][ctx] for g in f)) / (1 - sum(p(k - 1, g[1:]) for g in f))

    out = {}
    for i, t, _ in docs:
        s = [begin] * (order - 1) + cut(t)
        base = score = known = 0
        for q in range(order - 1, len(s)):
            c = grams[1][(s[q],)]
            known += c > 0
            base += math.log10((c + 0.5) / (n_all + 0.5 * (types + 1)))
            score += math.log10(p(order, tuple(s[q - order + 1 : q + 1])))
        out[i] = (len(s) - order + 1, known, n_all, base, score)
    return out, p, grams, alpha


def texts(n=160, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "X\x0by", "x"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=np.arange(63, 0, -1) / sum(range(64))))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "new unseen things"), (n + 3, rows[5][1]), (n + 4, "w1 W1\tw1\n" * 400)]
    return [(i, t, zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order):
    docs = texts()
    expected, p, grams, _ = brute(docs, order)
    got = katz.score(spark.createDataFrame(docs, "doc_id long, text string, held_out boolean").repartition(3, "doc_id").sortWithinPartitions("doc_id"), order).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, n_all, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, n_all)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    # the brute-force model that it equals is normalised
    if order > 1:
        for ctx in list({g[:-1] for g in grams[order]})[:20]:
            assert sum(p(order, (*ctx, w)) for (w,) in grams[1]) + p(order, (*ctx, "?")) == pytest.approx(1)


def test_good_turing():
    # d(r) = (r*/r - cut) / (1 - cut) worked by hand: cut = 6 * 2 / 100
    d = katz.Discounts.katz([0, 100, 40, 22, 14, 8, 2])
    assert d == pytest.approx([(0.8 - 0.12) / 0.88, (0.825 - 0.12) / 0.88, (56 / 66 - 0.12) / 0.88, (40 / 56 - 0.12) / 0.88, (12 / 40 - 0.12) / 0.88])
    assert d == pytest.approx(good_turing([100, 40, 22, 14, 8, 2]))
    assert katz.Discounts.katz([0, 5, 0, 1, 1, 1, 1]) == pytest.approx([0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9])


@pytest.mark.parametrize("order", [2, 3])
def test_stored_weights_of_all_contexts(spark, tmp_path, order, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 900)  # several parts
    docs = texts(60)
    _, _, grams, alpha = brute(docs, order)
    katz.score(spark.createDataFrame(docs, "doc_id long, text string, held_out boolean"), order, str(tmp_path / "m")).collect()
    stored, counted = {}, {}
    for r in spark.read.schema(katz.WEIGHT_TYPES).parquet(str(tmp_path / "m" / "backoff")).where("kind = 'weight'").collect():
        keys = katz.unpack_keys(r["keys"]).tolist()
        assert not set(keys) & set(stored) or r.k != order
        stored |= {(r.k, k): w for k, w in zip(keys, katz.unpack(r.weights, np.float64), strict=True)}
    for r in spark.read.schema(katz.TABLE_TYPES).parquet(str(tmp_path / "m" / "counts")).where("kind = 'table'").collect():
        counted |= {(r.k, k): int(c) for k, c in zip(katz.unpack_keys(r["keys"]).tolist(), katz.unpack(r.counts, np.int64), strict=True)}
    hash_of = lambda w: katz.BEGIN if w == "<b>" else katz.END if w == "<e>" else np.uint64(xxhash.xxh3_64_intdigest(w.encode()))
    key = lambda g: int(common.windows(np.array([hash_of(w) for w in g], np.uint64), len(g))[0])
    for k in range(2, order + 1):
        contexts = {g[:-1] for g in grams[k]}
        assert len([x for x in stored if x[0] == k]) == len(contexts)
        for ctx in contexts:
            assert stored[k, key(ctx)] == pytest.approx(math.log10(alpha(k, ctx)), abs=1e-9)
    assert all(counted[k, key(g)] == c for k in grams for g, c in grams[k].items())


def test_no_training_rows_and_nulls(spark):
    rows = [(1, "a b", True), (None, None, False)]
    got = {r.doc_id: r for r in katz.score(spark.createDataFrame(rows[:1], "doc_id long, text string, held_out boolean")).collect()}
    assert got[1].train_tokens == 0 and got[1].score == 0 and got[1].n_known == 0
    got = {r.doc_id: r for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert got[None].n_tokens == 1 and got[None].train_tokens == 1 and got[1].n_tokens == 3


def test_repeated_rows_clashing_columns_and_a_text_beyond_a_block(spark):
    rng = np.random.default_rng(8)
    long = " ".join(rng.choice([f"longer{i}" for i in range(40)], 800_000))
    assert len(long) > katz.BLOCK_BYTES
    docs = texts(30)
    docs += [docs[3], docs[3], docs[-1], (900, long, False)]
    expected, *_ = brute(docs, 2)
    clash = [(*d, 1, "x", 2.0) for d in docs]
    got = katz.score(spark.createDataFrame(clash, "doc_id long, text string, held_out boolean, k int, part string, score double").repartition(2)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in docs)
    for r in got:
        n, known, n_all, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, n_all)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_empty_table(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).count() == 0


def test_packed_arrays():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all() and len(katz.unpack_keys(katz.pack_keys(keys[:0]))) == 0
    parts = katz.parts_of(keys, 7)
    assert [b for _, b, _ in parts] == [0, *[e for *_, e in parts[:-1]]] and parts[-1][2] == len(keys)
