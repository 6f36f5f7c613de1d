"""Operator 13 against brute force over all positions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from dupescope.llm import repeats

L = repeats.LENGTH


def brute(texts):
    """(n_bytes, runs, kept) of each text; every start of every text is counted."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - L + 1):
            if seen[d[i : i + L]] > 1:
                gone[i : i + L] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((len(d), runs, bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])))
    return out


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, spans string, k1 int").repartition(parts)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, [(x.first, x.behind) for x in r.spans], bytes(r.kept)) for r in repeats.without_repeats(docs).collect())
    assert got == sorted((i if i is not None else -1, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    return got


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(30, 90)) for _ in range(4)] + ["é" * 120 + "x" * 30]
    texts = []
    for _ in range(60):
        text = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            b = rng.randint(2 * len(p) // 3, len(p))
            text += rng.choice(["", " ", "-"]) + p[a:b] + words(rng, rng.randint(0, 20))
        texts.append(text)
    near = list(texts[0] + words(rng, 100))
    for _ in range(5):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    texts += [None, "", "short", "y" * 199, "z" * 200, "z" * 201, "ab" * 180, "q" * 1000, texts[3], texts[3], words(rng, 40) * 2, ("0123456789" * 19 + "012345678") * 3]
    rows = list(enumerate(texts))
    rows += [(7, words(rng, 60)), (None, texts[5]), (None, words(rng, 50)), (8, texts[8])]
    return rows


@pytest.mark.parametrize("seed", range(1))
def test_brute_force(spark, seed):
    got = run(spark, corpus(seed))
    assert sum(bool(r[2]) for r in got) > 20 and any(len(r[2]) > 1 for r in got)


def test_edges_of_exactly_the_length(spark):
    rng = random.Random(3)
    rows = []
    for k in range(12):
        s = "".join(rng.choices("abcdefgh", k=L + k // 2))
        inside = s[: L - (k % 2)]
        rows += [(2 * k, words(rng, 20) + "<" + s + ">"), (2 * k + 1, words(rng, 30) + "[" + inside + "]" + words(rng, 5))]
    got = run(spark, rows)
    assert {b - a for r in got for a, b in r[2]} >= {L} and sum(not r[2] for r in got) >= 10


def test_many_contexts_of_one_passage(spark):
    """A passage in many texts whose surroundings all differ, and copies that overlap it only in part."""
    rng = random.Random(4)
    p = words(rng, 70)
    rows = [(i, words(rng, rng.randint(0, 9)) + p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)] + words(rng, rng.randint(0, 9))) for i in range(300)]
    run(spark, rows, 7)


def test_long_text_in_stretches(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(repeats, "STRETCH", 1000)
    p = words(rng, 600)
    pieces = list(repeats.stretches([p.encode(), None, b"x" * 150, b"y" * 200]))
    assert sum(int(x.starts.sum()) for x in pieces) == len(p) - L + 1 + 1
    monkeypatch.undo()
    long = words(rng, 130_000)  # longer than a stretch
    rows = [(1, long + p), (2, p[5:] + long[400_000:700_000]), (3, words(rng, 50) + long[523_000:525_900])]
    got = {r.doc_id: ([(x.first, x.behind) for x in r.spans], bytes(r.kept)) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(long)
    assert got[1][0] == [(400_000, 700_000), (n + 5, n + len(p))] and got[2] == ([(0, len(rows[1][1]))], b"")
    assert got[3][0] == [(len(rows[2][1]) - 2900, len(rows[2][1]))]


def test_digests_and_empty_table(spark, tmp_path):
    text = "w" * 150 + "v" * 150
    spark.createDataFrame([(1, text), (2, "u" + text), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op13_repeats(spark, str(tmp_path)).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {1: (300, 300, 1, digest(b"")), 2: (301, 300, 1, digest(b"u")), 3: (0, 0, 0, digest(b""))}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert repeats.op13_repeats(spark, f"{tmp_path}/none").count() == 0


def test_names():
    data = np.frombuffer(random.Random(1).randbytes(3000) * 2, np.uint8)
    for k in (0, 1):
        names = repeats.Names(data, k)
        at = np.arange(2000)
        assert (names.of(at, 250) == names.of(at + 3000, 250)).all() and len(np.unique(names.of(at, 250))) == 2000
    start, anchor = np.arange(100), repeats.anchors(repeats.Names(data, 0))[:100]
    hashes = repeats.Names(data, 0).grams()
    mask = (1 << 13) - 1
    for p, a in zip(start, anchor, strict=True):
        assert p <= a < p + repeats.REACH and int(hashes[a]) & ~mask == min(int(x) & ~mask for x in hashes[p : p + repeats.REACH])
