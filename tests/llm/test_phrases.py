"""Operator 12 against brute force on small corpora; SQL on the smallest data."""

import random
import re
from collections import Counter, defaultdict

import duckdb
from dupescope.llm import phrases


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 30}
        covered = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        kept = []
        for p, a in candidates.items():
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not (p in covered and 100 * covered[p] >= 80 * a):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["a", "b", "New", "york", "city", "é", "\x1cx", "z\x00q", "ß", "İ"] + [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(400):
        lang = rng.choice(["en", "en", "de", None, "und"])
        text = " ".join(rng.choice(["New York", "new york city", "a a a", "big  red\tdog", "É x"]) if rng.random() < 0.4 else rng.choice(words) + rng.choice(["", "", ".", ",", "\n", "\r", "\x0b"]) for _ in range(rng.randint(1, 40)))
        rows.append((text, lang))
    rows += [("in situ of late in situ of late " * 40, "en"), (None, "en"), ("", "fr"), (" \n.", None), ("one two", "fr")] + [("ein ganzer satz hier", "de")] * 50
    return rows


def collect(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def test_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i // 2, t, x, "clash", 1) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f int").repartition(3)
    got, expected = collect(phrases.collocations(docs)), brute(rows)
    assert got == expected and len({r[0] for r in got}) >= 3 and any(" " in r[2] and r[2].count(" ") == 3 for r in got)


def test_the_first_two_thousand_with_ties(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TOP", 7)  # used on the driver only
    rows = [(f"x{i} y{i}", "en") for i in range(20) for _ in range(30)] + [("é1 y", "en")] * 30
    got = [r[2] for r in collect(phrases.collocations(spark.createDataFrame(rows, "text string, lang string")))]
    assert sorted(got) == sorted(sorted([f"x{i} y{i}" for i in range(20)] + ["é1 y"], key=str.encode)[:7])


def test_several_automata_and_overlaps(monkeypatch):
    monkeypatch.setattr(phrases, "AUTOMATON_CHARS", 8)
    patterns = ["a a", "a", "ab", "b a", "b", "a b a b"]
    assert len(list(phrases.automata(patterns))) > 1
    assert phrases.matches(patterns, " a a a . ab b a . a b a b a b ").tolist() == [2, 7, 1, 3, 4, 2]
    assert phrases.matches([], " a ").tolist() == [] and phrases.words_of(None) == []


def test_very_long_text_and_upper_bounds(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(400_000))
    rows = [(text, "en"), ("q r", "en")]
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).collect()
    words = text.split(" ")
    pairs = Counter(zip(words, words[1:], strict=False))
    assert got and all(r.a == pairs[tuple(r.phrase.split(" "))] for r in got if r.phrase.count(" ") == 1)


def test_exact_beyond_64_bits(spark):
    most = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", most - 1, 1, 2), ("en", "a b c", most - 5, 1, 3), ("en", "b c", most, 2, 3), ("en", "", 4 * most, 0, 0)], "lang string, phrase string, f long, first long, last long")
    words = spark.createDataFrame([(1, most), (2, most + 2), (3, most)], "h long, f long")
    got = {r.phrase: (r.score, r.l, r.r) for r in phrases.scored(counts, words).collect()}
    assert got == {"a b": (2000000 * (most - 1) // (2 * most + 2), most, most + 2), "b c": (2000000 * most // (2 * most + 2), most + 2, most), "a b c": (999999, most, most)}
    assert [r.phrase for r in phrases.ranked(counts, words).collect()] == ["a b c"]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_equals_sql(spark, tmp_path):
    spark.createDataFrame(corpus(), "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(phrases.OP12_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, phrases.op12_collocations(spark, str(tmp_path)).select(names).collect())) == sorted(cur.fetchall())
