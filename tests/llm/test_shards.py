"""Operator 4: the permutation is one to one, and shards give the documents back."""

import numpy as np
import pytest
from dupescope.llm import common, shards
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 62))
def test_permutation(n, key):
    p = shards.Permutation(n, key)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (p.ordinals(slots) == np.arange(n)).all()


def test_keys_differ():
    assert (shards.Permutation(1000, 1).slots(np.arange(1000)) != shards.Permutation(1000, 2).slots(np.arange(1000))).mean() > 0.9


TEXTS = ["hello world", None, "", "é漢🙂" * 50, "x" * 5000, "same", "same"]


@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip_and_resume(spark, tmp_path, parts):
    layout = shards.Layout(length=64, per_shard=8)
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    total = shards.write(docs, str(tmp_path / "s"), 5, layout)
    got = sorted(shards.read(spark, str(tmp_path / "s"), layout).collect())
    assert [r.slot for r in got] == list(range(total))
    stream = b"".join(r.ids for r in sorted(got, key=lambda r: r.ordinal))
    assert sorted(stream.split(b"\xff")[:-1]) == sorted((t or "").encode() for _, t, _ in rows)
    assert (shards.Permutation(total, 5).slots(np.array([r.ordinal for r in got])) == np.array([r.slot for r in got])).all()
    assert sorted(shards.read(spark, str(tmp_path / "s"), layout, 11, 30).collect()) == got[11:30]
    files = [f for f in (tmp_path / "s").rglob("part-*") if not f.name.endswith(".crc")]
    assert len(files) == -(-total // 8) and all(f.stat().st_size % layout.stride == 0 for f in files)


@pytest.mark.parametrize("width", [2, 4])
def test_wide_ids_of_the_bpe_operator(spark, tmp_path, width):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    layout = shards.Layout(length=16, width=width, per_shard=4)
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")  # a column by the name of the shards' folder
    shards.write(docs, str(tmp_path / "s"), 9, layout, shards.BpeTokens(path, width=width))
    got = sorted(shards.read(spark, str(tmp_path / "s"), layout).collect(), key=lambda r: r.ordinal)
    ids = np.frombuffer(b"".join(r.ids for r in got), f"<u{width}").tolist()
    expected = [[*library.encode(t or "", add_special_tokens=False).ids, 49407] for _, t, _ in rows]
    found, doc = [], []
    for i in ids:
        doc.append(i)
        if i == 49407:
            found.append(doc)
            doc = []
    assert not doc and sorted(found) == sorted(expected)


def test_first_ordinals(spark):
    rng = np.random.default_rng(4)
    rows = [(int(n), int(c)) for n, c in zip(rng.integers(-(1 << 63), 1 << 63, 500), rng.integers(1, 9, 500), strict=True)]
    firsts, total = shards.first_ordinals(spark.createDataFrame(rows, "name long, n long"))
    first, count = {r.name: r.first for r in firsts.collect()}, dict(rows)
    at = 0
    for name in sorted(first, key=first.get):
        assert first[name] == at
        at += count[name]
    assert at == total and len(first) == 500


def test_each_task_writes_a_range_of_shards(spark, tmp_path):
    layout = shards.Layout(length=8, per_shard=4)
    docs = spark.createDataFrame([(i, f"some text of document {i}") for i in range(100)], "doc_id long, text string")
    total = shards.write(docs, str(tmp_path / "s"), 3, layout)
    by_task = {}
    for f in (tmp_path / "s").rglob("part-*"):
        if not f.name.endswith(".crc"):
            by_task.setdefault(f.name[:10], []).append(int(f.parent.name.removeprefix("shard=")))
    ranges = sorted((min(x), max(x), len(x)) for x in by_task.values())
    assert all(high - low + 1 == n for low, high, n in ranges) and sum(n for *_, n in ranges) == -(-total // 4)
    assert len(ranges) == common.partitions(spark) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert shards.op4_training_order(spark, str(tmp_path)).count() == 0


def test_damage_is_found():
    layout = shards.Layout(length=16)
    good = layout.record(3, 4, 5, b"abc") + b"\n"
    assert layout.parse(good) == (3, 4, 5, b"abc")
    with pytest.raises(ValueError):
        layout.parse(good[:40] + b"?" + good[41:])
