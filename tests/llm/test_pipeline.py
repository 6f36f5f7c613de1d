"""The pipeline: each stage's decision, stage by stage, and the registered queries."""

import corpus_pipeline
import pytest
from dupescope.llm import bpe, decontaminate, jaccard, language, secrets
from dupescope.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "language":
            model = language.fit(docs)
            rows = docs.select("doc_id", "text").collect()
            langs, scores = language.predict_texts([r.text for r in rows], model)
            assert ids(out) == sorted(r.doc_id for r, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= 0.3)
            assert all(any(c.isalpha() for c in r.text or "") for r in out.collect())
        elif name == "near_duplicates":
            assert ids(out) == ids(jaccard.linked(docs).where("doc_id = component_id"))
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert ids(out) == [i for i in ids(docs) if i not in bad]
        elif name == "secrets":
            assert ids(out) == ids(docs) and not secrets.scan(out).where("n_assign + n_access + n_hex > 0").count()
        else:
            assert ids(out) == ids(docs)
            continue
        assert out.columns == docs.columns
        docs = out
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, bpe.token_digests(docs, bpe.vocabulary_path()).collect()))


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "src1", 0), (None, "the of and", "en", None, 3), (2, "", None, "src2", 0), (3, "the of and to", "en", "src3", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, DATA)
        assert frame.columns[0] == "doc_id"


def test_stages_take_clashing_columns_and_repeated_rows(spark):
    extra = {"lang_pred": "x", "score": "y", "h": "z", "component_id": "c", "item_id": "i", "family": "f", "ids_sha256": "s", "rep": "r"}
    rows = [(i, f"the {w} of the house and the sea near {w}", "en", f"src{i}", 9, *extra.values()) for i, w in enumerate(("one", "two", "three"))]
    docs = spark.createDataFrame([*rows, rows[0]], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{c} string" for c in extra)]))
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, DATA)
        assert frame.columns == docs.columns and frame.count() == 4
    tokens = corpus_pipeline.STAGES[4][1](spark, frame, DATA).collect()
    assert sorted(r.doc_id for r in tokens) == [0, 0, 1, 2] and len({r.ids_sha256 for r in tokens}) == 3


def test_secret_stage_learns_from_every_document(spark):
    value = "-dishwasher-mississippi-"  # harmless once both words are known, which only the last five documents hold
    rows = [(i, f"the house pwd={value}" if i < 1 else "the house", "en", "src", 9) for i in range(9000)]
    rows += [(i, "the " * 10_000 + f"dishwasher mississippi {i}", "en", "src", 9) for i in range(9000, 9005)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, DATA)
    assert out.where("text like '%SECRET%'").count() == 0
    assert secrets.find(rows[0][1])[1]  # with the fixed words alone it is a secret


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_near_duplicates_go_whether_their_ids_are_broadcast_or_joined(spark, most, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_IDS", most)
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    rows = [(i, texts[i % 2], "x") for i in range(8)] + [(None, texts[0], "x"), (9, None, "x"), (0, texts[0], "y")]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, h string"))
    assert out.columns == ["doc_id", "text", "h"] and sorted(map(str, (r.doc_id for r in out.collect()))) == ["0", "0", "1", "9", "None"]


@pytest.mark.parametrize("copies", [6, 1000])
def test_secret_stage_keeps_finding_what_is_copied(spark, copies):
    rows = [(i, f"note {i} pwd = 'qzxkvbwjrtph' end", "en", "src", 9) for i in range(copies)]  # near copies, below 0.8
    out = dict(corpus_pipeline.STAGES)["secrets"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA)
    assert out.where("text like '%SECRET%' and text not like '%qzxkvbwjrtph%'").count() == copies


@pytest.mark.parametrize("n", range(1, 14))
def test_a_query_for_each_operator(n):
    assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(ORACLE_SQL) <= set(QUERIES)
