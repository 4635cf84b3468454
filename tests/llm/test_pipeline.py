"""Stages of the pipeline, each judged on its own input, and their chain."""

import collections

import pytest

import corpus_pipeline
from lonepoint.llm import mixing, pii, toxicity
from lonepoint.llm.near_dedup import near_duplicates
from lonepoint.llm.workload import QUERIES, piece_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """A small table with nulls, repeated rows and one more column."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 1, "", "en", "src0", 0), (None, "a", "de", None, 1)],
        docs.schema,
    )
    return docs.union(odd).selectExpr("*", "'x' AS component_id")


def stage(spark, docs, name):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, SF)


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "sentencepiece"]
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, docs, name):
    assert stage(spark, docs.limit(0), name).count() == 0


def test_toxicity_stage_drops_what_the_classifier_rejects(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = stage(spark, docs, "toxicity")
    assert left.columns == docs.columns
    rejected = toxicity.toxicity(docs, labels).where("predicted = 1").count()
    assert left.count() == docs.count() - rejected and rejected > 0


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs):
    left = stage(spark, docs, "near_dedup")
    assert left.columns == docs.columns
    want = {r.doc_id for r in near_duplicates(docs).where("kept").collect()}
    got = [r.doc_id for r in left.collect()]
    assert set(got) == want and len(got) == len(want)


def test_near_dedup_stage_loses_no_other_texts(spark, docs):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [
        (None, words("n")), (None, words("m")), (None, words("n")), (None, ""), (3, words("a")), (5, words("a") + " end"), (5, words("b")),
        (7, words("c")), (7, words("c") + " end"), (8, words("d")), (8, words("d")), (9, words("e")), (9, words("e")), (9, words("f")),
        (10, None), (10, ""), (11, words("b") + " end"),
    ]
    made = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], docs.schema)
    left = stage(spark, made, "near_dedup")
    assert left.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in left.collect())
    sevens = [got.pop((7, words("c") + end), 0) for end in ("", " end")]
    assert sorted(sevens) == [0, 1]
    assert got == collections.Counter([
        (None, words("n")), (None, words("m")), (None, words("n")), (None, ""), (3, words("a")), (5, words("b")),
        (8, words("d")), (9, words("e")), (9, words("f")), (10, None), (10, ""),
    ])
    # The same without other texts under an id.
    made = made.where("doc_id is null or doc_id in (3, 8)")
    got = collections.Counter(r.doc_id for r in stage(spark, made, "near_dedup").collect())
    assert got == {None: 4, 3: 1, 8: 1}


def test_pii_stage_masks(spark, docs):
    left = stage(spark, docs, "pii")
    assert left.columns == docs.columns and left.count() == docs.count()
    assert pii.find_pii(left).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert left.where("n_chars <> length(text)").count() == 0


def test_mixing_stage_repeats_rows(spark, docs):
    left = stage(spark, docs, "mixing")
    assert left.columns == docs.columns
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    got = collections.Counter()
    for r in left.collect():
        got[r.doc_id] += len((r.text or "").split())
    assert +got == +taken


def test_chain(spark):
    made = corpus_pipeline.run(spark, SF)
    rows = made.collect()
    assert made.columns == ["doc_id", "n_tokens", "ids", "ends", "decoded"] and rows
    model = piece_model()
    assert len(model) and all(r.n_tokens == len(r.ids) == len(r.ends) for r in rows)
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= known
