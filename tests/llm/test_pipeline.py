"""The corpus pipeline, stage by stage, on the smallest documents."""

import pytest
from pyspark.sql import functions as F

from sondage.llm import decontam, minhash, mixing, pii
from sondage.llm.common import materialise

from .test_corpus import own_columns_stay


@pytest.fixture(scope="module")
def small():
    """1,000 documents: with fewer labels the classifier is no test."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, small):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, small), name)
        out.append((name, before, docs))
    return out


def test_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stages[-1][2].columns == [*stages[-1][1].columns, "copies"]


def test_quality_keeps_clean_documents(spark, small, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = after.select("doc_id")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count() and bad.join(kept, "doc_id").count() <= 0.1 * bad.count()


def test_one_of_each_class_stays(stages):
    _, before, after = stages[1]
    classes = minhash.near_duplicates(before).where("kept")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in classes.collect())
    assert minhash.near_duplicates(after).where("NOT kept").count() == 0


def test_no_benchmark_windows_stay(spark, small, stages):
    _, before, after = stages[2]
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    hit = lambda d: {r.doc_id for r in decontam.search(d, items).where(F.size("found.items") > 0).collect()}
    was = hit(before)
    assert was and not hit(after)
    clean = before.where(~F.col("doc_id").isin(list(was)))
    assert clean.exceptAll(after).count() == 0


def test_no_personal_data_stays(stages):
    _, before, after = stages[3]
    assert any(pii.base_spans(r.text) for r in before.collect()) and not any(pii.base_spans(r.text) for r in after.collect())
    assert before.count() == after.count() and after.where("n_chars != length(text)").count() == 0


def test_mix_takes_what_it_says(stages):
    _, before, after = stages[4]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert {r.doc_id: r.copies for r in after.collect()} == want


def test_awkward_documents_pass_every_stage(spark, small, awkward, nothing):
    import corpus_pipeline

    for docs in (awkward, nothing):
        given = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, materialise(stage(spark, docs, small), "stage")
            assert docs.columns == given and docs.count() <= before.count()
            assert own_columns_stay(docs.collect()) or docs.columns == nothing.columns
            if name == "near_duplicates" and docs.count():
                # Of texts that are alike, of repeated rows and of near copies one stays; null ids and texts stay.
                kept = {r.doc_id for r in before.where("doc_id IS NOT NULL AND text IS NOT NULL").collect()} - {2, 7, 11}
                assert {r.doc_id for r in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect()} == kept
            if name == "personal_data":
                assert not [r for r in docs.collect() if r.text and "@b.co" in r.text] and docs.where("n_chars != length(text)").count() == 0
        last = corpus_pipeline.mixing_stage(spark, docs, small)
        extra = "copies_" if "copies" in given else "copies"
        assert last.columns == [*given, extra] and last.where(f"{extra} < 1").count() == 0
    assert last.count() == 0


def test_stage_keeps_columns_with_clashing_names(spark, small, awkward):
    import corpus_pipeline

    assert own_columns_stay(corpus_pipeline.quality_stage(spark, awkward, small).collect())
