"""The pipeline's stages on a small corpus, and what it does to each document."""

import re

import corpus_pipeline
from passagekit.llm import pii, quality_model, quality_rules, simhash
from tests.llm.conftest import CHECKED


def test_stages_agree_with_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, CHECKED).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["quality_rules"]
    assert ids(after) == {r.doc_id for r in quality_rules.query(spark, CHECKED).where("kept").collect()}
    before, after = kept["quality_classifier"]
    good = {r.doc_id for r in quality_model.query(spark, CHECKED).where("predicted = 1").collect()}
    assert ids(after) == ids(before) & good
    before, after = kept["simhash_near_dedup"]
    groups = simhash.near_duplicates(before).collect()
    assert sorted(ids(after)) == sorted({r.component_id for r in groups}) and after.count() == len(ids(after))
    before, after = kept["pii"]
    wanted = {r.doc_id: pii.replaced(r.text, pii.entities(r.text, pii.Surrogates(pii.KEY))) for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == wanted
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["best_fit_packing"]
    assert ids(after) == ids(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{CHECKED}/labels.parquet").collect()}
    left = [labels[i] for i in ids(before) if i in labels]
    assert all(left) and len(left) > 250


def test_empty_and_odd_documents(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "x y", None, None, 3), (None, "x y", None, None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows_of, name in ((rows, "odd"), ([], "empty")):
        docs = spark.createDataFrame(rows_of, schema)
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        for stage_name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path / name)).collect()
            if stage_name == "simhash_near_dedup":
                assert len(found) == (3 if rows_of else 0)
        assert corpus_pipeline.run(spark, str(tmp_path / name)).collect() == []


def test_near_copies_move_each_text_once(spark, tmp_path):
    text = "one two three four five six"
    hashed = spark.sql(f"SELECT xxhash64('{text} seven')").first()[0]
    rows = [(7, text, 1, 2), (5, text, 1, 2), (5, text, 1, 2), (None, text, 3, 4), (None, text, 3, 4), (None, None, 5, 6), (8, None, 7, 8)]
    rows += [(hashed, "something else altogether here", 9, 0), (None, f"{text} seven", 9, 0), (5, "", 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _first int, _place int")
    docs.write.parquet(str(tmp_path / "documents"))
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.read.parquet(str(tmp_path / "documents")), "")
    assert kept.columns == docs.columns
    wanted = [(5, text, 1, 2), (None, text, 3, 4), (None, None, 5, 6), rows[7], rows[8], (5, "", 9, 0)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(wanted, key=str)
    # Texts are shuffled once, and sorted only after the join, where none but those of repeated rows are left.
    plan = kept._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2
    written = re.findall(r"(?m)^\W*Exchange hashpartitioning\((.*)", plan)
    assert sum("_place" in keys for keys in written) == 1, plan
