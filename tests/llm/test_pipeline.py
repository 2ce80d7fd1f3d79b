"""The pipeline's stages, each on what the one before kept."""

import os

import corpus_pipeline
from tallygrid.llm import decontaminate, quality, similar


def test_stages(spark, small, tmp_path):
    docs = before = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == before.columns
        kept[name] = (docs, after)
        docs = after
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    source, after = kept["quality"]
    scores = quality.score_quality(source, spark.read.parquet(f"{small}/labels.parquet"))
    assert ids(after) == ids(scores.where("predicted = 1"))
    source, after = kept["near_duplicates"]
    groups = similar.similar_documents(source)
    assert ids(after) == ids(groups.where("key = first_key"))
    source, after = kept["repeats"]
    assert ids(after) == ids(source)
    source, after = kept["decontamination"]
    leaked = ids(decontaminate.leaks(source, spark.read.parquet(f"{small}/benchmark.parquet")))
    assert ids(after) == ids(source) - leaked
    source, after = kept["packing"]
    assert ids(after) == ids(source)


def test_run_gives_the_last_stage(spark, small):
    assert "bin_id" in corpus_pipeline.run(spark, small).columns


def written(spark, folder, documents):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "some question that nobody asks but in this benchmark of ours today"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


SCHEMA = "doc_id long, text string, source string, key long, f long, label string, n_words int, a long, node long, cluster long"


def test_odd_tables_go_through(spark, tmp_path):
    """Nulls in every column, empty, long and repeated texts, and columns whose names the stages use themselves."""
    long, leak = "word " * 40_000, "Well: some question that nobody asks but in this benchmark of ours today, it says"
    rows = [(1, "A text of its own with quite a few words in it.", "a"), (2, None, "a"), (3, "", None), (4, " \n", "b"), (5, long, "a"), (6, long, "b"), (None, "No id.", "b"), (None, None, None), (8, leak, "c"), (9, "x", "c"), (9, "x", "c"), (9, "y", "c")]
    docs = spark.createDataFrame([(*r, 1, 2, "l", 3, None, 5, None) for r in rows], SCHEMA)
    out = corpus_pipeline.run(spark, written(spark, tmp_path / "odd", docs)).toPandas()
    kept = set(out.doc_id.dropna().astype(int))
    assert {1, 5, 9} <= kept and 6 not in kept and 8 not in kept and out.doc_id.isna().any()
    assert (out[out.doc_id == 9].groupby("piece").size() == 3).all()


def test_empty_tables_go_through(spark, tmp_path):
    out = corpus_pipeline.run(spark, written(spark, tmp_path / "empty", spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0 and "bin_id" in out.columns


def test_stages_leave_only_the_result(spark, small):
    from tallygrid.llm.common import shared_dir

    out = corpus_pipeline.run(spark, small)
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == ["packing"] and shared_dir(spark).removeprefix("file://") in folder
