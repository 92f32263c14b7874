"""The plans that the queries must keep to hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from corpusflow.operators.embedding import HashedWords, embed
from corpusflow.operators.retrieval import ask_vectors
from corpusflow.operators.search import search
from corpusflow.plans import tables
from corpusflow.plans.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
JVM_ONLY = (
    "chunk_documents", "chunk_sections", "chunk_metadata", "doc_stats", "corpus_stats", "clean_latex",
    "split_sections", "split_sentences", "pack_sentences", "force_split", "token_counts",
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_text_work_stays_in_the_jvm(spark, name):
    text = plan(REGISTRY[name](spark, FOLDER))
    assert "Python" not in text and "InArrow" not in text


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_metadata", "doc_stats", "failed_documents", "split_sections"])
def test_documents_are_not_shuffled(spark, name):
    text = plan(REGISTRY[name](spark, FOLDER))
    assert "Exchange" not in text and "Window" not in text


def test_chunking_expression_is_evaluated_once(spark):
    text = plan(REGISTRY["chunk_documents"](spark, FOLDER))
    assert text.count("documentclass") == 1


def test_top_k_is_limited_before_the_shuffle(spark):
    hits = search(tables.label_vectors(spark, FOLDER).withColumnRenamed("label", "question_id"),
                  tables.vectors(spark, FOLDER))
    text = plan(hits)
    partial = text.index("WindowGroupLimit [question_id")
    assert "WindowGroupLimit" in text[partial + 10 :]  # a final and a partial one
    assert "TakeOrderedAndProject" in plan(REGISTRY["knn_single"](spark, FOLDER))


def test_no_query_makes_all_pairs(spark):
    for name in ("knn_exact", "knn_grid", "knn_ivf", "knn_lsh", "retrieve", "cosine_scores"):
        text = plan(REGISTRY[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_chunks_are_looked_up_without_a_shuffle_and_scored_without_text(spark):
    chunks = tables.stored_chunks(spark, FOLDER)
    vectors = tables.stored_chunk_vectors(spark, FOLDER)
    asked = embed(tables.questions(spark, FOLDER), HashedWords(), "question")
    text = plan(ask_vectors(asked, vectors, chunks))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "text" not in plan(search(asked, vectors))


def test_lookups_read_only_the_folders_of_the_hits(spark):
    assert "dynamicpruning" in plan(REGISTRY["retrieve_with_text"](spark, FOLDER)).lower()


def test_small_sides_never_shuffle_on_a_hot_key(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("cosine_scores", "knn_grid", "knn_exact"):
            text = plan(REGISTRY[name](spark, FOLDER))
            assert not re.search(r"Exchange hashpartitioning\((cell|label)#", text), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_indexes_are_pruned(spark):
    assert re.search(r"PartitionFilters: \[[^\]]*cell_id#", plan(REGISTRY["knn_ivf"](spark, FOLDER)))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan(REGISTRY["knn_lsh"](spark, FOLDER)))


def test_changed_data_is_not_served_from_an_old_table(spark, tmp_path):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source.limit(3).write.parquet(str(tmp_path / "documents.parquet"))
    first = tables.stored_chunks(spark, str(tmp_path)).select("metadata.paper_id").distinct().count()
    source.where("doc_id >= 20").limit(9).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert tables.stored_chunks(spark, str(tmp_path)).select("metadata.paper_id").distinct().count() > first


def test_asked_cells_only(spark, tmp_path):
    import numpy as np

    from corpusflow.operators.ivf import assign_cells, search_ivf
    from corpusflow.sources.vector_store import read_vectors, write_vectors

    rows = [(i, [float(i % 3 == c) for c in range(3)]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "vec_key long, embedding array<float>")
    write_vectors(assign_cells(vectors, np.eye(3)), str(tmp_path / "v"))
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "question_id long, embedding array<float>")
    hits = search_ivf(asked, read_vectors(spark, str(tmp_path / "v")), np.eye(3), k=2)
    assert re.search(r"PartitionFilters: \[[^\]]*cell_id#\d+ = 1", plan(hits))
    assert [r.vec_key for r in hits.collect()] == [1, 4]


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(tables.vectors(spark, FOLDER).filter("vec_key > 3").select("vec_key"))
    assert "PushedFilters: [IsNotNull(vec_id), GreaterThan(vec_id,3)]" in text
    assert "ReadSchema: struct<vec_id:bigint>" in text


def test_entry_points_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own <= set(entry.oracle_sql())
