import json
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.packing import Packing
from corpusflow.operators.chunking import chunk_documents
from corpusflow.operators.embedding import HashedWords, embed, embed_sync, with_content_key
from corpusflow.sources import versioned
from corpusflow.streaming.ingest import current_chunks, start_paper_stream


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, x string")


def held(spark, path):
    return sorted(((r["k"], r["x"]) for r in versioned.read_version(spark, path).collect()), key=str)


def test_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versioned.read_version(spark, path)
    first = versioned.commit(table(spark, [(1, "a"), (2, "b"), (None, "n"), (3, "c"), (3, "d")]), table(spark, []), path, ["k"])
    before = versioned.read_version(spark, path)
    versioned.commit(table(spark, [(2, "B")]), table(spark, [(2, ""), (3, "")]), path, ["k"])
    assert held(spark, path) == [(1, "a"), (2, "B"), (None, "n")]
    versioned.commit(table(spark, [(3, "again")]), table(spark, [(None, "")]), path, ["k"])
    assert held(spark, path) == [(1, "a"), (2, "B"), (3, "again")]
    # Who has read a version goes on reading it, and cannot commit upon it any more.
    assert before.count() == 5
    with pytest.raises(versioned.Conflict):
        versioned.commit(table(spark, [(9, "z")]), table(spark, []), path, ["k"], based_on=first)
    with pytest.raises(ValueError):
        versioned.commit(spark.createDataFrame([(1,)], "k long"), table(spark, []), path, ["k"])
    assert held(spark, path) == [(1, "a"), (2, "B"), (3, "again")]
    monkeypatch.setattr(versioned, "MOST_VERSIONS", 3)
    for i in range(5):
        versioned.commit(table(spark, [(1, str(i))]), table(spark, [(1, "")]), path, ["k"])
        assert len(versioned.manifest(spark, path)["parts"]) <= 3
    assert held(spark, path) == [(1, "4"), (2, "B"), (3, "again")]


def test_broken_off_jobs_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.commit(table(spark, [(1, "a")]), table(spark, []), path, ["k"], batch="s:0")
    table(spark, [(1, "half")]).write.parquet(f"{path}/v2-half/rows")
    with open(f"{path}/_versions/.hidden", "w") as out:
        out.write("{")
    assert held(spark, path) == [(1, "a")]
    again = versioned.commit(table(spark, [(1, "twice")]), table(spark, []), path, ["k"], batch="s:0")
    assert again["version"] == 1 and held(spark, path) == [(1, "a")]
    assert json.load(open(f"{path}/_versions/{versioned.MANIFEST % 1}"))["batches"] == {"s": 0}


def test_synchronised_vectors_equal_a_rebuild(spark, tmp_path):
    path, model = str(tmp_path / "t"), HashedWords(32)
    asked = []

    def texts(rows):
        return spark.createDataFrame(rows, "vec_key long, text string, more int")

    states = [
        [(k, f"text number {k}", 0) for k in range(20)],
        [(k, f"text number {k}" + (" changed" if k % 4 == 0 else ""), 0) for k in range(5, 30)],
        [(k, f"text number {k}" + (" changed" if k % 4 == 0 else ""), 0) for k in range(5, 30)],
        [(7, "seven", 1), (50, None, 1), (51, "", 1), (52, "seven", 1)],
        [],
    ]
    for state in states:
        embed_sync(texts(state), path, model)
        asked.append(versioned.manifest(spark, path)["version"])
        got = sorted(tuple(r) for r in versioned.read_version(spark, path).collect())
        fresh = with_content_key(texts([r for r in state if r[1] is not None]).select("vec_key", "text"))
        want = sorted(tuple(r) for r in embed(fresh, model).collect())
        assert got == want
    assert asked == [1, 2, 2, 3, 4]
    sizes = [spark.read.parquet(f"{path}/{p['rows']}").count() for p in versioned.manifest(spark, path)["parts"]]
    # Twenty at first, then ten new ones and the changed ones of the rest alone.
    assert sizes == [20, 10 + sum(k % 4 == 0 for k in range(5, 20)), 3, 0]


def test_three_deliveries_over_a_restart(spark, tmp_path):
    source, out, state, p = (str(tmp_path / x) for x in ("in", "out", "state")), None, None, Packing(60, 10)
    source, out, state = source
    long = "A sentence of some length, with a comma. " * 40

    def deliver(*rows):
        papers = spark.createDataFrame([(k, f"{k}.txt", t, n) for k, t, n in rows], "doc_key string, source_file string, text string, delivered long")
        papers.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(papers.schema).parquet(source)
        start_paper_stream(stream, out, state, p).awaitTermination()

    deliver(("a", long, 1), ("b", "Bee one.", 1), ("a", "Twice in a batch. " * 30, 2))
    deliver(("a", long + "Last.", 5), ("c", None, 1))
    deliver(("a", "Too late.", 3), ("b", None, 2), ("c", "Here now.", 2), ("a", long + "Last.", 5))
    last = spark.createDataFrame([("a", "a.txt", long + "Last."), ("b", "b.txt", None), ("c", "c.txt", "Here now.")], "doc_key string, source_file string, text string")
    want = chunk_documents(last, p)
    got = current_chunks(spark, out)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and want.count() > 5
    assert len([n for n in os.listdir(f"{out}/_versions") if n.endswith(".json")]) == 3
    failed = versioned.read_version(spark, out).where(F.col("error").isNotNull()).collect()
    assert [r["doc_key"] for r in failed] == ["b"]
