import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.packing import Packing
from corpusflow.operators.chunking import chunk_documents, with_chunk_key
from corpusflow.operators.ivf import assign_cells
from corpusflow.session import shared_folder
from corpusflow.sources import chunk_store, text_files, vector_store
from corpusflow.streaming.ingest import start_chunk_stream

LONG = "A sentence of some length, with a comma. " * 40


@pytest.fixture
def folder(tmp_path):
    papers = tmp_path / "papers"
    (papers / "deeper").mkdir(parents=True)
    (papers / "0810.1v2.txt").write_bytes(b"one\r\ntwo\rthree\xff \xe2\x82 \xc3\xa9\n")
    (papers / "long.txt").write_text(LONG)
    (papers / "empty.txt").write_text("")
    (papers / "notes.md").write_text("not a paper")
    (papers / "deeper" / "hidden.txt").write_text("not directly in the folder")
    return papers


def test_papers_of_a_folder(spark, folder):
    rows = {r.doc_key: r for r in text_files.read_papers(spark, str(folder)).collect()}
    assert set(rows) == {"0810.1v2", "long", "empty"} and rows["empty"].text == ""
    assert rows["0810.1v2"].source_file == "0810.1v2.txt"
    raw = (folder / "0810.1v2.txt").open(encoding="utf-8", errors="ignore").read()
    assert rows["0810.1v2"].text == raw == "one\ntwo\nthree  é\n"


def test_papers_of_several_folders(spark, folder, tmp_path):
    (tmp_path / "more").mkdir()
    for k in range(50):
        (tmp_path / "more" / f"{k}.txt").write_text("x" * k)
    rows = text_files.read_papers(spark, str(folder), str(tmp_path / "more"))
    assert rows.count() == 53 and {r.doc_key for r in rows.where("text = ''").collect()} == {"empty", "0"}
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "LocalRelation" not in plan and "inputFiles" not in plan
    (tmp_path / "none").mkdir()
    assert text_files.read_papers(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="not"):
        text_files.read_papers(spark, str(tmp_path / "missing"))


def test_replacement_characters_of_a_text_stay(spark, tmp_path):
    cases = {"valid": "a\ufffdb\r\n".encode(), "broken": b"\xff\xef\xbf\xbd\xe2\x82x\xef\xbf\xbd\xef\xbf", "é ü": b"\xc3"}
    for name, content in cases.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    (tmp_path / "no thing é.txt").write_bytes(b"")
    rows = {r.doc_key: r.text for r in text_files.read_papers(spark, str(tmp_path)).collect()}
    assert rows == {"valid": "a\ufffdb\n", "broken": "\ufffdx\ufffd", "é ü": "", "no thing é": ""}


@pytest.mark.parametrize("name", ["a.txt", "a.b.txt", ".txt", "a", "a.", "..a.txt"])
def test_file_stem(value, name):
    from pathlib import Path

    assert value(text_files.file_stem, name) == Path(name).stem


def test_chunks_as_json(spark, folder, tmp_path):
    chunks = chunk_documents(text_files.read_papers(spark, str(folder)), Packing(60, 10))
    chunk_store.write_chunks_json(chunks, str(tmp_path / "json"))
    back = chunk_store.read_chunks_json(spark, str(tmp_path / "json"))
    assert back.exceptAll(chunks).count() == 0 == chunks.exceptAll(back).count()
    assert chunks.count() > 5
    chunk_store.write_chunks(with_chunk_key(chunks), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == chunks.count()


def test_single_chunk_file(spark, tmp_path):
    chunk = {
        "text": "Größe",
        "metadata": {"paper_id": "p", "chunk_index": 0, "total_chunks": 1, "section": "abstract",
                     "char_count": 5, "token_count": 1, "source_file": "p.txt"},
    }
    whole = {
        "chunks": [chunk],
        "statistics": {"total_documents": 1, "total_chunks": 1, "total_tokens": 1, "avg_chunk_size": 1.0,
                       "documents_processed": [{"filename": "p.txt", "chunks": 1, "tokens": 1}]},
        "config": {"chunk_size": 512, "chunk_overlap": 100, "encoding": "cl100k_base"},
    }
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps(whole, indent=2, ensure_ascii=False), encoding="utf-8")
    row = chunk_store.read_chunk_file(spark, str(path)).first()
    assert row.text == "Größe" and row.metadata.asDict() == chunk["metadata"]
    recorded = chunk_store.read_chunk_file_statistics(spark, str(path)).first()
    assert (recorded.total_tokens, recorded.chunk_size) == (1, 512)


def test_vector_table(spark, tmp_path):
    rows = [(i, [float(i % 3 == c) for c in range(3)]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "vec_key long, embedding array<float>")
    import numpy as np

    path = str(tmp_path / "vectors")
    vector_store.write_vectors(assign_cells(vectors, np.eye(3)), path)
    assert sorted(d for d in os.listdir(path) if "=" in d) == [f"cell_id={c}" for c in range(3)]
    stored = vector_store.read_vectors(spark, path)
    assert {(r.vec_key, r.cell_id) for r in stored.collect()} == {(i, i % 3) for i in range(9)}
    config = vector_store.index_config(stored, "model", "ivf").first()
    assert tuple(config) == ("model", 3, 9, "IndexIVFFlat")
    plain = str(tmp_path / "plain")
    vector_store.write_vectors(vectors, plain)
    vector_store.append_vectors(vectors.withColumn("vec_key", F.col("vec_key") + 9), plain)
    assert vector_store.read_vectors(spark, plain).count() == 18


def test_stream_of_files(spark, folder, tmp_path):
    p, out, state = Packing(60, 10), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        start_chunk_stream(text_files.stream_papers(spark, str(folder)), out, state, p).awaitTermination()
        return spark.read.parquet(out)

    def batch():
        return chunk_documents(text_files.read_papers(spark, str(folder)), p)

    first = run()
    assert first.exceptAll(batch()).count() == 0 == batch().exceptAll(first).count()
    (folder / "new.txt").write_text(LONG + "And more, later.")
    second = run()  # only the new file is read
    assert second.exceptAll(batch()).count() == 0 == batch().exceptAll(second).count()
    assert second.count() > first.sparkSession.read.parquet(out).filter("metadata.paper_id = 'new'").count() > 0


def test_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and a.startswith(f"{root}/x-")


def test_folders_of_chunk_files_are_read_by_tasks(spark, tmp_path):
    """As by Spark's own source, but in as many tasks as their bytes ask for, however many files there are."""
    folder = tmp_path / "files"
    (folder / "below").mkdir(parents=True)

    def whole(name, text="Größe x"):
        chunks = [{"text": f"{text} {k}", "metadata": {"paper_id": name, "chunk_index": k}} for k in range(2)]
        return json.dumps({"chunks": chunks, "config": {"chunk_size": 1}}, ensure_ascii=False)

    for k in range(300):
        (folder / f"{k}.json").write_text(whole(str(k)), encoding="utf-8")
    (folder / "below" / "deep").write_text(whole("deep"), encoding="utf-8")
    (folder / "mark.json").write_text(whole("mark"), encoding="utf-8-sig")
    (folder / "wide.json").write_text(whole("wide"), encoding="utf-16")
    (folder / "packed.json.gz").write_bytes(gzip.compress(whole("packed").encode()))
    (folder / "empty.json").write_text("")
    (folder / "broken.json").write_bytes(b'{"chunks": [{"text": "\xff\xfe')
    (folder / "null.json").write_text('{"chunks": null}')
    for hidden in ("_hidden.json", ".hidden.json"):
        (folder / hidden).write_text(whole(hidden))
    got = chunk_store.read_chunk_file(spark, str(folder))
    own = spark.read.schema(chunk_store.CHUNK_FILE_SCHEMA).option("multiLine", True).json(str(folder))
    own = own.select(F.explode("chunks").alias("c")).select("c.text", "c.metadata")
    assert got.count() == own.count() == 2 * 303
    assert got.schema == own.schema and got.exceptAll(own).count() == 0 == own.exceptAll(got).count()
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < own.rdd.getNumPartitions()
    assert chunk_store.read_chunk_file(spark, str(folder / "below"), str(folder)).count() == 2 * 304
    (tmp_path / "parts" / "k=1").mkdir(parents=True)
    (tmp_path / "parts" / "k=1" / "part").write_text(whole("part"), encoding="utf-8")
    assert chunk_store.read_chunk_file(spark, str(tmp_path / "parts")).count() == 2
