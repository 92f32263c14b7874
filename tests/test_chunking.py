from pyspark.sql import functions as F

from corpusflow.functions.packing import Packing
from corpusflow.functions.tokens import FunctionCounter
from corpusflow.operators import chunking

RAW = (
    "[12pt]article\n\\begin{document}\nThis opening, with its commas, is longer than fifty characters.\n"
    "Results\nDiscussion\nShort, one.\n"
    "References\n" + " ".join(f"Sentence {i}, of a few words." for i in range(30))
)


def papers(spark):
    rows = [("p.1", "p.1.txt", RAW), ("empty", "empty.txt", ""), ("broken", "broken.txt", None)]
    return spark.createDataFrame(rows, "doc_key string, source_file string, text string")


def test_chunks_and_metadata(spark):
    p = Packing(chunk_size=60, overlap=12)
    rows = chunking.chunk_documents(papers(spark), p).orderBy("metadata.chunk_index").collect()
    meta = [r.metadata for r in rows]
    assert [m.chunk_index for m in meta] == list(range(len(rows)))
    assert {m.total_chunks for m in meta} == {len(rows)} and {m.paper_id for m in meta} == {"p.1"}
    assert [m.section for m in meta] == ["introduction"] + ["References"] * (len(rows) - 1)
    assert all(m.char_count == len(r.text) >= 50 for m, r in zip(meta, rows))
    assert all(m.token_count == len(r.text.split()) for m, r in zip(meta, rows))
    assert all(m.token_count <= 72 for m in meta)
    # The tail of one chunk begins the next.
    assert rows[2].text.split()[:12] == rows[1].text.split()[-12:]
    keys = chunking.with_chunk_key(chunking.chunk_documents(papers(spark), p)).select("chunk_key")
    assert {r.chunk_key for r in keys.collect()} == {f"p.1#{i}" for i in range(len(rows))}


def test_statistics_count_all_documents(spark):
    p = Packing(chunk_size=60, overlap=12)
    statistics = chunking.document_statistics(papers(spark), p)
    by_key = {r.doc_key: r for r in statistics.collect()}
    chunks = chunking.chunk_documents(papers(spark), p)
    n = chunks.count()
    tokens = chunks.agg(F.sum("metadata.token_count")).first()[0]
    assert (by_key["p.1"].chunks, by_key["p.1"].tokens, by_key["p.1"].error) == (n, tokens, None)
    assert (by_key["empty"].chunks, by_key["empty"].error) == (0, None)
    assert (by_key["broken"].chunks, by_key["broken"].error) == (0, "no text")
    totals = chunking.corpus_statistics(statistics).first()
    assert tuple(totals) == (3, n, tokens, tokens / n)
    failed = chunking.failed_documents(chunking.chunk_arrays(papers(spark), p))
    assert [r.doc_key for r in failed.collect()] == ["broken"]
    stored = chunking.statistics_of_chunks(chunks, papers(spark)).collect()
    assert {(r.doc_key, r.chunks, r.tokens) for r in stored} == {
        ("p.1", n, tokens), ("empty", 0, 0), ("broken", 0, 0),
    }
    nothing = chunking.corpus_statistics(statistics.filter("chunks = 0")).first()
    assert tuple(nothing) == (2, 0, 0, 0.0)


def test_preview(spark):
    rows = chunking.preview_chunks(chunking.chunk_documents(papers(spark), Packing(60, 12))).collect()
    assert [r.chunk_index for r in rows] == [0, 1, 2] and all(len(r.preview) <= 200 for r in rows)


def test_function_counter_gives_the_same_as_words(spark):
    words = FunctionCounter(lambda: lambda text: len(text.split()))
    for f in (chunking.chunk_documents, chunking.document_statistics):
        plain = f(papers(spark), Packing(60, 12))
        counted = f(papers(spark), Packing(60, 12, counter=words))
        assert sorted(map(str, counted.collect())) == sorted(map(str, plain.collect()))


def test_a_counter_that_raises_fails_one_document(spark):
    def factory():
        def count(text):
            if "|" in text:
                raise ValueError("reserved sign")
            return 7 * len(text)

        return count

    rows = [("a", "a.txt", "plain words. " * 40), ("b", "b.txt", "bad | sign. " * 40), ("c", "c.txt", None), ("d", "d.txt", "")]
    table = spark.createDataFrame(rows, "doc_key string, source_file string, text string")
    p = Packing(chunk_size=600, overlap=90, counter=FunctionCounter(factory))
    stats = {r.doc_key: r for r in chunking.document_statistics(table, p).collect()}
    assert {k: r.error for k, r in stats.items()} == {"a": None, "b": "token counter failed: reserved sign", "c": "no text", "d": None}
    chunks = chunking.chunk_documents(table, p).collect()
    assert {r.metadata.paper_id for r in chunks} == {"a"} and stats["a"].chunks == len(chunks) > 5
    assert all(r.metadata.token_count == 7 * len(r.text) for r in chunks)
    assert stats["a"].tokens == sum(r.metadata.token_count for r in chunks)
    failed = chunking.failed_documents(chunking.chunk_arrays(table, p)).collect()
    assert sorted(r.doc_key for r in failed) == ["b", "c"]


def test_preview_takes_as_many_papers_as_it_needs(spark):
    rows = [(f"{i:02d}", f"{i}.txt", "A sentence of some words for a chunk, no more. " * 3 if i % 7 == 6 else "short") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_key string, source_file string, text string")
    want = chunking.preview_chunks(chunking.chunk_documents(table)).collect()
    assert chunking.preview_documents(table).collect() == want and len(want) == 3
    assert len(chunking.preview_documents(table.limit(10)).collect()) == 1
    assert chunking.preview_documents(table.limit(0)).collect() == []
