"""The named queries: every operator at work on the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import clean, packing, sections
from corpusflow.functions.packing import Packing
from corpusflow.functions.tokens import FunctionCounter, WordCounter
from corpusflow.functions.vectors import l2_normalize, score
from corpusflow.operators import bounded, chunking, ivf, quantised, retrieval, search
from corpusflow.operators.embedding import HashedWords, Model, embed, embed_new, embed_sync, with_content_key
from corpusflow.operators.lsh import search_buckets
from corpusflow.plans import tables
from corpusflow.session import handed_over, shared_folder
from corpusflow.sources import chunk_store, text_files, vector_store, versioned
from corpusflow.streaming.ingest import current_chunks, start_chunk_stream, start_paper_stream

Query = Callable[[SparkSession, str], DataFrame]

SMALL = Packing(chunk_size=64, overlap=12)
TINY = Packing(chunk_size=40, overlap=8)
QUESTION_DIMENSION = 64
# Probes and tables that find nine of ten neighbours of questions far from all vectors.
PROBES = 8
TABLES, BITS = 12, 3
SHORT_QUESTION = 150
# Folders that the files of one query are dealt to.
FILE_FOLDERS = 64

REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n.split(".")[-1]) for n in names]


def _numbered(rows: DataFrame, items: Column, number: str, item: str, *keys: str) -> DataFrame:
    exploded = rows.select(*keys, F.posexplode(items).alias(number, item))
    return exploded.withColumn(number, F.col(number).cast("bigint"))


def _flat(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "metadata.paper_id",
        *_big("metadata.chunk_index", "metadata.total_chunks"),
        "metadata.section",
        *_big("metadata.char_count", "metadata.token_count"),
        "metadata.source_file",
        "text",
    )


# Scans and sinks


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``(name, content)`` rows as files, each by the task that holds its row.

    Names may begin with folders that are there.
    """
    whole = text_files.qualified(files.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(whole)
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                with system.open_output_stream(f"{path}/{name.as_py()}") as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    system, path = fs.FileSystem.from_uri(whole)
    system.create_dir(path, recursive=True)
    files.mapInArrow(run, "written bigint").agg(F.sum("written")).first()


@query
def corpus_scan(spark, folder):
    """Papers written as files and read back.

    They have foreign line ends, replacement characters of their own and, but for every third, a
    byte that is not UTF-8; every seventh file is empty.
    """
    whole = F.encode(F.concat("text", F.lit("\ufffd\r\nlast\rline")), "UTF-8")
    broken = F.when(F.col("doc_key") % 3 == 0, whole).otherwise(F.concat(whole, F.unhex(F.lit("FF"))))
    raw = F.when(F.col("doc_key") % 7 == 0, F.lit("").cast("binary")).otherwise(broken)
    name = F.concat(F.col("doc_key").cast("string"), F.lit(".v1.txt"))
    out = shared_folder(spark, "papers")
    write_files(tables.papers(spark, folder).select(name.alias("name"), raw.alias("content")), out)
    return text_files.read_papers(spark, out).select(
        "doc_key", "source_file", *_big_length("text"), F.md5("text").alias("digest")
    )


def _big_length(name: str) -> list[Column]:
    return [F.length(name).cast("bigint").alias("n_chars")]


@query
def failed_documents(spark, folder):
    """German papers lose their text; they alone fail."""
    rows = tables.table(spark, folder, "documents").select(
        F.col("doc_id").alias("doc_key"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.when(F.col("lang") != "de", F.col("text")).alias("text"),
    )
    statistics = chunking.document_statistics(rows)
    return statistics.filter(F.col("error").isNotNull()).select(
        "doc_key", "filename", "error", *_big("chunks", "tokens")
    )


@query
def chunks_json_roundtrip(spark, folder):
    out = shared_folder(spark, "chunks-json")
    chunk_store.write_chunks_json(chunking.chunk_documents(tables.papers(spark, folder)), out)
    return _flat(chunk_store.read_chunks_json(spark, out))


@query
def vector_table(spark, folder):
    stored, _ = tables.stored_cells(spark, folder)
    return stored.select(
        "vec_key", *_big("cell_id"), F.size("embedding").cast("bigint").alias("dimension")
    )


@query
def index_config(spark, folder):
    out = shared_folder(spark, "index-config")
    vector_store.write_index_config(tables.vectors(spark, folder), "driver-vectors", out)
    config = vector_store.read_index_config(spark, out)
    return config.select("model_name", *_big("embedding_dimension", "total_vectors"), "index_type")


@query
def embed_incremental(spark, folder):
    """The English papers are stored first, all papers later, and once more; no text twice."""
    rows = tables.table(spark, folder, "documents").select("lang", "text")
    out = shared_folder(spark, "content-vectors")
    first = with_content_key(rows.filter("lang = 'en'").select("text")).dropDuplicates(["content_key"])
    vector_store.write_vectors(embed(first, HashedWords()), out)
    for _ in range(2):
        new = embed_new(rows, vector_store.read_vectors(spark, out), HashedWords())
        vector_store.append_vectors(handed_over(new, "new-vectors"), out)
    return vector_store.read_vectors(spark, out).select(
        "content_key",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("used_buckets"),
    )


@query
def embed_sync_store(spark, folder):
    """Papers stored, then some changed, some deleted and some added, as a rebuild would have them."""
    rows = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("vec_key"), "lang", "text")
    old = F.when(F.col("vec_key") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    out = shared_folder(spark, "synchronised")
    embed_sync(rows.where("lang != 'fr'").withColumn("text", old), out, HashedWords())
    for _ in range(2):
        embed_sync(rows.where("lang != 'de'"), out, HashedWords())
    return versioned.read_version(spark, out).select(
        "vec_key", "content_key", F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("used_buckets")
    )


def shape_model():
    """A stand-in for an embedding model: how long a text is, and how many words it has."""
    return lambda texts: [[len(t), len(t.split(" ")), 1.0] for t in texts]


@query
def embed_model(spark, folder):
    rows = embed(tables.papers(spark, folder).select("doc_key", "text"), Model(shape_model))
    entries = _numbered(rows, F.col("embedding"), "i", "x", "doc_key")
    return entries.select("doc_key", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


# Cleaning


@query
def clean_bracket_lines(spark, folder):
    return tables.marked_papers(spark, folder).select(
        "doc_key", clean.drop_option_lines(F.col("text")).alias("text")
    )


@query
def clean_latex(spark, folder):
    return tables.marked_papers(spark, folder).select(
        "doc_key", clean.clean_text(F.col("text")).alias("text")
    )


@query
def collapse_whitespace(spark, folder):
    text = clean.collapse_newlines(clean.collapse_spaces(F.col("text")))
    return tables.marked_papers(spark, folder).select("doc_key", text.alias("text"))


@query
def drop_artifact_lines(spark, folder):
    return tables.marked_papers(spark, folder).select(
        "doc_key", clean.drop_artifact_lines(F.col("text")).alias("text")
    )


# Segmentation and packing


@query
def section_headers(spark, folder):
    lines = _numbered(
        tables.sectioned_papers(spark, folder), F.split("text", "\n"), "line_no", "line", "doc_key"
    )
    return lines.filter(sections.is_header(clean.strip(F.col("line"))))


@query
def split_sections(spark, folder):
    cut = sections.split_sections(clean.clean_text(F.col("text")))
    rows = _numbered(
        tables.sectioned_papers(spark, folder), cut, "section_no", "s", "doc_key"
    )
    return rows.select("doc_key", "section_no", "s.section", "s.text")


@query
def section_hint(spark, folder):
    text = F.concat_ws("\n", "text", "role", "text")
    return tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", sections.section_hint(text).alias("section")
    )


@query
def split_paragraphs(spark, folder):
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \t\n "))
    return _numbered(
        tables.papers(spark, folder), sections.split_paragraphs(text), "paragraph_no", "paragraph", "doc_key"
    )


@query
def split_sentences(spark, folder):
    return _numbered(
        tables.papers(spark, folder), sections.split_sentences(F.col("text")),
        "sentence_no", "sentence", "doc_key",
    )


def _sentences(spark, folder) -> DataFrame:
    cut = sections.split_sentences(F.col("text")).alias("sentences")
    return tables.papers(spark, folder).select("doc_key", cut)


@query
def pack_sentences(spark, folder):
    chunks = packing.pack_segments(_sentences(spark, folder), "sentences", "chunks", SMALL)
    return _numbered(chunks, F.col("chunks"), "chunk_no", "chunk", "doc_key")


@query
def chunk_overlap_tail(spark, folder):
    tails = packing.overlap_tail(_sentences(spark, folder), "sentences", "tail", SMALL)
    return tails.select("doc_key", "tail")


@query
def force_split(spark, folder):
    chunks = packing.force_split(tables.papers(spark, folder), "text", "chunks", TINY)
    return _numbered(chunks, F.col("chunks"), "chunk_no", "chunk", "doc_key")


@query
def chunk_documents(spark, folder):
    return _flat(chunking.chunk_documents(tables.papers(spark, folder)))


@query
def chunk_sections(spark, folder):
    """The whole chunking job on papers with sections and a small budget."""
    return _flat(chunking.chunk_documents(tables.sectioned_papers(spark, folder), TINY))


def forty_per_word():
    """A counter by which texts have more tokens than bytes."""
    return lambda text: 40 * len(text.split())


@query
def chunk_documents_counted(spark, folder):
    """The chunking job with a counter of one's own."""
    counted = Packing(chunk_size=64 * 40, overlap=40, counter=FunctionCounter(forty_per_word))
    return _flat(chunking.chunk_documents(tables.papers(spark, folder), counted))


def refuses_bars():
    """A counter that raises, as encoders do on reserved signs."""

    def count(text):
        if "|" in text:
            raise ValueError("reserved sign")
        return len(text.split())

    return count


@query
def failed_documents_counted(spark, folder):
    """Papers for which the counter raises fail alone."""
    counted = Packing(counter=FunctionCounter(refuses_bars))
    statistics = chunking.document_statistics(tables.papers(spark, folder), counted)
    return statistics.select("filename", "error", *_big("chunks", "tokens"))


@query
def split_by_paragraphs(spark, folder):
    """Texts over the budget that have several paragraphs are packed by these."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \t\n "))
    rows = tables.papers(spark, folder).withColumn("text", text)
    chunks = packing.recursive_split(rows, "text", "chunks", SMALL)
    return _numbered(chunks, F.col("chunks"), "chunk_no", "chunk", "doc_key")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), clean.strip), lambda x: x != "")


@query
def chunk_by_lines(spark, folder):
    """The chunking job with a cut of one's own: long sections are packed by lines."""
    by_lines = Packing(chunk_size=64, overlap=12, split=lines_of)
    return _flat(chunking.chunk_documents(tables.sectioned_papers(spark, folder), by_lines))


@query
def chunk_file_source(spark, folder):
    """Files that hold one object each: the chunks of a paper, its statistics and the settings."""
    chunks = chunking.chunk_documents(tables.papers(spark, folder), SMALL)
    entry = F.struct("metadata.chunk_index", "text", "metadata")
    # The chunks of one paper.
    papers = chunks.groupBy("metadata.paper_id").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    whole = F.to_json(
        F.struct(
            F.transform("found", lambda c: F.struct(c["text"].alias("text"), c["metadata"].alias("metadata"))).alias("chunks"),
            F.struct(F.lit(1).alias("total_documents"), F.size("found").alias("total_chunks")).alias("statistics"),
            F.struct(F.lit(SMALL.chunk_size).alias("chunk_size"), F.lit("words").alias("encoding")).alias("config"),
        )
    )
    out = shared_folder(spark, "chunk-files")
    # Millions of files are dealt to folders, which are listed and filled side by side.
    inner = F.pmod(F.xxhash64("paper_id"), F.lit(FILE_FOLDERS)).cast("string")
    name = F.concat_ws("/", inner, F.coalesce(F.concat("paper_id", F.lit(".json")), F.lit("None")))
    text_files.make_folders(spark, *[f"{out}/{k}" for k in range(FILE_FOLDERS)])
    write_files(papers.select(name.alias("name"), F.encode(whole, "UTF-8").alias("content")), out)
    return _flat(chunk_store.read_chunk_file(spark, *[f"{out}/{k}" for k in range(FILE_FOLDERS)]))


@query
def chunk_run(spark, folder):
    """A whole chunking job as stored: totals and settings, read back."""
    rows, out = tables.papers(spark, folder), shared_folder(spark, "run")
    chunks = chunking.with_chunk_key(chunking.chunk_documents(rows, SMALL))
    config = {"chunk_size": SMALL.chunk_size, "chunk_overlap": SMALL.overlap, "encoding": "words"}
    chunk_store.write_run(chunks, chunking.document_statistics(rows, SMALL), config, out)
    run = chunk_store.read_run(spark, out)
    totals = run["statistics"].withColumn("avg_chunk_size", F.round("avg_chunk_size", 6))
    stored = run["chunks"].agg(F.count("*").alias("stored_chunks"))
    # One row each.
    rows = totals.withColumn("one", F.lit(1)).join(run["config"].withColumn("one", F.lit(1)), "one")
    rows = rows.join(stored.withColumn("one", F.lit(1)), "one").drop("one")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_size", "chunk_overlap")})


@query
def chunk_metadata(spark, folder):
    return _flat(chunking.chunk_documents(tables.marked_papers(spark, folder), SMALL)).drop("text")


@query
def token_counts(spark, folder):
    return tables.papers(spark, folder).select(
        "doc_key", WordCounter().count(F.col("text")).cast("bigint").alias("tokens")
    )


@query
def drop_small_chunks(spark, folder):
    """Chunks kept and dropped per paper by the length limit."""
    cut = chunking.chunk_arrays(tables.sectioned_papers(spark, folder), Packing(40, 8, min_chars=0))
    kept = F.size(F.filter("chunks", lambda c: F.length(c["text"]) >= packing.MIN_CHUNK_CHARS))
    counted = cut.select("doc_key", kept.alias("kept"), F.size("chunks").alias("made"))
    return counted.select("doc_key", *_big("kept"), (F.col("made") - F.col("kept")).cast("bigint").alias("dropped"))


@query
def chunk_preview(spark, folder):
    chunks = chunking.preview_documents(tables.papers(spark, folder))
    return chunks.select("paper_id", *_big("chunk_index"), "section", *_big("token_count"), "preview")


@query
def doc_stats(spark, folder):
    statistics = chunking.document_statistics(tables.papers(spark, folder))
    return statistics.select("filename", *_big("chunks", "tokens"))


@query
def doc_stats_stored(spark, folder):
    """The same statistics from the stored chunk table."""
    chunks = tables.stored_chunks(spark, folder)
    statistics = chunking.statistics_of_chunks(chunks, tables.papers(spark, folder))
    return statistics.select("filename", *_big("chunks", "tokens"))


@query
def corpus_stats(spark, folder):
    statistics = chunking.document_statistics(tables.papers(spark, folder))
    return chunking.corpus_statistics(statistics).withColumn(
        "avg_chunk_size", F.round("avg_chunk_size", 6)
    )


@query
def stream_chunks(spark, folder):
    """Papers chunked by a stream over the table's files."""
    stored = tables.table(spark, folder, "documents")
    # The pattern stands for the table as one file or as a folder of files.
    stream = spark.readStream.schema(stored.schema).parquet(f"{folder}/documents.parque[t]")
    rows = stream.select(
        F.col("doc_id").alias("doc_key"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        "text",
    )
    out = shared_folder(spark, "stream")
    start_chunk_stream(rows, f"{out}/chunks", f"{out}/state").awaitTermination()
    return _flat(spark.read.parquet(f"{out}/chunks"))


@query
def stream_redelivered(spark, folder):
    """Papers that arrive up to three times, out of order and over a restart; the last delivery counts."""
    rows = tables.papers(spark, folder)
    out = shared_folder(spark, "deliveries")
    third, stale = F.col("doc_key") % 3 == 0, F.concat("text", F.lit(" stale"))

    def deliver(number: int, papers: DataFrame, text: Column) -> None:
        papers.withColumns({"text": text, "delivered": F.lit(number)}).write.mode("append").parquet(f"{out}/in")

    def ingest() -> None:
        stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).parquet(f"{out}/in")
        start_paper_stream(stream, f"{out}/papers", f"{out}/state").awaitTermination()

    deliver(1, rows, stale)
    deliver(3, rows.where(third), F.col("text"))
    ingest()
    deliver(2, rows, F.when(third, stale).otherwise(F.col("text")))
    ingest()
    return _flat(current_chunks(spark, f"{out}/papers"))


# Vectors and search


@query
def embed_hashed(spark, folder):
    """Non-zero entries of the vectors of all papers."""
    rows = embed(tables.papers(spark, folder).select("doc_key", "text"), HashedWords())
    entries = _numbered(rows, F.col("embedding"), "bucket", "x", "doc_key")
    return entries.filter(F.col("x") != 0).select(
        "doc_key", "bucket", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def l2_normalize_vectors(spark, folder):
    """Vectors scaled by their label, so that label 0 gives zero vectors."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    rows = tables.vectors(spark, folder).select("vec_key", l2_normalize(scaled).alias("unit"))
    entries = _numbered(rows, F.col("unit"), "i", "x", "vec_key")
    return entries.select("vec_key", "i", (F.round("x", 6) + 0.0).alias("x"))


@query
def cosine_scores(spark, folder):
    """Each vector against the mean direction of its label."""
    means = tables.small(tables.label_vectors(spark, folder).withColumnRenamed("embedding", "mean"))
    scored = tables.vectors(spark, folder).join(means, "label")
    return scored.select("vec_key", "label", (score(F.col("embedding"), F.col("mean")) + 0.0).alias("score"))


def _label_questions(spark, folder) -> DataFrame:
    return tables.label_vectors(spark, folder).withColumnRenamed("label", "question_id")


def _label_centroids(spark, folder):
    return ivf.collect_centroids(
        tables.label_vectors(spark, folder).withColumnRenamed("label", "cell_id")
    )


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("question_id", *_big("rank"), "vec_key", "score")


@query
def knn_exact(spark, folder):
    """Nearest vectors of each label's mean direction."""
    return _hits(search.search(_label_questions(spark, folder), tables.vectors(spark, folder)))


@query
def knn_bounded(spark, folder):
    """The same hits from the cells whose bounds say that they can hold one."""
    stored, cells = tables.stored_bounds(spark, folder)
    return _hits(bounded.search_bounded(_label_questions(spark, folder), stored, cells))


@query
def knn_quantised(spark, folder):
    """The same hits from codes of a byte for each number, and few whole vectors."""
    codes = tables.stored_codes(spark, folder)
    return _hits(quantised.search_quantised(_label_questions(spark, folder), codes, tables.vectors(spark, folder)))


@query
def knn_grid(spark, folder):
    """The same search in blocks, as for more questions than can be sent around."""
    asked, rows = _label_questions(spark, folder), tables.vectors(spark, folder)
    return _hits(search.search_exact(asked, rows, block_questions=3))


@query
def knn_unknown(spark, folder):
    """Vectors with an unknown number take no place from others."""
    broken = F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("embedding", 2, QUESTION_DIMENSION))
    rows = tables.vectors(spark, folder)
    rows = rows.withColumn("embedding", F.when(F.col("vec_key") % 3 == 0, broken).otherwise(F.col("embedding")))
    return _hits(search.search(_label_questions(spark, folder), rows))


@query
def knn_single(spark, folder):
    """Nearest vectors of the mean direction of all vectors."""
    rows = tables.vectors(spark, folder)
    mean = tables.mean_vectors(rows.withColumn("all", F.lit(0)), "all").first()["embedding"]
    return search.search_one(rows, mean)


@query
def ivf_assign(spark, folder):
    rows = tables.vectors(spark, folder).select("vec_key", "embedding")
    assigned = ivf.assign_cells(rows, _label_centroids(spark, folder))
    return assigned.select("vec_key", *_big("cell_id"))


def _text_questions(spark, folder) -> DataFrame:
    return tables.question_vectors(spark, folder, QUESTION_DIMENSION)


def _ivf_hits(spark, folder) -> DataFrame:
    stored, centroids = tables.stored_cells(spark, folder)
    return search.search(_text_questions(spark, folder), stored, method="ivf", centroids=centroids, nprobe=PROBES)


def _lsh_hits(spark, folder) -> DataFrame:
    return search_buckets(_text_questions(spark, folder), tables.stored_buckets(spark, folder, TABLES, BITS))


@query
def knn_ivf(spark, folder):
    return _hits(_ivf_hits(spark, folder))


@query
def knn_lsh(spark, folder):
    return _hits(_lsh_hits(spark, folder))


@query
def search_hnsw(spark, folder):
    """The approximate search as the selector offers it, over vectors that are not stored by bucket."""
    return _hits(
        search.search(
            _text_questions(spark, folder), tables.vectors(spark, folder), method="hnsw", tables=TABLES, bits=BITS
        )
    )


@query
def knn_graph(spark, folder):
    """The approximate search along a stored graph of neighbours."""
    graph = tables.stored_graph(spark, folder)
    return _hits(search.search(_text_questions(spark, folder), tables.vectors(spark, folder), method="hnsw", graph=graph))


@query
def knn_recall(spark, folder):
    """Recall of both approximate searches against the exact one."""
    exact = search.search_exact(_text_questions(spark, folder), tables.vectors(spark, folder))
    by_method = [
        search.recall(hits, exact).withColumn("method", F.lit(method))
        for method, hits in (("ivf", _ivf_hits(spark, folder)), ("hnsw", _lsh_hits(spark, folder)))
    ]
    return by_method[0].unionByName(by_method[1]).select("method", "question_id", "recall")


@query
def knn_ivf_trained(spark, folder):
    """Cells from k-means over all vectors; a question that looks into all finds what there is."""
    return _hits(
        search.search(
            _text_questions(spark, folder), tables.vectors(spark, folder), method="ivf", nprobe=ivf.MAX_CELLS
        )
    )


# Retrieval and prompts


@query
def valid_questions(spark, folder):
    """Short questions are blanked and drop out."""
    blanked = F.when(F.length("question") < SHORT_QUESTION, F.lit(" \t\n")).otherwise(
        F.concat(F.lit("  "), "question", F.lit("\n"))
    )
    return retrieval.valid_questions(tables.questions(spark, folder).withColumn("question", blanked))


def _retrieved(spark, folder, with_text: bool = True) -> DataFrame:
    asked = embed(tables.questions(spark, folder), HashedWords(), "question")
    hits = search.search(asked, tables.stored_chunk_vectors(spark, folder))
    return retrieval.retrieve(hits, tables.stored_chunks(spark, folder), with_text)


def _retrieved_flat(retrieved: DataFrame, *more: str) -> DataFrame:
    return retrieved.select(
        "question_id", *_big("rank"), "paper_id", "section", "score", *_big("chunk_index"),
        "source_file", *more,
    )


@query
def retrieve(spark, folder):
    return _retrieved_flat(_retrieved(spark, folder, with_text=False))


@query
def retrieve_with_text(spark, folder):
    return _retrieved_flat(_retrieved(spark, folder), "text")


@query
def search_report(spark, folder):
    report = retrieval.search_report(_retrieved(spark, folder, with_text=False))
    return report.select("question_id", *_big("rank"), "score", "paper", "section", "chunk", *_big("tokens"))


@query
def format_context(spark, folder):
    return retrieval.format_context(_retrieved(spark, folder))


@query
def format_sources(spark, folder):
    return retrieval.format_sources(_retrieved(spark, folder, with_text=False))


@query
def build_messages(spark, folder):
    contexts = retrieval.format_context(_retrieved(spark, folder))
    built = retrieval.build_messages(tables.questions(spark, folder), contexts)
    rows = _numbered(built, F.col("messages"), "message_no", "m", "question_id")
    return rows.select("question_id", "message_no", "m.role", "m.content")


def stand_in_model():
    """A stand-in for a language model, which refuses short questions."""

    def answer(messages: list[dict]) -> str:
        content = messages[-1]["content"]
        question = content.rsplit("USER QUESTION: ", 1)[1].rsplit("\n\nPlease provide", 1)[0]
        if len(question) < SHORT_QUESTION:
            raise ValueError("question too short")
        return f"From {len(content)} characters."

    return answer


def _answers(spark, folder, questions: DataFrame, store: str | None = None) -> DataFrame:
    answers = retrieval.answer_questions(
        questions, _retrieved(spark, folder), stand_in_model, include_sources=True, store=store
    )
    return answers.select(
        "question_id", "answer", "success", "error",
        F.size("sources").cast("bigint").alias("n_sources"),
        F.array_join(F.transform("sources", lambda s: s["paper_id"]), ",").alias("papers"),
        F.array_join("context", "|").alias("context"),
    )


@query
def answer_batch(spark, folder):
    return _answers(spark, folder, tables.questions(spark, folder))


@query
def answer_stored(spark, folder):
    """Half of the questions are answered by a first run, which the second does not ask again."""
    asked, store = tables.questions(spark, folder), shared_folder(spark, "answers")
    _answers(spark, folder, asked.where("question_id % 2 = 0"), store)
    return _answers(spark, folder, asked, store)
