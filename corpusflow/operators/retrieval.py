"""From hits to cited context, prompts and answers, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import strip
from corpusflow.operators.search import search
from corpusflow.session import handed_over
from corpusflow.sources import versioned
from corpusflow.sources.chunk_store import key_bucket

# Wording and layout of context, citations and prompts.
CONTEXT_TITLE = "RELEVANT RESEARCH CONTEXT:\n\n"
CONTEXT_ENTRY = "[Source %d - Paper: %s, Section: %s]\n%s\n\n"
SOURCES_TITLE = "\n\n📚 **Sources:**\n"
SOURCES_ENTRY = "%d. **%s** (Sections: %s)\n"
SOURCES_MAX_SECTIONS = 3
USER_MESSAGE = (
    "%s\n\nUSER QUESTION: %s\n\nPlease provide a friendly, easy-to-understand answer based on "
    "the research context above. Remember to explain complex concepts in simple terms!"
)
SYSTEM_PROMPT = """You are a friendly astrophysics research assistant who makes complex scientific concepts easy to understand. 

Your personality:
- Explain academic concepts in simple, everyday language
- Use analogies and examples when helpful
- Break down complex ideas into digestible parts
- Be enthusiastic about the science!
- Avoid unnecessary jargon, but when you must use technical terms, explain them
- Be conversational and warm in tone

When answering:
1. Use the provided research paper context to answer accurately
2. Explain complex concepts in simple terms
3. If the context doesn't contain the answer, say so honestly
4. Always cite which papers you're referencing
5. Be concise but thorough

Remember: Your goal is to make astrophysics accessible and exciting for everyone!"""
ERROR_ANSWER = "Sorry, I encountered an error: "
# The questions that are offered as examples.
EXAMPLE_QUESTIONS = (
    "What are gamma-ray bursts?",
    "Explain dark matter in simple terms",
    "How do black holes form?",
    "What is gravitational lensing?",
    "Tell me about galaxy clusters",
)

SOURCE_FIELDS = ("paper_id", "section", "score", "chunk_index", "source_file")


def valid_questions(questions: DataFrame) -> DataFrame:
    """Questions ``(question_id, question)``, stripped, without the blank ones."""
    return questions.withColumn("question", strip(F.col("question"))).filter(
        F.col("question") != ""
    )


def example_questions(spark: SparkSession) -> DataFrame:
    rows = list(enumerate(EXAMPLE_QUESTIONS))
    return spark.createDataFrame(rows, "question_id bigint, question string")


def retrieve(hits: DataFrame, chunks: DataFrame, with_text: bool = False) -> DataFrame:
    """Add the metadata of the chunks, and their text if asked for, to hits.

    ``chunks(chunk_key, text, metadata)``; text is only read ``with_text``. Of a stored chunk
    table only the folders with the keys of the hits are read.
    """
    columns = ["chunk_key", "metadata"] + (["text"] if with_text else [])
    keyed, key = hits.withColumnRenamed("vec_key", "chunk_key"), ["chunk_key"]
    if "key_bucket" in chunks.columns:
        keyed, key = keyed.withColumn("key_bucket", key_bucket(F.col("chunk_key"))), ["key_bucket", "chunk_key"]
    found = keyed.join(chunks.select(*columns, *key[:-1]), key)
    return found.select(
        "question_id",
        "rank",
        "chunk_key",
        "score",
        *[f"metadata.{f}" for f in ("paper_id", "section", "chunk_index", "source_file")],
        *[f"metadata.{f}" for f in ("total_chunks", "token_count")],
        *columns[2:],
    )


def ask_vectors(
    questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 5,
    method: str = "flat", **options,
) -> DataFrame:
    """Retrieve the text of the best ``k`` chunks for each question vector."""
    return retrieve(search(questions, vectors, k, method, **options), chunks, with_text=True)


def search_report(retrieved: DataFrame) -> DataFrame:
    """Readable lines of a search: score, paper, section, place in the paper, length."""
    return retrieved.select(
        "question_id",
        "rank",
        F.round(F.col("score").cast("decimal(18,6)"), 4).cast("string").alias("score"),
        F.col("paper_id").alias("paper"),
        "section",
        F.concat_ws("/", "chunk_index", "total_chunks").alias("chunk"),
        F.col("token_count").alias("tokens"),
    )


def gather_hits(retrieved: DataFrame) -> DataFrame:
    """One row per question with its hits as an array, best first.

    A question has at most ``k`` hits, so its array is small however skewed the papers are.
    Context, citations and sources are then columns over this one array.
    """
    fields = [f for f in (*SOURCE_FIELDS, "text") if f in retrieved.columns]
    hits = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return retrieved.groupBy("question_id").agg(hits.alias("hits"))


def context_text(hits: Column) -> Column:
    """The context that a prompt shows: numbered hits with paper, section and text."""

    def entry(h: Column) -> Column:
        return F.format_string(CONTEXT_ENTRY, h["rank"], h["paper_id"], h["section"], h["text"])

    return F.concat(F.lit(CONTEXT_TITLE), F.array_join(F.transform(hits, entry), ""))


def citation_text(hits: Column) -> Column:
    """Papers in the order of their first hit, each with its first sections."""

    def entry(paper: Column, i: Column) -> Column:
        of_paper = F.filter(hits, lambda h: h["paper_id"] == paper)
        sections = F.array_distinct(F.transform(of_paper, lambda h: h["section"]))
        shown = F.array_join(F.slice(sections, 1, SOURCES_MAX_SECTIONS), ", ")
        return F.format_string(SOURCES_ENTRY, i + 1, paper, shown)

    papers = F.array_distinct(F.transform(hits, lambda h: h["paper_id"]))
    return F.concat(F.lit(SOURCES_TITLE), F.array_join(F.transform(papers, entry), ""))


def format_context(retrieved: DataFrame) -> DataFrame:
    """The context text of each question."""
    return gather_hits(retrieved).select("question_id", context_text(F.col("hits")).alias("context"))


def format_sources(retrieved: DataFrame) -> DataFrame:
    """The citations of each question."""
    return gather_hits(retrieved).select(
        "question_id", citation_text(F.col("hits")).alias("citations")
    )


def messages(context: Column, question: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """Chat messages ``array<struct<role, content>>`` of a question."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system_prompt)),
        message("user", F.format_string(USER_MESSAGE, context, question)),
    )


def build_messages(
    questions: DataFrame, contexts: DataFrame, system_prompt: str = SYSTEM_PROMPT
) -> DataFrame:
    """Messages of every question; one without hits gets an empty context."""
    context = F.coalesce("context", F.lit(CONTEXT_TITLE))
    return questions.join(contexts, "question_id", "left").select(
        "question_id", messages(context, F.col("question"), system_prompt).alias("messages")
    )


AnswerModel = Callable[[list[dict]], str]


def complete(prompts: DataFrame, factory: Callable[[], AnswerModel]) -> DataFrame:
    """Replace ``messages`` by the ``answer`` of a model that is made once per task.

    A failing call becomes the ``error`` of its own row. Other columns are kept.
    """
    kept = [c for c in prompts.columns if c != "messages"]
    schema = T.StructType(
        [prompts.schema[c] for c in kept]
        + [T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()

        def call(prompt: list[dict]) -> tuple[str, str | None]:
            try:
                return model(prompt), None
            except Exception as e:  # the model is foreign code
                return f"{ERROR_ANSWER}{e}", str(e)

        for batch in batches:
            answers = [call(m) for m in batch.column("messages").to_pylist()]
            texts = [pa.array([a[i] for a in answers], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + texts, names=[*kept, "answer", "error"]
            )

    return prompts.mapInArrow(run, schema)


#: Prompts that are answered before their answers are committed; a broken-off run loses no more.
STORED_PROMPTS = 10_000


def complete_once(prompts: DataFrame, factory: Callable[[], AnswerModel], store: str | None = None) -> DataFrame:
    """``complete``, with one call of the model for all rows that have the same messages.

    With ``store``, the path of a versioned table ``(prompt_key, answer, error)``, answers that are
    there are not asked for again. New ones are committed every ``STORED_PROMPTS``, so a run that
    broke off goes on where it stopped. Prompts that failed are asked again by a later run.
    """
    spark = prompts.sparkSession
    keyed = handed_over(prompts.withColumn("prompt_key", F.sha2(F.to_json("messages"), 256)), "prompts")
    # Equal prompts meet by their hash and are combined before the shuffle.
    missing = keyed.groupBy("prompt_key").agg(F.first("messages").alias("messages"))
    if store is None:
        answered = handed_over(complete(missing, factory), "answers")
    else:
        if versioned.manifest(spark, store):
            known = versioned.read_version(spark, store, ["prompt_key", "error"]).where("error IS NULL")
            missing = missing.join(known, "prompt_key", "left_anti")
        missing = handed_over(missing, "missing-prompts")
        blocks = -(-missing.count() // STORED_PROMPTS)
        for b in range(blocks):
            some = missing.where(F.pmod(F.xxhash64("prompt_key"), F.lit(blocks)) == b)
            rows = handed_over(complete(some, factory), "answers")
            versioned.commit(rows, rows, store, ["prompt_key"])
        if not versioned.manifest(spark, store):
            return complete(prompts, factory)  # there are no prompts at all
        answered = versioned.read_version(spark, store)
    return keyed.drop("messages").join(answered, "prompt_key").drop("prompt_key")


def answer_questions(
    questions: DataFrame,
    retrieved: DataFrame,
    factory: Callable[[], AnswerModel],
    include_sources: bool = False,
    system_prompt: str = SYSTEM_PROMPT,
    store: str | None = None,
) -> DataFrame:
    """Answers with sources and context: ``question_id, answer, sources, context, success,
    error``. A failed answer keeps no sources and no context. Questions with the same prompt are
    answered once, and with ``store`` once for all runs; see ``complete_once``."""
    gathered = gather_hits(retrieved)
    hit_type = gathered.schema["hits"].dataType
    asked = (
        questions.select("question_id", "question")
        .join(gathered, "question_id", "left")
        .withColumn("hits", F.coalesce("hits", F.array().cast(hit_type)))
    )
    prompts = asked.select(
        "question_id",
        "hits",
        messages(context_text(F.col("hits")), F.col("question"), system_prompt).alias("messages"),
    )
    success, answer = F.col("error").isNull(), F.col("answer")
    if include_sources:
        cited = F.concat(answer, citation_text(F.col("hits")))
        answer = F.when(success, cited).otherwise(answer)
    kept = F.when(success, F.col("hits")).otherwise(F.array().cast(hit_type))
    return complete_once(prompts, factory, store).select(
        "question_id",
        answer.alias("answer"),
        F.transform(kept, lambda h: F.struct(*[h[f] for f in SOURCE_FIELDS])).alias("sources"),
        F.transform(kept, lambda h: h["text"]).alias("context"),
        success.alias("success"),
        "error",
    )
