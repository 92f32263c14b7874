import pytest
from corpusflow.operators import retrieval

CHUNKS = [
    # key, paper, section, index
    ("a#0", "a", "Methods", 0),
    ("a#1", "a", "Results", 1),
    ("a#2", "a", "Methods", 2),
    ("a#3", "a", "Other", 3),
    ("a#4", "a", "Last", 4),
    ("b#0", "b", "Intro", 0),
]
HITS = [(1, 1, "b#0", 0.91234567), (1, 2, "a#1", 0.8), (1, 3, "a#0", 0.7), (1, 4, "a#2", 0.6),
        (1, 5, "a#3", 0.5), (1, 6, "a#4", 0.4), (2, 1, "a#4", 0.3)]


@pytest.fixture(scope="module")
def retrieved(spark):
    chunks = spark.createDataFrame(
        [(f"text of {k}", (p, i, 5, s, 9, 2, f"{p}.txt"), k) for k, p, s, i in CHUNKS],
        "text string, metadata struct<paper_id:string,chunk_index:int,total_chunks:int,section:string,"
        "char_count:int,token_count:int,source_file:string>, chunk_key string",
    )
    hits = spark.createDataFrame(HITS, "question_id long, rank int, vec_key string, score double")
    return retrieval.retrieve(hits, chunks, with_text=True)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "What?"), (2, "fail"), (3, "No hits?")], "question_id long, question string")


CONTEXT = (
    "RELEVANT RESEARCH CONTEXT:\n\n"
    "[Source 1 - Paper: a, Section: Last]\ntext of a#4\n\n"
)


def test_context_and_citations(retrieved):
    contexts = {r.question_id: r.context for r in retrieval.format_context(retrieved).collect()}
    assert contexts[2] == CONTEXT
    assert contexts[1].count("[Source ") == 6 and contexts[1].index("b#0") < contexts[1].index("a#1")
    cited = {r.question_id: r.citations for r in retrieval.format_sources(retrieved).collect()}
    assert cited[1] == (
        "\n\n📚 **Sources:**\n1. **b** (Sections: Intro)\n2. **a** (Sections: Results, Methods, Other)\n"
    )
    assert cited[2] == "\n\n📚 **Sources:**\n1. **a** (Sections: Last)\n"


def test_report(retrieved):
    first = retrieval.search_report(retrieved).filter("question_id = 1 and rank = 1").first()
    assert tuple(first) == (1, 1, "0.9123", "b", "Intro", "0/5", 2)


def test_messages(retrieved, questions):
    built = retrieval.build_messages(questions, retrieval.format_context(retrieved), "Be kind.")
    rows = {r.question_id: r.messages for r in built.collect()}
    assert [m.role for m in rows[2]] == ["system", "user"] and rows[2][0].content == "Be kind."
    assert rows[2][1].content == (
        f"{CONTEXT}\n\nUSER QUESTION: fail\n\nPlease provide a friendly, easy-to-understand answer "
        "based on the research context above. Remember to explain complex concepts in simple terms!"
    )
    assert rows[3][1].content.startswith("RELEVANT RESEARCH CONTEXT:\n\n\n\nUSER QUESTION: No hits?")


def model():
    def answer(messages):
        if "USER QUESTION: fail" in messages[1]["content"]:
            raise RuntimeError("out of order")
        return messages[0]["role"]

    return answer


def test_answers(retrieved, questions):
    answers = retrieval.answer_questions(questions, retrieved, model, include_sources=True)
    rows = {r.question_id: r for r in answers.collect()}
    assert rows[1].success and rows[1].error is None
    assert rows[1].answer.startswith("system\n\n📚 **Sources:**\n1. **b**")
    assert [s.paper_id for s in rows[1].sources] == ["b", "a", "a", "a", "a", "a"]
    assert rows[1].sources[0].asDict() == {
        "paper_id": "b", "section": "Intro", "score": 0.91234567, "chunk_index": 0, "source_file": "b.txt",
    }
    assert rows[1].context[0] == "text of b#0"
    assert tuple(rows[2]) == (2, "Sorry, I encountered an error: out of order", [], [], False, "out of order")
    assert rows[3].success and rows[3].sources == []
    plain = retrieval.answer_questions(questions, retrieved, model).filter("question_id = 1").first()
    assert plain.answer == "system"


def counting_model(log, broken):
    """A model that writes down each call, and fails for questions that have ``broken`` in them."""

    def made():
        def answer(messages):
            question = messages[1]["content"].split("USER QUESTION: ")[1].split("\n")[0]
            with open(log, "a") as out:
                out.write(question + "\n")
            if broken and broken in question:
                raise RuntimeError("not now")
            return question.upper()

        return answer

    return made


def test_each_prompt_is_asked_once(spark, tmp_path, monkeypatch):
    log, store = tmp_path / "calls", str(tmp_path / "answers")

    def run(rows, broken=None, store=store):
        before = log.read_text().split("\n") if log.exists() else []
        asked = spark.createDataFrame(rows, "question_id long, question string")
        hits = spark.createDataFrame([], "question_id long, rank int, paper_id string, section string, score double, chunk_index int, source_file string, total_chunks int, token_count int, text string")
        got = retrieval.answer_questions(asked, hits, counting_model(str(log), broken), store=store)
        answers = {r.question_id: (r.answer, r.error) for r in got.collect()}
        return answers, len(log.read_text().split("\n")) - max(1, len(before)) if log.exists() else 0

    rows = [(i, f"q{i % 4}") for i in range(20)]
    assert run(rows, store=None) == ({i: (f"Q{i % 4}", None) for i in range(20)}, 4)
    first, calls = run(rows, broken="3")
    assert calls == 4 and first[0] == ("Q0", None) and first[3] == ("Sorry, I encountered an error: not now", "not now")
    # What is stored is not asked again; what failed is, and what is new.
    monkeypatch.setattr(retrieval, "STORED_PROMPTS", 1)
    second, calls = run([*rows, (30, "q9"), (31, "q9")])
    assert calls == 2 and second == {**{i: (f"Q{i % 4}", None) for i in range(20)}, 30: ("Q9", None), 31: ("Q9", None)}
    assert run([(1, "q9")]) == ({1: ("Q9", None)}, 0)
    assert run([]) == ({}, 0) and run([], store=str(tmp_path / "none")) == ({}, 0)


def test_valid_questions(spark):
    rows = spark.createDataFrame([(1, " a? \n"), (2, " \t\n"), (3, ""), (4, None)], "question_id long, question string")
    assert [tuple(r) for r in retrieval.valid_questions(rows).collect()] == [(1, "a?")]


def test_example_questions(spark):
    rows = retrieval.valid_questions(retrieval.example_questions(spark)).collect()
    assert [r.question_id for r in rows] == [0, 1, 2, 3, 4]


def test_question_without_text_column(retrieved):
    without = retrieved.drop("text")
    assert retrieval.format_sources(without).count() == 2


def test_the_system_prompt_is_the_fixed_one():
    import hashlib

    assert hashlib.md5(retrieval.SYSTEM_PROMPT.encode()).hexdigest() == "d19d01eea00b57443863c66d1510e76c"
