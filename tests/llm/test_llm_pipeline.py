"""The pipeline against a plain Python version, and every query on whole tables."""

from collections import Counter, defaultdict

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from corpusflow.llm import decontamination, line_dedup, quality_rules
from corpusflow.llm.queries import ORACLES, REGISTRY, word_tokenizer
from test_llm_copies import align_by_hand, classes, line_sets, shingles

FOLDER = "/root/testdata/sf0.001"


def rules_by_hand(docs):
    seen, hosts = defaultdict(set), defaultdict(set)
    hashes = {}
    for i, (t, source) in docs.items():
        hashes[i] = quality_rules.line_hashes(t)
        for h in hashes[i]:
            if h is not None:
                seen[source, h].add(t)
                hosts[source].add(t)
    common = {k for k, d in seen.items() if len(d) > max(5, 0.05 * len(hosts[k[0]]))}
    kept = {}
    for i, (t, source) in docs.items():
        words = t.encode().split()
        seen = Counter(zip(words, words[1:], words[2:]))
        again = {k + d for k in range(len(words) - 2) for d in range(3) if seen[tuple(words[k : k + 3])] > 1}
        lines = [x for x, h in zip(t.split("\n"), hashes[i]) if (source, h) not in common]
        left = sum(len(x.encode().split()) for x in lines)
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words) and left >= 0.3 * len(words):
            kept[i] = ("\n".join(lines) if len(lines) < t.count("\n") + 1 else t, source)
    return kept


def alike_by_hand(sets, least=0.8):
    """Pairs of similar sets, found by what they share."""
    where = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            where[g].append(k)
    pairs = []
    for k, s in sets.items():
        shared = Counter(j for g in s for j in where[g] if j > k)
        pairs += [(k, j) for j, n in shared.items() if n >= least * (len(s) + len(sets[j]) - n) - 1e-9]
    return pairs


def lines_by_hand(docs):
    places = []
    for i, (t, _) in docs.items():
        for k, x in enumerate(t.split("\n")):
            x = line_dedup.normal(x)
            if x:
                places.append((i, k, x))
    kinds = line_sets({x for *_, x in places})
    root = classes([p for sets in kinds for p in alike_by_hand(sets)], {x for *_, x in places})
    first = {}
    for i, k, x in sorted(places):
        first.setdefault(root[x], (i, k))
    gone = {(i, k) for i, k, x in places if first[root[x]] != (i, k)}
    kept = {}
    for i, (t, source) in docs.items():
        rest = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        cut = len(rest) < t.count("\n") + 1
        if not cut or any(x.encode().split() for x in rest):
            kept[i] = ("\n".join(rest), source)
    return kept


def leaks_by_hand(docs, items):
    words = {w: n for n, w in enumerate({w for t in [*items.values(), *(t for t, _ in docs.values())] for w in decontamination.words_of(t)})}
    code = {i: [words[w] for w in decontamination.words_of(t)] for i, (t, _) in docs.items()}
    found = set()
    for item in items.values():
        asked = [words[w] for w in decontamination.words_of(item)]
        for i, c in code.items():
            # Too few words in common for any alignment that counts.
            if sum((Counter(asked) & Counter(c)).values()) * 2 >= len(asked) and i not in found:
                import numpy as np

                score, _, _ = decontamination.align(np.array(asked), np.array(c))
                if score >= 0.5 * 2 * len(asked):
                    found.add(i)
    return found


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r["doc_id"]: (r["text"] or "", r["source"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    return docs, items


def test_stages_against_plain_python(spark, tables):
    docs, items = tables
    rows, columns = spark.read.parquet(f"{FOLDER}/documents.parquet"), None
    columns = rows.columns
    texts = lambda rows: {r["doc_id"]: r["text"] for r in rows.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]

    want = rules_by_hand(docs)
    rows = stages[0](spark, rows, FOLDER)
    assert rows.columns == columns and texts(rows) == {i: t for i, (t, _) in want.items()}
    assert 0 < len(want) < len(docs)

    want = lines_by_hand(want)
    rows = stages[1](spark, rows, FOLDER)
    assert rows.columns == columns and texts(rows) == {i: t for i, (t, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows.collect())

    root = classes(alike_by_hand({i: shingles(t) for i, (t, _) in want.items() if t.split()}), want)
    want = {i: x for i, x in want.items() if root[i] == i}
    rows = stages[2](spark, rows, FOLDER)
    assert rows.columns == columns and set(texts(rows)) == set(want)

    leaked = leaks_by_hand(want, items)
    rows = stages[3](spark, rows, FOLDER)
    assert rows.columns == columns and set(texts(rows)) == set(want) - leaked
    assert leaked

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(word_tokenizer()).encode
    packed = stages[4](spark, rows, FOLDER).collect()
    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {i: len(encode(want[i][0], add_special_tokens=False).ids) + 1 for i in set(want) - leaked}


def test_stages_of_an_empty_table_and_of_nulls(spark, documents):
    for rows in ([], [(None, None), (1, None), (1, None), (2, "")]):
        docs = documents(rows)
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            assert out.count() == (0 if stage is corpus_pipeline.rules else len(rows))


def test_run_hands_over_through_files(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, name):
    got = REGISTRY[name](spark, FOLDER).toArrow()
    assert got.num_rows > 0 and entry.queries()[name] is REGISTRY[name]
    if name in ORACLES:
        assert compare(got, duck(FOLDER).sql(ORACLES[name]).to_arrow_table()) is None
