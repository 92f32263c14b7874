import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusflow.llm import lexical_search as ls
from corpusflow.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def by_hand(docs, items, k=50):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    spoken = [c for _, c in counted if c]
    n_docs, total = len(spoken), sum(sum(c.values()) for c in spoken)
    df = Counter(t for c in spoken for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // max(total, 1)
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=50, **index):
    corpus = ls.corpus_size(docs)
    rows = ls.rank(spark, ls.build(docs, corpus, **index), corpus, items, k)
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.fixture
def asked(spark):
    return lambda rows: spark.createDataFrame([(*r, 3) for r in rows], "item_id long, text string, rank int")


def test_terms():
    texts = ["", "Ab-cÉ9 9", "x", "...", "y z", "😀a\x00b", "A" * 50, "é", "z", "a.b"]
    column = pa.array(["cut", *texts, "off"]).slice(1, len(texts))
    found, doc, n = ls.terms_of(column)
    want = [(i, t) for i, text in enumerate(texts) for t in terms(text)]
    assert list(zip(doc.tolist(), found.to_pylist())) == want
    assert n.tolist() == [len(terms(t)) for t in texts]
    assert ls.terms_of(pa.array(["", ""]))[2].tolist() == [0, 0]


@pytest.mark.parametrize("block, coordinates", [(2, 3), (4, 64), (64, 512)])
def test_against_plain_python(spark, documents, asked, prose, block, coordinates):
    rng = random.Random(block)
    words = prose.words(60) + ["É", "mañana", "x1", "THE"]
    weights = [1 / (1 + i) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(i, text(rng.randint(0, 80))) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(70)] + [(None, rows[7][1]), (7, rows[7][1]), (500, None), (501, "")]
    rows += [(502, text(30_000))]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(90, None), (91, ""), (92, "!!"), (93, "unheard"), (None, "the x1"), (5, "mañana"), (94, rows[7][1])]
    got = searched(spark, documents(rows).repartition(3), asked(items), block=block, coordinates=coordinates)
    assert got == by_hand(rows, items)


def test_few_and_empty(spark, documents, asked):
    items = [(1, "a b")]
    assert searched(spark, documents([]), asked(items)) == []
    assert searched(spark, documents([(1, None), (2, "")]), asked(items)) == []
    assert searched(spark, documents([(1, "a")]), asked([])) == []
    docs = [(1, "a"), (2, "a c"), (3, "b")]
    assert searched(spark, documents(docs), asked(items)) == by_hand(docs, items)
    assert searched(spark, documents(docs), asked(items), k=1) == by_hand(docs, items, 1)


def test_items_in_blocks(spark, documents, asked, prose, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_ITEMS", 3)
    rows = [(i, prose.prose(30)) for i in range(50)]
    items = [(i, prose.prose(10)) for i in range(8)]
    assert searched(spark, documents(rows), asked(items)) == by_hand(rows, items)


def topics(n, seed=1):
    """Documents of twenty topics: frequent words common to all, and words of the topic."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(20)]
    return [" ".join(rng.choices(common, k=30) + rng.choices([f"t{k % 20}x{i}" for i in range(15)], k=40)) for k in range(n)]


def test_bounds_hold_and_blocks_are_skipped():
    texts = topics(3000)
    corpus = (len(texts), 70 * len(texts))
    row = pa.record_batch(ls.segment(pa.array(range(len(texts))), pa.array(texts), corpus, 512, 64), schema=ls.INDEX_SCHEMA)
    asked = sorted(set(" ".join(texts).split()))
    s = ls.Segment(row, 0, pa.array(asked), corpus)
    assert s.blocked == len(asked)
    dense = np.zeros((len(texts), len(asked)), np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(s.at))
    dense[doc, s.term] = s.value
    for i in range(s.blocks):
        docs = s.block_docs[s.block_at[i] : s.block_at[i + 1]]
        assert 0 < len(docs) <= 64
        assert (s.summary[i].astype(np.int64) * ls.STEP >= dense[docs].max(axis=0)).all()
    for t in range(s.blocked):
        mine = np.concatenate([s.block_docs[s.block_at[i] : s.block_at[i + 1]] for i in np.flatnonzero(s.block_owner == t)])
        assert sorted(mine.tolist()) == np.flatnonzero(dense[:, t]).tolist()
    names = [[f"t{q}x1", f"t{q}x2", f"t{q}x3", "c1"] for q in range(20)]
    items = [(np.array([asked.index(t) for t in n]), np.array([3000, 3000, 3000, 50])) for n in names]
    best = ls.Best(len(items), 50)
    held, read = ls.search_segment(s, items, best)
    assert read < held / 2
    for (t, w), (score, _, _) in zip(items, best.rows):
        whole = np.zeros(len(texts), np.int64)
        for a, b in zip(t, w):
            whole += b * dense[:, s.here[a]]
        assert score.tolist() == sorted(whole.tolist(), reverse=True)[:50]


def test_row_groups_hold_few_segments(spark, tmp_path):
    names = ls.INDEX_SCHEMA.names
    rows = [tuple([str(i)] if c == "terms" else [i] if c == "doc_ids" else random.Random(i).randbytes(1 << 20 if c == "tf" else 8) for c in names) for i in range(12)]
    index = ls.store(spark.createDataFrame(rows, ls.INDEX).coalesce(1), str(tmp_path / "index"))
    files = [pq.ParquetFile(f).metadata for f in Path(tmp_path, "index").glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12
    assert max(g.num_rows for g in groups) <= 3
    tf = [g.column(i) for g in groups for i in range(g.num_columns) if g.column(i).path_in_schema == "tf"]
    assert not any(c.is_stats_set or c.has_dictionary_page for c in tf)
    got = sorted((tuple(r) for r in index.collect()), key=lambda r: r[2])
    assert got == rows


def test_documents_are_read_in_pieces(spark, documents, asked, tmp_path, monkeypatch):
    documents([(1, "a b"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    asked([(1, "a")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    monkeypatch.setattr(ls, "search", lambda docs, items: seen.append(docs))
    queries.op13_lexical_search(spark, str(tmp_path))
    options = seen[0]._jdf.queryExecution().analyzed().relation().options()
    assert options.get("parquet.hadoop.vectored.io.enabled").get() == "false"
