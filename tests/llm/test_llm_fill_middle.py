import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import fill_middle


def by_hand(doc, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def held(documents, rows):
    made = fill_middle.transform(documents(rows)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made)
    want = sorted((d is None, d, *by_hand(d, t), t or "") for d, t in rows)
    assert got == want
    for r in made:
        if r["form"] != "plain":
            text = r["back"]
            assert r["prefix_bytes"] == len(text[: r["prefix_chars"]].encode())
            assert r["middle_bytes"] == len(text[r["prefix_chars"] : r["prefix_chars"] + r["middle_chars"]].encode())
    return {r["form"] for r in made}


def test_against_plain_python(documents, prose):
    rng = random.Random(5)
    signs = ["a", "b", " ", "\n", "é", "ß", "漢", "😀", "<", ">", "<P", "S>", "M", "́", "\x00", "\U0010ffff", "߿", "ࠀ", "￿", "\U00010000"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(600 + i, t) for i, t in enumerate(["<P>", "a<S>b", "x<M>", "<P><S", "", None])]
    assert held(documents, rows) == {"plain", "psm", "spm"}


def test_long_null_and_repeated(documents, prose):
    long = "漢a😀é" * 500_000
    held(documents, [(1, long), (3, "x" * 3_000_000), (3, "same"), (3, "same"), (-7, "minus é"), (2, None), (2, "")])
    held(documents, [(1, ""), (2, None)])
    null = fill_middle.transform(documents([(None, "héllo wörld")])).first()
    assert (null["n"], null["form"], null["prefix_chars"], null["middle_chars"], null["output"]) == by_hand(None, "héllo wörld")


def test_sparse_index(prose):
    for text in ("", "plain", "é", "aé漢😀z", "😀" * 5 + "abc"):
        raw = text.encode()
        index = fill_middle.Exceptions(np.frombuffer(raw, np.uint8))
        assert len(index.at) == sum(ord(c) > 127 for c in text)
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in points])
        assert index.bytes(points).tolist() == places.tolist()
        assert index.points(places).tolist() == points.tolist()


def test_empty_table(documents):
    assert fill_middle.transform(documents([])).collect() == []


def test_seed_and_shares(documents, prose):
    rows = [(i, prose.prose(20)) for i in range(400)]
    whole = fill_middle.transform(documents(rows), cut=0).select("form").distinct().collect()
    assert [r["form"] for r in whole] == ["plain"]
    first = fill_middle.transform(documents(rows), seed=2, cut=100, suffix_first=100)
    assert {r["form"] for r in first.select("form").distinct().collect()} == {"spm"}
    assert [by_hand(d, t, 2)[2] for d, t in rows if by_hand(d, t, 2)[2] is not None] == [
        r["prefix_chars"] for r in first.orderBy("doc_id").collect() if by_hand(r["doc_id"], dict(rows)[r["doc_id"]], 2)[2] is not None
    ]


@pytest.mark.parametrize("text", ["<S", "ab<", "<<P", "P><S"])
def test_half_marks(documents, text):
    held(documents, [(i, text * 3) for i in range(60)])
