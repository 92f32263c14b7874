import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import packing
from corpusflow.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_tokenizer())


def test_pieces_equal_the_tokenizer(documents, tokenizer, prose):
    odd = "İK ſ Σς 'S don't <|endoftext|>x a<|startoftext|> é é\t \x1c12 3.4! ###a!!b 각́"
    texts = [None, "", " \n ", odd, prose.prose(9000), "x" * 30000, odd]
    rows = packing.pack_documents(documents([(i, t) for i, t in enumerate(texts)]), word_tokenizer()).collect()
    of = defaultdict(dict)
    for r in rows:
        of[r["doc_id"]][r["piece"]] = r
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for k in range(len(of[i])):
            r = of[i][k]
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["length"]) == (at, min(4096, len(ids) - at))
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_other_tokenizers_get_whole_texts(documents, prose):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.WordIds(word_tokenizer()).by_word and not packing.WordIds(path).by_word
    other = Tokenizer.from_file(path)
    texts = ["Hello  World", " a\nb ", "Don't É 漢字", prose.prose(300)]
    rows = packing.token_pieces(documents(list(enumerate(texts))), path).collect()
    want = {i: zlib.crc32(np.array(other.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == want


def test_small_cache_gives_the_same_ids(prose, monkeypatch):
    texts = [prose.prose(200) + " Mot É été! " + "漢字" * k for k in range(40)]
    big = packing.WordIds(word_tokenizer())
    want, edges = big.whole(pa.array(texts))
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    for ids_of in (big, packing.WordIds(word_tokenizer())):
        got, cuts = zip(*(ids_of(pa.array(["cut", t]).slice(1)) for t in texts))
        assert np.array_equal(np.concatenate(got), want)
        assert [c.tolist() for c in cuts] == [[0, n] for n in np.diff(edges)]
    assert ids_of.size < 200_000


def check_sequences(rows, tokens, documents_, cost):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in bins.values():
        found.sort()
        assert [o for o, _ in found] == list(np.cumsum([0] + [n for _, n in found])[:-1])
        assert sum(n for _, n in found) <= tokens
        assert len(found) <= documents_
        assert len(found) == 1 or sum(n * n for _, n in found) <= cost
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(4096, 1024, 4096**2), (1000, 3, 10**9), (1000, 50, 300_000)])
def test_every_capacity_holds(spark, rule, limits):
    rng = np.random.default_rng(4)
    rows = [(i % 40, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, limits[0] + 1, 700))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    packed = packing.pack(pieces, *limits, rule=rule).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in packed) == sorted((r[0], r[4]) for r in rows)
    bins = check_sequences(packed, *limits)
    if limits[1] == 1024:
        assert len(bins) <= sum(r[3] for r in rows) / 4096 * 1.05 + 1


def test_near_the_least_number_of_sequences():
    rng = np.random.default_rng(5)
    n = rng.lognormal(6.5, 1, 4000).clip(1, 4095).round()
    bins, before = packing.fit(np.stack([n, np.ones(len(n)), n * n], axis=1), np.array([4096.0, 1024, 4096**2]))
    assert bins.max() + 1 <= np.ceil(n.sum() / 4096) + 2


def test_repeated_rows_and_null_ids(documents):
    rows = packing.pack_documents(documents([(None, "a b"), (7, "a b"), (7, "a b")]), word_tokenizer()).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in rows) == [(False, 3), (False, 3), (True, 3)]
    assert len(check_sequences(rows, 4096, 1024, 4096**2)) == 1


def test_empty_table(documents):
    assert packing.pack_documents(documents([]), word_tokenizer()).collect() == []
