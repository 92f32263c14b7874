"""Counts of joined texts from the counts of their parts, for byte-pair encodings."""

import base64
import os
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusflow.functions import tokens
from corpusflow.functions.tokens import FunctionCounter, _Counts, _running_sums

HOME = "/opt/tokenizers"
JOINS = 10_000


def byte_bpe():
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(f"{HOME}/byte_bpe_50k.json")
    return lambda text: len(encoder.encode(text, add_special_tokens=False).ids)


def ranks(name):
    import public_tokenizers
    import tiktoken

    rows = (line.split() for line in open(f"{HOME}/{name}", "rb"))
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in rows}, special_tokens={})
    return lambda text: len(encoder.encode_ordinary(text))


def word_bpe():
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(f"{HOME}/word_bpe_49k.json")
    return lambda text: len(encoder.encode(text, add_special_tokens=False).ids)


def pieces():
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=f"{HOME}/piece_bpe_32k.model")
    return lambda text: len(encoder.encode(text))


COUNTERS = {
    "byte_bpe": byte_bpe,
    "ranks": lambda: ranks("byte_bpe_50k.tiktoken"),
    "multi": lambda: ranks("byte_bpe_multi_50k.tiktoken"),
    "words": word_bpe,
    "pieces": pieces,
}


@pytest.mark.skipif(not os.path.isdir(HOME), reason="no tokenizers here")
@pytest.mark.parametrize("name", COUNTERS)
def test_joined_segments(name):
    """Segments of papers, and words carried over in front of segments, joined by spaces."""
    count = COUNTERS[name]()
    rng = random.Random(3)
    papers = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    papers = [t[:4000] for t in papers[:400]]
    odd = ["(", ")", "...", "don't", "x's", "1,000", "--", "a\nb", "é", "漢字", "😀!", "'", "#1", "C++", "a_b", "'s", " x", "end.\n\nNew"]
    counts, done, wrong = _Counts(count), 0, []
    while done < JOINS:
        text = rng.choice(papers)
        segments = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        for _ in range(len(segments) // 4 + 1):
            segments.insert(rng.randrange(len(segments) + 1), " ".join(rng.choices(odd, k=rng.randint(1, 4))).strip())
        words = [w for s in segments for w in s.split()]
        own, spaced = _running_sums(counts, segments, False), _running_sums(counts, segments, True)
        words_own, words_spaced = _running_sums(counts, words, False), _running_sums(counts, words, True)
        for _ in range(40):
            a = rng.randrange(len(segments))
            b = rng.randint(a + 1, min(len(segments), a + 8))
            joined, parts = " ".join(segments[a:b]), own[a + 1] - own[a] + spaced[b] - spaced[a + 1]
            wrong += [joined] * (count(joined) != parts)
            w = rng.randrange(len(words))
            v = rng.randint(w + 1, min(len(words), w + 20))
            carried = " ".join(words[w:v]) + " " + joined
            parts = words_own[w + 1] - words_own[w] + words_spaced[v] - words_spaced[w + 1] + spaced[b] - spaced[a]
            wrong += [carried] * (count(carried) != parts)
            done += 2
    assert not wrong, (len(wrong), wrong[:3])


@pytest.mark.parametrize("name", ["_count", "_count_all", "_measure"])
def test_batches_are_measured_a_few_documents_at_a_time(name):
    """However large a batch is, a task holds and returns few of its documents at a time."""
    text = "some words " * 500
    docs = {"_count": text, "_count_all": [text], "_measure": [{"text": text, "words": text.split(), "segments": [text], "budget": 9}]}
    batch = pa.array([docs[name]] * 1000 + [None])
    counter = FunctionCounter(lambda: lambda t: len(t.split()))
    parts = list(getattr(counter, name).func(iter([batch])))
    assert sum(map(len, parts)) == 1001 and max(map(len, parts)) <= 1 + tokens.PIECE_BYTES * 1001 // batch.nbytes
    found = [x for part in parts for x in part.to_pylist()]
    own = {"_count": lambda d: d, "_count_all": lambda d: d["counts"][0], "_measure": lambda d: d[0]["tokens"]}[name]
    assert {own(d) for d in found[:-1]} == {1000} and found[-1] in (None, {"counts": None, "error": None})


def test_kept_counts_are_bounded_by_their_characters():
    """Long stretches, which hardly come again, do not pile up."""
    calls = []
    counts = _Counts(lambda text: calls.append(text) or len(text))
    long = [f"{k} ".ljust(100_000, "x") for k in range(100)]
    assert [counts[t] for t in long] == [100_000] * 100
    assert sum(map(len, counts)) <= tokens.KEPT_CHARS
    assert counts["x" * (tokens.KEPT_CHARS + 1)] == tokens.KEPT_CHARS + 1
    assert counts["word"] == counts["word"] == 4 and calls.count("word") == 1
    assert sum(map(len, counts)) <= tokens.KEPT_CHARS
