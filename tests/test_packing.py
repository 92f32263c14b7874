import random

import pytest
from pyspark.sql import types as T

from corpusflow.functions import packing
from corpusflow.functions.packing import Packing
from corpusflow.functions.tokens import FunctionCounter

LIST = T.ArrayType(T.StringType())


def cost(count, words):
    return sum(map(count, words))


def check_chunks(segments, chunks, size, overlap, count):
    """What must hold for the chunks of a list of segments, however they are found.

    Words of a chunk are looked up in the words of the text: a chunk is words ``a..b-1``, of
    which those before ``new`` repeat the chunk before.
    """
    words = [w for s in segments for w in s.split()]
    ends, n = [], 0
    for s in segments:
        n += len(s.split())
        ends.append(n)
    own = {b: count(s) for s, b in zip(segments, ends)}
    start_of = dict(zip(ends, [0, *ends[:-1]]))
    over = {b for b in ends if own[b] > size}
    inside = {k: b for b in over for k in range(start_of[b], b)}
    spans, new = [], 0
    for chunk in chunks:
        found = chunk.split()
        a = next(a for a in range(new, -1, -1) if words[a : a + len(found)] == found and a + len(found) > new)
        b = a + len(found)
        spans.append((a, new, b))
        new = b
    assert new == len(words)  # all words, in order, none left out
    last_forced = None
    for k, (a, new, b) in enumerate(spans):
        forced = inside.get(new)
        if forced is not None:
            # A segment over the budget stands alone: cut by words, repeating words of its own.
            assert b <= forced and a >= start_of[forced]
            if new > start_of[forced]:
                assert a == max(spans[k - 1][0], new - overlap) if overlap else a == new
            held = count(" ".join(words[a : new + 1])) + cost(count, words[new + 1 : b]) if new > a else cost(count, words[a:b])
            assert held <= size or b == new + 1
            if b < forced:
                assert held + count(words[b]) > size
            last_forced = b
            continue
        # Whole segments, none of which is over the budget.
        assert b in own and not any(new < e <= b for e in over)
        parts = [e for e in ends if new < e <= b]
        if a == new:
            assert sum(own[e] for e in parts) <= size
            # Only the first chunk, or the one behind a segment over the budget, repeats nothing.
            tail = [] if k == 0 or last_forced == new else words[spans[k - 1][0] : new]
            assert not tail or cost(count, tail[-1:]) > overlap
        else:
            # The longest tail of the chunk before within the overlap, or the whole of it.
            before = words[spans[k - 1][0] : new]
            whole = count(" ".join(before)) <= overlap
            first_word = spans[k - 1][0]
            if whole:
                assert a == first_word
            else:
                assert cost(count, words[a:new]) <= overlap
                assert a == first_word or cost(count, words[a - 1 : new]) > overlap
            first = count(" ".join(words[a : parts[0]]))
            assert first + sum(own[e] for e in parts[1:]) <= size or len(parts) == 1
        following = next((e for e in ends if e > b), None)
        if following is not None and following not in over and k + 1 < len(spans) and start_of[following] < following:
            first = count(" ".join(words[a : parts[0]])) if a < new else own[parts[0]]
            assert first + sum(own[e] for e in parts[1:]) + own[following] > size  # no more would have fitted


def check_tail(text, tail, overlap, count):
    words, kept = text.split(), tail.split()
    if count(text) <= overlap:
        assert kept == words
        return
    assert kept == words[len(words) - len(kept) :]
    assert cost(count, kept) <= overlap < cost(count, words[len(words) - len(kept) - 1 :])


def word_count(text):
    return len(text.split())


def three_letters():
    """A counter like a byte-pair encoding: pieces of three characters, a space included."""
    import re

    def count(text):
        return sum(-(-len(piece) // 3) for piece in re.findall(r"\s?\S+|\s+", text))

    return count


def texts(seed, n=60):
    rng = random.Random(seed)
    for _ in range(n):
        yield [
            " ".join("x" * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(rng.choice([1, 2, 3, 5, 8, 30])))
            for _ in range(rng.randint(0, 12))
        ]


def run(spark, operator, p, rows, kind=LIST):
    table = spark.createDataFrame(
        [(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.LongType()), T.StructField("t", kind)])
    )
    return [r["out"] for r in operator(table, "t", "out", p).orderBy("i").collect()]


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (8, 7), (25, 5), (5, 9)])
@pytest.mark.parametrize("factory", [None, three_letters])
def test_packing(spark, size, overlap, factory):
    options = {"counter": FunctionCounter(factory)} if factory else {}
    count = factory() if factory else word_count
    rows = list(texts(size * 100 + overlap))
    got = run(spark, packing.pack_segments, Packing(size, overlap, **options), rows)
    for r, chunks in zip(rows, got):
        check_chunks(r, chunks, size, overlap, count)


@pytest.mark.parametrize("factory", [None, three_letters])
def test_force_split_and_tail(spark, factory):
    options = {"counter": FunctionCounter(factory)} if factory else {}
    count = factory() if factory else word_count
    rows = [" ".join(r) for r in texts(5)]
    p = Packing(12, 4, **options)
    got = run(spark, packing.force_split, p, rows, T.StringType())
    for r, chunks in zip(rows, got):
        if count(r) > 12:
            check_chunks([r], chunks, 12, 4, count)
        else:
            assert chunks == ([" ".join(r.split())] if r.strip() else [])
    tails = run(spark, packing.overlap_tail, p, [r.split(" ") for r in rows])
    for r, tail in zip(rows, tails):
        check_tail(r, tail, 4, count)


def test_blocks_of_the_fold_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    rows = list(texts(41))
    got = run(spark, packing.pack_segments, Packing(10, 3), rows)
    for r, chunks in zip(rows, got):
        check_chunks(r, chunks, 10, 3, word_count)


def test_sizes_of_a_long_segment(spark):
    thousand = " ".join(f"word{i}" for i in range(1000))
    [chunks] = run(spark, packing.force_split, Packing(), [thousand], T.StringType())
    assert [word_count(c) for c in chunks] == [512, 512, 176]
    six = FunctionCounter(lambda: lambda text: 6 * len(text.split()))
    [chunks] = run(spark, packing.force_split, Packing(counter=six), [thousand], T.StringType())
    assert len(chunks) == 916


def test_recursive_split(spark):
    p = Packing(6, 2)
    rows = ["short\ntext  here", "one two three.\n\nfour five six.\n\nseven eight", "a b c. d e f. g h i."]
    assert run(spark, packing.recursive_split, p, rows, T.StringType()) == [
        ["short\ntext  here"],
        ["one two three. four five six.", "five six. seven eight"],
        ["a b c. d e f.", "e f. g h i."],
    ]


def test_words_are_kept_without_overlap(spark):
    rows = list(texts(77))
    got = run(spark, packing.pack_segments, Packing(9, 0), rows)
    assert [" ".join(c).split() for c in got] == [" ".join(r).split() for r in rows]
    assert all(word_count(c) <= 9 for chunks in got for c in chunks)


def test_byte_pair_encoding(spark):
    """A real encoding attaches the space to the next word, as running sums assume."""
    pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = list(texts(9, 40))

    def factory():
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_file(path)
        return lambda text: len(bpe.encode(text, add_special_tokens=False).ids)

    count = factory()
    p = Packing(80, 24, counter=FunctionCounter(factory))
    whole = run(spark, packing.recursive_split, p, [" ".join(r) for r in rows], T.StringType())
    for r, chunks in zip(rows, whole):
        assert [" ".join(c.split()) for c in chunks] == [" ".join(r)] if r and count(" ".join(r)) <= 80 else True
    for r, chunks in zip(rows, run(spark, packing.pack_segments, p, rows)):
        assert " ".join(r).split() == [] or chunks
        check_chunks(r, chunks, 80, 24, lambda t: count(t))


def test_counters_of_any_kind_lose_nothing(spark):
    """More tokens than bytes, words that cost nothing, and a function that raises."""
    rows = ["one two three. " * 9, "a b. c d.", "", "x"]
    three = Packing(60, 10, counter=FunctionCounter(lambda: lambda text: 3 * len(text)))
    got = run(spark, packing.recursive_split, three, rows, T.StringType())
    assert all(got)
    for r, chunks in zip(rows, got):
        assert set(" ".join(chunks).split()) == set(r.split())
    free = FunctionCounter(lambda: lambda text: text.count("a"))
    tails = run(spark, packing.overlap_tail, Packing(9, 2, counter=free), [["a b b b b b a b b b b b a b b b"], ["b b"]])
    assert tails == ["b b b b b a b b b b b a b b b", "b b"]
