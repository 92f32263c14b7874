import random
from collections import defaultdict

import numpy as np
import pytest

from corpusflow.llm import decontamination, jaccard_join, line_dedup
from corpusflow.llm.components import components, union_find


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)]
    want = classes(edges, {n for e in edges for n in e})
    table = spark.createDataFrame([*edges, (None, 1), (2, 2)], "x long, y long").repartition(7)
    got = {r["node"]: r["root"] for r in components(table).collect()}
    lone = {n for n in want if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: r for n, r in want.items() if n not in lone}
    assert components(table.limit(0)).collect() == []
    nodes, roots = union_find(*np.array(edges).T)
    assert dict(zip(nodes.tolist(), roots.tolist())) == want


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def joined_by_hand(rows):
    sets = [(i, shingles(t or "")) for i, t in rows]
    links, pairs = defaultdict(int), []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and i is not None and j is not None and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    root = classes(pairs, [i for i, _ in sets if i is not None])
    return {i: (root[i], links[i]) for i, _ in sets if i is not None}, pairs


def near_copies(prose, groups=12, size=12):
    rows = []
    for g in range(groups):
        base = prose.prose(prose.rng.choice([6, 30, 120]))
        for _ in range(size):
            rows.append((len(rows) * 7 % 1009, prose.edited(base, prose.rng.choice([0, 0.01, 0.02, 0.2]))))
    return rows


@pytest.mark.parametrize("bucket", [1024, 4])
def test_join_equals_brute_force(documents, prose, monkeypatch, bucket):
    """With tiny buckets, further levels and blocks of large buckets do the same work."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    passage = prose.prose(20)
    rows = near_copies(prose) + [(2000 + i, prose.prose(60) + "\n" + passage) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, "One two"), (3003, "one  TWO"), (3004, "one"), (3005, " \n")]
    want, pairs = joined_by_hand(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(documents(rows)).collect()}
    found, all_links = sum(n for _, n in got.values()), sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want) and found >= 0.98 * all_links
    assert all(want[i][0] == want[c][0] for i, (c, _) in got.items())
    if found == all_links:
        assert got == want


def test_join_of_repeated_rows_and_null_ids(documents, prose):
    text = prose.prose(40)
    rows = [(5, text), (5, text), (None, text), (3, text), (9, prose.prose(40)), (9, prose.prose(30))]
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in jaccard_join.join(documents(rows)).collect())
    assert got == [("3", 3, 2), ("5", 3, 2), ("5", 3, 2), ("9", 9, 0), ("9", 9, 0), ("None", None, 0)]
    kept = jaccard_join.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "9", "None"]
    assert jaccard_join.join(documents([])).collect() == []


def test_runs_reach_the_recall():
    rng = np.random.default_rng(3)
    reps, met = jaccard_join.repetitions(0.8, 0.99), 0
    for _ in range(400):
        common = rng.integers(0, 2**63, 160).astype(np.uint64)
        a, b = (np.r_[common, rng.integers(0, 2**63, 20).astype(np.uint64)] for _ in range(2))
        met += any(set(jaccard_join.chosen(a, r + 1, 0)) & set(jaccard_join.chosen(b, r + 1, 0)) for r in range(reps))
    assert met >= 392


def test_alike_equals_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j]))}
    assert set(zip(*(x.tolist() for x in jaccard_join.alike(sets, 0.5)))) == want


def line_sets(lines):
    """Shingles of distinct lines by kind, kinds apart: of 4 characters below 160, of 8 from 128 on."""
    kinds = ((4, 4, 159), (8, 128, 10**9))
    return [{x: {x[p : p + w] for p in range(len(x) - w + 1)} for x in lines if a <= len(x) <= z} for w, a, z in kinds]


def lines_by_hand(rows):
    """Numbers of the lines that go, for each document."""
    places, names = [], set()
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            x = line_dedup.normal(x)
            if x:
                places.append((i, k, x))
                names.add(x)
    names = sorted(names)
    pairs = [
        (a, b)
        for keys in line_sets(names)
        for a in keys
        for b in keys
        if a < b and len(keys[a]) >= 0.8 * len(keys[b]) >= 0.64 * len(keys[a]) and len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b])
    ]
    root = classes(pairs, names)
    kept = {}
    for i, k, x in sorted(places):
        kept.setdefault(root[x], (i, k))
    gone = defaultdict(list)
    for i, k, x in places:
        if kept[root[x]] != (i, k):
            gone[i].append(k)
    return gone, len(pairs)


@pytest.mark.parametrize("bucket", [1024, 3])
def test_lines_equal_brute_force(documents, prose, monkeypatch, bucket):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    pool = [" ".join(prose.words(25)) for _ in range(30)]
    rows = []
    for i in range(120):
        some = [prose.rng.choice(pool) for _ in range(2)]
        lines = [some[0], prose.edited(some[1], 0.03), " ".join(prose.words(15)), "Of.", "", some[0].upper() + "  "]
        rows.append((i * 13 % 997, "\n".join(lines)))
    rows += [(5000, None), (5001, ""), (5002, "ab\nab\nab"), (5003, prose.word() * 9000)]
    want, pairs = lines_by_hand(rows)
    got = {r["doc_id"]: r for r in line_dedup.repeated_lines(documents(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_lines"] == (t or "").count("\n") + 1 for i, t in rows)
    different = sum(sorted(want[i]) != got[i]["removed"] for i, _ in rows)
    assert pairs > 30 and different <= 2
    assert all(not got[i]["removed"] for i in (5000, 5001, 5003)) and got[5002]["removed"] == [1, 2]
    assert sum("Of." in t.split("\n") and 3 in got[i]["removed"] for i, t in rows[:120]) == 119


@pytest.mark.parametrize("low, high", [(40, 60), (60, 80), (120, 170)])
def test_lines_with_one_edit(documents, prose, low, high):
    """Copies with one other character, of lines that 8-character shingles would often lose."""
    rows, want = [], 0
    for i in range(100):
        line = " ".join(prose.words(60))[: prose.rng.randint(low, high)].strip().ljust(low, "q")
        k = prose.rng.randrange(len(line))
        rows += [(i, line), (1000 + i, line[:k] + "#" + line[k + 1 :])]
    gone, _ = lines_by_hand(rows)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(documents(rows)).collect()}
    want = [i for i, _ in rows if gone[i]]
    assert len(want) >= 95 and not any(got[i] for i, _ in rows if not gone[i])
    assert sum(got[i] == [0] for i in want) >= 0.97 * len(want)


def test_short_lines_and_many_alike(documents, monkeypatch):
    """Lines of a few characters go by equality; numbered lines meet in buckets of many blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 64)
    rows = [(1, "第一章\n}"), (2, "第一章\nabc"), (3, "ABC\n }  \n"), (4, "abd")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(documents(rows)).collect()}
    assert got == {1: [], 2: [0], 3: [0, 1], 4: []}
    kept = line_dedup.dedup_lines(documents(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "第一章\n}"), (2, "abc"), (4, "abd")]
    rows = [(i, f"this line stands at the foot of every page of the book, number {i}") for i in range(1500)]
    got = line_dedup.repeated_lines(documents(rows)).where("size(removed) > 0").count()
    assert got == 1499


def test_lines_of_repeated_rows_and_null_ids(documents, prose):
    a, b = (" ".join(prose.words(12)) for _ in range(2))
    rows = [(None, a + "\n" + b), (1, a), (1, a), (2, "x\n" + b), (3, b + "\nnew words stand here"), (4, "  ")]
    docs = documents(rows)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in kept.collect())
    new = "new words stand here"
    assert found == [("2", "x", 1), ("3", new, len(new)), ("4", "  ", 2), ("None", a + "\n" + b, len(a + b) + 1)]
    assert line_dedup.repeated_lines(documents([])).collect() == []


def test_normal_lines_have_single_spaces(prose):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert all(line_dedup.normal(f"A{c}b") == line_dedup.normal(f"{c}a b{c}") == "a b" for c in spaces)
    assert line_dedup.normal(" \u00ad\u200b A  ") == "\u00ad\u200b a" and line_dedup.normal(" \t ") == line_dedup.normal("") == ""
    for _ in range(2000):
        line = "".join(prose.rng.choice([" ", "a", "B", "\t", "\u3000", "\u00e9", "\x00"]) for _ in range(prose.rng.randint(0, 6)))
        assert line_dedup.normal(line) == " ".join(line.lower().split())


def test_bands_share(prose):
    """Lines at the threshold share a band, as often as the formula says."""
    met = 0
    for _ in range(200):
        line = " ".join(prose.words(40))
        other = prose.edited(line, 0.03)
        a, b = (line_dedup.shingle_set(x, 8) for x in (line, other))
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) < 0.8:
            met += 1
            continue
        x, y = line_dedup.band_keys([line, other], 1)
        met += bool((x == y).any())
    assert met >= 195
    assert (line_dedup.band_keys(["abcdefgh", "zz abcdefgh yy"], 1)[0] == line_dedup.band_keys(["abcdefgh"], 1)[0]).all()


def numbers(data):
    return np.frombuffer(data, np.int64).tolist()


def test_bands_are_dealt_in_few_rows(documents, prose):
    """A shuffle row for each part of a batch, not for each band; all bands are there."""
    lines = [" ".join(prose.words(k % 40 + 1)) for k in range(400)]
    docs = documents([(i, "\n".join(lines[i::4])) for i in range(4)]).coalesce(1)
    rows = line_dedup.places(docs).collect()
    assert [(r["doc_id"], r["n_lines"]) for r in rows if r["n_lines"] is not None] == [(i, 100) for i in range(4)]
    by_key = {line_dedup.key_of(x): x for x in lines}
    want = set()
    for number, kind in enumerate(line_dedup.KINDS):
        some = {k: x for k, x in by_key.items() if kind.least <= len(x) <= kind.most}
        for key, bands in zip(some, line_dedup.band_keys(list(some.values()), number).tolist()):
            want |= {(band, key | number) for band in bands}
    dealt = line_dedup._dealt(line_dedup.places(docs).where("bands IS NOT NULL").select("key", "bands"), 3).collect()
    assert len(want) > 4000 and len(dealt) == 3
    assert {pair for r in dealt for pair in zip(numbers(r["keys"]), numbers(r["reps"]))} == want


@pytest.mark.parametrize("block, most", [(1_000_000, 1_000_000), (20, 1_000_000), (20, 60)])
def test_shared_bands_in_blocks(spark, prose, monkeypatch, block, most):
    """Bands of two lines are found whichever blocks these come in, also by tasks that are full."""
    monkeypatch.setattr(line_dedup, "BLOCK_BANDS", block)
    monkeypatch.setattr(line_dedup, "HELD_BANDS", most)
    pairs = [(prose.rng.randrange(400) * 2, prose.rng.randrange(300) * 2) for _ in range(600)] + [(2000, 2 * k) for k in range(90)] + [(2002, 4)] * 50
    rows = [(rep, np.array([key], np.int64).tobytes()) for key, rep in pairs]
    lines = spark.createDataFrame(rows, "key long, bands binary").repartition(5)
    got = [(r["key"], r["rep"]) for r in line_dedup._shared(line_dedup._dealt(lines, 3), 3).collect()]
    several = {key for key, _ in pairs if len({rep for k, rep in pairs if k == key}) > 1}
    want = {(key, rep) for key, rep in pairs if key in several}
    assert 0 < len(several) < len({key for key, _ in pairs}) and want <= set(got) <= set(pairs)
    assert most == 60 or set(got) == want


def test_each_part_of_the_bands_has_its_task(spark):
    """No two parts meet in a task by chance, which would let the largest task grow."""
    rows = [(2 * k, np.arange(0, 120, 2).tobytes()) for k in range(8)]
    lines = spark.createDataFrame(rows, "key long, bands binary")
    found = line_dedup._shared(line_dedup._dealt(lines, 30), 30)
    assert [r["count"] for r in found.distinct().groupBy("key").count().collect()] == [8] * 60
    assert sorted(len(set(c)) for c in found.rdd.map(lambda r: r["key"] // 2 % 30).glom().collect()) == [1] * 30


def test_sets_of_many_lines_equal_those_of_one(prose):
    lines = [" ".join(prose.words(k % 30 + 1)) + "\u4e2d\U0001f600\ud800" for k in range(300)] + ["aaaaaaaa" * 20] + ["x" * 60_000]
    data = [(number, x) for x in lines for number, kind in enumerate(line_dedup.KINDS) if kind.least <= len(x) <= kind.most]
    got = line_dedup.named_sets([bytes([number]) + x.encode("utf-8", "surrogatepass") for number, x in data])
    for (number, x), found in zip(data, got):
        width = line_dedup.KINDS[number].width
        codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
        assert found.tolist() == sorted(set(line_dedup.shingle_hashes(codes, width).tolist()))
        assert len(found) == len({x[p : p + width] for p in range(len(x) - width + 1)})


def test_lines_of_a_task_are_cut_at_once(spark):
    """The sets that a task needs come from one call, those of pairs met elsewhere are left out."""

    def make():
        def cut(data):
            if len(set(data)) != len(data) or b"" in data:
                raise ValueError("cut twice or in vain")
            return [np.frombuffer(x, np.uint8).astype(np.uint64) for x in data]

        return cut

    sets = {1: bytes(range(10)), 2: bytes(range(9)), 3: bytes(range(8)), 4: b"", 5: bytes(range(100, 110)), 6: bytes(range(100, 109))}
    buckets = [(rep, 10, 3) for rep in (1, 2, 3)] + [(rep, 20, 2) for rep in (1, 3)] + [(rep, 30, 2) for rep in (5, 6)] + [(4, 40, 1)]
    found = jaccard_join.linked(
        spark.createDataFrame(buckets, "rep long, key long, n long"),
        spark.createDataFrame([(rep, 2, data) for rep, data in sets.items()], "rep long, copies long, data binary"),
        make,
        0.8,
    )
    assert sorted(map(tuple, found.collect())) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (5, 5, 2), (6, 5, 2)]


def test_bands_lose_one_pair_in_a_hundred():
    """At the threshold, by the formula, and in what is made."""
    short, long = line_dedup.KINDS
    assert (1 - 0.8**long.rows) ** long.bands < 0.006 and (1 - 0.8**short.rows) ** short.bands < 0.008
    assert line_dedup.band_keys(["a line of some words"], 1).shape == (1, 10) and line_dedup.band_keys(["a line"], 0).shape == (1, 21)


def align_by_hand(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment(prose):
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 20))
        score, begin, end = decontamination.align(a, b)
        assert score == align_by_hand(a, b)
        assert align_by_hand(a, b[begin:end]) == score


def test_leaks_are_found(spark, documents, prose):
    items = [(i, prose.prose(prose.rng.randint(14, 60))) for i in range(20)]
    rows, want = [], {}
    for i in range(120):
        text = prose.prose(150)
        if i % 3:
            k = prose.rng.randrange(20)
            passage = items[k][1] if i % 3 == 1 else prose.edited(items[k][1], 0.12).upper()
            text, want[i] = text + " " + passage + ".\n" + prose.prose(40), k
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, items[3][1]), (503, "\n".join(t for _, t in items))]
    benchmark = spark.createDataFrame([*items, (None, "a b c d"), (50, None), (51, ""), (52, "two words"), (53, items[0][1])], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.search(documents(rows), benchmark).collect()}
    found = [i for i in want if want[i] in got[i]["item_ids"]]
    assert all(i in found for i in want if i % 3 == 1) and len(found) >= 0.95 * len(want)
    assert not any(got[i]["leaked"] for i in range(0, 120, 3)) and not got[500]["leaked"] and not got[501]["leaked"]
    assert got[502]["item_id"] == 3 and got[502]["score"] == 1.0 and got[502]["begin"] == 0
    assert got[503]["item_ids"] == [*range(20), 53]


def test_scores_equal_brute_force(spark, documents, prose):
    """Every item against every text by full alignment."""
    items = [(i, prose.prose(20)) for i in range(6)]
    rows = [(i, prose.prose(40) + " " + prose.edited(items[i % 6][1], 0.1) + " " + prose.prose(20)) for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["scores"])) for r in decontamination.search(documents(rows), benchmark).collect()}
    words = {w: n for n, w in enumerate({w for _, t in items + rows for w in decontamination.words_of(t)})}
    code = lambda t: [words[w] for w in decontamination.words_of(t)]
    for i, t in rows:
        want = {k: align_by_hand(code(x), code(t)) / 40 for k, x in items}
        assert got[i] == {k: pytest.approx(s, abs=1e-6) for k, s in want.items() if s >= 0.5}


def test_blocks_of_items_and_clean(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    items = [(i, prose.prose(20)) for i in range(10)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(i, prose.prose(30) + " " + items[i][1]) for i in range(10)] + [(10, prose.prose(50)), (None, "a"), (11, None)])
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "11", "None"]
    assert decontamination.search(documents([]), benchmark).collect() == []
    assert decontamination.search(docs, benchmark.limit(0)).where("leaked").count() == 0


def test_short_items_and_every_fourth_word(spark, documents, prose):
    """Edited copies alone and beside a whole one, by full alignment."""
    items = [(0, " ".join(prose.words(4))), (1, " ".join(prose.words(5)))] + [(k, " ".join(prose.words(20))) for k in range(2, 12)]
    broken = {k: " ".join(prose.word() + "q" if n % 4 == 3 else w for n, w in enumerate(t.split())) for k, t in items[2:]}
    rows = [(k, prose.prose(30) + " " + (t if k < 2 else broken[k]) + " " + prose.prose(30)) for k, t in items]
    rows += [(100 + k, prose.prose(30) + " " + t) for k, t in items[7:]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["scores"])) for r in decontamination.search(documents(rows), benchmark).collect()}
    words = {w: n for n, w in enumerate({w for _, t in items + rows for w in decontamination.words_of(t)})}
    code = lambda t: [words[w] for w in decontamination.words_of(t)]
    for i, t in rows:
        want = {k: align_by_hand(code(x), code(t)) / (2 * len(code(x))) for k, x in items}
        want = {k: s for k, s in want.items() if s >= 0.5}
        assert i % 100 in want and got[i] == {k: pytest.approx(s, abs=1e-6) for k, s in want.items()}


def test_rows_that_share_an_id_keep_their_own_links(documents, prose):
    from corpusflow.llm import jaccard_join

    a, b = prose.prose(120), prose.prose(120)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose.prose(120)), (1, a)]
    got = sorted(tuple(r) for r in jaccard_join.join(documents(rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 4, 0)]


def test_equal_items_are_all_found(spark, documents, prose):
    from corpusflow.llm import decontamination

    a, b = prose.prose(20), prose.prose(20)
    items = spark.createDataFrame([(7, a), (3, a.upper()), (5, b), (7, a), (9, a)], "item_id long, text string")
    docs = documents([(1, f"x {a} y"), (2, prose.prose(60)), (3, f"{b} and {a}")])
    rows = {r["doc_id"]: r for r in decontamination.search(docs, items).collect()}
    assert rows[1]["item_ids"] == [3, 7, 9] and rows[1]["item_id"] == 3
    assert rows[2]["item_ids"] == [] and rows[3]["item_ids"] == [3, 5, 7, 9]
