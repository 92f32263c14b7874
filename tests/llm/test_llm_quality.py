import re
from collections import Counter

import numpy as np

from corpusflow.llm import quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(zip(words, words[1:], words[2:]))
    again = {k + d for k in range(len(words) - 2) for d in range(3) if count[tuple(words[k : k + 3])] > 1}
    return (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(again))


def test_base_figures(documents, prose):
    texts = [None, "", "\x1c a\x0b\x85 b c", "a b c a b c a b", "x\nx\n\n \ny", "é# 😀 <|>", prose.prose(200), "a " * 5000, "a b a b a"]
    texts += [" ".join(prose.rng.choice("ab\n") for _ in range(40)) for _ in range(50)]
    rows = {r["doc_id"]: r for r in quality_rules.judge(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = by_hand(t or "")
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_common_lines_go_and_depleted_documents_too(documents, prose):
    boiler = prose.prose(36)  # three lines
    rows = [(i, prose.prose(120) + "\n" + boiler, "h") for i in range(30)]
    rows += [(100 + i, prose.prose(96), "h") for i in range(5)]
    rows += [(200 + i, boiler + "\n" + boiler + "\n" + prose.prose(12), "h") for i in range(3)]
    rows += [(300 + i, prose.prose(120) + "\n" + boiler.upper() + " ", "other") for i in range(5)]
    copy = prose.prose(120)
    rows += [(400 + i, copy, "h") for i in range(40)]
    judged = {r["doc_id"]: r for r in quality_rules.judge(documents(rows)).collect()}
    assert all(judged[i]["kept"] and judged[i]["common_words"] == 36 for i in range(30))
    assert all(judged[i]["kept"] and judged[i]["common_words"] == 0 for i in (*range(100, 105), *range(300, 305), *range(400, 440)))
    assert not any(judged[i]["kept"] for i in range(200, 203))
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.clean(documents(rows)).collect()}
    assert set(cleaned) == {i for i, *_ in rows if judged[i]["kept"]}
    text = dict((r[0], r[1]) for r in rows)
    assert all(cleaned[i] == text[i].removesuffix("\n" + boiler) for i in range(30))
    assert all(cleaned[i] == text[i] for i in cleaned if i >= 100)


def test_common_lines_by_hand(documents, prose):
    """The limits against a plain count; copies of a text are one document on both sides."""
    pool = [prose.prose(8) for _ in range(30)]
    rows = [(i, "\n".join(prose.rng.sample(pool, 3) + [prose.prose(60)]), f"h{i % 2}") for i in range(80)]
    rows += [(100 + i, rows[0][1], "h0") for i in range(50)] + [(200, rows[0][1], "h1"), (201, None, "h1"), (202, rows[1][1], None)]
    seen, hosts = {}, {}
    for _, t, host in rows:
        for h in quality_rules.line_hashes(t or ""):
            if h is not None:
                seen.setdefault((host or "", h), set()).add(t)
                hosts.setdefault(host or "", set()).add(t)
    for least, share in ((5, 0.0), (2, 0.15), (3, 0.1)):
        want = {k for k, d in seen.items() if len(d) > least and len(d) > share * len(hosts[k[0]])}
        got = quality_rules.common_lines(quality_rules.lines(documents(rows)), least, share).collect()
        assert {(r["host"], r["line_hash"]) for r in got} == want
        assert want


def test_a_host_of_fifty_documents(documents, prose):
    """A footer goes, whatever copies the host has, and pages of little else are rejected."""
    menu = [f"menu {prose.prose(7)}" for _ in range(9)]
    page = lambda k, n: "\n".join(menu + [f"{prose.prose(n)} {k}"])
    rows = [(i, prose.prose(90)) for i in range(40)] + [(i, page(i, 70)) for i in range(40, 46)] + [(i, page(i, 8)) for i in range(46, 50)]
    for copies in (0, 20):
        some = rows + [(100 + k, rows[40][1]) for k in range(copies)]
        judged = {r["doc_id"]: r for r in quality_rules.judge(documents(some)).collect()}
        assert all(r["kept"] and not r["common_words"] for i, r in judged.items() if i < 40)
        assert all(judged[i]["common_words"] == 72 for i in range(40, 50))
        assert all(judged[i]["kept"] for i in judged if 40 <= i < 46 or i >= 100)
        assert not any(judged[i]["kept"] or judged[i]["base_failed"] for i in range(46, 50))


def test_clean_keeps_columns_and_nulls(documents):
    long = " ".join(f"w{i}" for i in range(60))
    docs = documents([(None, long), (1, long), (1, long), (2, None)])
    rows = quality_rules.clean(docs)
    assert rows.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in rows.collect()) == ["1", "1", "None"]
    assert quality_rules.judge(documents([])).collect() == []


def labelled(spark, documents, prose, n=400):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = prose.prose(80) if good else " ".join(w + "###" for w in prose.words(60))
        rows.append((i, text))
        labels.append((i, int(good), 0, "x"))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), dict((a, b) for a, b, *_ in labels)


def test_classifier_on_held_out_rows(spark, documents, prose):
    import zlib

    docs, labels, truth = labelled(spark, documents, prose)
    rows = quality_classifier.score(docs, labels).collect()
    assert len(rows) == 400
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_labels_of_held_out_rows_are_never_read(spark, documents, prose):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled(spark, documents, prose, 150)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    turned = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, turned).collect()}
    assert all(abs(first[i] - again[i]) < 1e-9 for i in first)


def test_normal_equations_equal_a_direct_fit(spark, documents, prose):
    docs, labels, truth = labelled(spark, documents, prose, 200)
    rows = quality_classifier.document_statistics(docs)
    model = quality_classifier.train(rows, labels)
    seen = [r for r in rows.collect() if r["fold"] > 1]
    x, y = np.array([r["x"] for r in seen]), np.array([truth[r["doc_id"]] for r in seen], float)
    z = model.features(x)
    penalty = quality_classifier.RIDGE * len(x) * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), np.clip(z @ model.weights, -9, 9), atol=1e-5)


def test_pooled_is_isotonic_and_least_squares():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 5, 40).astype(float)
    y = rng.uniform(0, 1, 40) * n
    fit = quality_classifier.pooled(np.arange(40), n, y)
    assert (np.diff(fit) >= -1e-12).all()
    # Each level is the largest mean from the left of the least mean to the right.
    want = [max(min(y[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(fit, want)


def test_classifier_without_rows_or_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(documents([]), none).collect() == []
    rows = quality_classifier.score(documents([(1, ""), (None, None), (2, "a")]), none).collect()
    assert [r["score"] for r in rows] == [0.5] * 3
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.score(documents([(i, "a b") for i in range(20)] + [(3, "a b")]), one).collect()
    assert len(rows) == 21 and all(r["predicted"] == 1 for r in rows)


def test_lines_of_templated_hosts_are_counted(documents, prose):
    """Documents that are mostly template are no copies of each other."""
    template = [" ".join(prose.words(8)) for _ in range(20)]
    rows = [(i, "\n".join(template + [" ".join(prose.words(8)) for _ in range(2)]), "h") for i in range(60)]
    judged = {r["doc_id"]: r for r in quality_rules.judge(documents(rows)).collect()}
    assert all(not judged[i]["kept"] and judged[i]["common_words"] == 160 for i in range(60))
