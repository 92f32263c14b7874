import hashlib
import random
import re
import time

import pytest

from corpusflow.llm import personal, queries

#: The patterns as they are stated, without any haste.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def by_hand(text):
    spans = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if passes(kind, m.group())]
    return [s for _, _, s in sorted(spans)]


def with_digit(digits):
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def iban(country, body):
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def listed(text):
    return [f"{personal.KINDS[s.kind]}:{s.start}:{s.end}" for s, _ in personal.find(text)]


def base(found):
    return [s for s in found if s.split(":")[0] in personal.BASE]


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@@", ".", "-", "+", "1", "25", "255", "256", "0255", " ", "  ", "(", ")", "é", "😀", "\n", "_", "%", "x@y.z", "4111111111111111", "+1 (017) 555-7713", "10.0.0.1"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert base(listed(text)) == by_hand(text), repr(text)
    digits = ["0", "1", "5", "9", " ", "-", ".", "+"]
    for _ in range(6000):
        text = "".join(rng.choice(digits) for _ in range(rng.randint(1, 60)))
        assert base(listed(text)) == by_hand(text), repr(text)


def test_query_columns(spark, prose, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"{prose.prose(20)} mail a{i}@b.com {with_digit('4' + str(rng.randrange(10**14)).zfill(14))} and 10.1.2.{i} +1 (555) 123-45{i:02d} é") for i in range(30)]
    rows += [(40, None), (41, ""), (None, "x@y.de"), (42, "a@b.c"), (42, "a@b.c")]
    spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, spans int, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((d is None, d, ",".join(by_hand(t))) for d, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["spans"]) for r in got) == want
    for r in got:
        kinds = [s.split(":")[0] for s in r["spans"].split(",")]
        assert [r[f"n_{k}"] for k in personal.BASE] == [kinds.count(k) for k in personal.BASE]
        assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert {r["n_card"] for r in got if r["doc_id"] is not None and r["doc_id"] < 30} == {1}


def test_added_kinds():
    number = iban("DE", "500105175407324931")
    assert listed(f"konto {number}.") == [f"iban:6:{6 + len(number)}"]
    spaced = " ".join(number[k : k + 4] for k in range(0, len(number), 4))
    # Groups of digits may be a card as well; the IBAN gives way to a base span only.
    found = listed(f"konto {spaced} EUR")
    assert base(found) == by_hand(f"konto {spaced} EUR")
    assert base(found) or found == [f"iban:6:{6 + len(spaced)}"]
    assert not [s for s in listed(f"konto {number[:-1]}{(int(number[-1]) + 1) % 10}") if s.startswith("iban")]
    assert listed("social security 123-45-6789") == ["ssn:16:27"]
    assert listed("score 123-45-6789") == [] and listed("ssn 000-45-6789") == []
    assert listed("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up") == ["ipv6:5:44"]
    thirteen = with_digit("422222222222")
    assert listed(f"credit card {thirteen}") == ["card13:12:25"] and listed(f"isbn {thirteen}") == []
    assert listed("tel 030 1234567") == ["local_phone:4:15"] and listed("about 030 1234567") == []


def test_context_adjusts_the_score():
    score = lambda text: personal.find(text)[0][1]
    assert score("server 10.0.0.1") > score("then 10.0.0.1") > score("version 10.0.0.1")
    far = "server " + "x " * 60 + "10.0.0.1"
    assert score(far) == score("then 10.0.0.1")
    # Base spans stay, whatever they score.
    assert listed("version release 1.2.3.4") == ["ip:16:23"]


def test_mod97_and_luhn():
    rng = random.Random(8)
    for _ in range(300):
        body = "".join(rng.choice("0123456789ABCDEFGHIJ") for _ in range(18))
        whole = iban("GB", body)
        assert personal.mod97(whole)
        wrong = whole[:-1] + ("1" if whole[-1] == "0" else "0")
        assert not personal.mod97(wrong)
        digits = str(rng.randrange(10**16))
        assert personal.luhn(digits) == luhn(digits)


@pytest.mark.parametrize("text", ["a" * 2_000_000 + "@", "1" * 2_000_000, "1." * 1_000_000, "+1" * 500_000, "a@" * 500_000, "A1" * 500_000, "1 " * 1_000_000, ":1" * 500_000])
def test_long_texts_take_linear_time(text):
    started = time.time()
    personal.find(text)
    assert time.time() - started < 20


def test_empty_table(documents):
    assert personal.scan(documents([])).collect() == []


def test_precision_on_prose(prose):
    texts = [prose.prose(200) + f" {n} in 19{n % 100:02d} and 3.14.15 at 12:30, 1 234 567" for n in range(200)]
    assert sum(len(listed(t)) for t in texts) == 0
