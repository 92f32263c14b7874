"""Secrets in texts: fixed patterns and tokens that pass a battery of randomness tests.

Only DataFrame functions: every text is worked on within its row, nothing is shuffled but one
small table of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import texts

#: The base patterns, in the order of their kinds, and the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: The same matches as those of ``HEX`` that are long enough: runs are matched whole.
HEX_LONG = "[0-9a-f]{16,}+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

#: A candidate is a whole run of these characters, long enough for the tests.
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Symbols of each encoding that a candidate may have, the narrowest first.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("letters", "^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Encodings that share their strata, since a short token may look like any of them.
MIXED = ("base36", "base62", "base64")
ONE_CASE = ("decimal", "hex", "letters", "base32", "base36")
#: Lengths at which a new stratum begins.
BANDS = (24, 32, 48, 96)
#: Levels among which each stratum takes the least that keeps false discoveries rare enough.
LEVELS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5)
#: p-values above this are taken to be those of random tokens alone.
EVEN = 0.5


def _spans(text: Column, found: Column, pattern: str, keep: Column, kind: int) -> Column:
    """``(start, kind, end)`` of the matches ``found`` for which the array ``keep`` is true.

    The pieces of the text between the matches say where each match stands.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = F.arrays_zip(found.alias("m"), F.split(text, pattern).alias("g"), keep.alias("k"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["g"])
        end = start + F.coalesce(F.length(row["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        spans = F.when(row["k"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(rows, begin, step)["spans"]).otherwise(none)


def _long(found: Column, least: int) -> Column:
    return F.transform(found, lambda m: F.length(m) >= least)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a rational approximation to within 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def randomness(token: Column) -> Column:
    """``(stratum, p)`` of a candidate: its kind of encoding and length band, and the joint p-value.

    Three tests against evenly drawn symbols: chi-squared of the symbol counts (upper tail,
    moments for the given length), number of runs above and below the middle of the alphabet,
    and correlation of neighbours (both two-sided); Fisher's sum joins the p-values.
    """
    body = F.regexp_replace(token, "=+$", "")
    encoding, symbols = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, pattern, alphabet in reversed(ENCODINGS[:-1]):
        encoding = F.when(body.rlike(pattern), F.lit(name)).otherwise(encoding)
        symbols = F.when(body.rlike(pattern), F.lit(alphabet)).otherwise(symbols)
    band = F.lit(0)
    for least in BANDS:
        band = band + F.when(F.length(body) >= least, 1).otherwise(0)
    stratum = F.concat_ws(":", F.when(encoding.isin(*MIXED), "mixed").otherwise(encoding), band.cast("string"))
    shape = F.struct(
        F.when(encoding.isin(*ONE_CASE), F.lower(body)).otherwise(F.translate(body, "-_", "+/")).alias("body"),
        symbols.alias("symbols"), stratum.alias("stratum"),
    )

    def codes(s: Column) -> Column:
        x = F.transform(F.split(s["body"], ""), lambda c: F.instr(s["symbols"], c).cast("double"))
        return F.struct(
            x.alias("x"), F.length(s["body"]).cast("double").alias("n"), F.length(s["symbols"]).cast("double").alias("k"),
            F.aggregate(F.array_distinct(F.split(s["body"], "")), F.lit(0.0), lambda a, c: a + F.pow(F.length(s["body"]) - F.length(F.replace(s["body"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
            F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("sum"),
            s["stratum"].alias("stratum"),
        )

    def figures(s: Column) -> Column:
        n, mean, middle = s["n"], s["sum"] / s["n"], (s["k"] + 1) / 2
        pairs = F.zip_with(F.slice(s["x"], 1, F.size(s["x"]) - 1), F.slice(s["x"], 2, F.size(s["x"])), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(
            s["stratum"].alias("stratum"), n.alias("n"), s["k"].alias("k"), s["squares"].alias("squares"),
            F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + F.when(v > middle, 1.0).otherwise(0.0)).alias("high"),
            F.aggregate(pairs, F.lit(1.0), lambda a, p: a + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0)).alias("runs"),
            F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean)).alias("cross"),
            F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)).alias("spread"),
        )

    def scores(s: Column) -> Column:
        n, k = s["n"], s["k"]
        chi = (k / n * s["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        expected = 1 + 2 * s["high"] * (n - s["high"]) / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(spread > 0, (s["runs"] - expected) / F.sqrt(spread)).otherwise(99.0)
        serial = F.when(s["spread"] > 0, (s["cross"] / s["spread"] + 1 / n) * F.sqrt(n)).otherwise(99.0)
        return F.struct(
            s["stratum"].alias("stratum"), _normal_tail(chi).alias("chi"),
            (2 * _normal_tail(F.abs(runs))).alias("runs"), (2 * _normal_tail(F.abs(serial))).alias("serial"),
        )

    def joint(s: Column) -> Column:
        logs = [-F.ln(F.greatest(s[c], F.lit(1e-300))) for c in ("chi", "runs", "serial")]
        half = logs[0] + logs[1] + logs[2]
        return F.struct(s["stratum"].alias("stratum"), (F.exp(-half) * (1 + half + half * half / 2)).alias("p"))

    return _with(_with(_with(_with(shape, codes), figures), scores), joint)


def levels(tokens: DataFrame, most_false: float) -> DataFrame:
    """``(stratum, level)``: at which p-value a token of a stratum counts as random.

    ``tokens`` has ``stratum`` and ``p``. p-values of random tokens are even between 0 and 1, so
    those above ``EVEN`` say how many there are, with a known error. What stands above a level
    beyond their share and two standard errors is false, and one more for safety, so a few tokens
    show nothing. Each stratum, so each length, takes the least of ``LEVELS`` at which the share of
    false ones is at most ``most_false``, and none if there is no such level.
    """
    over = [F.count_if(F.col("p") > t).alias(f"over{i}") for i, t in enumerate(LEVELS)]
    counted = tokens.groupBy("stratum").agg(F.count("*").alias("m"), *over)
    truly = F.least(F.col(f"over{LEVELS.index(EVEN)}") / (1 - EVEN), F.col("m"))
    level = F.coalesce(
        *(
            F.when((F.col(f"over{i}") > 0) & (F.greatest(F.col(f"over{i}") - truly * (1 - t) - 2 * F.sqrt(truly * EVEN / (1 - EVEN)), F.lit(0.0)) + 1 <= most_false * F.col(f"over{i}")), t)
            for i, t in enumerate(LEVELS)
        )
    )
    return counted.select("stratum", level.alias("level")).where("level IS NOT NULL")


def scan(docs: DataFrame, most_false: float = 0.05) -> DataFrame:
    """One row per row of ``docs`` with its secrets; see ``KINDS``.

    A span is ``kind:start:end`` of a whole match, in code points, end exclusive. ``assign``,
    ``access`` and ``hex`` are leftmost non-overlapping matches, less those that are too short;
    ``base_sha256`` is the digest of these alone. ``random`` are candidates that no other span
    touches and whose joint p-value is above the level of their stratum. Null texts count as
    empty, without spans; ids may be null or repeat.
    """
    rows = texts(docs)
    tokens = rows.select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("token"))
    tested = tokens.select(randomness(F.col("token")).alias("r")).select("r.*")
    # A row per kind of encoding and length band, 25 at most.
    by_stratum = levels(tested, most_false).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "level"))).alias("of"))
    text = F.col("text")
    found = rows.select(
        "doc_id", "text",
        *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX_LONG, CANDIDATE))),
        by_stratum.scalar().alias("levels"),
    )
    values = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)))

    def passes(token: Column) -> Column:
        return _with(randomness(token), lambda r: F.coalesce(r["p"] > F.try_element_at(F.col("levels"), r["stratum"]), F.lit(False)))

    spans = found.select(
        "doc_id",
        _spans(text, F.col("assign"), ASSIGN, _long(values, LEAST["assign"]), 0).alias("assign"),
        _spans(text, F.col("access"), ACCESS, _long(F.col("access"), LEAST["access"]), 1).alias("access"),
        _spans(text, F.col("hex"), HEX_LONG, _long(F.col("hex"), LEAST["hex"]), 2).alias("hex"),
        _spans(text, F.col("random"), CANDIDATE, F.transform("random", passes), 3).alias("random"),
    )
    base = spans.select(
        "*", F.array_sort(F.concat("assign", "access", "hex")).alias("base")
    )
    alone = base.withColumn(
        "random", F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    )

    def listed(found: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return alone.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
