"""Named queries of the numbered operators over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import (
    chat_tools,
    decontamination,
    fill_middle,
    jaccard_join,
    lexical_search,
    line_dedup,
    lm_scoring,
    packing,
    personal,
    quality_classifier,
    quality_rules,
    secrets,
    url_filter,
)
from corpusflow.llm.common import IN_PIECES, table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), word_tokenizer())


@query
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


@query
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded, since SQL adds up in another order."""
    scored = lm_scoring.score(table(spark, folder, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


ORACLES["op7_lm_scoring"] = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), words AS (
    SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, ws FROM split
), grams AS (
    SELECT doc_id, n, i, ws[i] AS w,
        CASE WHEN i > 1 THEN ws[i - 1] END AS v,
        CASE WHEN i > 2 THEN ws[i - 2] END AS u
    FROM words
), c1 AS (SELECT w, count(*) AS c FROM grams GROUP BY ALL
), c2 AS (SELECT v, w, count(*) AS c FROM grams WHERE v IS NOT NULL GROUP BY ALL
), c3 AS (SELECT u, v, w, count(*) AS c FROM grams WHERE u IS NOT NULL GROUP BY ALL
), total AS (SELECT count(*) AS c FROM grams
), scored AS (
    SELECT doc_id, least(i, 3) AS longest, CASE WHEN c3.c >= 2 THEN 3 WHEN c2.c >= 2 THEN 2 ELSE 1 END AS used,
        CASE WHEN c3.c >= 2 THEN ln(c3.c / b.c)
            WHEN c2.c >= 2 THEN ln(c2.c / a.c)
            ELSE ln(c1.c / total.c) END AS s
    FROM grams g CROSS JOIN total
    JOIN c1 ON c1.w = g.w
    LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w
    LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w
    LEFT JOIN c1 a ON a.w = g.v
    LEFT JOIN c2 b ON b.v = g.u AND b.w = g.v
), summed AS (
    SELECT doc_id, count(*) AS n, sum(s + (longest - used) * ln(0.4)) AS s, count(*) FILTER (used < longest) AS back
    FROM scored GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0), 6) AS log_score,
    round(s / n, 6) AS mean_log_score, coalesce(back, 0) AS n_backed_off
FROM documents d LEFT JOIN summed USING (doc_id)
"""


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).drop("text_hash", "common")


ORACLES["op8_quality_rules"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), split AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d
), places AS (
    SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
        unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS w
    FROM split
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM places
), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM windows CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id
), lines AS (
    SELECT doc_id, t, host, unnest(ls) AS line FROM split
), normal AS (
    SELECT doc_id, t, host, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
        regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') AS line
    FROM lines
), hosts AS (SELECT host, count(DISTINCT t) AS n FROM normal GROUP BY host
), often AS (
    SELECT host, line FROM normal JOIN hosts USING (host) GROUP BY host, line
    HAVING count(DISTINCT t) > greatest(5, 0.05 * any_value(n))
), lost AS (
    SELECT doc_id, sum(words)::BIGINT AS n FROM normal JOIN often USING (host, line) GROUP BY doc_id
), figures AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS common_words
    FROM split LEFT JOIN repeated r USING (doc_id) LEFT JOIN lost l USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - common_words >= 0.3 * n_words AS kept
FROM figures
"""


#: Functions that the turns of ``conversations`` call, and their parameters.
CHAT_SCHEMAS = {
    "lookup": {"prompt": ("string", True), "words": ("integer", True)},
    "compose": {"prompt": ("string", True), "words": ("integer", True), "tone": ("string", False)},
}


@query
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn is a call, the turn behind it the result.

    A call waits for the user turn two before; by a hash of the conversation, in some all wait for the
    one behind instead, and in some for both, so that calls wait for each other. By a hash of the turn some
    break their schema or are made twice. Calls and results that are marked in a text count as well.
    """
    turns = table(spark, folder, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    drawn, whole = F.crc32(key), F.crc32(F.col("conv_id").cast("string"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))

    def turn(by: int):
        return F.concat_ws(":", F.col("conv_id"), F.col("turn") + by)

    before, behind = F.when(F.col("turn") >= 2, turn(-2)), turn(2)
    after = F.when(whole % 8 == 0, F.array(behind)).when(whole % 8 == 1, F.array(before, behind)).otherwise(F.array(before))
    prompt = F.when(drawn % 13 != 0, F.col("text")).alias("prompt")
    plain = F.to_json(F.struct(words.alias("words"), prompt))
    wrong = F.to_json(F.struct(words.cast("string").alias("words"), prompt))
    calls = turns.where("role = 'user'").select(
        "conv_id", key.alias("call_id"), "turn", F.explode(F.when(drawn % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("seq"),
        F.when(drawn % 17 == 0, "search").when(words <= 30, "lookup").otherwise("compose").alias("name"),
        F.when(drawn % 11 == 0, wrong).otherwise(plain).alias("arguments"), F.array_compact(after).alias("after"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", turn(-1).alias("call_id"), "turn", F.lit(0).alias("seq"), F.col("text").alias("content")
    )
    return chat_tools.link(
        calls.unionByName(chat_tools.marked_calls(turns)), results.unionByName(chat_tools.marked_results(turns)), CHAT_SCHEMAS
    )


#: The rules of the query, and the labels of hosts to be listed.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
UNWANTED = ("casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x")


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judge(pages, url_filter.hosts_named(pages, UNWANTED), URL_RULES).drop("entry")


ORACLES["op10_url_filter"] = r"""
WITH urls AS (
    SELECT page_id, coalesce(url, '') AS url FROM pages
), parts AS (
    SELECT page_id,
        lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)) AS host,
        regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
    FROM urls
), list AS (
    SELECT DISTINCT regexp_extract(host, '(?:^|\.)((?:casino-win|free-bets|cheap-pills|ads-track|spam-farm|adult-x)\..+)$', 1) AS entry
    FROM parts
), ruled AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/'
    END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN EXISTS (SELECT 1 FROM list WHERE entry != '' AND ('.' || host) LIKE '%.' || entry) THEN 'block'
    ELSE 'allow'
END AS verdict
FROM ruled
"""


@query
def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*personal.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *map(count, personal.BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.transform(table(spark, folder, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_in_middle"] = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
    SELECT doc_id, t, length(t) AS n,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM drawn
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE
        WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars,
    CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents", **IN_PIECES), table(spark, folder, "benchmark"))


ORACLES["op13_lexical_search"] = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts CROSS JOIN total GROUP BY term
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) CROSS JOIN total
    GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""
