"""The named queries in plain SQL, for checking the Spark results with DuckDB."""

from __future__ import annotations

from corpusflow.operators.retrieval import SYSTEM_PROMPT
from corpusflow.plans.queries import BITS, PROBES, QUESTION_DIMENSION, SHORT_QUESTION, TABLES
from corpusflow.plans.tables import MARKED_HEAD, MARKED_TAIL

WS = (
    r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NL = "chr(10)"
MIN_CHARS = 50


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')"


def n_words(e: str) -> str:
    return f"len({words(e)})"


def sentences(e: str) -> str:
    cut = f"string_split(regexp_replace({e}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"


def option_lines(e: str) -> str:
    return rf"regexp_replace({e}, '(?m)^\[.*?\].*?$', '', 'g')"


def clean_commands(e: str) -> str:
    for pattern in (
        r"\\usepackage\{.*?\}",
        r"\\documentclass\{.*?\}",
        r"\\begin\{.*?\}",
        r"\\end\{.*?\}",
        r"\\section\*?\{",
        r"\\subsection\*?\{",
        r"\\cite\{",
        r"\\ref\{",
        r"\\label\{",
        r"\\",
        r"[{}]",
        r" +",
    ):
        e = f"regexp_replace({e}, '{pattern}', '{' ' if pattern == ' +' else ''}', 'g')"
    return e


def content_lines(e: str) -> str:
    lines = f"list_transform(string_split({e}, {NL}), lambda l: {strip('l')})"
    return (
        f"list_filter({lines}, lambda l: length(l) >= 3 and not starts_with(l, '[') "
        "and l <> 'document')"
    )


def clean_lines(e: str) -> str:
    return content_lines(clean_commands(option_lines(e)))


HEADER = (
    rf"(?i)^(?:(?:abstract|introduction|methods?|methodology|results?|discussion|conclusion"
    rf"|references?|acknowledgments?){WS}*$|\p{{Nd}}+\.?{WS}+[A-Z]|[A-Z][A-Z{WS[1:-1]}]{{3,}}$)"
)


def looks_like_header(e: str) -> str:
    return f"regexp_matches(lower({strip(e)}), '{HEADER}')"


def is_header(e: str) -> str:
    return f"(length({strip(e)}) < 100 and {looks_like_header(e)})"


PAPERS = "select doc_id as doc_key, doc_id || '.txt' as source_file, text from documents"
MARKED = (
    "select doc_id as doc_key, doc_id || '.txt' as source_file, "
    f"{quoted(MARKED_HEAD)} || text || {quoted(MARKED_TAIL)} as text from documents"
)
SECTIONED = f"""select conv_id || ':' || turn as doc_key, conv_id || ':' || turn || '.txt' as source_file,
    concat_ws({NL}, text, role, text, 'Results', 'Discussion', text, '1. Last part', text) as text
    from conversations"""


def numbered(rows: str, items: str, number: str, item: str) -> str:
    return f"""select doc_key, unnest({items}) as {item},
        generate_subscripts({items}, 1) - 1 as {number} from ({rows})"""


def pack(items: str, size: int, overlap: int, forced_overlap: int | None = None) -> str:
    """Fold a list of segments into chunks, as texts; sizes count words."""
    again = overlap if forced_overlap is None else forced_overlap
    forced = (
        f"list_transform(range(0, greatest(1, {n_words('x')} - {again}), {size - again}), "
        f"lambda i: array_to_string({words('x')}[i + 1 : i + {size}], ' '))"
    )
    tail = f"array_to_string({words('a.cur')}[-{overlap}:], ' ')"
    fold = f"""list_reduce({items}, lambda a, x: case
        when {n_words('x')} > {size} then {{'done': list_concat(a.done,
            case when a.cur is null then [] else [a.cur] end, {forced}),
            'cur': null::varchar, 'n': 0::bigint}}
        when a.cur is not null and a.n + {n_words('x')} > {size} then {{
            'done': list_append(a.done, a.cur),
            'cur': (case when a.n <= {overlap} then a.cur else {tail} end) || ' ' || x,
            'n': least(a.n, {overlap}) + {n_words('x')}}}
        else {{'done': a.done, 'cur': case when a.cur is null then x else a.cur || ' ' || x end,
            'n': a.n + {n_words('x')}}} end,
        {{'done': []::varchar[], 'cur': null::varchar, 'n': 0::bigint}})"""
    return (
        f"list_transform([{fold}], lambda r: case when r.cur is null then r.done "
        "else list_append(r.done, r.cur) end)[1]"
    )


def sections_cte(rows: str) -> str:
    """CTEs down to ``sections(doc_key, source_file, sid, section, text)``."""
    return f"""docs as ({rows}),
    lines as (select doc_key, source_file, unnest(l) as line, generate_subscripts(l, 1) as pos
        from (select doc_key, source_file, {clean_lines('text')} as l from docs)),
    heads as (select *, {is_header('line')} as head from lines),
    runs as (select *, sum(head::int) over (partition by doc_key order by pos) as sid from heads),
    named as (select doc_key, source_file, sid,
        coalesce(left(max(line) filter (head), 50), 'introduction') as section,
        string_agg(line, {NL} order by pos) filter (not head) as text
        from runs group by all),
    sections as (select * from named where text is not null
        union all select doc_key, source_file, 0, 'unknown', string_agg(line, {NL} order by pos)
        from runs group by doc_key, source_file having bool_and(head))"""


def chunks_cte(
    rows: str, size: int = 512, overlap: int = 100, min_chars: int = MIN_CHARS,
    forced_overlap: int | None = None, per_word: int = 1, cut: str | None = None,
) -> str:
    """CTEs down to ``chunks`` with the columns of the flat chunk table.

    ``cut`` gives the segments of a section; a word costs ``per_word`` tokens.
    """
    return f"""{sections_cte(rows)},
    packed as (select *, case when {n_words('text')} <= {size} then [text]
        else {pack(cut or sentences('text'), size, overlap, forced_overlap)} end as c from sections),
    pieces as (select doc_key, source_file, sid, section, {strip('unnest(c)')} as text,
        generate_subscripts(c, 1) as cno from packed),
    kept as (select * from pieces where length(text) >= {min_chars}),
    chunks as (select doc_key::varchar as paper_id,
        row_number() over (partition by doc_key order by sid, cno) - 1 as chunk_index,
        count(*) over (partition by doc_key) as total_chunks, section,
        length(text) as char_count, {per_word} * {n_words('text')} as token_count, source_file, text from kept)"""


def doc_stats_sql(rows: str) -> str:
    return f"""{chunks_cte(rows)},
    per_doc as (select source_file as filename, count(c.paper_id) as chunks,
        coalesce(sum(c.token_count), 0)::bigint as tokens
        from docs d left join chunks c using (source_file) group by source_file)"""


# Vectors

MEANS = """dims as (select label::bigint as label, unnest(embedding)::double as x,
        generate_subscripts(embedding, 1) as i from embeddings),
    dim_means as (select label, i, avg(x) as m from dims group by label, i),
    raw_means as (select label, list(m order by i) as m from dim_means group by label),
    means as (select label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as mean
        from raw_means),
    vecs as (select vec_id as vec_key, label::bigint as label, embedding::double[] as v
        from embeddings)"""


def dot(a: str, b: str) -> str:
    return f"(round(list_dot_product({a}, {b}), 6) + 0.0)"


def hashed_cte(texts: str, name: str, width: int) -> str:
    """CTEs down to ``<name>(tid, bucket, x)``, the non-zero entries of hashed vectors."""
    return f"""{name}_w as (select tid, unnest(list_filter(
            regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) as w
            from ({texts})),
    {name}_h as (select tid, ('0x' || substr(md5(w), 1, 8))::bigint % {width} as bucket,
        sum(case when substr(md5(w), 9, 1) < '8' then 1 else -1 end) as n from {name}_w group by all),
    {name} as (select tid, bucket,
        (n / sqrt(sum(n * n) over (partition by tid)))::float::double as x from {name}_h where n <> 0)"""


QUESTIONS = "select item_id as question_id, text as question from benchmark"
DENSE_QUESTIONS = f"""{hashed_cte('select item_id as tid, text from benchmark', 'qh', QUESTION_DIMENSION)},
    qv as (select q.item_id as question_id, list(coalesce(x, 0.0) order by b.bucket) as v
        from benchmark q cross join (select unnest(range(0, {QUESTION_DIMENSION})) as bucket) b
        left join qh on qh.tid = q.item_id and qh.bucket = b.bucket group by q.item_id)"""


def ranked(scored: str, k: int = 5) -> str:
    return f"""select * from (select *, row_number() over (partition by question_id
        order by score desc, vec_key) as rank from {scored}) where rank <= {k}"""


EXACT = f"""scored as (select question_id, vec_key, {dot('qv.v', 'vecs.v')} as score
    from qv cross join vecs), exact as ({ranked('scored')})"""
IVF = f"""cell_scores as (select vec_key, means.label as cell_id, {dot('v', 'mean')} as s
        from vecs cross join means),
    assigned as (select vec_key, cell_id from cell_scores qualify
        row_number() over (partition by vec_key order by s desc, cell_id) = 1),
    probes as (select question_id, means.label as cell_id from qv cross join means qualify
        row_number() over (partition by question_id order by {dot('v', 'mean')} desc, label) <= {PROBES}),
    ivf_scored as (select question_id, vec_key, {dot('qv.v', 'vecs.v')} as score
        from probes join assigned using (cell_id) join qv using (question_id) join vecs using (vec_key)),
    ivf as ({ranked('ivf_scored')})"""
LSH = f"""planes as (select r, list(case when substr(md5(r || ':' || i), 1, 1) < '8' then 1.0 else -1.0 end
        order by i) as plane from (select unnest(range(0, {TABLES * BITS})) as r)
        cross join (select unnest(range(0, {QUESTION_DIMENSION})) as i) group by r),
    v_buckets as (select vec_key, r // {BITS} as t,
        sum((round(list_dot_product(v, plane), 9) >= 0)::bigint << (r % {BITS})) as b
        from vecs cross join planes group by all),
    q_buckets as (select question_id, r // {BITS} as t,
        sum((round(list_dot_product(v, plane), 9) >= 0)::bigint << (r % {BITS})) as b
        from qv cross join planes group by all),
    candidates as (select distinct question_id, vec_key from q_buckets join v_buckets using (t, b)),
    lsh_scored as (select question_id, vec_key, {dot('qv.v', 'vecs.v')} as score
        from candidates join qv using (question_id) join vecs using (vec_key)),
    lsh as ({ranked('lsh_scored')})"""

RETRIEVED = f"""{chunks_cte(PAPERS)},
    keyed as (select *, paper_id || '#' || chunk_index as vec_key from chunks),
    {hashed_cte('select item_id as tid, text from benchmark', 'qh', 384)},
    {hashed_cte('select vec_key as tid, text from keyed', 'ch', 384)},
    sums as (select qh.tid as question_id, ch.tid as vec_key, sum(qh.x * ch.x) as s
        from qh join ch using (bucket) group by all),
    pairs as (select q.item_id as question_id, keyed.vec_key, round(coalesce(s, 0.0), 6) + 0.0 as score
        from benchmark q cross join keyed left join sums on sums.question_id = q.item_id
        and sums.vec_key = keyed.vec_key),
    hits as ({ranked('pairs')}),
    retrieved as (select * from hits join keyed using (vec_key)),
    contexts as (select question_id, 'RELEVANT RESEARCH CONTEXT:' || {NL} || {NL} ||
        string_agg('[Source ' || rank || ' - Paper: ' || paper_id || ', Section: ' || section || ']'
        || {NL} || text || {NL} || {NL}, '' order by rank) as context from retrieved group by question_id),
    by_section as (select question_id, paper_id, section, min(rank) as r from retrieved group by all),
    by_paper as (select question_id, paper_id, min(r) as r,
        array_to_string(list(section order by r)[1:3], ', ') as sections from by_section group by all),
    placed as (select *, row_number() over (partition by question_id order by r) as place from by_paper),
    cited as (select question_id, {NL} || {NL} || '📚 **Sources:**' || {NL} || string_agg(place || '. **' ||
        paper_id || '** (Sections: ' || sections || ')' || {NL}, '' order by place) as citations
        from placed group by question_id),
    prompts as (select question_id, question, context || {NL} || {NL} || 'USER QUESTION: ' || question
        || {NL} || {NL} || 'Please provide a friendly, easy-to-understand answer based on the research '
        || 'context above. Remember to explain complex concepts in simple terms!' as content
        from ({QUESTIONS}) join contexts using (question_id))"""

FLAT = "paper_id, chunk_index, total_chunks, section, char_count, token_count, source_file, text"
RETRIEVED_FLAT = "question_id, rank, paper_id, section, score, chunk_index, source_file"


def _numbered_sql(rows: str, items: str, number: str, item: str) -> str:
    return f"select doc_key, {number}, {item} from ({numbered(rows, items, number, item)})"


def _paragraphs(e: str) -> str:
    cut = f"regexp_split_to_array({e}, '\\n{WS}*\\n')"
    return f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"


_LINES = f"list_filter(list_transform(string_split(text, {NL}), lambda x: {strip('x')}), lambda x: x <> '')"
_FIVE = f"list_transform(string_split({strip('t')}, {NL})[1:5], lambda l: {strip('l')})"

ORACLES: dict[str, str] = {
    "corpus_scan": f"""select doc_id || '.v1' as doc_key, doc_id || '.v1.txt' as source_file,
        length(t) as n_chars, md5(t) as digest from (select doc_id, case when doc_id % 7 = 0 then ''
        else regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(65533) || {NL} || 'last' || {NL} || 'line' end as t
        from documents)""",
    "failed_documents": """select doc_id as doc_key, doc_id || '.txt' as filename,
        'no text' as error, 0::bigint as chunks, 0::bigint as tokens from documents
        where lang = 'de' or lang is null or text is null""",
    "chunks_json_roundtrip": f"with {chunks_cte(PAPERS)} select {FLAT} from chunks",
    "vector_table": f"with {MEANS}, qv as (select 0 as question_id, [0.0] as v), {IVF} "
    "select vec_key, cell_id, len(v) as dimension from assigned join vecs using (vec_key)",
    "index_config": """select 'driver-vectors' as model_name, max(len(embedding)) as
        embedding_dimension, count(*) as total_vectors, 'IndexFlatIP' as index_type from embeddings""",
    "embed_incremental": f"""with fresh as (select distinct sha256(text) as tid, text from documents),
        {hashed_cte('select tid, text from fresh', 'h', 384)}
        select fresh.tid as content_key, count(bucket) as used_buckets
        from fresh left join h using (tid) group by fresh.tid""",
    "embed_model": """with m as (select doc_id as doc_key, [length(text), len(string_split(text, ' ')), 1.0]::double[] as v
        from documents)
        select doc_key, unnest(range(0, 3)) as i,
        round((unnest(v) / sqrt(list_dot_product(v, v)))::float::double, 5) as x from m""",
    "clean_bracket_lines": f"select doc_key, {option_lines('text')} as text from ({MARKED})",
    "clean_latex": f"select doc_key, array_to_string({clean_lines('text')}, {NL}) as text from ({MARKED})",
    "collapse_whitespace": f"""select doc_key, regexp_replace(regexp_replace(text, ' +', ' ', 'g'),
        '\\n{{3,}}', {NL} || {NL}, 'g') as text from ({MARKED})""",
    "drop_artifact_lines": f"select doc_key, array_to_string({content_lines('text')}, {NL}) as text from ({MARKED})",
    "section_headers": f"""select * from ({_numbered_sql(SECTIONED, f"string_split(text, {NL})", 'line_no', 'line')})
        where {is_header('line')}""",
    "split_sections": f"""with {sections_cte(SECTIONED)} select doc_key,
        row_number() over (partition by doc_key order by sid) - 1 as section_no, section, text
        from sections""",
    "section_hint": f"""select conv_id, turn, coalesce(left(list_filter({_FIVE},
        lambda l: {looks_like_header('l')})[1], 50), 'unknown') as section from
        (select conv_id, turn, concat_ws({NL}, text, role, text) as t from conversations)""",
    "split_paragraphs": _numbered_sql(
        PAPERS, _paragraphs(f"replace(text, '. ', '.' || {NL} || ' ' || chr(9) || {NL} || ' ')"),
        "paragraph_no", "paragraph",
    ),
    "split_sentences": _numbered_sql(PAPERS, sentences("text"), "sentence_no", "sentence"),
    "pack_sentences": _numbered_sql(
        f"select doc_key, {pack(sentences('text'), 64, 12)} as c from ({PAPERS})", "c", "chunk_no", "chunk"
    ),
    "chunk_overlap_tail": f"""select doc_key, case when {n_words('t')} <= 12 then t
        else array_to_string({words('t')}[-12:], ' ') end as tail from
        (select doc_key, array_to_string({sentences('text')}, ' ') as t from ({PAPERS}))""",
    "force_split": _numbered_sql(
        f"""select doc_key, list_transform(range(0, greatest(1, len(w) - 8), 32),
            lambda i: array_to_string(w[i + 1 : i + 40], ' ')) as c
            from (select doc_key, {words('text')} as w from ({PAPERS})) where len(w) > 0""",
        "c", "chunk_no", "chunk",
    ),
    "chunk_documents": f"with {chunks_cte(PAPERS)} select {FLAT} from chunks",
    "chunk_documents_counted": f"with {chunks_cte(PAPERS, 64, 1, forced_overlap=40, per_word=40)} select {FLAT} from chunks",
    "failed_documents_counted": f"""with {doc_stats_sql(PAPERS)},
        bad as (select distinct source_file as filename from sections where contains(text, '|'))
        select p.filename, case when bad.filename is not null then 'token counter failed: reserved sign' end as error,
        case when bad.filename is null then chunks else 0 end as chunks,
        case when bad.filename is null then tokens else 0 end as tokens
        from per_doc p left join bad using (filename)""",
    "split_by_paragraphs": _numbered_sql(
        f"""select doc_key, case when {n_words('t')} <= 64 then [t]
            when len({_paragraphs('t')}) = 1 then {pack(sentences('t'), 64, 12)}
            else {pack(_paragraphs('t'), 64, 12)} end as c from (select doc_key,
            replace(text, '. ', '.' || {NL} || ' ' || chr(9) || {NL} || ' ') as t from ({PAPERS}))""",
        "c", "chunk_no", "chunk",
    ),
    "chunk_by_lines": f"""with {chunks_cte(SECTIONED, 64, 12, cut=_LINES)} select {FLAT} from chunks""",
    "chunk_file_source": f"with {chunks_cte(PAPERS, 64, 12)} select {FLAT} from chunks",
    "chunk_run": f"""with {chunks_cte(PAPERS, 64, 12)}, per_doc as (select source_file as filename,
        count(c.paper_id) as chunks, coalesce(sum(c.token_count), 0)::bigint as tokens
        from docs d left join chunks c using (source_file) group by source_file)
        select count(*) as total_documents, sum(chunks)::bigint as total_chunks, sum(tokens)::bigint as total_tokens,
        round(coalesce(sum(tokens) / nullif(sum(chunks), 0), 0.0), 6) as avg_chunk_size,
        64::bigint as chunk_size, 12::bigint as chunk_overlap, 'words' as encoding,
        sum(chunks)::bigint as stored_chunks from per_doc""",
    "chunk_sections": f"with {chunks_cte(SECTIONED, 40, 8)} select {FLAT} from chunks",
    "chunk_metadata": f"with {chunks_cte(MARKED, 64, 12)} select * exclude (text) from chunks",
    "token_counts": f"select doc_key, {n_words('text')} as tokens from ({PAPERS})",
    "drop_small_chunks": f"""with {chunks_cte(SECTIONED, 40, 8, 0)} select doc_key,
        count(k.text) filter (length(k.text) >= {MIN_CHARS}) as kept,
        count(k.text) filter (length(k.text) < {MIN_CHARS}) as dropped
        from docs left join (select doc_key, text from kept) k using (doc_key) group by doc_key""",
    "chunk_preview": f"""with {chunks_cte(PAPERS)} select paper_id, chunk_index, section, token_count,
        left(text, 200) as preview from chunks order by paper_id, chunk_index limit 3""",
    "doc_stats": f"with {doc_stats_sql(PAPERS)} select * from per_doc",
    "doc_stats_stored": f"with {doc_stats_sql(PAPERS)} select * from per_doc",
    "corpus_stats": f"""with {doc_stats_sql(PAPERS)} select count(*) as total_documents,
        sum(chunks)::bigint as total_chunks, sum(tokens)::bigint as total_tokens,
        round(coalesce(sum(tokens) / nullif(sum(chunks), 0), 0.0), 6) as avg_chunk_size from per_doc""",
    "stream_chunks": f"with {chunks_cte(PAPERS)} select {FLAT} from chunks",
    "embed_hashed": f"""with {hashed_cte('select doc_id as tid, text from documents', 'h', 384)}
        select tid as doc_key, bucket, round(x, 6) as x from h""",
    "l2_normalize_vectors": f"""with {MEANS}, scaled as (select vec_key,
        list_transform(v, lambda x: x * label) as s from vecs),
        units as (select vec_key, sqrt(list_dot_product(s, s)) as n, s from scaled)
        select vec_key, unnest(range(0, len(s))) as i, round(case when n > 0 then unnest(s) / n
        else 0.0 end, 6) + 0.0 as x from units""",
    "cosine_scores": f"""with {MEANS} select vec_key, label, {dot('v', 'mean')} as score
        from vecs join means using (label)""",
    "knn_exact": f"""with {MEANS}, scored as (select means.label as question_id, vec_key,
        {dot('v', 'mean')} as score from means cross join vecs) {ranked('scored')}""",
    "knn_unknown": f"""with {MEANS}, scored as (select means.label as question_id, vec_key,
        {dot('v', 'mean')} as score from means cross join vecs where vec_key % 3 <> 0) {ranked('scored')}""",
    "knn_ivf_trained": f"with {MEANS}, {DENSE_QUESTIONS}, {EXACT} select * from exact",
    "knn_single": f"""with {MEANS}, one as (select list_transform(m, lambda x: x /
        sqrt(list_dot_product(m, m))) as q from (select list(m order by i) as m from
        (select i, avg(x) as m from dims group by i)))
        select vec_key, {dot('v', 'q')} as score from vecs cross join one
        order by score desc, vec_key limit 5""",
    "ivf_assign": f"with {MEANS}, qv as (select 0 as question_id, [0.0] as v), {IVF} "
    "select vec_key, cell_id from assigned",
    "knn_ivf": f"with {MEANS}, {DENSE_QUESTIONS}, {IVF} select * from ivf",
    "knn_lsh": f"with {MEANS}, {DENSE_QUESTIONS}, {LSH} select * from lsh",
    "knn_recall": f"""with {MEANS}, {DENSE_QUESTIONS}, {EXACT}, {IVF}, {LSH},
        found as (select 'ivf' as method, question_id, vec_key from ivf
            union all select 'hnsw', question_id, vec_key from lsh)
        select m.method, e.question_id, round(count(f.vec_key) / count(*), 6) as recall
        from exact e cross join (values ('ivf'), ('hnsw')) m(method)
        left join found f on f.method = m.method and f.question_id = e.question_id
            and f.vec_key = e.vec_key group by all""",
    "valid_questions": f"""select question_id, {strip('question')} as question from ({QUESTIONS})
        where length(question) >= {SHORT_QUESTION}""",
    "retrieve": f"with {RETRIEVED} select {RETRIEVED_FLAT} from retrieved",
    "retrieve_with_text": f"with {RETRIEVED} select {RETRIEVED_FLAT}, text from retrieved",
    "search_report": f"""with {RETRIEVED} select question_id, rank, round(score::decimal(18,6), 4)::decimal(18,4)::varchar as score,
        paper_id as paper, section, chunk_index || '/' || total_chunks as chunk,
        token_count as tokens from retrieved""",
    "format_context": f"with {RETRIEVED} select question_id, context from contexts",
    "format_sources": f"with {RETRIEVED} select question_id, citations from cited",
    "build_messages": f"""with {RETRIEVED} select question_id, 0::bigint as message_no,
        'system' as role, {quoted(SYSTEM_PROMPT)} as content from prompts
        union all select question_id, 1, 'user', content from prompts""",
    "answer_batch": f"""with {RETRIEVED}, gathered as (select question_id, count(*) as n,
        string_agg(paper_id, ',' order by rank) as papers, string_agg(text, '|' order by rank) as context
        from retrieved group by question_id), judged as (select *, length(question) >= {SHORT_QUESTION} as ok
        from prompts)
        select question_id, case when ok then 'From ' || length(content) || ' characters.' || citations
            else 'Sorry, I encountered an error: question too short' end as answer, ok as success,
            case when not ok then 'question too short' end as error,
            case when ok then n else 0 end as n_sources, case when ok then papers else '' end as papers,
            case when ok then g.context else '' end as context
        from judged join gathered g using (question_id) join cited using (question_id)""",
}
ORACLES["knn_grid"] = ORACLES["knn_bounded"] = ORACLES["knn_quantised"] = ORACLES["knn_exact"]
# Exact up to as many vectors as a search begins with; tests hold the recall beyond.
ORACLES["knn_graph"] = ORACLES["knn_ivf_trained"]
ORACLES["answer_stored"] = ORACLES["answer_batch"]
ORACLES["stream_redelivered"] = ORACLES["stream_chunks"]
ORACLES["embed_sync_store"] = f"""with {hashed_cte("select doc_id as tid, text from documents where lang <> 'de'", 'h', 384)}
    select doc_id as vec_key, sha256(text) as content_key, count(bucket) as used_buckets
    from documents left join h on tid = doc_id where lang <> 'de' group by doc_id, text"""
ORACLES["search_hnsw"] = ORACLES["knn_lsh"]
