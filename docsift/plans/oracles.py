"""DuckDB SQL for every registered query that SQL can express.

The fixture derivations of ``fixtures`` are repeated here as CTEs; string
constants come from ``docsift.config`` so both sides share them. Newlines
are spliced with chr(10) because DuckDB literals do not interpret escapes.
"""

from __future__ import annotations

import string

from docsift.config import (
    ANSWER_TEMPLATE,
    APOLOGY,
    DEFAULT,
    NO_DOCUMENTS_MESSAGE,
    NO_INFO_MARKER,
    NO_RELEVANT_ANSWER,
    PY_LINEBREAK_CLASS,
    PROMPT_TEMPLATE,
    PY_WHITESPACE_CLASS,
    STATUS_PROCESSED,
    SUPPORTED_EXTENSIONS,
    TITLES_HEADER,
)
from docsift.functions.features import TOKEN_PATTERN
from docsift.functions.text import NON_WHITESPACE
from docsift.operators.answers import TITLE_LISTING
from docsift.plans.catalog import PADDED_K, RETRIEVE_K, SEARCH_K
from docsift.plans.fixtures import FIXTURE_KEYWORDS, LIST_REQUEST
from docsift.plans.oracle_chunks import chunk_ctes


def lit(s: str) -> str:
    """Python string -> DuckDB string expression."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")"


def fill(template: str, **exprs: str) -> str:
    """A ``str.format`` template as a DuckDB ``||`` concatenation."""
    parts = []
    for literal, name, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if name is not None:
            parts.append(exprs[name])
    return "(" + " || ".join(parts) + ")"


WS = PY_WHITESPACE_CLASS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def title(x: str) -> str:
    first = f"regexp_extract({x}, '^[^{PY_LINEBREAK_CLASS[1:-1]}]*', 0)"
    return f"CASE WHEN length({x}) > 0 THEN {strip(first)} END"


def ext(path: str) -> str:
    base = f"regexp_extract({path}, '[^/]*$', 0)"
    return f"lower(regexp_extract({base}, '^\\.*[^.].*(\\.[^.]*)$', 1))"


SUPPORTED = ", ".join(f"'{e}'" for e in SUPPORTED_EXTENSIONS)

CLEAN_FILES = """
files AS (
  SELECT 'kb/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.MD' END AS path,
         doc_id AS list_order, text
  FROM documents),"""

MIXED_FILES = f"""
files AS (
  SELECT 'kb/' || CAST(doc_id AS VARCHAR) ||
         CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.pdf' ELSE '.docx' END AS path,
         doc_id AS list_order,
         CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN {lit(' ' + chr(10) + ' ')} ELSE text END AS text
  FROM documents),"""

INGESTED = f"""
classified AS (
  SELECT path, list_order, text,
         CASE WHEN {ext('path')} NOT IN ({SUPPORTED}) THEN 'Unsupported file type'
              WHEN text IS NULL THEN 'no text'
              WHEN text = '' THEN 'empty text'
              WHEN NOT regexp_matches(text, '{NON_WHITESPACE}') THEN 'no chunks' END AS reason
  FROM files),
accepted AS (
  SELECT md5(text) AS id, {title('text')} AS title, path, list_order, text
  FROM classified WHERE reason IS NULL),
registry AS (
  SELECT id, arg_min(title, list_order) AS title, arg_min(path, list_order) AS file_path,
         '{STATUS_PROCESSED}' AS status
  FROM accepted GROUP BY id),
registry0 AS (
  SELECT id, arg_min(title, list_order) AS title, arg_min(path, list_order) AS file_path,
         '{STATUS_PROCESSED}' AS status
  FROM accepted WHERE list_order % 2 = 0 GROUP BY id),
deleted AS (SELECT md5(text) AS id FROM files WHERE list_order % 5 = 0),
vec AS (
  SELECT e.vec_id AS pos, md5(d.text) AS doc_id, e.embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 3),
qv AS (SELECT vec_id AS query_id, embedding FROM embeddings)"""


def with_(*ctes: str, recursive: bool = False, files: str = CLEAN_FILES) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([(files + INGESTED).strip(), *ctes])


def dist(a: str, b: str) -> str:
    sq = "(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: {sq}))"


def hits_cte(name: str, queries: str, index: str, k: int) -> str:
    return f"""{name} AS (
  SELECT q.query_id, v.pos, v.doc_id, {dist('q.embedding', 'v.embedding')} AS dist,
         row_number() OVER (PARTITION BY q.query_id ORDER BY {dist('q.embedding', 'v.embedding')}, v.pos) AS rank
  FROM {queries} q, {index} v
  QUALIFY rank <= {k})"""


def retrieved_cte(name: str, hits: str, registry: str) -> str:
    return f"""{name} AS (
  SELECT h.query_id, CAST(h.rank AS BIGINT) AS rank, r.id, r.title, r.file_path
  FROM (SELECT query_id, doc_id, min(rank) AS rank FROM {hits} WHERE doc_id IS NOT NULL GROUP BY 1, 2) h
  JOIN {registry} r ON r.id = h.doc_id)"""


QUESTIONS = f"""questions AS (
  SELECT CAST(conv_id * 100 + turn AS BIGINT) AS query_id, conv_id, turn,
         CASE WHEN conv_id % 10 = 0 AND turn <= 1 THEN {lit(LIST_REQUEST)} ELSE text END AS text
  FROM conversations WHERE role = 'user')"""

WIDTH = "(SELECT max(len(embedding)) FROM embeddings)"


def feature_ctes(p: str, source: str, keys: list[str], text: str, width: str) -> str:
    """Hashed, normalised sparse features, ending in ``{p}feat(keys, bucket, weight)``."""
    k = ", ".join(keys)
    return f"""{p}tok AS (
  SELECT {k}, unnest(regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')) AS tok FROM {source}),
{p}code AS (
  SELECT {k}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {width} AS bucket,
         CASE WHEN ('0x' || substr(md5(tok), 9, 1))::BIGINT % 2 = 1 THEN -1 ELSE 1 END AS sgn
  FROM {p}tok),
{p}cnt AS (SELECT {k}, bucket, sum(sgn) AS v FROM {p}code GROUP BY ALL HAVING sum(sgn) <> 0),
{p}feat AS (
  SELECT {k}, CAST(bucket AS BIGINT) AS bucket,
         CAST(CAST(CAST(v AS DOUBLE) / sqrt(CAST(sum(v * v) OVER (PARTITION BY {k}) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS weight
  FROM {p}cnt)"""


QFEAT = feature_ctes("q", "questions", ["query_id"], "text", WIDTH) + f""",
qdense AS (
  SELECT q.query_id, list(coalesce(f.weight, 0.0) ORDER BY r.b) AS embedding
  FROM questions q CROSS JOIN range({WIDTH}) r(b)
  LEFT JOIN qfeat f ON f.query_id = q.query_id AND f.bucket = r.b
  GROUP BY q.query_id)"""

PROMPTS = f"""{QUESTIONS},
{QFEAT},
{hits_cte('qhits', 'qdense', 'vec', RETRIEVE_K)},
{retrieved_cte('qret', 'qhits', 'registry')},
prompts AS (
  SELECT r.query_id, r.id AS doc_id, r.rank, r.file_path,
         {fill(PROMPT_TEMPLATE, content=f"substring(f.text, 1, {DEFAULT.prefix_chars})", query="q.text")} AS prompt
  FROM qret r JOIN questions q ON q.query_id = r.query_id
  LEFT JOIN files f ON f.path = r.file_path),
responses AS (
  SELECT p.query_id, p.doc_id,
         CASE WHEN p.query_id // 100 % 13 = 0 THEN NULL
              WHEN (p.query_id % 100 + 1 + p.rank) % 3 = 0 THEN a.text || {lit(' ' + NO_INFO_MARKER)}
              ELSE a.text END AS response
  FROM prompts p LEFT JOIN conversations a
    ON a.role = 'assistant' AND a.conv_id = p.query_id // 100 AND a.turn = p.query_id % 100 + 1),
kept AS (
  SELECT p.query_id, p.doc_id, p.rank, p.file_path, coalesce(r.response, {lit(APOLOGY)}) AS response
  FROM prompts p LEFT JOIN responses r ON r.query_id = p.query_id AND r.doc_id = p.doc_id
  WHERE NOT contains(coalesce(r.response, {lit(APOLOGY)}), {lit(NO_INFO_MARKER)}))"""

TITLE_HEADER = TITLES_HEADER.rstrip("\n")

ORACLES: dict[str, str] = {
    "retrieve_top3": with_(hits_cte("hits", "qv", "vec", RETRIEVE_K), retrieved_cte("ret", "hits", "registry"))
    + "\nSELECT * FROM ret",
    "knn_top5": with_(hits_cte("hits", "qv", "vec", SEARCH_K))
    + "\nSELECT query_id, CAST(rank AS BIGINT) AS rank, pos, doc_id, round(dist, 6) AS dist FROM hits",
    "knn_padded": with_(
        """cent AS (
  SELECT CAST(label AS BIGINT) AS pos, 'label-' || CAST(label AS VARCHAR) AS doc_id,
         list(m ORDER BY i) AS embedding
  FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m
        FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
        GROUP BY label, i)
  GROUP BY label)""",
        hits_cte("hits", "qv", "cent", PADDED_K),
    )
    + f"""
SELECT s.query_id, CAST(s.rank AS BIGINT) AS rank, coalesce(h.pos, -1) AS pos, h.doc_id, round(h.dist, 6) AS dist
FROM (SELECT vec_id AS query_id, unnest(range(1, {PADDED_K} + 1)) AS rank FROM embeddings) s
LEFT JOIN hits h ON h.query_id = s.query_id AND h.rank = s.rank""",
    "knn_with_deleted_docs": with_(
        "reg_left AS (SELECT * FROM registry WHERE id NOT IN (SELECT id FROM deleted WHERE id IS NOT NULL))",
        hits_cte("hits", "qv", "vec", RETRIEVE_K),
        retrieved_cte("ret", "hits", "reg_left"),
    )
    + "\nSELECT * FROM ret",
    "position_lookup": with_()
    + "\nSELECT e.vec_id * 2 AS pos, v.doc_id FROM embeddings e LEFT JOIN vec v ON v.pos = e.vec_id * 2",
    "last_position_per_doc": with_() + "\nSELECT doc_id, max(pos) AS last_pos FROM vec GROUP BY doc_id",
    "vector_counts": with_() + "\nSELECT doc_id, count(*) AS n_vectors FROM vec GROUP BY doc_id",
    "vector_total": with_() + "\nSELECT count(*) AS ntotal FROM vec",
    "append_positions": with_()
    + """
SELECT (SELECT max(pos) + 1 FROM vec) + row_number() OVER (ORDER BY doc_id, pos) - 1 AS pos, doc_id, pos AS src_pos
FROM vec""",
    "reingest_after_delete": with_()
    + """
SELECT (SELECT max(pos) + 1 FROM vec) + row_number() OVER (ORDER BY doc_id, pos) - 1 AS pos, doc_id, pos AS src_pos
FROM vec WHERE doc_id IN (SELECT id FROM deleted)""",
    "reject_bad_width": with_(
        f"""vw AS (
  SELECT pos, doc_id, CASE WHEN pos % 11 = 0 THEN embedding[1:len(embedding) - 1] ELSE embedding END AS embedding
  FROM vec)"""
    )
    + f"""
SELECT pos, doc_id FROM vw
WHERE doc_id IN (SELECT doc_id FROM vw GROUP BY doc_id HAVING bool_and(len(embedding) = {WIDTH}))""",
    "content_ids": "SELECT doc_id, md5(text) AS id FROM documents",
    "titles": f"SELECT doc_id, {title('text')} AS title FROM documents",
    "dedup_first_wins": "SELECT md5(text) AS id, min(doc_id) AS first_doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "incremental_ingest": with_(files=MIXED_FILES)
    + f"""
SELECT id, arg_min(title, list_order) AS title, arg_min(path, list_order) AS file_path, '{STATUS_PROCESSED}' AS status
FROM accepted WHERE id NOT IN (SELECT id FROM registry0) GROUP BY id""",
    "registry_list": with_() + "\nSELECT id, title, file_path FROM registry",
    "registry_titles": with_() + "\nSELECT title FROM registry",
    "registry_exists": with_()
    + "\nSELECT path, md5(text) AS id, md5(text) IN (SELECT id FROM registry0) AS processed FROM files",
    "registry_lookup": with_() + "\nSELECT id, title, file_path FROM registry WHERE id IN (SELECT doc_id FROM vec)",
    "registry_delete": with_() + "\nSELECT * FROM registry WHERE id NOT IN (SELECT id FROM deleted WHERE id IS NOT NULL)",
    "detect_format": with_(files=MIXED_FILES)
    + f"""
SELECT path, {ext('path')} AS ext,
       CASE WHEN {ext('path')} IN ({SUPPORTED}) THEN substring({ext('path')}, 2) END AS format
FROM files""",
    "quarantine": with_(files=MIXED_FILES) + "\nSELECT path, reason FROM classified WHERE reason IS NOT NULL",
    "html_text_runs": "SELECT page_id, array_to_string(regexp_extract_all(html, '>[^<]+<'), '') AS text FROM pages",
    "html_runs_title": f"""
SELECT page_id, md5(t) AS id, {title('t')} AS title
FROM (SELECT page_id, array_to_string(regexp_extract_all(html, '>[^<]+<'), '') AS t FROM pages)""",
    "page_concat": """
SELECT conv_id, md5(text) AS id, length(text) AS n_chars, text
FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)""",
    "read_by_path": with_(hits_cte("hits", "qv", "vec", RETRIEVE_K), retrieved_cte("ret", "hits", "registry"))
    + """
SELECT r.query_id, r.rank, r.file_path, length(f.text) AS n_chars, f.path IS NULL AS missing
FROM ret r LEFT JOIN files f ON f.path = r.file_path""",
    "folder_scan": f"""
WITH written AS (
  SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '.' WHEN doc_id % 17 = 0 THEN '_' ELSE '' END || CAST(doc_id AS VARCHAR)
      || CASE WHEN doc_id % 23 = 0 THEN '.docx' WHEN doc_id % 5 = 0 THEN '.md' ELSE '.txt' END AS name,
    CASE WHEN doc_id % 11 = 0 THEN ''
         ELSE replace(replace(CASE WHEN doc_id % 7 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END,
                              chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS text
  FROM documents
), judged AS (
  SELECT name, text, CASE WHEN doc_id % 23 = 0 THEN 'Unsupported file type'
    WHEN doc_id % 19 = 0 AND doc_id % 11 <> 0 THEN 'invalid UTF-8'
    WHEN doc_id % 5 = 0 THEN 'no Markdown renderer given' WHEN text = '' THEN 'empty text'
    WHEN NOT regexp_matches(text, '{NON_WHITESPACE}') THEN 'no chunks' END AS reason FROM written
)
SELECT name, CASE WHEN reason IS NULL THEN md5(text) END AS id, CASE WHEN reason IS NULL THEN length(text) END AS n_chars, reason
FROM judged""",
    "read_opened_files": with_(hits_cte("hits", "qv", "vec", RETRIEVE_K), retrieved_cte("ret", "hits", "registry"))
    + """
SELECT r.query_id, r.rank, f.list_order || '.txt' AS name,
       CASE WHEN f.list_order % 9 <> 0 THEN md5(f.text) END AS id,
       CASE WHEN f.list_order % 9 <> 0 THEN length(f.text) END AS n_chars, f.list_order % 9 = 0 AS missing
FROM ret r JOIN files f ON f.path = r.file_path""",
    "query_features": "WITH " + QUESTIONS + ",\n" + QFEAT + "\nSELECT query_id, bucket, weight FROM qfeat",
    "retrieve_questions": with_(
        QUESTIONS, QFEAT, hits_cte("qhits", "qdense", "vec", RETRIEVE_K), retrieved_cte("qret", "qhits", "registry")
    )
    + "\nSELECT * FROM qret",
    "prompts": with_(PROMPTS) + "\nSELECT query_id, doc_id, rank, prompt FROM prompts",
    "messages": with_(PROMPTS)
    + f"""
SELECT query_id, doc_id, CAST(0 AS BIGINT) AS msg_no, 'system' AS role, {lit(DEFAULT.system_prompt)} AS content FROM prompts
UNION ALL
SELECT query_id, doc_id, CAST(1 AS BIGINT) AS msg_no, 'user' AS role, prompt AS content FROM prompts""",
    "filter_answers": with_(PROMPTS) + "\nSELECT query_id, doc_id, rank, file_path, response FROM kept",
    "format_answers": with_(PROMPTS)
    + f"""
SELECT q.query_id, coalesce(a.answer, {lit(NO_RELEVANT_ANSWER)}) AS answer
FROM questions q LEFT JOIN (
  SELECT query_id,
         string_agg({fill(ANSWER_TEMPLATE, doc_id="doc_id", file_path="file_path", response="response")},
                    {lit(chr(10) + chr(10))} ORDER BY rank) AS answer
  FROM kept GROUP BY query_id) a ON a.query_id = q.query_id""",
    "route_queries": "WITH "
    + QUESTIONS
    + f"""
SELECT query_id,
       CASE WHEN {strip('lower(text)')} IN ({", ".join(lit(p) for p in DEFAULT.list_phrases)}) THEN 'list'
            WHEN {" OR ".join(f"contains({strip('lower(text)')}, {lit(k)})" for k in FIXTURE_KEYWORDS)} THEN 'retrieve'
            ELSE 'converse' END AS route
FROM questions""",
    "title_message": with_()
    + f"""
SELECT CAST(0 AS BIGINT) AS line_no,
       CASE WHEN (SELECT count(*) FROM registry) > 0 THEN {lit(TITLE_HEADER)} ELSE {lit(NO_DOCUMENTS_MESSAGE)} END AS line
UNION ALL
SELECT row_number() OVER (ORDER BY file_path, id) AS line_no, title AS line FROM registry""",
    "ingest_end_to_end": with_() + "\nSELECT * FROM registry",
}
# streams end in the same tables as their batch counterparts
ORACLES["stream_ingest"] = ORACLES["ingest_end_to_end"]
ORACLES["model_features"] = ORACLES["query_features"]
ORACLES["late_answers"] = ORACLES["format_answers"]
ORACLES["stream_routing"] = ORACLES["route_queries"]

# chunk-based queries: the chunking rule restated set-wise in SQL (oracle_chunks)
CHUNKS = chunk_ctes("SELECT id AS doc_id, any_value(text) AS text FROM accepted GROUP BY id")
ORACLES["chunks"] = (
    with_(CHUNKS, recursive=True)
    + "\nSELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, start, chunk FROM sql_chunks"
)
ORACLES["page_chunks"] = (
    "WITH RECURSIVE "
    + chunk_ctes(
        "SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
    )
    + "\nSELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, start, chunk FROM sql_chunks"
)
ORACLES["chunk_counts"] = (
    with_(CHUNKS, recursive=True) + "\nSELECT doc_id, count(*) AS n_chunks FROM sql_chunks GROUP BY doc_id"
)
ORACLES["chunk_features"] = (
    with_(CHUNKS, feature_ctes("c", "sql_chunks", ["doc_id", "chunk_no"], "chunk", str(DEFAULT.dim)), recursive=True)
    + "\nSELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, bucket, weight FROM cfeat"
)
ORACLES["ingest_positions"] = (
    with_(
        CHUNKS,
        "cnt AS (\n  SELECT c.doc_id, o.list_order, count(*) AS n\n"
        "  FROM sql_chunks c JOIN (SELECT id, min(list_order) AS list_order FROM accepted GROUP BY id) o"
        " ON o.id = c.doc_id\n  GROUP BY c.doc_id, o.list_order)",
        recursive=True,
    )
    + "\nSELECT doc_id,\n"
    "       CAST(coalesce(sum(n) OVER (ORDER BY list_order, doc_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_pos,\n"
    "       n AS n_vectors\nFROM cnt"
)

# the store: even files, two deletes, all files, (vectors) ; clear, odd files
STORE = (
    "cnt AS (SELECT doc_id AS id, count(*) AS n FROM sql_chunks GROUP BY doc_id),\n"
    "evens AS (SELECT id, min(list_order) AS ord FROM accepted WHERE list_order % 2 = 0 GROUP BY id),\n"
    "odds AS (SELECT id, min(list_order) AS ord FROM accepted WHERE list_order % 2 = 1 GROUP BY id),\n"
    "alls AS (SELECT id, min(list_order) AS ord FROM accepted GROUP BY id),\n"
    "gone AS (SELECT DISTINCT md5(text) AS id FROM files\n"
    "  WHERE text IS NOT NULL AND (list_order % 5 = 0 OR list_order % 7 = 0)),\n"
    "second AS (SELECT * FROM alls\n"
    "  WHERE id NOT IN (SELECT id FROM evens WHERE id NOT IN (SELECT id FROM gone))),\n"
    "loads AS (SELECT 1 AS load, id, ord FROM evens UNION ALL SELECT 2, id, ord FROM second)"
)
ORACLES["store_lifecycle"] = (
    with_(CHUNKS, STORE, recursive=True)
    + """
SELECT 'after deletes' AS step, f.path AS file_path, e.id, c.n AS n_vectors
FROM evens e JOIN cnt c ON c.id = e.id JOIN files f ON f.list_order = e.ord
WHERE e.id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'after second load', f.path, r.id, CAST(r.k * c.n AS BIGINT)
FROM (SELECT l.id, arg_max(ord, load) AS ord, count(*) AS k FROM loads l GROUP BY l.id) r
JOIN cnt c ON c.id = r.id JOIN files f ON f.list_order = r.ord
UNION ALL
SELECT 'after clear', NULL, NULL, CAST(0 AS BIGINT)
UNION ALL
SELECT 'after third load', f.path, o.id, c.n
FROM odds o JOIN cnt c ON c.id = o.id JOIN files f ON f.list_order = o.ord"""
)
PLACED = """placed AS (
  SELECT s.doc_id, s.chunk_no, row_number() OVER (ORDER BY l.load, l.ord, l.id, s.chunk_no) - 1 AS pos
  FROM loads l JOIN sql_chunks s ON s.doc_id = l.id)"""
ORACLES["stored_positions"] = (
    with_(CHUNKS, STORE, PLACED, recursive=True)
    + """
SELECT t.step, e.vec_id * 7 AS pos, p.doc_id
FROM embeddings e CROSS JOIN (VALUES ('operations'), ('merged')) t(step) LEFT JOIN placed p ON p.pos = e.vec_id * 7"""
)
ORACLES["store_vectors"] = (
    with_(
        CHUNKS,
        feature_ctes("c", "sql_chunks", ["doc_id", "chunk_no"], "chunk", str(DEFAULT.dim)),
        STORE,
        PLACED,
        recursive=True,
    )
    + """
SELECT p.pos, p.doc_id, f.bucket, f.weight
FROM placed p JOIN cfeat f ON f.doc_id = p.doc_id AND f.chunk_no = p.chunk_no"""
)
ORACLES["registry_clear"] = (
    with_(CHUNKS, recursive=True)
    + """
SELECT 'before' AS step, 'registry' AS tbl, count(DISTINCT id) AS n_rows FROM accepted
UNION ALL SELECT 'before', 'vectors', count(*) FROM sql_chunks
UNION ALL SELECT 'after', 'registry', CAST(0 AS BIGINT)
UNION ALL SELECT 'after', 'vectors', CAST(0 AS BIGINT)"""
)

ROUTES = f"""routes AS (
  SELECT query_id,
         CASE WHEN {strip('lower(text)')} IN ({", ".join(lit(p) for p in DEFAULT.list_phrases)}) THEN 'list'
              WHEN {" OR ".join(f"contains({strip('lower(text)')}, {lit(k)})" for k in FIXTURE_KEYWORDS)} THEN 'retrieve'
              ELSE 'converse' END AS route
  FROM questions)"""

ORACLES["answer_queries"] = with_(
    PROMPTS,
    ROUTES,
    f"""formatted AS (
  SELECT query_id,
         string_agg({fill(ANSWER_TEMPLATE, doc_id="doc_id", file_path="file_path", response="response")},
                    {lit(chr(10) + chr(10))} ORDER BY rank) AS answer
  FROM kept GROUP BY query_id)""",
    """conv AS (
  SELECT conv_id * 100 + turn - 1 AS query_id, CASE WHEN conv_id % 13 = 0 THEN NULL ELSE text END AS response
  FROM conversations WHERE role = 'assistant')""",
) + f"""
SELECT r.query_id, r.route,
       CASE r.route WHEN 'retrieve' THEN coalesce(f.answer, {lit(NO_RELEVANT_ANSWER)})
                    WHEN 'converse' THEN coalesce(c.response, {lit(APOLOGY)}) END AS answer,
       CASE r.route WHEN 'list' THEN '{TITLE_LISTING}' END AS listing
FROM routes r LEFT JOIN formatted f ON f.query_id = r.query_id LEFT JOIN conv c ON c.query_id = r.query_id"""
ORACLES["stream_answers"] = ORACLES["answer_queries"]
ORACLES["stream_retrieved"] = with_(
    QUESTIONS, ROUTES, QFEAT, hits_cte("qhits", "qdense", "vec", RETRIEVE_K), retrieved_cte("qret", "qhits", "registry")
) + "\nSELECT * FROM qret WHERE query_id IN (SELECT query_id FROM routes WHERE route = 'retrieve')"
