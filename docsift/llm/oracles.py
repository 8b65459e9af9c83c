"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from docsift.llm import license_scan

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _license_scan() -> str:
    """Base places by comparing every start, containment by every block."""
    lists = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    templates = license_scan.default_templates()
    base = " UNION ALL ".join(
        f"SELECT rid, '{t.label}' AS label, unnest(list_filter(range(len(w)), lambda i: "
        f"w[i + 1:i + {len(t.words)}] = {lists(t.words)})) AS place FROM words"
        for t in templates if t.phrase
    )
    notices = " UNION ALL ".join(
        f"SELECT rid, '{t.label}' AS label, len(list_intersect(b, {lists(sorted(set(t.words)))}))::DOUBLE / {len(set(t.words))} AS share, "
        f"len(list_intersect(b, {lists(sorted(set(t.words)))})) >= {t.need} AS found FROM blocks"
        for t in templates if not t.phrase
    )
    return rf"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{license_scan.WORD}') AS w FROM documents
), blocks AS MATERIALIZED (
  SELECT rid, list_distinct(w[k * 64 + 1:k * 64 + 128]) AS b FROM (SELECT rid, w, unnest(range(greatest(1, (len(w) + 63) // 64))) AS k FROM words)
), base AS MATERIALIZED ({base}), notices AS MATERIALIZED (SELECT * FROM ({notices}) WHERE found),
base_of AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(label) AS ls FROM base GROUP BY rid
), notice_of AS (SELECT rid, list(label) AS ls, max(share) AS score FROM notices GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(b.ls, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(n.ls, [])))), ',') AS labels,
  CASE WHEN b.rid IS NOT NULL THEN 1.0 ELSE coalesce(n.score, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base_of b USING (rid) LEFT JOIN notice_of n USING (rid)
"""


EXACT_DEDUP = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY h) AS n
  FROM rows WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, n AS group_size, pos = 1 AS kept, h AS text_sha256 FROM ranked
"""

LINE_DEDUP = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts
), keyed AS (
  SELECT rid, doc_id, pos, line, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) >= 5
), marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

WARC = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS h FROM pages
), digits AS (
  SELECT page_id, size, h, list_reduce(list_transform(range(8),
    lambda i: to_base(('0x' || substr(h, 1 + 5 * i, 5))::BIGINT, 32, 4)), lambda a, b: a || b) AS d, min(page_id) OVER (PARTITION BY h, size) AS first
  FROM rows
)
SELECT page_id, size::BIGINT AS payload_bytes,
  translate(d, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digits
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    md5('mix-1' || ':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
), caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM per_source
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
), targets AS (
  SELECT source, source_size, least(w * max(level) OVER (), cap)::DOUBLE AS target FROM levels
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY lpad(length(bin(s.size))::VARCHAR, 2, '0') || left(bin(s.size), 4), s.key, s.size) AS rank,
    ('0x' || left(md5('mix-1/' || coalesce(s.source, '')), 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * least(floor(rank * rate + u) - floor((rank - 1) * rate + u), ceil(rate)))::BIGINT AS taken
FROM ranked
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), grams AS MATERIALIZED (
  SELECT rid, len(s) AS n, unnest(s) AS g FROM sets
), linked AS MATERIALIZED (
  SELECT a.rid AS x, b.rid AS y FROM grams a JOIN grams b ON a.g = b.g AND a.rid < b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), twoway AS MATERIALIZED (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(x, y) AS (
  SELECT rid, rid FROM sets UNION SELECT r.x, b.y FROM reach r JOIN twoway b ON r.y = b.x
)
SELECT any_value(a.doc_id) AS doc_id, any_value(len(a.s))::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM reach r JOIN sets a ON r.x = a.rid JOIN sets b ON r.y = b.rid GROUP BY r.x
"""

DIVERGENCE = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), terms AS MATERIALIZED (SELECT rid, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term
), of_lang AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
of_group AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
groups AS MATERIALIZED (
  SELECT d.lang, d.source, coalesce(g.n, 0) AS n, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN of_group g USING (lang, source) LEFT JOIN of_lang l USING (lang)
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, c.n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM (
    SELECT p.*, 1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
    FROM p JOIN kept k USING (lang, term) JOIN of_lang l USING (lang) WHERE p.n > 0
  ) WHERE p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS MATERIALIZED (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS phrase
    FROM words, (SELECT unnest([1, 2, 3]) AS k)
  ) GROUP BY lang, phrase
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
found AS MATERIALIZED (SELECT lang, phrase, f AS a FROM f WHERE len(phrase) > 1 AND f >= 10),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, unnest([phrase[1:2], phrase[2:3]]) AS phrase, a FROM found WHERE len(phrase) = 3
  ) GROUP BY lang, phrase
), stays AS (
  SELECT f.lang, f.phrase, f.a FROM found f LEFT JOIN inside i ON f.lang = i.lang AND f.phrase = i.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * f.a
), cuts AS (
  SELECT s.lang, s.phrase, s.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * s.a * s.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM stays) s
  JOIN f x ON x.lang = s.lang AND x.phrase = s.phrase[1:k] JOIN f y ON y.lang = s.lang AND y.phrase = s.phrase[k + 1:]
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pos FROM cuts
), ranked AS (
  SELECT *, array_to_string(phrase, ' ') AS words,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM lowest WHERE pos = 1
)
SELECT lang, rank, words AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op1_license_scan": _license_scan(), "op5_exact_dedup": EXACT_DEDUP, "op8_warc": WARC, "op7_line_dedup": LINE_DEDUP,
    "op10_mixing": MIXING, "op11_ngram_join": NGRAM_JOIN, "op12_divergence": DIVERGENCE, "op13_collocations": COLLOCATIONS,
}
