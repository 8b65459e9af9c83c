"""Chunking (F13) in DuckDB SQL, for the oracle of the chunk-based queries.

Set-based restatement of the rule (no per-character loop):

* levels 1..4 split segments on the first separator present in them
  (separator kept at the start of the following piece); pieces of length
  >= size become the segments of the next level with the later separators;
* shorter pieces form runs: maximal sequences inside one segment that no
  long piece interrupts;
* inside a run with piece boundaries B_0 < ... < B_m, the group starting at
  boundary s ends at e(s) = max{j : B_j - B_s <= size} (a RANGE window); the
  next group starts at the first boundary >= B_e - min(overlap, size - len_e)
  (a RANGE window with a per-row offset); a recursive CTE follows these
  pointers from s = 0, one step per chunk;
* each group is stripped; blank groups vanish; chunks are numbered by
  (start, end).

The engine computes spans with a different (sequential) algorithm; the two
agree on all fixture documents and on the hand-made edge strings.
"""

from __future__ import annotations

from docsift.config import CHUNK_OVERLAP, CHUNK_SIZE, PY_WHITESPACE_CLASS, SEPARATORS

WS = PY_WHITESPACE_CLASS


def _sep_sql(s: str) -> str:
    return " || ".join("chr(10)" if ch == "\n" else f"'{ch}'" for ch in s) if s else "''"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _level(n: int, size: int, seps) -> str:
    seg = "substring(d.text, s.sa + 1, s.sb - s.sa)"
    pick = " ".join(
        f"WHEN s.r <= {i} AND contains({seg}, {_sep_sql(sep)}) THEN {i}" for i, sep in enumerate(seps) if sep
    )
    last = len(seps) - 1
    sep_of = "CASE si " + " ".join(f"WHEN {i} THEN {_sep_sql(sep)}" for i, sep in enumerate(seps) if sep) + " END"
    sep_len = "CASE si " + " ".join(f"WHEN {i} THEN {len(sep)}" for i, sep in enumerate(seps) if sep) + " END"
    return f"""sel{n} AS (
  SELECT s.doc_id, s.sa, s.sb, {seg} AS seg, CASE {pick} ELSE {last} END AS si
  FROM segs{n} s JOIN cdocs d USING (doc_id)),
parts{n} AS (
  SELECT doc_id, sa, si, p.k AS k, CASE WHEN p.k = 1 THEN p.n ELSE p.n + {sep_len} END AS plen
  FROM (SELECT doc_id, sa, si, unnest(list_transform(string_split(seg, {sep_of}),
               lambda x, i: struct_pack(k := i, n := length(x)))) AS p
        FROM sel{n} WHERE si < {last})
  UNION ALL
  SELECT doc_id, sa, si, x + 1 AS k, 1 AS plen
  FROM (SELECT doc_id, sa, si, unnest(range(sb - sa)) AS x FROM sel{n} WHERE si = {last})),
pieces{n} AS (
  SELECT doc_id, sa, si, k, CAST(sa + sum(plen) OVER w - plen AS BIGINT) AS pa,
         CAST(sa + sum(plen) OVER w AS BIGINT) AS pb
  FROM parts{n}
  WINDOW w AS (PARTITION BY doc_id, sa ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
marked{n} AS (
  SELECT doc_id, sa, si, pa, pb, pb - pa >= {size} AS is_long,
         sum(CASE WHEN pb - pa >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sa ORDER BY k) AS run_no
  FROM pieces{n} WHERE pb > pa),
segs{n + 1} AS (SELECT doc_id, pa AS sa, pb AS sb, si + 1 AS r FROM marked{n} WHERE is_long)"""


def chunk_ctes(docs_sql: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, seps=SEPARATORS) -> str:
    """CTEs ending in ``sql_chunks(doc_id, chunk_no, start, chunk)``.
    ``docs_sql`` selects (doc_id, text). Use under ``WITH RECURSIVE``."""
    levels = len(seps)
    parts = [
        f"cdocs AS ({docs_sql})",
        "segs1 AS (SELECT doc_id, 0 AS sa, length(text) AS sb, 0 AS r FROM cdocs)",
    ]
    parts += [_level(n, size, seps) for n in range(1, levels + 1)]
    leaves = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS lvl, sa, run_no, pa, pb FROM marked{n} WHERE NOT is_long" for n in range(1, levels + 1)
    )
    parts.append(f"leaves AS ({leaves})")
    parts.append(
        """bnd AS (
  SELECT doc_id, lvl, sa, run_no, pa AS b,
         CAST(row_number() OVER (PARTITION BY doc_id, lvl, sa, run_no ORDER BY pa) - 1 AS BIGINT) AS j FROM leaves
  UNION ALL
  SELECT doc_id, lvl, sa, run_no, max(pb) AS b, CAST(count(*) AS BIGINT) AS j FROM leaves GROUP BY doc_id, lvl, sa, run_no)"""
    )
    parts.append(
        f"""ext AS (
  SELECT doc_id, lvl, sa, run_no, j, b,
         max(j) OVER (PARTITION BY doc_id, lvl, sa, run_no ORDER BY b
                      RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING) AS e,
         max(j) OVER (PARTITION BY doc_id, lvl, sa, run_no) AS m,
         min(j) OVER (PARTITION BY doc_id, lvl, sa, run_no ORDER BY b
                      RANGE BETWEEN least({overlap}, {size} - coalesce(nb - b, 0)) PRECEDING AND CURRENT ROW) AS t
  FROM (SELECT *, lead(b) OVER (PARTITION BY doc_id, lvl, sa, run_no ORDER BY b) AS nb FROM bnd))"""
    )
    parts.append(
        """nxt AS (
  SELECT x.doc_id, x.lvl, x.sa, x.run_no, x.j AS s, x.b AS gs, x.e, x.m, y.b AS ge, y.t AS nx
  FROM ext x JOIN ext y ON y.doc_id = x.doc_id AND y.lvl = x.lvl AND y.sa = x.sa AND y.run_no = x.run_no AND y.j = x.e)"""
    )
    parts.append(
        """chain(doc_id, lvl, sa, run_no, s) AS (
  SELECT DISTINCT doc_id, lvl, sa, run_no, 0 FROM leaves
  UNION ALL
  SELECT c.doc_id, c.lvl, c.sa, c.run_no, n.nx
  FROM chain c JOIN nxt n ON n.doc_id = c.doc_id AND n.lvl = c.lvl AND n.sa = c.sa AND n.run_no = c.run_no AND n.s = c.s
  WHERE n.e < n.m)"""
    )
    parts.append(
        f"""grp AS (
  SELECT n.doc_id, n.gs, n.ge, substring(d.text, n.gs + 1, n.ge - n.gs) AS seg
  FROM chain c JOIN nxt n ON n.doc_id = c.doc_id AND n.lvl = c.lvl AND n.sa = c.sa AND n.run_no = c.run_no AND n.s = c.s
  JOIN cdocs d ON d.doc_id = n.doc_id),
stripped AS (
  SELECT doc_id, gs + length(regexp_extract(seg, '^{WS}*', 0)) AS start, {_strip('seg')} AS chunk FROM grp),
sql_chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(chunk)) - 1 AS chunk_no,
         CAST(start AS BIGINT) AS start, chunk
  FROM stripped WHERE chunk <> '')"""
    )
    return ",\n".join(parts)
