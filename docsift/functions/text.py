"""Scalar text functions as native Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.config import PY_LINEBREAK_CLASS, PY_WHITESPACE_CLASS, SUPPORTED_EXTENSIONS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_id(text) -> Column:
    """lowercase hex MD5 of the UTF-8 text."""
    return F.md5(_col(text))


# Python's str.isspace() set, spelled out for the native multi-character trim
PY_WHITESPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def py_strip(s) -> Column:
    """Python ``str.strip()`` (its whitespace set, not just U+0020), as
    the native trim over that set."""
    return F.trim(_col(s), F.lit(PY_WHITESPACE_CHARS))


def first_line(text) -> Column:
    """First line as ``str.splitlines()[0]`` would give it ('' if the text
    starts with a break). Empty text has no first line: NULL.

    The line is a prefix of the first LF-delimited segment, which the native
    ``substring_index`` finds without decoding the whole text; the regex for
    the other break characters then runs on that segment only."""
    t = _col(text)
    segment = F.substring_index(t, "\n", 1)
    line = F.regexp_extract(segment, f"^[^{PY_LINEBREAK_CLASS[1:-1]}]*", 0)
    return F.when(t != "", line)


def title(text) -> Column:
    """first line, stripped. NULL for empty text (which has no first line)."""
    return py_strip(first_line(text))


NON_WHITESPACE = "[^" + PY_WHITESPACE_CLASS[1:-1] + "]"


def is_blank(text) -> Column:
    """True when the text holds only Python whitespace (zero chunks).
    Native trim over that character set, from the left only: that stops at the
    first other character, a trim from the right maps the whole text first."""
    return F.ltrim(_col(text), F.lit(PY_WHITESPACE_CHARS)) == ""


def fold_newlines(text) -> Column:
    """S3: universal-newline read folds CRLF and CR to LF."""
    return F.regexp_replace(_col(text), "\r\n?", "\n")


def file_extension(path) -> Column:
    """``os.path.splitext(path)[1].lower()`` on a '/'-separated path."""
    base = F.regexp_extract(_col(path), "[^/]*$", 0)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1))


def detect_format(path, supported=SUPPORTED_EXTENSIONS) -> Column:
    """S2: 'pdf' / 'txt' / 'md' for supported extensions, else NULL."""
    ext = file_extension(path)
    return F.when(ext.isin(*supported), F.substring(ext, 2, 100))


def html_text_runs(html, keep_brackets: bool = True) -> Column:
    """Every non-overlapping ``>[^<]+<`` run, joined with no separator.
    With ``keep_brackets`` (the reproduced behaviour) the brackets stay."""
    h = _col(html)
    if keep_brackets:
        return F.array_join(F.regexp_extract_all(h, F.lit(">[^<]+<"), F.lit(0)), "")
    return F.array_join(F.regexp_extract_all(h, F.lit(">([^<]+)<"), F.lit(1)), "")


def prefix(text, n: int) -> Column:
    """first n characters (code points)."""
    return F.substring(_col(text), 1, n)


def contains_any(text, needles) -> Column:
    """any needle occurs as a substring (case-sensitive)."""
    t = _col(text)
    cond = F.lit(False)
    for n in needles:
        cond = cond | t.contains(n)
    return cond


def normalize_query(text) -> Column:
    """``text.lower().strip()``."""
    return py_strip(F.lower(_col(text)))


def fill(template: str, **fields) -> Column:
    """A ``str.format`` template as a native ``concat`` of its literal parts
    and the given columns (fixed templates live in ``docsift.config``)."""
    parts = []
    for literal, name, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(_col(fields[name]))
    return F.concat(*parts)
