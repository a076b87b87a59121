"""String helpers (P8, F3-F6, F8-F10). All JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..profiles import (NOTIFICATION_KEEP_CHARS, NOTIFICATION_MAX_CHARS,
                        WHITESPACE_CHARS)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """strip Unicode White_Space at both ends (Spark's one-arg trim only strips U+0020)."""
    return F.trim(col(c), F.lit(WHITESPACE_CHARS))


def utrim_start(c) -> Column:
    return F.ltrim(col(c), F.lit(WHITESPACE_CHARS))


def utrim_end(c) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE_CHARS))


def is_blank(c) -> Column:
    """True when nothing but Unicode White_Space remains; null stays null."""
    return utrim(c) == F.lit("")


def basename(path) -> Column:
    """last path component, ignoring trailing slashes."""
    return F.element_at(F.split(F.regexp_replace(col(path), "/+$", ""), "/"), -1)


def url_name(path) -> Column:
    """F2, F10 (lenient): the last component of a path; of a file: URL, with its %-escapes decoded."""
    name = basename(path)
    decoded = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.when(F.lower(F.substring(col(path), 1, 5)) == "file:", decoded).otherwise(name)


def megabytes(n) -> Column:
    """F3 as written: ``size / 1024 / 1024`` on integers."""
    return F.floor(F.floor(col(n).cast("bigint") / 1024) / 1024).cast("bigint")


def megapixels(w, h) -> Column:
    """``(w*h) / 1_000_000`` on integers."""
    return F.floor((col(w).cast("bigint") * col(h).cast("bigint")) / 1000000).cast("bigint")


def notification(message, graphemes: bool = False) -> Column:
    """longer than 100 characters -> first 97 and '...'. The desktop front end counts what a
    reader sees as one character (``graphemes``: extended grapheme clusters), the workflow code points."""
    m = col(message)
    if graphemes:
        # A cluster has one code point at least, so most messages are not matched at all.
        longer = (F.char_length(m) > NOTIFICATION_MAX_CHARS) & m.rlike(rf"^\X{{{NOTIFICATION_MAX_CHARS + 1}}}")
        return F.when(longer, F.concat(F.regexp_extract(m, rf"^\X{{{NOTIFICATION_KEEP_CHARS}}}", 0), F.lit("..."))).otherwise(m)
    return F.when(F.char_length(m) > NOTIFICATION_MAX_CHARS,
                  F.concat(F.substring(m, 1, NOTIFICATION_KEEP_CHARS), F.lit("..."))).otherwise(m)


def last_line_message(stderr) -> Column:
    """last line of the tool's stderr without a leading 'Error: '."""
    return F.regexp_replace(F.element_at(F.split(col(stderr), "\n"), -1), "^Error: ", "")


def page_no(page_idx) -> Column:
    """F8: page numbers shown to people are 1-based."""
    return (col(page_idx) + 1).cast("int")


def fmt(template: str, **parts) -> Column:
    """A message column from a fixed template: ``{name}`` is replaced by the
    column (or string) given for ``name``; everything else is literal text."""
    import re
    pieces = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        v = parts[m.group(1)]
        pieces.append(F.lit(v) if isinstance(v, str) else col(v).cast("string"))
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def sql_str(s: str) -> str:
    """A Spark SQL string literal for ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
