"""Type detection (P1, R1-R7) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..profiles import Profile, get_profile
from .text import col

# Our mapping (not taken from the source tool, which asks the operating system):
# media types that count as source code, routed like text/*.
SOURCE_CODE_TYPES = ("application/javascript", "application/x-sh", "application/x-python",
                     "application/x-ruby", "application/x-perl", "application/json",
                     "application/xml", "application/sql")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(path) -> Column:
    """Lower-cased URL scheme, '' for a plain path. A regex, not parse_url (which throws on spaces)."""
    return F.lower(F.regexp_extract(col(path), _SCHEME, 1))


def is_local(path, accepted: tuple[str, ...] = ()) -> Column:
    """A plain path or a file: URL (or one of an accepted scheme)."""
    return scheme(path).isin("", "file", *accepted)


def unescaped(c: Column) -> Column:
    """%-escapes decoded (UTF-8); a '+' is a '+'; a text with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def to_local_path(path) -> Column:
    """'file:///a/b', 'file://localhost/a/b', 'file:/a%20b' -> '/a/b', '/a/b', '/a b'; other paths unchanged."""
    p = col(path)
    return F.when(scheme(p) == "file", unescaped(F.regexp_replace(p, r"^[Ff][Ii][Ll][Ee]:(//[^/]*)?", ""))).otherwise(p)


def lookup_path(path, profile: Profile | str) -> Column:
    """Where an entry's file is looked up. The strict tool takes its arguments as plain paths,
    whatever they look like; the lenient library takes URLs, and refuses (null) those that
    are neither file: nor of an accepted scheme."""
    p = get_profile(profile)
    if not p.use_declared_type:
        return col(path)
    return F.when(is_local(path, p.accepted_schemes), to_local_path(path))


def url_path(path) -> Column:
    """Path component of a URL: no scheme, authority, ?query or #fragment
    (a plain path keeps those characters)."""
    p = col(path)
    no_q = F.regexp_replace(p, r"[?#].*$", "")
    return (F.when(scheme(p) != "", F.regexp_replace(no_q, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", ""))
            .otherwise(p))


def extension(path) -> Column:
    """Lower-cased extension of the last segment (trailing slashes ignored);
    null for none, '.hidden', '..', trailing dot."""
    last = F.regexp_replace(col(path), "/+$", "")
    return F.lower(F.nullif(F.regexp_extract(last, r"[^/]\.([^./]*)$", 1), F.lit("")))


def route_from_type(declared_type) -> Column:
    """Route by declared media type; null when the type does not decide."""
    t = F.lower(col(declared_type))
    return (F.when(t == "application/pdf", F.lit("pdf"))
            .when(t.startswith("image/"), F.lit("image"))
            .when(t.startswith("text/") | t.isin(*SOURCE_CODE_TYPES), F.lit("text")))


def route_from_extension(ext, profile: Profile | str) -> Column:
    """Pdf, then image, else text."""
    p = get_profile(profile)
    e = col(ext)
    return (F.when(e == "pdf", F.lit("pdf"))
            .when(e.isin(*p.image_extensions), F.lit("image"))
            .otherwise(F.lit("text")))


def route(path, profile: Profile | str, declared_type=None) -> Column:
    """R5 + R6: declared type first under lenient, extension otherwise."""
    p = get_profile(profile)
    by_ext = route_from_extension(extension(url_path(path) if p.use_declared_type else col(path)), p)
    if p.use_declared_type and declared_type is not None:
        return F.coalesce(route_from_type(declared_type), by_ext)
    return by_ext


def ocr_route(path, profile: Profile | str) -> Column:
    """The recognizer takes a .pdf as PDF pages and anything else as one image."""
    p = get_profile(profile)
    ext = extension(url_path(path) if p.use_declared_type else col(path))
    return F.when(ext == "pdf", F.lit("pdf")).otherwise(F.lit("image"))
