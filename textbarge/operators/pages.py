"""Page assembly (G1-G17, A6, A7, M1, P10, P11, P13-P16), set-based.

The source tools walk pages with an accumulator. Every accumulator test
reduces to "is there an earlier page with text?", i.e. ``page_idx > f`` with
``f`` the first such page. Light rows (path, page, bytes, tests) give a document's
statistics, ``f`` among them, and the pages whose text is wanted; pages expected but
missing are found on keys. A document may hold any share of all pages, so its text
comes as segments (operators/concat.py): rows ``path, seg, text`` with ``seg`` from 0
and the document's other columns repeated; joined in ``seg`` order they are its text.
Page texts move by (path, page) and by (path, seg), never by their path alone; a
document up to ``Profile.segment_bytes`` is one row.

Inputs
  facts: ``path, open_error, locked, page_count`` (+ ``width_px, height_px`` for images)
  pages: ``path, page_idx, embedded, lines, error, elapsed_ms, width_pt, height_pt``,
         one row per page; a repeated page row adds its text once more (rows of one
         page are in the order of their text) and never hides a missing page
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import lenient_error, make_error, null_error, strict_error
from ..functions.raster import raster_px, too_many_pixels
from ..functions.route import ocr_route
from ..functions.text import fmt, is_blank, page_no, utrim, utrim_end, utrim_start
from ..profiles import Profile, get_profile
from ..session import spool
from .concat import put_together, segment_plan

# Texts of the PDF / image extraction steps.
STRICT_NO_EXTRACTABLE_TEXT = "PDF contains no extractable text"
STRICT_OCR_UNAVAILABLE = "OCR is only supported on macOS"
# The helper's and the tool's names are the caller's.
STRICT_HELPER_MISSING = "OCR helper '{helper}' not found. Install it alongside {tool}."
STRICT_IMAGE_BLANK = "Image contains no recognizable text"
STRICT_PDF_BLANK = "Error: No text recognized in PDF (all pages were blank or unreadable)"
STRICT_PAGES_HAD_ERRORS = "Error: {k} of {n} pages had errors"
STRICT_OPEN_FAILED = "Error: Could not open PDF: {path}\nThe file may be corrupted or inaccessible."
STRICT_LOCKED = "Error: PDF is password-protected"
STRICT_NO_PAGES = "Error: PDF has no pages"
STRICT_WARN_ACCESS = "Warning: Could not access page {n}"
STRICT_WARN_RENDER = "Warning: Could not render page {n}"
STRICT_WARN_OCR = "Warning: OCR failed on page {n}: {error}"
STRICT_IMAGE_LOAD = "Error: Could not load image: {path}"
STRICT_IMAGE_CONVERT = "Error: Could not convert image to CGImage"
STRICT_IMAGE_OCR = "Error: OCR failed: {error}"
STRICT_OCR_FAILED = "OCR failed: {stderr}"
STRICT_OCR_EMPTY = "PDF contains no recognizable text (OCR found nothing)"
STRICT_PAGE_EXTRACT = "Failed to extract page {n}: {error}"
LENIENT_OPEN_FAILED = "Could not open PDF"
LENIENT_LOCKED = "PDF is password-protected"
LENIENT_NO_PAGES = "PDF has no pages"
LENIENT_PDF_BLANK = "No text recognized in PDF"
LENIENT_IMAGE_BLANK = "No text recognized in image"
LENIENT_IMAGE_LOAD = "Could not load image"
LENIENT_IMAGE_CONVERT = "Could not convert image"
LENIENT_FAILED_PAGES = "\n\n[Warning: Failed to process pages: {pages}]"
LENIENT_TRUNCATED = "\n\n[Warning: PDF truncated. Processed {cap} of {n} pages]"


def _s(c) -> Column:
    return c.cast("string")


# --------------------------------------------------------------------------- G1
def expand_pages(facts: DataFrame, cap: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per expected page ``0 .. min(n, cap)-1``; nothing for n <= 0.

    A document's page numbers are one array (4 bytes each) before ``explode``
    streams them out; the following join spreads them by page.
    """
    n = F.col("page_count").cast("int")
    m = F.least(n, F.lit(cap)) if cap is not None else n
    return (facts.where(m > 0)
            .select("path", *keep, F.explode(F.sequence(F.lit(0), m - 1)).alias("page_idx")))


def attach_pages(expanded: DataFrame, pages: DataFrame) -> DataFrame:
    """LEFT JOIN extractor results so a page without a result stays visible."""
    return (expanded.join(pages.withColumn("_has", F.lit(True)), ["path", "page_idx"], "left")
            .withColumn("has_result", F.coalesce(F.col("_has"), F.lit(False))).drop("_has"))


def page_range(facts: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per document with pages: ``path, page_count, _m`` (``_m`` = pages to read)."""
    n = F.col("page_count").cast("int")
    m = F.least(n, F.lit(cap)) if cap is not None else n
    return facts.select("path", "page_count", m.alias("_m")).where(F.col("_m") > 0)


def present_pages(rng: DataFrame, pages: DataFrame, cols: list[str]) -> DataFrame:
    """Page results inside their document's page range. Joined on ``path`` against
    one row per document, so page text moves at most once (and not at all when
    the document table is small enough for Spark to broadcast)."""
    return (pages.select(*cols).join(rng.select("path", "_m"), "path")
            .where((F.col("page_idx") >= 0) & (F.col("page_idx") < F.col("_m"))).drop("_m"))


def _seen() -> Column:
    """The distinct page numbers of a document's results, in order (an aggregate)."""
    return F.array_sort(F.collect_set("page_idx"))


def _absent(seen: Column) -> Column:
    """Page numbers below ``_m`` without a result."""
    none = F.array().cast("array<int>")
    have = F.coalesce(seen, none)
    return F.when(F.size(have) < F.col("_m"), F.array_except(F.sequence(F.lit(0), F.col("_m") - 1), have)).otherwise(none)


# ----------------------------------------------------------------------- G16/G17
def top_candidates(candidates) -> Column:
    """First candidate of each text block; blocks without one are dropped."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    return F.filter(F.transform(c, lambda b: F.try_element_at(b, F.lit(1))), lambda x: x.isNotNull())


def page_status(profile: Profile | str) -> Column:
    """G15, G17, P11, M1: 'ok', 'access', 'render', 'timeout' or 'recognize'."""
    p = get_profile(profile)
    s = F.when(~F.col("has_result"), F.lit("access"))
    if p.max_image_pixels is not None:
        s = s.when(too_many_pixels(raster_px(F.col("width_pt")), raster_px(F.col("height_pt")),
                                   p.max_image_pixels), F.lit("render"))
    if p.ocr_timeout_ms is not None:
        s = s.when(F.col("elapsed_ms") > F.lit(p.ocr_timeout_ms), F.lit("timeout"))
    return s.when(F.col("error").isNotNull(), F.lit("recognize")).otherwise(F.lit("ok"))


def strict_warning(status="status", page_idx="page_idx", error="error") -> Column:
    n = page_no(F.col(page_idx))
    st = F.col(status)
    return (F.when(st == "access", fmt(STRICT_WARN_ACCESS, n=n))
            .when(st == "render", fmt(STRICT_WARN_RENDER, n=n))
            .when(st.isin("recognize", "timeout"),
                  fmt(STRICT_WARN_OCR, n=n, error=F.coalesce(F.col(error), F.lit("timed out")))))


# ------------------------------------------------------------------- PDF checks
def pdf_gate(facts: DataFrame, profile: Profile | str, stage: str = "embedded") -> DataFrame:
    """Adds ``pdf_error`` (STRUCT or NULL) for documents that cannot be paged.

    stage 'embedded' is the first pass (library open / locked / no pages);
    stage 'ocr' is the strict OCR helper, whose failures read 'OCR failed: Error: ...'.
    """
    p = get_profile(profile)
    path = F.col("path")
    if p.name == "lenient":
        e = (F.when(F.col("open_error").isNotNull(), lenient_error("extractionFailed", path, F.lit(LENIENT_OPEN_FAILED)))
             .when(F.col("locked"), lenient_error("extractionFailed", path, F.lit(LENIENT_LOCKED)))
             .when(F.col("page_count") <= 0, lenient_error("extractionFailed", path, F.lit(LENIENT_NO_PAGES)))
             .otherwise(null_error()))
    elif stage == "embedded":
        e = F.when(F.col("open_error").isNotNull(),
                   strict_error("ExtractionError", path, F.col("open_error"))).otherwise(null_error())
    else:
        ocr = lambda m: strict_error("ExtractionError", path, fmt(STRICT_OCR_FAILED, stderr=m))
        e = (F.when(F.col("open_error").isNotNull(), ocr(fmt(STRICT_OPEN_FAILED, path=path)))
             .when(F.col("locked"), ocr(F.lit(STRICT_LOCKED)))
             .when(F.col("page_count") <= 0, ocr(F.lit(STRICT_NO_PAGES)))
             .otherwise(null_error()))
    return facts.withColumn("pdf_error", e)


# ------------------------------------------------------------------ G2-G4 (embedded)
def _piece(p: Profile) -> Column:
    """What a page adds: strict takes a page without text as empty, lenient skips it."""
    text = F.coalesce(F.col("embedded"), F.lit("")) if p.name == "strict" else F.col("embedded")
    return F.when(F.col("error").isNull(), text)


def _embedded(facts: DataFrame, pages: DataFrame, p: Profile, stored: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``facts`` behind the PDF gate; its pages as light rows; per document with a page range
    ``path, failure, prose, f`` (``f``: the first page with text)."""
    gated = pdf_gate(facts, p, "embedded")
    rng = page_range(gated.where(F.col("pdf_error").isNull()))
    piece = _piece(p)
    light = present_pages(rng, pages.select("path", "page_idx", "error", F.octet_length(piece).cast("bigint").alias("n_bytes"), (~is_blank(piece)).alias("prose")),
                          ["path", "page_idx", "error", "n_bytes", "prose"])
    if stored:
        light = spool(light, "page_sizes")
    aggs = [F.max("prose").alias("prose"), F.min(F.when(F.col("n_bytes") > 0, F.col("page_idx"))).alias("f")]
    if p.name == "strict":
        aggs += [F.min(F.when(F.col("error").isNotNull(), F.struct("page_idx", "error"))).alias("bad"), _seen().alias("seen")]
    # Every document with a page range, also those without any page row.
    st = rng.select("path", "_m").join(light.groupBy("path").agg(*aggs), "path", "left")
    failure = F.lit(None).cast("struct<page_idx:int,error:string>")
    if p.name == "strict":
        gap = F.array_min(_absent(F.col("seen")))
        missing = F.when(gap.isNotNull(), F.struct(gap.alias("page_idx"), F.lit("page missing").alias("error")))
        failure = F.least(F.col("bad"), missing)
    return gated, light, st.select("path", failure.alias("failure"), F.coalesce("prose", F.lit(False)).alias("prose"), "f")


def _heads(st: DataFrame, slots: DataFrame) -> DataFrame:
    """The documents' columns for each of their segments, and for segment 0 of those without any."""
    return st.join(slots, "path", "left").withColumn("seg", F.coalesce("seg", F.lit(0).cast("bigint")))


def assemble_embedded(facts: DataFrame, pages: DataFrame, profile: Profile | str) -> DataFrame:
    """Embedded-text pass. Returns ``path, seg, text, error, blank``.

    G2: '\n' goes before a page only when something non-empty came before, so
    the text is the pages from the first non-empty one on, joined with '\n'.
    G3 (strict): the first failing page (a missing page included) fails the
    document; its error comes from keys and short texts only.
    G4 (lenient): a page without text, failed or missing, is skipped.
    ``blank`` marks documents whose text is blank after trimming (G5 decides).
    """
    p = get_profile(profile)
    gated, light, st = _embedded(facts, pages, p, stored=True)
    st = spool(st, "documents")
    begun = st.where(F.col("failure").isNull() & F.col("f").isNotNull()).select("path", "f")
    wanted = light.where(F.col("n_bytes").isNotNull()).join(begun, "path").where(
        (F.col("page_idx") > F.col("f")) | ((F.col("page_idx") == F.col("f")) & (F.col("n_bytes") > 0)))
    numbers, slots = segment_plan(wanted.select("path", "page_idx", "n_bytes"), ["path"], "page_idx", p.segment_bytes)
    numbers = numbers.join(begun, "path").select("path", "page_idx", "seg", (F.col("page_idx") == F.col("f")).alias("opening"))
    body = pages.select("path", "page_idx", _piece(p).alias("piece")).join(numbers, ["path", "page_idx"])
    # An empty row of the first page with text is before it.
    body = body.select("path", "page_idx", "seg", F.when(~(F.col("opening") & (F.col("piece") == "")), F.col("piece")).alias("_t"), F.lit(True).alias("_lead"))
    texts = put_together(body, ["path"], "page_idx", "\n")
    bad = F.col("failure")
    err = F.when(bad.isNotNull(), strict_error("ExtractionError", "path", fmt(
        STRICT_PAGE_EXTRACT, n=page_no(bad.getField("page_idx")), error=bad.getField("error")))).otherwise(null_error())
    built = _heads(st, slots).join(texts, ["path", "seg"], "left").select(
        "path", "seg", F.when(bad.isNull(), F.coalesce("text", F.lit(""))).alias("text"), err.alias("error"),
        (bad.isNull() & ~F.col("prose")).alias("blank"))
    # Documents without a page range: failing the PDF gate, or with no pages.
    others = gated.where(F.col("pdf_error").isNotNull() | (F.coalesce(F.col("page_count"), F.lit(0)) <= 0)).select(
        "path", F.lit(0).cast("bigint").alias("seg"), F.when(F.col("pdf_error").isNull(), F.lit("")).alias("text"), F.col("pdf_error").alias("error"),
        F.col("pdf_error").isNull().alias("blank"))
    return built.unionByName(others)


def blank_documents(facts: DataFrame, pages: DataFrame, profile: Profile | str) -> DataFrame:
    """``path`` of the documents whose embedded text is blank and without error (G5), from
    page-level tests alone: a text is blank exactly when all its pieces are."""
    gated, _, st = _embedded(facts, pages, get_profile(profile), stored=False)
    none = gated.where(F.col("pdf_error").isNull() & (F.coalesce(F.col("page_count"), F.lit(0)) <= 0)).select("path")
    return st.where(F.col("failure").isNull() & ~F.col("prose")).select("path").unionByName(none)


# ----------------------------------------------------------------- G6-G13 (OCR)
def _sep_lines(profile: Profile, page_idx: Column) -> Column:
    pre, post = profile.page_separator.split("{n}")
    return F.array(F.lit(""), F.concat(F.lit(pre), _s(page_no(page_idx)), F.lit(post)), F.lit(""))


def classify_pages(facts: DataFrame, pages: DataFrame, profile: Profile | str) -> DataFrame:
    """G1 + G17: expected pages (capped under lenient) with their status."""
    p = get_profile(profile)
    expected = expand_pages(facts, p.page_cap)
    cols = ["path", "page_idx", "lines", "error", "elapsed_ms", "width_pt", "height_pt"]
    return attach_pages(expected, pages.select(*cols)).withColumn("status", page_status(p))


def assemble_ocr(facts: DataFrame, pages: DataFrame, profile: Profile | str) -> DataFrame:
    """OCR pass over PDF pages. Returns ``path, seg, text, error, n_pages, n_failed, failed_list``.

    G6/G7: before page i (i > 0) the lines '', separator(i+1), '' are added when
    an earlier successful page produced a line, i.e. ``i > f`` with ``f`` the
    first successful page with lines; blank later pages still get one.
    G8: strict prints every line followed by '\n'; lenient joins with '\n' and trims.
    G9 (strict): any failed page fails the document. G10/G12 (lenient): warnings.
    G13: blank result is an error (strict only when no page failed). A page behind
    ``f`` is never blank, for its separator is not; so light rows tell whether a
    document is, and in which segments the trimmed text starts and ends.

    A document's failures are listed in its error or warning, one value; pages without a
    result follow from the page numbers it has.
    """
    p = get_profile(profile)
    gated = pdf_gate(facts, p, "ocr")
    rng = page_range(gated.where(F.col("pdf_error").isNull()), p.page_cap)
    lines = F.coalesce(F.col("lines"), F.array().cast("array<string>"))
    joined = F.array_join(lines, "\n")
    tests = ["error", "elapsed_ms", "width_pt", "height_pt"]
    light = present_pages(rng, pages.select("path", "page_idx", *tests, F.size(lines).alias("n_lines"), F.octet_length(joined).cast("bigint").alias("n_bytes"),
                                            (~is_blank(joined)).alias("prose")), ["path", "page_idx", *tests, "n_lines", "n_bytes", "prose"])
    light = light.withColumn("has_result", F.lit(True)).withColumn("status", page_status(p))
    # A failure as it is listed: a warning line (strict) or the page number (lenient).
    listed = strict_warning() if p.name == "strict" else _s(page_no(F.col("page_idx")))
    ok = F.col("status") == "ok"
    light = spool(light.select("path", "page_idx", ok.alias("ok"), F.when(~ok, listed).alias("listed"), "n_lines", "n_bytes", "prose"), "page_sizes")
    own = light.groupBy("path").agg(
        F.collect_list(F.when(~F.col("ok"), F.struct("page_idx", "listed"))).alias("bad"), _seen().alias("seen"),
        F.min(F.when(F.col("ok") & (F.col("n_lines") > 0), F.col("page_idx"))).alias("f"))

    def listed_absent(i: Column) -> Column:
        line = fmt(STRICT_WARN_ACCESS, n=page_no(i)) if p.name == "strict" else _s(page_no(i))
        return F.struct(i.alias("page_idx"), line.alias("listed"))

    none = F.array().cast("array<struct<page_idx:int,listed:string>>")
    failed = F.array_sort(F.concat(F.coalesce(F.col("bad"), none), F.transform(_absent(F.col("seen")), listed_absent)))
    st = (rng.join(own, "path", "left").withColumn("failed", failed).withColumn("n_failed", F.size("failed").cast("bigint"))
          .withColumn("failed_list", F.when(F.col("n_failed") > 0, F.array_join(
              F.col("failed.listed"), "\n" if p.name == "strict" else ", "))))
    st = spool(st.select("path", "page_count", "_m", "n_failed", "failed_list", "f"), "documents")
    n_failed, path = F.col("n_failed"), F.col("path")
    begun = st.where(F.col("f").isNotNull() & ((n_failed == 0) if p.name == "strict" else F.lit(True))).select("path", "f")
    wanted = light.where("ok").join(begun, "path").where(
        (F.col("page_idx") > F.col("f")) | ((F.col("page_idx") == F.col("f")) & (F.col("n_lines") > 0)))
    # Whether a page's text is not blank: behind f its separator is not.
    solid = wanted.groupBy("path", "page_idx").agg(F.max((F.col("page_idx") > F.col("f")) | F.col("prose")).alias("solid"), F.first("f").alias("f"))
    numbers, slots = segment_plan(wanted.select("path", "page_idx", "n_bytes"), ["path"], "page_idx", p.segment_bytes)
    numbers = numbers.join(solid, ["path", "page_idx"])
    bounds = numbers.groupBy("path").agg(F.min(F.when(F.col("solid"), F.col("seg"))).alias("start"), F.max("seg").alias("end"))
    heads = _heads(st.join(bounds, "path", "left"), slots)

    i, opening = F.col("page_idx"), F.col("page_idx") == F.col("f")
    body = pages.withColumn("has_result", F.lit(True)).where(page_status(p) == "ok").select("path", "page_idx", lines.alias("lines")).join(numbers.select("path", "page_idx", "seg", "f"), ["path", "page_idx"])
    piece = F.when(~opening, F.array_join(F.concat(_sep_lines(p, i), F.col("lines")), "\n")).when(F.size("lines") > 0, F.array_join("lines", "\n"))
    texts = put_together(body.select("path", "page_idx", "seg", piece.alias("_t"), F.lit(True).alias("_lead")), ["path"], "page_idx", "\n", out="core")
    res = heads.join(texts, ["path", "seg"], "left")
    blank, seg, last = F.col("start").isNull(), F.col("seg"), F.col("seg") == F.col("end")
    if p.name == "strict":
        stderr = (F.when(n_failed > 0, F.concat(F.col("failed_list"), F.lit("\n"),
                                                 fmt(STRICT_PAGES_HAD_ERRORS, k=n_failed, n=F.col("page_count"))))
                  .otherwise(F.lit(STRICT_PDF_BLANK)))
        err = (F.when((n_failed > 0) | blank,
                      strict_error("ExtractionError", path, fmt(STRICT_OCR_FAILED, stderr=utrim(stderr))))
               .otherwise(null_error()))
        text = F.when(last, F.concat(F.col("core"), F.lit("\n"))).otherwise(F.col("core"))
    else:
        core = F.when(seg < F.col("start"), F.lit("")).when(seg == F.col("start"), utrim_start("core")).otherwise(F.col("core"))
        warn_failed = F.when(n_failed > 0, fmt(LENIENT_FAILED_PAGES, pages=F.col("failed_list"))) \
            .otherwise(F.lit(""))
        warn_trunc = (F.when(F.col("page_count") > F.lit(p.page_cap),
                             fmt(LENIENT_TRUNCATED, cap=str(p.page_cap), n=F.col("page_count")))
                      .otherwise(F.lit("")))
        err = (F.when(blank, lenient_error("extractionFailed", path, F.lit(LENIENT_PDF_BLANK)))
               .otherwise(null_error()))
        text = F.when(last, F.concat(utrim_end(core), warn_failed, warn_trunc)).otherwise(core)
    built = res.select("path", "seg", F.when(err.isNull(), text).alias("text"), err.alias("error"),
                       F.col("_m").cast("bigint").alias("n_pages"), n_failed.alias("n_failed"),
                       F.col("failed_list"))
    refused = gated.where(F.col("pdf_error").isNotNull()).select(
        "path", F.lit(0).cast("bigint").alias("seg"), F.lit(None).cast("string").alias("text"), F.col("pdf_error").alias("error"),
        F.lit(0).cast("bigint").alias("n_pages"), F.lit(0).cast("bigint").alias("n_failed"),
        F.lit(None).cast("string").alias("failed_list"))
    # A blank document of several segments (blank lines beyond a segment's size) is one error.
    return built.where(F.col("error").isNull() | (F.col("seg") == 0)).unionByName(refused)


# ------------------------------------------------------------------------ images
def assemble_image(facts: DataFrame, pages: DataFrame, profile: Profile | str) -> DataFrame:
    """Single-image OCR (R7, G14, G15, P10). ``facts`` has ``path, open_error, width_px, height_px``;
    an optional ``convert_error`` marks images that open but have no bitmap (P15);
    ``pages`` has one result row (page_idx 0) per image. Returns ``path, text, error``."""
    p = get_profile(profile)
    r = pages.where(F.col("page_idx") == 0).select("path", "lines", F.col("error").alias("ocr_error"), "elapsed_ms")
    bitmap = F.col("convert_error") if "convert_error" in facts.columns else F.lit(None).cast("string")
    d = facts.select("path", "open_error", bitmap.alias("convert_error"), "width_px", "height_px").join(r, "path", "left")
    path = F.col("path")
    lines = F.coalesce(F.col("lines"), F.array().cast("array<string>"))
    joined = F.array_join(lines, "\n")
    if p.name == "strict":
        ocr = lambda m: strict_error("ExtractionError", path, fmt(STRICT_OCR_FAILED, stderr=m))
        text = F.when(F.size(lines) > 0, F.concat(joined, F.lit("\n"))).otherwise(F.lit(""))
        err = (F.when(F.col("open_error").isNotNull(), ocr(fmt(STRICT_IMAGE_LOAD, path=path)))
               .when(F.col("convert_error").isNotNull(), ocr(F.lit(STRICT_IMAGE_CONVERT)))
               .when(F.col("ocr_error").isNotNull(), ocr(fmt(STRICT_IMAGE_OCR, error=F.col("ocr_error"))))
               .when(is_blank(text), strict_error("ExtractionError", path, F.lit(STRICT_IMAGE_BLANK)))
               .otherwise(null_error()))
    else:
        text = joined
        err = (F.when(F.col("open_error").isNotNull(), lenient_error("extractionFailed", path, F.lit(LENIENT_IMAGE_LOAD)))
               .when(F.col("convert_error").isNotNull(), lenient_error("extractionFailed", path, F.lit(LENIENT_IMAGE_CONVERT)))
               .when(too_many_pixels("width_px", "height_px", p.max_image_pixels),
                     lenient_error("imageTooLarge", path, width=F.col("width_px"), height=F.col("height_px")))
               .when(F.col("elapsed_ms") > F.lit(p.ocr_timeout_ms), lenient_error("ocrTimeout", path))
               .when(F.col("ocr_error").isNotNull(), lenient_error("extractionFailed", path, F.col("ocr_error")))
               .when(is_blank(text), lenient_error("extractionFailed", path, F.lit(LENIENT_IMAGE_BLANK)))
               .otherwise(null_error()))
    return d.select("path", F.when(err.isNull(), text).alias("text"), err.alias("error"))


# -------------------------------------------------------------------------- G5
def embedded_or_ocr(facts: DataFrame, embedded_pages: DataFrame, ocr_pages: DataFrame | None,
                    profile: Profile | str, ocr_available: bool = True,
                    image_facts: DataFrame | None = None) -> DataFrame:
    """Embedded text unless blank; then OCR, run only for the blank documents.

    Which documents are blank is known from page-level tests, so nothing is
    assembled twice or stored in between. The recognizer goes by the extension:
    a document that only its declared type makes a PDF is recognized as an
    image (facts from ``image_facts``).
    Returns ``path, seg, text, error, source`` with source 'embedded', 'ocr' or NULL.
    """
    p = get_profile(profile)
    emb = assemble_embedded(facts, embedded_pages, p)
    path = F.col("path")
    if p.name == "strict" and not ocr_available:
        e = F.when(F.col("blank"), strict_error("ExtractionError", path, F.lit(STRICT_NO_EXTRACTABLE_TEXT))) \
            .otherwise(F.col("error"))
        # A blank text of several segments is one error.
        return emb.where(~F.col("blank") | (F.col("seg") == 0)).select(
            "path", "seg", F.when(~F.col("blank"), F.col("text")).alias("text"), e.alias("error"),
            F.when(~F.col("blank") & F.col("error").isNull(), F.lit("embedded")).alias("source"))
    blank = blank_documents(facts, embedded_pages, p)
    if ocr_pages is None:
        # A recognizer without results: every page of a blank document is missing.
        from .. import schemas
        ocr_pages = emb.sparkSession.createDataFrame([], schemas.PAGE_RESULTS)
    as_pdf, as_image = blank, None
    if image_facts is not None:
        as_pdf = blank.where(ocr_route("path", p) == "pdf")
        as_image = blank.where(ocr_route("path", p) == "image")
    wanted = facts.join(as_pdf, "path", "left_semi")
    o = assemble_ocr(wanted, ocr_pages.join(as_pdf, "path", "left_semi"), p).select("path", "seg", "text", "error")
    # Documents that the recognizer has an outcome for, without putting their texts together.
    reached = pdf_gate(wanted, p, "ocr").where(F.col("pdf_error").isNotNull() | F.col("page_count").isNotNull()).select("path")
    if as_image is not None:
        images = assemble_image(image_facts.join(as_image, "path", "left_semi"), ocr_pages, p)
        if p.name == "strict":
            # The tool re-checks the helper's text: blank -> error (unreachable when the helper succeeded).
            images = images.withColumn("error", F.when(F.col("error").isNull() & is_blank(F.col("text")), strict_error(
                "ExtractionError", path, F.lit(STRICT_OCR_EMPTY))).otherwise(F.col("error")))
        o = o.unionByName(images.select("path", F.lit(0).cast("bigint").alias("seg"), "text", "error"))
        reached = reached.unionByName(image_facts.join(as_image, "path", "left_semi").select("path"))
    unseen = blank.join(reached, "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("seg"), F.lit(None).cast("string").alias("text"), null_error().alias("error"))
    by_ocr = o.unionByName(unseen).select("path", "seg", "text", "error", F.when(F.col("error").isNull(), F.lit("ocr")).alias("source"))
    by_text = emb.where(~F.col("blank")).select("path", "seg", "text", "error", F.when(F.col("error").isNull(), F.lit("embedded")).alias("source"))
    return by_text.unionByName(by_ocr)
