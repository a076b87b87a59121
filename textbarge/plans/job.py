"""End-to-end job: manifest -> validated, routed, decoded entries -> payload per run.

    manifest LEFT JOIN inventory -> validation -> route
      text : LEFT JOIN file bytes -> decode (expressions)     \\
      pdf  : embedded pages, OCR only for blank documents      } unionByName
      image: OCR result of the single page                    /
      inline ('-'): text as given
    -> per-run payload (policy) ; failures -> quarantine

Shuffles: the inventory / text / page joins (on path) and the payload's. File
bytes are decoded where they are read; no exchange carries them. Validation
and routing happen once: the classified entries (paths and flags, no text) are
written and read back by each route.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.errors import lenient_error, strict_error
from ..functions.route import ocr_route, route
from ..functions.text import fmt
from ..operators.pages import (STRICT_HELPER_MISSING, STRICT_OCR_UNAVAILABLE, assemble_image, assemble_ocr,
                               embedded_or_ocr)
from ..operators.payload import build_payload
from ..operators.validate import open_error, validation_error
from ..profiles import Profile, get_profile
from ..session import spool
from ..sources.files import attach_decoded
from ..sources.manifest import with_lookup_path

_ERR = "struct<kind:string,path:string,message:string>"
# Engine text for an entry whose bytes or extraction results could not be read.
CONTENT_UNAVAILABLE = "file content unavailable"
DECODED_COLS = ["run_id", "ord", "path", "route", "encoding", "text", "error", "part"]


@dataclass
class JobInputs:
    manifest: DataFrame                       # run_id, ord, path, inline_text, declared_type
    inventory: DataFrame                      # one row per path: exists, is_dir, link_target_exists, readable, length
    files: DataFrame | None = None            # path, content (text route bytes)
    pdf_facts: DataFrame | None = None        # path, open_error, locked, page_count
    pdf_pages: DataFrame | None = None        # embedded-text pass: path, page_idx, embedded, error
    ocr_pages: DataFrame | None = None        # OCR pass: path, page_idx, lines, error, elapsed_ms, width_pt, height_pt
    image_facts: DataFrame | None = None      # path, open_error[, convert_error], width_px, height_px
    runs: DataFrame | None = None             # run_id of all runs, also of those without an entry
    files_whole: bool = False                 # ``files`` has all there is to read: no file is looked for beside it


def decode_entries(inp: JobInputs, profile: Profile | str, ocr_available: bool = True,
                   helper_missing: tuple[str, str] | None = None) -> DataFrame:
    """One row per manifest entry: ``run_id, ord, path, route, encoding, text, error, part``; the
    later segments of a large document's text are rows with ``part`` above 0.

    ``helper_missing``, the names of the helper and of the tool: the strict tool's
    platform has a recognizer, but its helper program is not installed (P16); ``ocr_available=False``: the platform has none."""
    p = get_profile(profile)
    ocr_available = ocr_available and helper_missing is None
    m = with_lookup_path(inp.manifest, p)
    inline = (m.where(F.col("is_inline"))
              .select("run_id", "ord", "path", F.lit("inline").alias("route"), F.lit("utf-8").alias("encoding"),
                      F.col("inline_text").alias("text"), F.lit(None).cast(_ERR).alias("error"), F.lit(0).cast("bigint").alias("part")))
    has_entry = "entry_length" in inp.inventory.columns
    inv = inp.inventory.select(F.col("path").alias("lookup_path"), "exists", "is_dir", "link_target_exists",
                               "readable", "length",
                               (F.col("entry_length") if has_entry else F.col("length")).alias("_entry_len"))
    e = (m.where(~F.col("is_inline")).join(inv, "lookup_path", "left")
         .withColumn("route", route(F.col("path"), p, F.col("declared_type")))
         .withColumn("verr", validation_error(p, size="_entry_len")))
    e = spool(e, "entries")
    bad = e.where(F.col("verr").isNotNull()).select(
        "run_id", "ord", "path", "route", F.lit(None).cast("string").alias("encoding"),
        F.lit(None).cast("string").alias("text"), F.col("verr").alias("error"), F.lit(0).cast("bigint").alias("part"))
    ok = e.where(F.col("verr").isNull())
    parts = [inline, bad]

    # text route: decoded in the scan, texts joined by path
    t = ok.where(F.col("route") == "text").withColumn("oerr", open_error(p, "path", "text"))
    if inp.files is not None:
        t = attach_decoded(t, inp.files, p, fallback=not inp.files_whole)
    else:
        t = t.withColumns({"text": F.lit(None).cast("string"), "encoding": F.lit(None).cast("string"),
                           "error": F.lit(None).cast(_ERR)})
    parts.append(t.select("run_id", "ord", "path", "route", "encoding",
                          F.when(F.col("oerr").isNull(), F.col("text")).alias("text"),
                          F.coalesce("oerr", "error").alias("error"), F.lit(0).cast("bigint").alias("part")))

    # pdf route
    pdf = ok.where(F.col("route") == "pdf").withColumn("oerr", open_error(p, "path", "pdf"))
    if inp.pdf_facts is not None:
        want = pdf.where(F.col("oerr").isNull()).select(F.col("lookup_path").alias("path")).distinct()
        facts = inp.pdf_facts.join(want, "path", "left_semi")
        r = embedded_or_ocr(facts, inp.pdf_pages, inp.ocr_pages, p, ocr_available, image_facts=inp.image_facts)
        r = r.select(F.col("path").alias("lookup_path"), F.col("text").alias("r_text"), F.col("error").alias("r_err"), F.col("seg").alias("part"))
        pdf = pdf.join(r, "lookup_path", "left")
    else:
        pdf = pdf.withColumn("r_text", F.lit(None).cast("string")).withColumn("r_err", F.lit(None).cast(_ERR)).withColumn("part", F.lit(0).cast("bigint"))
    parts.append(pdf.select("run_id", "ord", "path", "route", F.lit(None).cast("string").alias("encoding"),
                            F.when(F.col("oerr").isNull(), F.col("r_text")).alias("text"),
                            F.coalesce("oerr", "r_err").alias("error"), F.coalesce("part", F.lit(0).cast("bigint")).alias("part"))
                 .where(F.col("text").isNotNull() | (F.col("part") == 0)))

    # image route
    img = ok.where(F.col("route") == "image").withColumn("oerr", open_error(p, "path", "image"))
    if p.name == "strict" and not ocr_available:
        # The command-line tool has no recognizer on this platform, or no helper.
        reason = F.lit(STRICT_OCR_UNAVAILABLE) if helper_missing is None else fmt(
            STRICT_HELPER_MISSING, helper=helper_missing[0], tool=helper_missing[1])
        img = img.withColumn("oerr", F.coalesce(F.col("oerr"), strict_error("ExtractionError", F.col("path"), reason)))
    if inp.image_facts is not None and inp.ocr_pages is not None:
        want = img.where(F.col("oerr").isNull()).select(F.col("lookup_path").alias("path")).distinct()
        r = assemble_image(inp.image_facts.join(want, "path", "left_semi"), inp.ocr_pages, p).withColumn("seg", F.lit(0).cast("bigint"))
        if p.use_declared_type and inp.pdf_facts is not None:
            # What only its declared type makes an image is recognized as PDF pages if it is named .pdf.
            pdf_named = want.where(ocr_route("path", p) == "pdf")
            o = assemble_ocr(inp.pdf_facts.join(pdf_named, "path", "left_semi"), inp.ocr_pages.join(pdf_named, "path", "left_semi"), p)
            r = r.join(pdf_named, "path", "left_anti").unionByName(o.select("path", "text", "error", "seg"))
        r = r.select(F.col("path").alias("lookup_path"), F.col("text").alias("r_text"), F.col("error").alias("r_err"), F.col("seg").alias("part"))
        img = img.join(r, "lookup_path", "left")
    else:
        img = img.withColumn("r_text", F.lit(None).cast("string")).withColumn("r_err", F.lit(None).cast(_ERR)).withColumn("part", F.lit(0).cast("bigint"))
    parts.append(img.select("run_id", "ord", "path", "route", F.lit(None).cast("string").alias("encoding"),
                            F.when(F.col("oerr").isNull(), F.col("r_text")).alias("text"),
                            F.coalesce("oerr", "r_err").alias("error"), F.coalesce("part", F.lit(0).cast("bigint")).alias("part"))
                 .where(F.col("text").isNotNull() | (F.col("part") == 0)))

    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    # An entry that produced neither text nor error (bytes or results could not be read) is an error.
    reason = F.lit(CONTENT_UNAVAILABLE)
    missing = (strict_error("IoError", F.col("path"), reason) if p.name == "strict"
               else lenient_error("extractionFailed", F.col("path"), reason))
    return out.withColumn("error", F.when(F.col("text").isNull() & F.col("error").isNull(), missing)
                          .otherwise(F.col("error")))


def single_part(decoded: DataFrame) -> DataFrame:
    """``decoded`` without ``part`` where no document has more than one segment: the plain, cheaper plans do."""
    return decoded.drop("part") if decoded.where("part > 0").isEmpty() else decoded


def run_job(inp: JobInputs, profile: Profile | str = "strict", policy: str = "fail_fast",
            ocr_available: bool = True, helper_missing: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(decoded entries, payload per run)``.

    The decoded entries are written once as Parquet in the shared folder: the
    payload's passes start from stored rows and read only the columns they
    need, and a lost executor costs a re-read rather than the whole lineage.
    """
    decoded = spool(decode_entries(inp, profile, ocr_available, helper_missing), "decoded")
    entries = single_part(decoded)
    runs = inp.manifest.select("run_id")
    if inp.runs is not None:
        runs = runs.unionByName(inp.runs.select(F.col("run_id").cast("string").alias("run_id")))
    return decoded, build_payload(entries, profile, policy, runs=runs)
