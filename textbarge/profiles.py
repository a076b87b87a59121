"""The two rule sets of the source tool, as data.

``strict`` is the command-line tool plus its OCR helper; ``lenient`` is the
desktop library. Every operator takes a profile and reads its constants here.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values that must equal the source tool's for identical results.
# ---------------------------------------------------------------------------
BINARY_SNIFF_BYTES = 8192
LENIENT_MAX_FILE_BYTES = 50 * 1024 * 1024
LENIENT_MAX_OUTPUT_BYTES = 100 * 1024 * 1024
MAX_IMAGE_PIXELS = 50_000_000
LENIENT_PAGE_CAP = 100
OCR_TIMEOUT_MS = 60_000
RENDER_DPI = 150.0
POINTS_PER_INCH = 72.0
STRICT_PAGE_SEPARATOR = "--- Page {n} ---"
LENIENT_PAGE_SEPARATOR = "══════════ Page {n} ══════════"
STRICT_IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "tif", "gif", "bmp", "webp", "heic", "heif")
LENIENT_IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "tif", "heic", "webp", "bmp", "gif")
NOTIFICATION_MAX_CHARS = 100
NOTIFICATION_KEEP_CHARS = 97
# Unicode White_Space: what both trim implementations strip.
WHITESPACE_CHARS = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# ---------------------------------------------------------------------------

# Size of a payload segment: what one task puts together (operators/concat.py).
SEGMENT_BYTES = 64 * 1024 * 1024
# Engine bound: Spark's binary values (and the binaryFile reader) stop at 2^31-1
# bytes; a bigger file fails its task, so it is kept out of the scan and
# reported as an error instead of aborting the job.
ENGINE_MAX_FILE_BYTES = 2147483647


@dataclass(frozen=True)
class Profile:
    name: str
    max_file_bytes: int | None
    max_output_bytes: int | None
    page_cap: int | None
    page_separator: str
    image_extensions: tuple[str, ...]
    use_declared_type: bool
    keep_failed_pages: bool
    ocr_timeout_ms: int | None
    max_image_pixels: int | None
    segment_bytes: int = SEGMENT_BYTES
    # URL schemes besides file: whose paths are looked up as they are (a cluster's
    # storage, e.g. ("hdfs", "s3")); the source tool accepts none.
    accepted_schemes: tuple[str, ...] = ()

    def with_(self, **kw) -> "Profile":
        d = self.__dict__.copy()
        d.update(kw)
        return Profile(**d)


STRICT = Profile(
    name="strict",
    max_file_bytes=None,
    max_output_bytes=None,
    page_cap=None,
    page_separator=STRICT_PAGE_SEPARATOR,
    image_extensions=STRICT_IMAGE_EXTENSIONS,
    use_declared_type=False,
    keep_failed_pages=False,
    ocr_timeout_ms=None,
    max_image_pixels=None,
)

LENIENT = Profile(
    name="lenient",
    max_file_bytes=LENIENT_MAX_FILE_BYTES,
    max_output_bytes=LENIENT_MAX_OUTPUT_BYTES,
    page_cap=LENIENT_PAGE_CAP,
    page_separator=LENIENT_PAGE_SEPARATOR,
    image_extensions=LENIENT_IMAGE_EXTENSIONS,
    use_declared_type=True,
    keep_failed_pages=True,
    ocr_timeout_ms=OCR_TIMEOUT_MS,
    max_image_pixels=MAX_IMAGE_PIXELS,
)


def get_profile(p: "Profile | str") -> Profile:
    if isinstance(p, Profile):
        return p
    return {"strict": STRICT, "lenient": LENIENT}[p]
