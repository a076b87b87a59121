"""Typed errors and their display texts.

An error is one ``STRUCT<kind, path, message>``; ``message`` is already the
text the profile would show, so downstream sinks never re-derive it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, fmt, megabytes, megapixels, url_name

# ---------------------------------------------------------------------------
# Error kinds and their display texts.
# strict (command-line tool), 7 kinds; {path} as given, {detail} from the cause.
STRICT_MESSAGES = {
    "FileNotFound": "File not found: {path}",
    "PermissionDenied": "Permission denied: {path}",
    "BinaryFile": "Cannot read binary file: {path}",
    "ExtractionError": "Failed to extract text from '{path}': {detail}",
    "IoError": "Failed to read file '{path}': {detail}",
    "ClipboardError": "Clipboard error: {detail}",
    "NoFilesSpecified": "No files specified",
}
# lenient (desktop library), 10 kinds; {name} = last path component,
# {mb} = size / 1024 / 1024, {mp} = width * height / 1000000 (integers).
LENIENT_MESSAGES = {
    "fileNotFound": "File not found: {name}",
    "permissionDenied": "Permission denied: {name}",
    "binaryFile": "Binary file: {name}",
    "fileTooLarge": "File too large ({mb}MB): {name}",
    "outputTooLarge": "Output too large ({mb}MB) for clipboard",
    "imageTooLarge": "Image too large ({mp}MP): {name}",
    "isDirectory": "Cannot copy directory: {name}",
    "notFileURL": "Not a local file: {path}",
    "extractionFailed": "{detail}",
    "ocrTimeout": "OCR timed out: {name}",
}
# ---------------------------------------------------------------------------
STRICT_KINDS = tuple(STRICT_MESSAGES)
LENIENT_KINDS = tuple(LENIENT_MESSAGES)
# Operating-system and codec texts that the strict tool passes through.
IO_INVALID_UTF8 = "stream did not contain valid UTF-8"
IO_IS_DIRECTORY = "Is a directory (os error 21)"
IO_PERMISSION_DENIED = "Permission denied (os error 13)"
# Messages of the desktop front end (not error kinds).
NO_FILE_SELECTED = "No file selected"
SELECT_ONE_FILE = "Please select only one file"
FILE_IS_EMPTY = "File is empty"
SUMMARY_FORMAT = "Copied {bytes} bytes from {what} to clipboard"
SUMMARY_MANY = "{n} files"
COPIED_CONTENTS = "Copied contents to clipboard"
# The workflow loop: a non-regular file is skipped with this notice.
NOT_A_FILE = "Not a file: {path}"
# The desktop front end's own refusal of a non-local item (before the library runs).
NOT_LOCAL_NOTICE = "Not a local file"


def make_error(kind: str, path, message) -> Column:
    return F.struct(F.lit(kind).alias("kind"), col(path).cast("string").alias("path"),
                    col(message).cast("string").alias("message"))


def null_error() -> Column:
    return F.lit(None).cast("struct<kind:string,path:string,message:string>")


def strict_error(kind: str, path, detail=None) -> Column:
    p = col(path)
    parts = {"path": p}
    if detail is not None:
        parts["detail"] = col(detail)
    return make_error(kind, p, fmt(STRICT_MESSAGES[kind], **parts))


def lenient_error(kind: str, path, detail=None, size=None, width=None, height=None) -> Column:
    p = col(path)
    parts = {"path": p, "name": url_name(p)}
    if detail is not None:
        parts["detail"] = col(detail)
    if size is not None:
        parts["mb"] = megabytes(size)
    if width is not None and height is not None:
        parts["mp"] = megapixels(width, height)
    return make_error(kind, p, fmt(LENIENT_MESSAGES[kind], **parts))


def summary(n_bytes, n_files, first_path) -> Column:
    """'Copied B bytes from X to clipboard'; X = path, 'stdin' or 'N files'."""
    what = (F.when(col(n_files) == 1,
                   F.when(col(first_path) == "-", F.lit("stdin")).otherwise(col(first_path)))
            .otherwise(fmt(SUMMARY_MANY, n=n_files)))
    return fmt(SUMMARY_FORMAT, bytes=n_bytes, what=what)
