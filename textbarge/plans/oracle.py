"""DuckDB SQL stating each query's expected result on the same parquet tables.

Each statement is written from the rule, not from the Spark code: it shares no
functions with the engine, states page accumulators with plain window
functions (the engine uses none), spells decoding out on code points (the
engine works on bytes), and rebuilds every message from its fixed text. The
driver runs both sides on the same tables and compares rows, columns and an
order-insensitive hash of the values.
"""

ORACLE = {}

ORACLE["payload_by_source"] = """
WITH g AS (
  SELECT source AS run_id, count(*) AS n_files,
         string_agg(text, chr(10) ORDER BY doc_id) AS payload,
         min_by('/data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt', doc_id) AS first_path
  FROM documents GROUP BY source)
SELECT run_id, n_files, CAST(strlen(payload) AS BIGINT) AS n_bytes, payload,
       'Copied ' || CAST(strlen(payload) AS VARCHAR) || ' bytes from '
         || CASE WHEN n_files = 1 THEN first_path ELSE CAST(n_files AS VARCHAR) || ' files' END
         || ' to clipboard' AS summary,
       CAST(NULL AS VARCHAR) AS error_kind, CAST(NULL AS VARCHAR) AS error_message
FROM g
"""

# --------------------------------------------------------------------------
# helpers for writing the SQL
# --------------------------------------------------------------------------
# The White_Space property of Unicode, spelled here on its own.
WS_SQL = "||".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
DOC_PATH = "('/data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt')"
# A Latin-1 string whose code points, read as bytes, form valid UTF-8.
UTF8_AS_LATIN1 = (r"(?:[\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
                  r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
                  r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}"
                  r"|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*")
LATIN1_BYTES_AS_UTF8 = ("try(decode(from_hex(list_aggr(list_transform(string_split(text, ''), "
                        "lambda x: lpad(to_hex(unicode(x)), 2, '0')), 'string_agg', ''))))")

ORACLE["nul_sniff"] = """
SELECT doc_id,
       CAST(strlen(text) * (8200 // strlen(text) + 1) + CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END AS BIGINT) AS n_bytes,
       CAST(CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 8191 WHEN 2 THEN 8192 ELSE -1 END AS INTEGER) AS nul_offset,
       doc_id % 4 IN (0, 1) AS is_binary
FROM documents
"""

ORACLE["blank_filter"] = f"""
WITH t AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '   ' WHEN 1 THEN chr(9) || chr(10) WHEN 2 THEN chr(160)
                 WHEN 3 THEN chr(12288) || chr(12288) ELSE chr(12288) || text || ' ' || chr(10) END AS t
  FROM documents)
SELECT doc_id, trim(t, {WS_SQL}) = '' AS is_blank, trim(t, {WS_SQL}) AS trimmed,
       CAST(length(trim(t, {WS_SQL})) AS BIGINT) AS n_chars
FROM t
"""

ORACLE["utf8_strict"] = f"""
SELECT doc_id,
       CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS text,
       CASE WHEN doc_id % 10 = 0 THEN 'IoError' END AS error_kind,
       CASE WHEN doc_id % 10 = 0 THEN 'Failed to read file ''' || {DOC_PATH} || ''': stream did not contain valid UTF-8' END
         AS error_message
FROM documents
"""

ORACLE["lossy_text"] = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(65533) ELSE text END AS text FROM documents
"""

ORACLE["bom_decode"] = """
SELECT doc_id,
       CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be'
                       WHEN 3 THEN 'utf-32le' ELSE 'utf-32be' END AS encoding,
       text,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'BinaryFile' END AS strict_kind
FROM documents
"""

# UTF-16BE bytes read as UTF-16LE: every unit byte-swapped; invalid when a swapped
# unit is an unpaired surrogate (low byte D8-DB not followed by DC-DF, or DC-DF alone).
ORACLE["utf16_guess"] = """
WITH d AS (
  SELECT doc_id, text,
         regexp_replace(regexp_replace(text, '[\\x{D8}-\\x{DB}][\\x{DC}-\\x{DF}]', '', 'g'),
                        '[^\\x{D8}-\\x{DF}]', '', 'g') = '' AS le_ok
  FROM documents)
SELECT doc_id,
       CASE doc_id % 3 WHEN 0 THEN 'utf-16le' WHEN 1 THEN CASE WHEN le_ok THEN 'utf-16le' ELSE 'utf-16be' END
            ELSE 'binary' END AS encoding,
       CASE doc_id % 3 WHEN 0 THEN text
            WHEN 1 THEN CASE WHEN le_ok THEN list_aggr(list_transform(string_split(text, ''),
                 lambda x: chr((unicode(x) % 256) * 256 + unicode(x) // 256)), 'string_agg', '') ELSE text END
            ELSE NULL END AS text,
       'BinaryFile' AS strict_kind
FROM d
"""

ORACLE["latin1_fallback"] = f"""
WITH d AS (SELECT doc_id, text, regexp_full_match(text, '{UTF8_AS_LATIN1}') AS u8 FROM documents)
SELECT doc_id,
       CASE WHEN u8 THEN 'utf-8' ELSE 'iso-8859-1' END AS encoding,
       CASE WHEN u8 THEN {LATIN1_BYTES_AS_UTF8} ELSE text END AS text,
       CASE WHEN u8 THEN NULL ELSE 'IoError' END AS strict_kind
FROM d
"""

ORACLE["size_gate"] = f"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
       CASE WHEN strlen(text) > 8192 THEN 'fileTooLarge' END AS error_kind,
       CASE WHEN strlen(text) > 8192 THEN 'File too large (' || CAST(strlen(text) // 1024 // 1024 AS VARCHAR)
            || 'MB): ' || CAST(doc_id AS VARCHAR) || '.txt' END AS error_message
FROM documents
"""

ORACLE["output_gate"] = """
WITH g AS (SELECT source AS run_id, string_agg(text, chr(10) ORDER BY doc_id) AS p FROM documents GROUP BY source)
SELECT run_id, CAST(strlen(p) AS BIGINT) AS n_bytes,
       CASE WHEN strlen(p) <= 131072 THEN p END AS payload,
       CASE WHEN strlen(p) > 131072 THEN 'outputTooLarge' END AS error_kind,
       CASE WHEN strlen(p) > 131072 THEN 'Output too large (' || CAST(strlen(p) // 1024 // 1024 AS VARCHAR)
            || 'MB) for clipboard' END AS error_message
FROM g
"""

ORACLE["payload_status"] = f"""
WITH g AS (
  SELECT source AS run_id, count(*) AS n_files, count(*) FILTER (WHERE doc_id % 97 = 0) AS n_failed,
         min(doc_id) FILTER (WHERE doc_id % 97 = 0) AS bad,
         string_agg(text, chr(10) ORDER BY doc_id) AS p
  FROM documents GROUP BY source)
SELECT run_id, n_files, n_failed,
       CAST(CASE WHEN n_failed = 0 THEN strlen(p) ELSE 0 END AS BIGINT) AS n_bytes,
       CASE WHEN n_failed = 0 THEN p END AS payload,
       CASE WHEN n_failed > 0 THEN 'FileNotFound' END AS error_kind,
       CASE WHEN n_failed > 0 THEN 'File not found: /data/' || run_id || '/' || CAST(bad AS VARCHAR) || '.txt' END
         AS error_message
FROM g
"""

ORACLE["last_success_wins"] = """
WITH g AS (
  SELECT conv_id, count(*) AS n_files, count(*) FILTER (WHERE turn % 3 = 2) AS n_failed,
         max_by(text, turn) FILTER (WHERE turn % 3 <> 2) AS payload,
         max(turn) FILTER (WHERE turn % 3 <> 2) AS t
  FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS run_id, payload, CAST(strlen(payload) AS BIGINT) AS n_bytes, n_files, n_failed,
       'Copied ' || CAST(strlen(payload) AS VARCHAR) || ' bytes from /conv/' || CAST(conv_id AS VARCHAR) || '/'
         || CAST(t AS VARCHAR) || '.txt to clipboard' AS summary,
       CAST(NULL AS VARCHAR) AS error_kind
FROM g
"""

ORACLE["selection_cardinality"] = """
WITH r AS (SELECT unnest(['system', 'user', 'assistant', 'tool']) AS role),
e AS (SELECT DISTINCT conv_id, r.role FROM conversations, r)
SELECT e.conv_id, e.role, count(c.conv_id) AS n_items,
       CASE WHEN count(c.conv_id) = 0 THEN 'No file selected' WHEN count(*) > 1 THEN 'Please select only one file' END AS message
FROM e LEFT JOIN conversations c ON e.conv_id = c.conv_id AND e.role = c.role GROUP BY e.conv_id, e.role
"""

ORACLE["inline_union"] = """
WITH g AS (
  SELECT conv_id, count(*) AS n_files, string_agg(text, chr(10) ORDER BY turn) AS payload,
         min_by(CASE WHEN role = 'system' THEN 'stdin'
                     ELSE '/conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt' END, turn) AS fp
  FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS run_id, n_files, CAST(strlen(payload) AS BIGINT) AS n_bytes, payload,
       'Copied ' || CAST(strlen(payload) AS VARCHAR) || ' bytes from '
         || CASE WHEN n_files = 1 THEN fp ELSE CAST(n_files AS VARCHAR) || ' files' END || ' to clipboard' AS summary
FROM g
"""

ORACLE["outcome_rollup"] = f"""
WITH d AS (SELECT doc_id, regexp_full_match(text, '{UTF8_AS_LATIN1}') AS u8 FROM documents),
o AS (
  SELECT 'strict' AS profile,
         CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN u8 THEN 'ok' ELSE 'IoError' END
              ELSE 'BinaryFile' END AS kind FROM d
  UNION ALL
  SELECT 'lenient', CASE WHEN doc_id % 4 = 3 THEN 'binaryFile' ELSE 'ok' END FROM d)
SELECT profile, 'text' AS route, kind, count(*) AS n FROM o GROUP BY profile, kind
"""

# --------------------------------------------------------------------------
# page assembly
# --------------------------------------------------------------------------
from ..profiles import LENIENT_PAGE_SEPARATOR, STRICT_PAGE_SEPARATOR  # noqa: E402

CONV_PATH = "('/conv/' || CAST(conv_id AS VARCHAR) || '.pdf')"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _sep_sql(fmt: str) -> str:
    pre, post = fmt.split("{n}")
    return f"'{pre}' || CAST(turn + 1 AS VARCHAR) || '{post}'"


ORACLE["pages_embedded"] = f"""
WITH p AS (
  SELECT conv_id, turn, (turn % 7 = 4 AND conv_id % 2 = 0) AS bad,
         CASE WHEN turn % 7 = 4 AND conv_id % 2 = 0 THEN NULL
              WHEN conv_id % 5 = 4 AND turn IN (0, 1) THEN 'same'
              WHEN turn < conv_id % 3 OR turn % 5 = 3 THEN '' ELSE text END AS emb
  FROM conversations),
s AS (SELECT conv_id, turn, emb,
             coalesce(bool_or(emb <> '') OVER (PARTITION BY conv_id ORDER BY turn {PRIOR}), false) AS prior
      FROM p),
l AS (SELECT conv_id, turn, emb,
             coalesce(bool_or(emb <> '') OVER (PARTITION BY conv_id ORDER BY turn {PRIOR}), false) AS prior
      FROM p WHERE NOT bad),
st AS (SELECT conv_id, string_agg(CASE WHEN prior THEN chr(10) ELSE '' END || emb, '' ORDER BY turn) AS t
       FROM s GROUP BY conv_id),
lt AS (SELECT conv_id, string_agg(CASE WHEN prior THEN chr(10) ELSE '' END || emb, '' ORDER BY turn) AS t
       FROM l GROUP BY conv_id),
fb AS (SELECT conv_id, min(turn) FILTER (WHERE bad) AS fbad, conv_id % 5 = 4 AND bool_or(turn = 1) AS gap FROM p GROUP BY conv_id)
SELECT fb.conv_id,
       CASE WHEN fbad IS NULL AND NOT gap THEN coalesce(st.t, '') END AS strict_text,
       CASE WHEN gap THEN 'Failed to extract text from ''/conv/' || CAST(fb.conv_id AS VARCHAR)
            || '.pdf'': Failed to extract page 2: page missing'
            WHEN fbad IS NOT NULL THEN 'Failed to extract text from ''/conv/' || CAST(fb.conv_id AS VARCHAR)
            || '.pdf'': Failed to extract page ' || CAST(fbad + 1 AS VARCHAR) || ': unsupported font encoding' END
         AS strict_error,
       coalesce(lt.t, '') AS lenient_text,
       CAST(NULL AS VARCHAR) AS lenient_error
FROM fb LEFT JOIN st ON st.conv_id = fb.conv_id LEFT JOIN lt ON lt.conv_id = fb.conv_id
"""


def _ocr_sql(profile: str, cap: int | None) -> str:
    sep = _sep_sql(STRICT_PAGE_SEPARATOR if profile == "strict" else LENIENT_PAGE_SEPARATOR)
    capf = f"WHERE turn < {cap}" if cap else ""
    failed = ("(turn % 4 = 3 AND conv_id % 3 = 0)" if profile == "strict"
              else "((turn % 4 = 3 AND conv_id % 3 = 0) OR (turn % 4 = 1 AND conv_id % 5 = 1))")
    return f"""
WITH n AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
p AS (
  SELECT conv_id, turn,
         CASE WHEN turn < conv_id % 3 THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines,
         {failed} AS failed
  FROM conversations {capf}),
q AS (SELECT *, coalesce(bool_or(NOT failed AND len(lines) > 0)
                         OVER (PARTITION BY conv_id ORDER BY turn {PRIOR}), false) AS prior FROM p),
r AS (SELECT *, list_concat(CASE WHEN prior THEN ['', {sep}, ''] ELSE []::VARCHAR[] END, lines) AS piece FROM q),
g AS (
  SELECT conv_id, count(*) AS n_pages, count(*) FILTER (WHERE failed) AS n_failed,
         string_agg(CASE WHEN NOT failed AND len(piece) > 0 THEN array_to_string(piece, chr(10)) END,
                    chr(10) ORDER BY turn) AS core,
         string_agg(CASE WHEN failed THEN 'Warning: OCR failed on page ' || CAST(turn + 1 AS VARCHAR)
                         || ': recognition failed' END, chr(10) ORDER BY turn) AS warns,
         string_agg(CASE WHEN failed THEN CAST(turn + 1 AS VARCHAR) END, ', ' ORDER BY turn) AS failed_pages
  FROM r GROUP BY conv_id)
SELECT g.*, n.n FROM g JOIN n USING (conv_id)
"""


ORACLE["pages_ocr_strict"] = f"""
WITH x AS ({_ocr_sql("strict", None)})
SELECT conv_id,
       CASE WHEN n_failed = 0 AND trim(coalesce(core, ''), {WS_SQL}) <> '' THEN core || chr(10) END AS text,
       CASE WHEN n_failed > 0 THEN 'Failed to extract text from ''' || {CONV_PATH} || ''': OCR failed: '
                 || trim(warns || chr(10) || 'Error: ' || CAST(n_failed AS VARCHAR) || ' of ' || CAST(n AS VARCHAR)
                 || ' pages had errors', {WS_SQL})
            WHEN trim(coalesce(core, ''), {WS_SQL}) = '' THEN 'Failed to extract text from ''' || {CONV_PATH}
                 || ''': OCR failed: Error: No text recognized in PDF (all pages were blank or unreadable)' END
         AS error_message,
       CAST(n_pages AS BIGINT) AS n_pages, CAST(n_failed AS BIGINT) AS n_failed
FROM x
"""

ORACLE["pages_ocr_lenient"] = f"""
WITH x AS ({_ocr_sql("lenient", 4)})
SELECT conv_id,
       CASE WHEN trim(coalesce(core, ''), {WS_SQL}) <> '' THEN
            trim(core, {WS_SQL})
            || CASE WHEN n_failed > 0 THEN chr(10) || chr(10) || '[Warning: Failed to process pages: '
                    || failed_pages || ']' ELSE '' END
            || CASE WHEN n > 4 THEN chr(10) || chr(10) || '[Warning: PDF truncated. Processed 4 of '
                    || CAST(n AS VARCHAR) || ' pages]' ELSE '' END END AS text,
       CASE WHEN trim(coalesce(core, ''), {WS_SQL}) = '' THEN 'No text recognized in PDF' END AS error_message,
       CAST(n_pages AS BIGINT) AS n_pages, CAST(n_failed AS BIGINT) AS n_failed, failed_pages
FROM x
"""

ORACLE["embedded_or_ocr"] = f"""
WITH d AS (
  SELECT doc_id, '/data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, documents.text AS text,
         b.text AS btext
  FROM documents LEFT JOIN benchmark b ON b.item_id * 3 = documents.doc_id)
SELECT doc_id,
       CASE WHEN doc_id % 3 <> 0 THEN 'embedded' WHEN btext IS NOT NULL THEN 'ocr' END AS strict_source,
       CASE WHEN doc_id % 3 <> 0 THEN text WHEN btext IS NOT NULL THEN btext || chr(10) END AS strict_text,
       CASE WHEN doc_id % 3 = 0 AND btext IS NULL THEN 'Failed to extract text from ''' || path
            || ''': OCR failed: Warning: Could not access page 1' || chr(10) || 'Error: 1 of 1 pages had errors' END
         AS strict_error,
       CASE WHEN doc_id % 3 <> 0 THEN 'embedded' WHEN btext IS NOT NULL THEN 'ocr' END AS lenient_source,
       CASE WHEN doc_id % 3 <> 0 THEN text WHEN btext IS NOT NULL THEN trim(btext, {WS_SQL}) END AS lenient_text,
       CASE WHEN doc_id % 3 = 0 AND btext IS NULL THEN 'No text recognized in PDF' END AS lenient_error
FROM d
"""

ORACLE["page_failures"] = """
WITH f AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, unnest(range(0, n)) AS page_idx FROM f),
p AS (SELECT conv_id, turn, turn % 4 = 3 AS err, turn % 7 = 6 AS slow,
             CASE WHEN turn % 6 = 5 THEN 5000.0::DOUBLE ELSE 612.0::DOUBLE END AS w,
             CASE WHEN turn % 6 = 5 THEN 5000.0::DOUBLE ELSE 792.0::DOUBLE END AS h
      FROM conversations WHERE turn % 5 <> 4),
j AS (SELECT e.conv_id, e.page_idx, p.turn IS NOT NULL AS has, err, slow,
             CAST(trunc(w * (150.0::DOUBLE / 72.0::DOUBLE)) AS BIGINT)
               * CAST(trunc(h * (150.0::DOUBLE / 72.0::DOUBLE)) AS BIGINT) AS px
      FROM e LEFT JOIN p ON p.conv_id = e.conv_id AND p.turn = e.page_idx)
SELECT conv_id, CAST(page_idx + 1 AS INTEGER) AS page_no,
       CASE WHEN NOT has THEN 'access' WHEN err THEN 'recognize' ELSE 'ok' END AS strict_status,
       CASE WHEN NOT has THEN 'access' WHEN px > 50000000 THEN 'render' WHEN slow THEN 'timeout'
            WHEN err THEN 'recognize' ELSE 'ok' END AS lenient_status,
       CASE WHEN NOT has THEN 'Warning: Could not access page ' || CAST(page_idx + 1 AS VARCHAR)
            WHEN err THEN 'Warning: OCR failed on page ' || CAST(page_idx + 1 AS VARCHAR) || ': recognition failed'
       END AS strict_warning
FROM j
"""

ORACLE["page_expand"] = """
WITH f AS (SELECT conv_id, max(turn) + 1 + conv_id % 2 AS n FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, unnest(range(0, n)) AS page_idx FROM f)
SELECT e.conv_id, CAST(e.page_idx AS INTEGER) AS page_idx, CAST(e.page_idx + 1 AS INTEGER) AS page_no,
       c.turn IS NOT NULL AS has_result
FROM e LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE turn % 5 <> 4) c
  ON c.conv_id = e.conv_id AND c.turn = e.page_idx
"""

ORACLE["page_timeout"] = """
SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS elapsed_ms,
       CASE WHEN floor(value * 1000) <= 60000 THEN event_type END AS text,
       CASE WHEN floor(value * 1000) > 60000 THEN 'ocrTimeout' END AS error_kind,
       CASE WHEN floor(value * 1000) > 60000 THEN 'OCR timed out: ' || CAST(event_id AS VARCHAR) || '.png' END
         AS error_message
FROM events
"""

ORACLE["raster_gate"] = """
WITH d AS (
  SELECT p_partkey,
         CAST(trunc(p_size * 61.2::DOUBLE * (150.0::DOUBLE / 72.0::DOUBLE)) AS INTEGER) AS width_px,
         CAST(trunc(p_size * 79.2::DOUBLE * (150.0::DOUBLE / 72.0::DOUBLE)) AS INTEGER) AS height_px
  FROM part)
SELECT p_partkey, width_px, height_px, CAST(width_px AS BIGINT) * height_px AS pixels,
       CAST(width_px AS BIGINT) * height_px // 1000000 AS megapixels,
       CASE WHEN CAST(width_px AS BIGINT) * height_px > 50000000 THEN 'imageTooLarge' END AS error_kind,
       CASE WHEN CAST(width_px AS BIGINT) * height_px > 50000000 THEN 'Image too large ('
            || CAST(CAST(width_px AS BIGINT) * height_px // 1000000 AS VARCHAR) || 'MP): '
            || CAST(p_partkey AS VARCHAR) || '.png' END AS error_message
FROM d
"""

# --------------------------------------------------------------------------
# validation, routing, errors, lookups
# --------------------------------------------------------------------------
ORACLE["doc_facts_gate"] = """
WITH d AS (SELECT o_orderkey AS k, '/orders/' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS path,
                  CAST(o_orderkey AS VARCHAR) || '.pdf' AS name FROM orders)
SELECT k AS o_orderkey,
       CASE WHEN k % 17 = 0 OR k % 13 = 0 THEN 'FileNotFound'
            WHEN k % 11 = 0 OR k % 7 = 0 OR k % 5 = 0 THEN 'ExtractionError' END AS strict_kind,
       CASE WHEN k % 17 = 0 OR k % 13 = 0 THEN 'File not found: ' || path
            WHEN k % 11 = 0 THEN 'Failed to extract text from ''' || path || ''': Is a directory (os error 21)'
            WHEN k % 7 = 0 THEN 'Failed to extract text from ''' || path || ''': Permission denied (os error 13)'
            WHEN k % 5 = 0 THEN 'Failed to extract text from ''' || path || ''': bad xref table' END AS strict_message,
       CASE WHEN k % 17 = 0 OR k % 13 = 0 THEN 'fileNotFound' WHEN k % 11 = 0 THEN 'isDirectory'
            WHEN k % 7 = 0 THEN 'permissionDenied' WHEN (k % 23) * 3000000 > 52428800 THEN 'fileTooLarge'
            WHEN k % 5 = 0 OR k % 3 = 0 OR k % 19 = 0 THEN 'extractionFailed' END AS lenient_kind,
       CASE WHEN k % 17 = 0 OR k % 13 = 0 THEN 'File not found: ' || name
            WHEN k % 11 = 0 THEN 'Cannot copy directory: ' || name WHEN k % 7 = 0 THEN 'Permission denied: ' || name
            WHEN (k % 23) * 3000000 > 52428800 THEN 'File too large (' || CAST((k % 23) * 3000000 // 1024 // 1024 AS VARCHAR)
                 || 'MB): ' || name
            WHEN k % 5 = 0 THEN 'Could not open PDF' WHEN k % 3 = 0 THEN 'PDF is password-protected'
            WHEN k % 19 = 0 THEN 'PDF has no pages' END AS lenient_message
FROM d
"""


def _error_messages_sql() -> str:
    name = "(s_name || '.txt')"
    p = "path"
    det = "detail"
    cases = [
        f"'File not found: ' || {p}", f"'Permission denied: ' || {p}", f"'Cannot read binary file: ' || {p}",
        f"'Failed to extract text from ''' || {p} || ''': ' || {det}", f"'Failed to read file ''' || {p} || ''': ' || {det}",
        f"'Clipboard error: ' || {det}", "'No files specified'",
        f"'File not found: ' || {name}", f"'Permission denied: ' || {name}", f"'Binary file: ' || {name}",
        f"'File too large (' || CAST(s_suppkey * 3145728 // 1024 // 1024 AS VARCHAR) || 'MB): ' || {name}",
        "'Output too large (' || CAST(s_suppkey * 3145728 // 1024 // 1024 AS VARCHAR) || 'MB) for clipboard'",
        f"'Image too large (' || CAST((s_suppkey + 4000) * (s_suppkey + 3000) // 1000000 AS VARCHAR) || 'MP): ' || {name}",
        f"'Cannot copy directory: ' || {name}", f"'Not a local file: ' || {p}", det, f"'OCR timed out: ' || {name}",
    ]
    kinds = ["FileNotFound", "PermissionDenied", "BinaryFile", "ExtractionError", "IoError", "ClipboardError",
             "NoFilesSpecified", "fileNotFound", "permissionDenied", "binaryFile", "fileTooLarge", "outputTooLarge",
             "imageTooLarge", "isDirectory", "notFileURL", "extractionFailed", "ocrTimeout"]
    kc = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    mc = " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(cases))
    note = "CASE WHEN length(m) > 100 THEN left(m, 97) || '...' ELSE m END"
    return f"""
WITH s AS (
  SELECT s_suppkey, s_name, CAST(s_suppkey % 17 AS INTEGER) AS idx,
         '/srv/' || CAST(s_nationkey AS VARCHAR) || '/' || s_name || '.txt' AS path,
         trim(repeat(s_name || ' ', CAST(1 + s_suppkey % 6 AS INTEGER))) AS detail
  FROM supplier),
m AS (SELECT s_suppkey, idx, CASE idx {kc} END AS kind, CASE idx {mc} END AS m FROM s)
SELECT s_suppkey, CASE WHEN idx < 7 THEN 'strict' ELSE 'lenient' END AS profile, kind, m AS message,
       {note} AS notification,
       CASE WHEN idx < 7 THEN {note} END AS workflow
FROM m
"""


ORACLE["error_messages"] = _error_messages_sql()

# Each row's result follows from the rule that made its path, not from parsing it.
ORACLE["local_url_check"] = """
WITH d AS (SELECT page_id, url, CAST(page_id AS VARCHAR) AS i, page_id % 6 AS m FROM pages),
p AS (
  SELECT page_id, m, CASE m WHEN 0 THEN '/srv/pages/' || i || '%20+.html' WHEN 1 THEN 'file:///srv/my%20pages/a+b%2Bc-' || i || '.html'
           WHEN 2 THEN 'FILE://localhost/srv/%C3%A9-' || i || '.html' WHEN 3 THEN 'notes:' || i || '.txt'
           WHEN 4 THEN 'file:/srv/100%/' || i || '.html' ELSE url END AS path,
         CASE m WHEN 0 THEN '/srv/pages/' || i || '%20+.html' WHEN 1 THEN '/srv/my pages/a+b+c-' || i || '.html'
           WHEN 2 THEN '/srv/é-' || i || '.html' WHEN 4 THEN '/srv/100%/' || i || '.html' END AS lookup_path,
         CASE m WHEN 0 THEN i || '%20+.html' WHEN 1 THEN 'a+b+c-' || i || '.html' WHEN 2 THEN 'é-' || i || '.html'
           WHEN 3 THEN 'notes:' || i || '.txt' WHEN 4 THEN i || '.html' ELSE string_split(rtrim(url, '/'), '/')[-1] END AS name
  FROM d)
SELECT page_id, path, m NOT IN (3, 5) AS is_local, lookup_path, path AS strict_path,
       CASE WHEN m IN (3, 5) THEN 'Not a local file: ' || path END AS error_message, 'File not found: ' || name AS not_found
FROM p
"""

ORACLE["extension_route"] = """
WITH d AS (
  SELECT 'page-' || CAST(page_id AS VARCHAR) AS item, url AS path, CAST(NULL AS VARCHAR) AS declared_type FROM pages
  UNION ALL
  SELECT 'doc-' || CAST(doc_id AS VARCHAR),
         '/data/' || source || '/' || CAST(doc_id AS VARCHAR)
           || CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.heif' WHEN 3 THEN '.txt'
                              WHEN 4 THEN '' ELSE '.tar.gz' END,
         CASE doc_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/plain' END
  FROM documents),
u AS (
  SELECT item, path, declared_type,
         CASE WHEN regexp_extract(path, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) <> ''
              THEN regexp_replace(regexp_replace(path, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*:(//[^/]*)?', '')
              ELSE path END AS up
  FROM d),
e AS (
  SELECT item, declared_type,
         lower(nullif(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]\\.([^./]*)$', 1), '')) AS strict_ext,
         lower(nullif(regexp_extract(regexp_replace(up, '/+$', ''), '[^/]\\.([^./]*)$', 1), '')) AS lenient_ext
  FROM u)
SELECT item, strict_ext, lenient_ext,
       CASE WHEN strict_ext = 'pdf' THEN 'pdf'
            WHEN strict_ext IN ('png','jpg','jpeg','tiff','tif','gif','bmp','webp','heic','heif') THEN 'image'
            ELSE 'text' END AS strict_route,
       CASE WHEN declared_type = 'application/pdf' THEN 'pdf' WHEN declared_type LIKE 'image/%' THEN 'image'
            WHEN declared_type LIKE 'text/%' THEN 'text'
            WHEN lenient_ext = 'pdf' THEN 'pdf'
            WHEN lenient_ext IN ('png','jpg','jpeg','tiff','tif','heic','webp','bmp','gif') THEN 'image'
            ELSE 'text' END AS lenient_route,
       CASE WHEN item LIKE 'doc-%' THEN CASE WHEN CAST(item[5:] AS BIGINT) % 6 = 0 THEN 'pdf' ELSE 'image' END
            WHEN lenient_ext = 'pdf' THEN 'pdf' ELSE 'image' END AS lenient_ocr_route
FROM e
"""

ORACLE["missing_files"] = f"""
SELECT doc_id, l.doc_id IS NOT NULL AS exists,
       CASE WHEN l.doc_id IS NULL THEN 'File not found: ' || {DOC_PATH} END AS strict_message,
       CASE WHEN l.doc_id IS NULL THEN 'File not found: ' || CAST(doc_id AS VARCHAR) || '.txt' END AS lenient_message
FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
"""

ORACLE["missing_only"] = f"""
SELECT doc_id, {DOC_PATH} AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""

ORACLE["extraction_lookup"] = """
WITH d AS (SELECT d.doc_id, d.text, l.quality, '/img/' || CAST(d.doc_id AS VARCHAR) || '.png' AS path,
                  CASE WHEN l.doc_id IS NULL THEN 'No extraction result for this path'
                       WHEN l.quality = 0 THEN 'low quality scan' END AS msg
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN msg IS NULL THEN text END AS text,
       CASE WHEN msg IS NOT NULL THEN 'Failed to extract text from ''' || path || ''': ' || msg END AS strict_message,
       msg AS lenient_message
FROM d
"""

ORACLE["top_candidate"] = f"""
WITH d AS (
  SELECT doc_id, '/img/' || CAST(doc_id AS VARCHAR) || '.png' AS path,
         list_filter(list_transform(string_split(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END, chr(10)),
                                    lambda l: list_filter(string_split(l, ' '), lambda w: w <> '')[1]),
                     lambda x: x IS NOT NULL) AS lines
  FROM documents),
t AS (SELECT doc_id, path, lines, array_to_string(lines, chr(10)) AS j FROM d)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines,
       CASE WHEN trim(CASE WHEN len(lines) > 0 THEN j || chr(10) ELSE '' END, {WS_SQL}) <> ''
            THEN CASE WHEN len(lines) > 0 THEN j || chr(10) ELSE '' END END AS strict_text,
       CASE WHEN trim(CASE WHEN len(lines) > 0 THEN j || chr(10) ELSE '' END, {WS_SQL}) = ''
            THEN 'Failed to extract text from ''' || path || ''': Image contains no recognizable text' END AS strict_error,
       CASE WHEN trim(j, {WS_SQL}) <> '' THEN j END AS lenient_text,
       CASE WHEN trim(j, {WS_SQL}) = '' THEN 'No text recognized in image' END AS lenient_error
FROM t
"""

# --------------------------------------------------------------------------
# storage round trips
# --------------------------------------------------------------------------
ORACLE["publish_readback"] = ORACLE["payload_by_source"]

ORACLE["quarantine_readback"] = f"""
SELECT doc_id, 'IoError' AS kind, {DOC_PATH} AS path,
       'Failed to read file ''' || {DOC_PATH} || ''': stream did not contain valid UTF-8' AS message
FROM documents WHERE doc_id % 10 = 0
"""

ORACLE["scan_and_decode"] = """
SELECT doc_id,
       CAST(CASE WHEN doc_id % 7 = 3 THEN -1 WHEN doc_id % 10 = 0 THEN 0 ELSE strlen(text) END AS BIGINT) AS n_bytes,
       CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 10 = 0 THEN '' ELSE text END AS text,
       CASE WHEN doc_id % 7 = 3 THEN 'FileNotFound' END AS error_kind
FROM documents
"""

ORACLE["stream_ingest"] = f"""
SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN text END AS text,
       CASE WHEN doc_id % 13 = 0 THEN 'BinaryFile' END AS kind,
       CASE WHEN doc_id % 13 = 0 THEN 'Cannot read binary file: ' || {DOC_PATH} END AS message
FROM documents
"""

ORACLE["extractor_hook"] = """
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_pages, ltrim(text, chr(10)) AS text
FROM documents
"""

ORACLE["mixed_manifest"] = """
WITH g AS (
  SELECT source AS run_id, count(*) AS n_files, count(*) FILTER (WHERE doc_id % 29 = 0) AS n_failed,
         min(doc_id) FILTER (WHERE doc_id % 29 = 0) AS bad,
         string_agg(CASE WHEN doc_id % 5 = 1 THEN text || chr(10) ELSE text END, chr(10) ORDER BY doc_id) AS p
  FROM documents GROUP BY source)
SELECT run_id, n_files, n_failed,
       CAST(CASE WHEN n_failed = 0 THEN strlen(p) ELSE 0 END AS BIGINT) AS n_bytes,
       CASE WHEN n_failed = 0 THEN p END AS payload,
       CASE WHEN n_failed > 0 THEN 'FileNotFound' END AS error_kind,
       CASE WHEN n_failed > 0 THEN 'File not found: /data/' || run_id || '/' || CAST(bad AS VARCHAR)
            || CASE bad % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.txt' END END AS error_message
FROM g
"""

ORACLE["stream_latest"] = """
SELECT CAST(conv_id AS VARCHAR) AS run_id, max_by(text, turn) AS payload, max(turn) AS last_ord, count(*) AS n_ok
FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id
"""

ORACLE["single_selection"] = f"""
WITH s AS (
  SELECT CAST(conv_id AS VARCHAR) || '/' || role AS run_id, count(*) AS n_files,
         min_by(CASE WHEN turn % 5 = 4 THEN ' ' || chr(10) ELSE text END, turn) AS t,
         min_by('/conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt', turn) AS p
  FROM conversations GROUP BY conv_id, role)
SELECT run_id,
       CASE WHEN n_files = 1 AND trim(t, {WS_SQL}) <> '' THEN t END AS payload,
       CAST(CASE WHEN n_files = 1 AND trim(t, {WS_SQL}) <> '' THEN strlen(t) ELSE 0 END AS BIGINT) AS n_bytes,
       n_files,
       CASE WHEN n_files > 1 THEN 'Please select only one file'
            WHEN trim(t, {WS_SQL}) = '' THEN 'File is empty' END AS message,
       CASE WHEN n_files > 1 THEN 'Please select only one file'
            WHEN trim(t, {WS_SQL}) = '' THEN 'File is empty' ELSE 'Copied contents to clipboard' END AS summary
FROM s
"""

ORACLE["empty_runs"] = f"""
WITH g AS (
  SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS p FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS run_id,
       CASE WHEN conv_id % 10 = 0 THEN 0 ELSE n END AS n_files,
       CAST(CASE WHEN conv_id % 10 = 0 THEN 0 ELSE strlen(p) END AS BIGINT) AS n_bytes,
       CASE WHEN conv_id % 10 = 0 THEN 'NoFilesSpecified' END AS error_kind,
       CASE WHEN conv_id % 10 = 0 THEN 'No files specified' END AS error_message,
       CASE WHEN conv_id % 10 = 0 THEN 'No file selected' WHEN n > 1 THEN 'Please select only one file'
            WHEN trim(p, {WS_SQL}) = '' THEN 'File is empty' END AS lenient_message
FROM g
"""

ORACLE["pdf_without_ocr"] = """
SELECT doc_id, source,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'embedded' END AS text_from,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text,
       CASE WHEN doc_id % 3 = 0 THEN 'Failed to extract text from ''/data/' || source || '/' || CAST(doc_id AS VARCHAR)
            || '.pdf'': PDF contains no extractable text' END AS error_message
FROM documents
"""

# Of 13 files: 0 starts with NULs and has odd length (binary), 1 is empty, 2 is blank, 5 is a PDF,
# 6 an image without results, the others texts; over 8192 bytes is too large.
ORACLE["stream_files"] = """
WITH d AS (
  SELECT doc_id % 13 AS m, text, CAST(doc_id AS VARCHAR) || CASE doc_id % 13 WHEN 5 THEN '.pdf' WHEN 6 THEN '.png' ELSE '.txt' END AS name,
         CASE doc_id % 13 WHEN 0 THEN strlen(text) + 1 + strlen(text) % 2 WHEN 1 THEN 0 WHEN 2 THEN 2
              WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE strlen(text) END AS size
  FROM documents)
SELECT name, CASE m WHEN 5 THEN 'pdf' WHEN 6 THEN 'image' ELSE 'text' END AS route,
       CASE WHEN size <= 8192 AND m NOT IN (0, 1, 2, 6) THEN text END AS text,
       CASE WHEN size > 8192 THEN 'fileTooLarge' WHEN m = 0 THEN 'binaryFile' WHEN m IN (1, 2) THEN 'empty'
            WHEN m = 6 THEN 'extractionFailed' END AS kind,
       CASE WHEN size > 8192 THEN 'File too large (' || CAST(size // 1048576 AS VARCHAR) || 'MB): ' || name WHEN m = 0 THEN 'Binary file: ' || name
            WHEN m IN (1, 2) THEN 'File is empty' WHEN m = 6 THEN 'file content unavailable' END AS message
FROM d
"""

ORACLE["workflow_notifications"] = """
WITH e AS (
  SELECT conv_id, turn, text,
         CASE WHEN turn % 2 = 1 THEN '/conv/' || CAST(conv_id AS VARCHAR) || '/' || repeat('deep/', 20)
                   || CAST(turn AS VARCHAR) || '.txt'
              ELSE '/conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt' END AS path
  FROM conversations),
n AS (
  SELECT conv_id, turn, text,
         CASE WHEN turn % 4 = 3 THEN 'Not a file: ' || path
              WHEN turn % 3 = 2 THEN 'Cannot read binary file: ' || path END AS m
  FROM e),
w AS (SELECT conv_id, max_by(text, turn) FILTER (WHERE turn % 4 <> 3 AND turn % 3 <> 2) AS last_payload
      FROM conversations GROUP BY conv_id)
SELECT CAST(n.conv_id AS VARCHAR) AS run_id, turn AS ord,
       CASE WHEN m IS NULL THEN 'Copied contents to clipboard'
            WHEN length(m) > 100 THEN left(m, 97) || '...' ELSE m END AS notice,
       w.last_payload
FROM n JOIN w ON w.conv_id = n.conv_id
"""

ORACLE["payload_segments"] = """
WITH g AS (
  SELECT source AS run_id, count(*) AS n_files, string_agg(text, chr(10) ORDER BY doc_id) AS payload,
         sum(strlen(text) + 64) - max_by(strlen(text) + 64, doc_id) AS before_last
  FROM documents GROUP BY source)
SELECT run_id, n_files, CAST(strlen(payload) AS BIGINT) AS n_bytes, CAST(strlen(payload) AS BIGINT) AS segment_bytes, payload,
       before_last >= 4096 AS split
FROM g
"""

ORACLE["custom_store"] = ORACLE["payload_by_source"]

ORACLE["lenient_selection"] = f"""
WITH d AS (
  SELECT doc_id AS i, text, CAST(doc_id AS VARCHAR) AS run_id,
         CAST(doc_id AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.txt' END AS name
  FROM documents),
r AS (
  SELECT run_id, name,
         CASE WHEN i % 29 = 0 THEN 'fileNotFound' WHEN i % 31 = 3 THEN 'fileTooLarge' END AS refused,
         CASE WHEN i % 5 > 1 THEN CASE WHEN i % 7 = 2 THEN ' ' || chr(10) ELSE text END
              WHEN i % 5 = 0 AND i % 10 <> 0 AND i % 20 <> 5 THEN text
              ELSE 'seen ' || run_id END AS t
  FROM d),
o AS (
  SELECT run_id, name, t, coalesce(refused, CASE WHEN trim(t, {WS_SQL}) = '' THEN 'empty' END) AS error_kind FROM r)
SELECT run_id, CASE WHEN error_kind IS NULL THEN t END AS payload,
       CAST(CASE WHEN error_kind IS NULL THEN strlen(t) ELSE 0 END AS BIGINT) AS n_bytes,
       CASE error_kind WHEN 'fileNotFound' THEN 'File not found: ' || name WHEN 'fileTooLarge' THEN 'File too large (60MB): ' || name
            WHEN 'empty' THEN 'File is empty' ELSE 'Copied contents to clipboard' END AS summary, error_kind
FROM o
UNION ALL SELECT 'nothing', NULL, 0, NULL, 'noSelection'
"""

ORACLE["no_recognizer"] = """
WITH d AS (
  SELECT doc_id, text, '/sel/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN '.pdf' ELSE '.png' END AS path
  FROM documents WHERE doc_id % 5 < 2),
e AS (
  SELECT *, doc_id % 29 <> 0 AND doc_id % 5 = 0 AND doc_id % 10 <> 0 AS good,
         CASE WHEN doc_id % 29 = 0 THEN 'File not found: ' || path
              WHEN doc_id % 10 = 0 THEN 'Failed to extract text from ''' || path || ''': PDF contains no extractable text' END AS same
  FROM d)
SELECT doc_id, CASE WHEN good THEN text END AS none_text, CASE WHEN good THEN text END AS helper_text,
       coalesce(same, CASE WHEN doc_id % 5 = 1 THEN 'Failed to extract text from ''' || path || ''': OCR is only supported on macOS' END) AS none_message,
       coalesce(same, CASE WHEN doc_id % 5 = 1 THEN 'Failed to extract text from ''' || path
                || ''': OCR helper ''ocr-helper'' not found. Install it alongside the tool.' END) AS helper_message
FROM e
"""

ORACLE["pdf_gate_ocr"] = """
WITH d AS (SELECT o_orderkey AS k, '/orders/' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS path FROM orders),
m AS (
  SELECT k, path, 'Failed to extract text from ''' || path || ''': OCR failed: Error: ' AS pre,
         CASE WHEN k % 5 = 0 THEN 'Could not open PDF: ' || path || chr(10) || 'The file may be corrupted or inaccessible.'
              WHEN k % 3 = 0 THEN 'PDF is password-protected' WHEN k % 7 = 0 THEN 'PDF has no pages' END AS pdf,
         CASE WHEN k % 5 = 0 THEN 'Could not load image: ' || path WHEN k % 4 = 0 THEN 'Could not convert image to CGImage' END AS strict_m,
         CASE WHEN k % 5 = 0 THEN 'Could not load image' WHEN k % 4 = 0 THEN 'Could not convert image' END AS lenient_image
  FROM d)
SELECT k AS o_orderkey, pre || pdf AS pdf_message, pre || strict_m AS strict_image, lenient_image FROM m
"""

ORACLE["publish_file_bytes"] = """
SELECT doc_id, CAST(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE strlen(text) END AS BIGINT) AS n_bytes,
       CASE WHEN doc_id % 10 <> 0 THEN text END AS payload, CASE WHEN doc_id % 10 = 0 THEN 'IoError' END AS error_kind
FROM documents
"""

ORACLE["pages_segments"] = f"""
SELECT s.conv_id, s.text AS strict_text, l.text AS lenient_text
FROM ({ORACLE["pages_ocr_strict"]}) s JOIN ({ORACLE["pages_ocr_lenient"]}) l ON l.conv_id = s.conv_id
"""

# Which calls fail, and how, is the query's rule on ids.
ORACLE["extractor_isolation"] = """
WITH d AS (
  SELECT doc_id, text, 'Failed to extract text from ''/data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt'': Failed to extract page ' AS pre,
         CASE WHEN doc_id % 17 = 3 THEN '3: extractor raised ValueError: cannot read ' || CAST(doc_id AS VARCHAR)
              WHEN doc_id % 23 = 5 THEN '1: extractor died (exit code 3)'
              WHEN doc_id % 101 = 7 THEN '1: extractor timed out after 1.5 s' END AS failed
  FROM documents)
SELECT doc_id, CASE WHEN failed IS NULL THEN ltrim(text, chr(10)) END AS text, pre || failed AS error_message,
       coalesce(failed LIKE '%timed out%', false) AS late
FROM d
"""

# DuckDB's own grapheme functions, not the engine's expression.
ORACLE["notification_graphemes"] = """
WITH m AS (
  SELECT doc_id, replace(replace(replace(replace(text, 'e', 'e' || chr(769) || chr(803)), 'o', chr(127465) || chr(127466)),
                 'a', chr(128104) || chr(8205) || chr(128105) || chr(8205) || chr(128103)), 't', chr(128077) || chr(127997)) AS m
  FROM documents)
SELECT doc_id, CASE WHEN length_grapheme(m) > 100 THEN left_grapheme(m, 97) || '...' ELSE m END AS notice FROM m
"""
