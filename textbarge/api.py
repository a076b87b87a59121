"""Public API: every step is ``DataFrame -> DataFrame`` and takes a profile."""

from .operators.concat import ordered_segments  # noqa: F401
from .operators.decode import decode_text  # noqa: F401
from .operators.pages import (assemble_embedded, assemble_image, assemble_ocr, attach_pages,  # noqa: F401
                              classify_pages, embedded_or_ocr, expand_pages, pdf_gate, top_candidates)
from .operators.payload import build_payload, outcome_rollup  # noqa: F401
from .operators.validate import missing_paths, open_error, selection_status, validation_error  # noqa: F401
from .plans.job import JobInputs, decode_entries, run_job  # noqa: F401
from .profiles import LENIENT, STRICT, Profile, get_profile  # noqa: F401
from .sources.extraction import lookup_extraction, read_page_results, run_extractor  # noqa: F401
from .sources.files import attach_decoded, materialize_files, probe_inventory, read_bytes, scan_files  # noqa: F401
from .sources.manifest import manifest_from_paths, read_manifest, split_inline, with_lookup_path  # noqa: F401
from .sources.sinks import publish, publish_file, quarantine, read_payload, read_quarantine  # noqa: F401
from .streaming.ingest import (compact_latest, decode_stream, file_stream, read_latest, start_drop_folder,  # noqa: F401
                               start_ingest, start_latest)


def route_entries(df, profile, path="path", declared_type="declared_type"):
    """R1-R7 as an operator: adds ``route``."""
    from .functions.route import route
    dt = df[declared_type] if declared_type in df.columns else None
    return df.withColumn("route", route(df[path], profile, dt))


def validate(df, profile, path="path"):
    """P1-P6 as an operator: adds ``error``, the first failing check."""
    return df.withColumn("error", validation_error(profile, path))


assemble_pages = embedded_or_ocr
stream_ingest = start_ingest
route = route_entries
