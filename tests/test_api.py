"""The public surface named in the survey (§2.13) and documented in the README."""

from textbarge import api

SURVEY_STEPS = ["read_manifest", "scan_files", "validate", "route", "decode_text", "attach_pages",
                "assemble_pages", "build_payload", "publish", "quarantine", "stream_ingest"]
DOCUMENTED = ["probe_inventory", "with_lookup_path", "validation_error", "route_entries", "expand_pages",
              "assemble_embedded", "assemble_ocr", "assemble_image", "embedded_or_ocr", "lookup_extraction",
              "run_extractor", "outcome_rollup", "read_payload", "decode_stream", "start_ingest", "start_latest",
              "read_latest", "file_stream", "run_job", "JobInputs", "publish_file", "read_bytes"]


def test_survey_steps_exist():
    assert [n for n in SURVEY_STEPS if not callable(getattr(api, n, None))] == []


def test_documented_helpers_exist():
    assert [n for n in DOCUMENTED if not callable(getattr(api, n, None))] == []


def test_route_step(spark):
    df = spark.createDataFrame([("a.pdf", None), ("b.png", None), ("c", "text/plain")], "path string, declared_type string")
    assert [r.route for r in api.route(df, "lenient").collect()] == ["pdf", "image", "text"]
