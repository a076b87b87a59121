"""Quickstart: a manifest of local files (and one inline entry) to published payloads.

    python examples/quickstart.py

Writes a few files into a fresh folder, runs the strict job, publishes the
payload table and prints what was published. On a cluster the same calls take
shared-storage URIs and ``spark.checkpoint.dir`` comes from the session.
"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textbarge import api, schemas  # noqa: E402
from textbarge.session import get_session  # noqa: E402


def main() -> None:
    root = tempfile.mkdtemp(prefix="textbarge-quickstart-")
    os.makedirs(f"{root}/inbox")
    with open(f"{root}/inbox/a.txt", "wb") as f:
        f.write(b"Hello, world!\nThis is a test file.")
    with open(f"{root}/inbox/b.bin", "wb") as f:
        f.write(bytes.fromhex("48656C006F"))
    open(f"{root}/inbox/empty.txt", "wb").close()

    spark = get_session("local[4]", shuffle_partitions=4, extra={"spark.checkpoint.dir": f"{root}/ckpt"})
    rows = [("run1", 0, f"{root}/inbox/a.txt", None, None), ("run1", 1, f"{root}/inbox/empty.txt", None, None),
            ("run2", 0, f"{root}/inbox/b.bin", None, None), ("run3", 0, "-", "hello from stdin", None)]
    spark.createDataFrame(rows, schemas.MANIFEST).write.parquet(f"{root}/manifests")

    manifest = api.read_manifest(spark, f"{root}/manifests")
    inventory = api.probe_inventory(api.with_lookup_path(manifest))
    files = api.scan_files(spark, f"{root}/inbox/", max_bytes=50 * 1024 * 1024)
    decoded, payload = api.run_job(api.JobInputs(manifest, inventory, files), "strict", "fail_fast")
    api.publish(payload, f"{root}/payload")
    api.quarantine(decoded, f"{root}/quarantine")
    for r in api.read_payload(spark, f"{root}/payload").orderBy("run_id").collect():
        print(r.run_id, repr(r.payload), "|", r.summary or r.error.message)


if __name__ == "__main__":
    main()
