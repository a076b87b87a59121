"""Page assembly (G1-G17) against a sequential accumulator model, both profiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textbarge.operators.pages import assemble_embedded, assemble_image, assemble_ocr, expand_pages
from textbarge.profiles import LENIENT, STRICT, WHITESPACE_CHARS

PAGES_T = ("path string, page_idx int, embedded string, lines array<string>, error string, "
           "elapsed_ms bigint, width_pt double, height_pt double")
FACTS_T = "path string, open_error string, locked boolean, page_count int"


# ----------------------------------------------------------------- test models
def model_embedded(n, pages, strict):
    acc = ""
    for i in range(n):
        r = pages.get(i)
        if r is None or r[1] is not None:
            if strict:
                return None, f"page {i + 1}"
            continue
        if r[0] is None:
            if strict:
                r = ("", None)
            else:
                continue
        if acc:
            acc += "\n"
        acc += r[0]
    return acc, None


def model_ocr(n, pages, profile):
    cap = profile.page_cap
    count = min(n, cap) if cap else n
    pre, post = profile.page_separator.split("{n}")
    text, failed = [], []
    for i in range(count):
        r = pages.get(i)
        if r is None or r[1] is not None:
            failed.append(i + 1)
            continue
        if i > 0 and text:
            text += ["", f"{pre}{i + 1}{post}", ""]
        text += r[0]
    if profile.name == "strict":
        if failed:
            return None, "failed"
        if "\n".join(text).strip(WHITESPACE_CHARS) == "":
            return None, "blank"
        return "".join(x + "\n" for x in text), None
    res = "\n".join(text).strip(WHITESPACE_CHARS)
    if res == "":
        return None, "blank"
    if failed:
        res += "\n\n[Warning: Failed to process pages: " + ", ".join(map(str, failed)) + "]"
    if n > cap:
        res += f"\n\n[Warning: PDF truncated. Processed {cap} of {n} pages]"
    return res, None


def _random_docs(seed, n_docs=150):
    rnd = random.Random(seed)
    words = ["", " ", "a", "b c", "　", "x\ny", "\n", "z"]
    docs = {}
    for d in range(n_docs):
        n = rnd.choice([0, 1, 1, 2, 3, 4, 5, 6])
        pages = {}
        for i in range(n):
            u = rnd.random()
            if u < 0.1:
                continue  # missing page
            err = "boom" if u < 0.2 else None
            lines = [rnd.choice(words) for _ in range(rnd.choice([0, 0, 1, 2, 3]))]
            emb = rnd.choice(["", "", "t", " ", "p\nq", None])
            pages[i] = (lines, err, emb)
        docs[f"/d/{d}.pdf"] = (n, pages)
    return docs


def _frames(spark, docs, which):
    facts = spark.createDataFrame([(p, None, False, n) for p, (n, _) in docs.items()], FACTS_T)
    rows = []
    for p, (n, pages) in docs.items():
        for i, (lines, err, emb) in pages.items():
            rows.append((p, i, emb if which == "emb" else None, lines, err, 10, 612.0, 792.0))
    return facts, spark.createDataFrame(rows, PAGES_T)


@pytest.mark.parametrize("profile", [STRICT, LENIENT, LENIENT.with_(page_cap=3)], ids=["strict", "lenient", "cap3"])
def test_ocr_matches_model(spark, profile):
    docs = _random_docs(11)
    facts, pages = _frames(spark, docs, "ocr")
    got = {r.path: r for r in assemble_ocr(facts, pages, profile).collect()}
    for p, (n, pg) in docs.items():
        model_pages = {i: (lines, err) for i, (lines, err, _) in pg.items()}
        want, err = model_ocr(n, model_pages, profile)
        r = got[p]
        if n == 0:
            assert r.error is not None
            continue
        if err is None:
            assert r.error is None and r.text == want, (p, n, pg, r)
        else:
            assert r.text is None and r.error is not None, (p, n, pg, r)


@pytest.mark.parametrize("profile", [STRICT, LENIENT], ids=["strict", "lenient"])
def test_embedded_matches_model(spark, profile):
    docs = _random_docs(23)
    facts, pages = _frames(spark, docs, "emb")
    got = {r.path: r for r in assemble_embedded(facts, pages, profile).collect()}
    for p, (n, pg) in docs.items():
        model_pages = {i: (emb, err) for i, (_, err, emb) in pg.items()}
        want, err = model_embedded(n, model_pages, profile.name == "strict")
        r = got[p]
        if profile.name == "lenient" and n == 0:
            assert r.error is not None  # "PDF has no pages"
            continue
        if err is None:
            assert r.error is None and r.text == want, (p, n, pg, r)
        else:
            assert r.error is not None and r.text is None


def _one(spark, pages, n, profile, which="ocr"):
    facts = spark.createDataFrame([("/x.pdf", None, False, n)], FACTS_T)
    rows = [("/x.pdf", i, emb, lines, err, 10, 612.0, 792.0) for i, (emb, lines, err) in enumerate(pages)]
    pg = spark.createDataFrame(rows, PAGES_T)
    f = assemble_ocr if which == "ocr" else assemble_embedded
    return f(facts, pg, profile).first()


def test_g2_fixture(spark):
    r = _one(spark, [("", None, None), ("a", None, None), ("", None, None), ("b", None, None)], 4, STRICT, "emb")
    assert r.text == "a\n\nb"


def test_g6_fixture(spark):
    r = _one(spark, [(None, ["x"], None), (None, [], None), (None, ["y"], None)], 3, STRICT)
    assert r.text == "x\n\n--- Page 2 ---\n\n\n--- Page 3 ---\n\ny\n"
    r = _one(spark, [(None, [], None), (None, ["y"], None)], 2, STRICT)
    assert r.text == "y\n"


def test_failed_first_page(spark):
    pages = [(None, None, "vision error"), (None, ["y"], None)]
    r = _one(spark, pages, 2, STRICT)
    assert r.text is None
    assert r.error.message == ("Failed to extract text from '/x.pdf': OCR failed: Warning: OCR failed on page 1: "
                               "vision error\nError: 1 of 2 pages had errors")
    r = _one(spark, pages, 2, LENIENT)
    assert r.text == "y\n\n[Warning: Failed to process pages: 1]"


def test_truncation(spark):
    r = _one(spark, [(None, ["z"], None)] * 101, 101, LENIENT)
    assert r.text.endswith("\n\n[Warning: PDF truncated. Processed 100 of 101 pages]")
    assert r.text.count("══════════ Page") == 99
    assert r.n_pages == 100


def test_all_blank(spark):
    for prof in (STRICT, LENIENT):
        r = _one(spark, [(None, [], None), (None, [" "], None)], 2, prof)
        assert r.text is None and r.error is not None


def test_expand_pages(spark):
    facts = spark.createDataFrame([("/a", None, False, 3), ("/b", None, False, 0), ("/c", None, False, 5)], FACTS_T)
    got = sorted((r.path, r.page_idx) for r in expand_pages(facts, cap=4).collect())
    assert got == [("/a", 0), ("/a", 1), ("/a", 2), ("/c", 0), ("/c", 1), ("/c", 2), ("/c", 3)]


def test_image(spark):
    facts = spark.createDataFrame([("/i.png", None, 100, 100), ("/big.png", None, 10000, 10000),
                                   ("/blank.png", None, 10, 10), ("/slow.png", None, 10, 10)],
                                  "path string, open_error string, width_px int, height_px int")
    pages = spark.createDataFrame([("/i.png", 0, None, ["Hello, World!"], None, 5, None, None),
                                   ("/big.png", 0, None, ["x"], None, 5, None, None),
                                   ("/blank.png", 0, None, [], None, 5, None, None),
                                   ("/slow.png", 0, None, ["x"], None, 61000, None, None)], PAGES_T)
    s = {r.path: r for r in assemble_image(facts, pages, STRICT).collect()}
    le = {r.path: r for r in assemble_image(facts, pages, LENIENT).collect()}
    assert s["/i.png"].text == "Hello, World!\n" and le["/i.png"].text == "Hello, World!"
    assert le["/big.png"].error.kind == "imageTooLarge" and s["/big.png"].text == "x\n"
    assert le["/blank.png"].error.message == "No text recognized in image"
    assert s["/blank.png"].error.message.endswith("Image contains no recognizable text")
    assert le["/slow.png"].error.message == "OCR timed out: slow.png"


def test_output_limit_applies_to_final_text_not_estimate(spark):
    """30 leading blank pages then 'abc': the raw join has 30 leading separators,
    the text is 3 bytes; a 20-byte output limit must accept it (exact, at the payload)."""
    from textbarge.operators.payload import build_payload
    prof = LENIENT.with_(max_output_bytes=20)
    pages = [("", None, None)] * 30 + [("abc", None, None)]
    r = _one(spark, pages, 31, prof, "emb")
    assert r.error is None and r.text == "abc"
    d = spark.createDataFrame([("run", 0, "/x.pdf", r.text, None)],
                              "run_id string, ord int, path string, text string, "
                              "error struct<kind:string,path:string,message:string>")
    assert build_payload(d, prof, "single").first().payload == "abc"


@pytest.mark.parametrize("which", ["embedded", "ocr"])
@pytest.mark.parametrize("profile", [STRICT, LENIENT], ids=["strict", "lenient"])
def test_no_page_text_moves_by_path_alone(spark, which, profile):
    """With no broadcast anywhere (the large-scale path) and documents of many segments, page text
    crosses exchanges by (path, page) and (path, seg) only."""
    from plan_tools import exchanges_by
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = _random_docs(5, 30)
        facts, pages = _frames(spark, docs, "emb" if which == "embedded" else "ocr")
        df = (assemble_embedded if which == "embedded" else assemble_ocr)(facts, pages, profile.with_(segment_bytes=100))
        assert df.agg({"seg": "max"}).first()[0] > 0
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    below = exchanges_by(plan, "path")
    assert below and not any(re.search(r"listagg|\b(embedded|piece|lines|_t)#", x) for x in below)
    assert sum(1 for x in plan.splitlines() if "listagg" in x) > 0


def _joined(rows):
    """Each document's rows by path, with its text put together from the segments."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.seg)):
        if r.path in out:
            first, text = out[r.path]
            assert r.error is None and first.seg == 0 and text is not None
            out[r.path] = (first, text + r.text)
        else:
            out[r.path] = (r, r.text)
    return out


@pytest.mark.parametrize("segment", [1, 90, 200])
@pytest.mark.parametrize("profile", [STRICT, LENIENT, LENIENT.with_(page_cap=3)], ids=["strict", "lenient", "cap3"])
def test_documents_in_segments_match_the_model(spark, profile, segment):
    docs = _random_docs(31, 40)
    # Blank pages first and last, of several segments; a page that is there twice, once empty.
    docs["/lead.pdf"] = (4, {0: (["  "] * 60, None, " " * 130), 1: (["\u2003"], None, ""), 2: (["x "], None, "x "), 3: ([" "] * 90, None, "\n" * 150)})
    docs["/blank.pdf"] = (1, {0: ([" "] * 200, None, "\n" * 300)})
    for kind in ("ocr", "emb"):
        facts, pages = _frames(spark, docs, kind)
        run = assemble_ocr if kind == "ocr" else assemble_embedded
        got = _joined(run(facts, pages, profile.with_(segment_bytes=segment)).collect())
        assert got.keys() == docs.keys()
        for path, (n, pg) in docs.items():
            first, text = got[path]
            if n == 0:
                continue
            if kind == "ocr":
                want, err = model_ocr(n, {i: (lines, e) for i, (lines, e, _) in pg.items()}, profile)
            else:
                want, err = model_embedded(n, {i: (emb, e) for i, (_, e, emb) in pg.items()}, profile.name == "strict")
            assert (first.error is None) == (err is None) and text == (want if err is None else None), (path, n, pg)


@pytest.mark.parametrize("profile", [STRICT, LENIENT], ids=["strict", "lenient"])
def test_a_repeated_first_page_may_be_empty(spark, profile):
    facts = spark.createDataFrame([("/d.pdf", None, False, 2)], FACTS_T)
    pages = spark.createDataFrame([("/d.pdf", i, t, t.split(), None, 1, 1.0, 1.0) for i, t in ((0, ""), (0, "x"), (1, "z"))], PAGES_T)
    for segment in (1, 1 << 20):
        prof = profile.with_(segment_bytes=segment)
        assert _joined(assemble_embedded(facts, pages, prof).collect())["/d.pdf"][1] == "x\nz"
        assert _joined(assemble_ocr(facts, pages, prof).collect())["/d.pdf"][1].startswith("x\n\n")


def test_embedded_or_ocr_without_ocr_table(spark):
    """OCR available but no OCR results table: a blank PDF's pages are all missing."""
    from textbarge.operators.pages import embedded_or_ocr
    facts = spark.createDataFrame([("/b.pdf", None, False, 1), ("/t.pdf", None, False, 1)], FACTS_T)
    emb = spark.createDataFrame([("/b.pdf", 0, " ", None, None, 1, 1.0, 1.0), ("/t.pdf", 0, "text", None, None, 1, 1.0, 1.0)],
                                PAGES_T).select("path", "page_idx", "embedded", "error")
    got = {r.path: r for r in embedded_or_ocr(facts, emb, None, STRICT).collect()}
    assert got["/t.pdf"].text == "text"
    assert got["/b.pdf"].error.message.endswith("Warning: Could not access page 1\nError: 1 of 1 pages had errors")


@pytest.mark.parametrize("profile", [STRICT, LENIENT], ids=["strict", "lenient"])
def test_a_repeated_page_hides_no_gap(spark, profile):
    """Pages 0, 0 and 2 of 3: page 1 is missing, and strict fails on it."""
    from textbarge.operators.pages import blank_documents
    facts = spark.createDataFrame([("/d.pdf", None, False, 3)], FACTS_T)
    pages = spark.createDataFrame([("/d.pdf", i, t, [t], None, 1, 1.0, 1.0) for i, t in ((0, "x"), (0, "x"), (2, "z"))], PAGES_T)
    emb = assemble_embedded(facts, pages, profile).first()
    ocr = assemble_ocr(facts, pages, profile).first()
    if profile is STRICT:
        assert emb.error.message.endswith("Failed to extract page 2: page missing")
        assert ocr.error.message.endswith("Warning: Could not access page 2\nError: 1 of 3 pages had errors")
    else:
        assert emb.text == "x\nx\nz" and ocr.failed_list == "2"
    assert blank_documents(facts, pages, profile).count() == 0


def test_blank_documents_agree_with_the_assembled_text(spark):
    from textbarge.operators.pages import blank_documents
    facts, pages = _frames(spark, _random_docs(8, 60), "emb")
    for profile in (STRICT, LENIENT):
        want = {r.path for r in assemble_embedded(facts, pages, profile).where("blank").collect()}
        assert {r.path for r in blank_documents(facts, pages, profile).collect()} == want


def test_images_that_cannot_be_converted(spark):
    facts = spark.createDataFrame([("/a.png", None, "no bitmap", 1, 1)], "path string, open_error string, convert_error string, width_px int, height_px int")
    pages = spark.createDataFrame([("/a.png", 0, "", ["x"], None, 1, 1.0, 1.0)], PAGES_T)
    assert assemble_image(facts, pages, STRICT).first().error.message.endswith("OCR failed: Error: Could not convert image to CGImage")
    assert assemble_image(facts, pages, LENIENT).first().error.message == "Could not convert image"
