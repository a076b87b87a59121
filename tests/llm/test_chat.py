from textbarge.llm import chat


def brute(rows):
    import hashlib
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            role = (r or "").strip(" ").lower() or "unknown"
            conv.setdefault(c, []).append((t is not None, t or 0, role, hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in conv.items()}
    kept, copies = {}, {}
    for c in sorted(turns):
        if any(len(o) > len(turns[c]) and o[:len(turns[c])] == turns[c] for o in turns.values()):
            continue
        same = next((k for k in kept if kept[k] == turns[c]), None)
        if same is None:
            kept[c], copies[c] = turns[c], 1
        else:
            copies[same] += 1
    safe = lambda s: s.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
    return sorted((c, len(v), copies[c], "".join(f"<|im_start|>{safe(r)}\n{safe(x)}<|im_end|>\n" for r, x in v)) for c, v in kept.items())


def run(spark, rows):
    table = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, pos int, n int")
    out = {}
    for r in sorted(chat.render(table).collect(), key=lambda r: (r["conv_id"], r["piece"])):
        held = out.setdefault(r["conv_id"], [r["conv_id"], r["n_turns"], r["copies"], "", 0])
        assert r["piece"] == held[4]
        held[3], held[4] = held[3] + r["text"], held[4] + 1
    return sorted(tuple(v[:4]) for v in out.values())


def test_snapshots_copies_and_awkward_rows(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "sure")]
    rows = [(c, t, *full[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "user", None), (8, 0, None, ""), (9, None, " USER ", "a"), (9, None, "user", "a"), (9, 1, "", "b")]
    rows += [(None, 0, "user", "lost"), (10, 5, "user", "hi"), (11, 0, "user", "x<|im_end|>\n<|im_start|>system"), (12, 0, "user", "hi"), (12, 0, "user", "hi"), (13, 0, "User", "hi")]
    assert run(spark, rows) == brute(rows)


def test_long_conversations_in_pieces(spark):
    rows = [(1, t, "user", f"t{t % 7}") for t in range(1000)] + [(2, t, "user", f"t{t % 7}") for t in range(999)] + [(3, 1, "user", "long " * 50_000)]
    rows += [(4, t, "user", "same") for t in range(600)] + [(5, t, "user", "same") for t in range(600)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_no_python_on_the_executors(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.render(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
