"""Small tables with awkward rows: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

EXTRA = "hit string, score double, fp string, key string, n string, ids string, Statistics string, toxicity string, kept_id string, copies string, held string, id string, y string"
N_EXTRA = len(EXTRA.split(", "))
WORDS = "the of and thing other rest ereth onble anly shou kept house water light stone".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s", "ed", "ing"])) for _ in range(n))


def documents(spark, rows):
    """rows of (doc_id, text); every other column is null or clashes."""
    return spark.createDataFrame([(d, t, None, "s", None, *["x"] * 0, "h", 0.5, *["z"] * (N_EXTRA - 2)) for d, t in rows],
                                 f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


def awkward():
    long = prose(99, 30_000)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, prose(1, 50)), (5, prose(1, 50)), (5, prose(1, 50)), (6, long), (None, prose(2, 20)), (None, None),
            (7, "é ü 日本 " + prose(3, 30)), (-8, "One."), (9, "a  b\n c " + "x" * 5000), (10, prose(1, 50) + " end")]
