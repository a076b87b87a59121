"""URL filters: rules first, then gradient-boosted trees over lexical features of the url.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; its path goes on up to ``?``, ``#`` or the end. A rule (verdict, host, path) fits
its host and all subdomains where the path starts with the rule's; of the rules that fit, the
longest (host and path together) wins, then the longer host, then the earlier in the list.

A url without a rule is judged by trees trained on the urls that have one. Features are
lengths, depth, host labels, digit ratio, character entropy, parameter counts, escapes and
hyphens, and statistics of the host's last label and last two labels: how many of a part of the
labelled urls with that ending are blocked, and how many there are; the trees are grown on the
other part, so no url is judged by its own label. Features are binned at quantiles; each level of
a tree is one aggregate of integer gradients by (node, feature, bin), so the same rows give the
same trees in any order; splits are chosen from that table of ``TREES x bins`` size.

Only DataFrame functions: no Python worker takes part. The fit takes about ``max_labelled``
labelled urls, those of the smallest hashes (a documented bound); every url is judged.

Defined results: a null url or one without ``://`` has an empty host and path; null and repeated
page ids are judged row by row; without labelled urls everything is allowed, with labels of one
kind everything gets that kind; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from .common import column, only, read, spool

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled urls that the fit takes (about), and the hash buckets by which they are chosen.
MAX_LABELLED, BUCKETS = 20_000, 4096
TREES, DEPTH, BINS, RATE, L2 = 12, 3, 16, 0.4, 1.0
#: Weight of the overall share in an ending's share.
PRIOR = 8.0
#: Gradients are summed as multiples of 2^-24.
UNIT = 1 << 24
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "escapes", "hyphens")
ENDINGS = ("label", "site")
FEATURES = (*LEXICAL, *[f"{e}_{s}" for e in ENDINGS for s in ("share", "seen")])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule (host and path as one string) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][1] + rules[i][2]), len(rules[i][1]), -i))
    for what, of, start in (rules[i] for i in order):     # the last that fits stands
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def _entropy(url: Column) -> Column:
    """Bits a character, all characters outside printable ASCII counted as one."""
    plain, n = F.regexp_replace(url, "[^\\x20-\\x7E]", "\u0001"), F.length(url).cast("double")

    def term(c: Column) -> Column:
        k = (F.length(plain) - F.length(F.replace(plain, c, F.lit("")))).cast("double")
        return k * F.log2(n / k)

    # An empty string splits into one empty piece, which counts no character.
    kinds = F.filter(F.array_distinct(F.split(plain, "")), lambda c: c != "")
    return F.when(n > 0, F.aggregate(kinds, F.lit(0.0), lambda sum_, c: sum_ + term(c)) / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    length = F.length(url).cast("double")
    return dict(zip(LEXICAL, (
        length, F.length(host).cast("double"), F.length(path).cast("double"), _count(path, "/"),
        F.size(F.split(host, "\\.")).cast("double"), F.when(length > 0, _count(url, "[0-9]") / length).otherwise(0.0), _entropy(url),
        _count(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), "="), _count(url, "%"), _count(url, "-"))))


def _featured(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rows`` (page_id, url) with host, path, rule, ruling, the endings and the lexical features."""
    host, path = parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, ruling = ruled(F.col("host"), F.col("path"), rules)
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    url = F.coalesce(F.col("url"), F.lit(""))
    return rows.withColumns({"rule": rule, "ruling": ruling, "label": F.substring_index(bare, ".", -1), "site": F.substring_index(bare, ".", -2),
                             **lexical(url, F.col("host"), F.col("path"))})


@dataclass
class Model:
    """Trees as {heap index: (feature, bin) or leaf value}; ``edges`` of each feature's bins; ``stats`` of the endings."""

    base: float
    share: float = 0.0
    edges: list[list[float]] = field(default_factory=list)
    trees: list[dict] = field(default_factory=list)
    stats: dict[str, DataFrame] = field(default_factory=dict)


def _walk(tree: dict, above, node: int = 0, leaf=lambda tree, node: F.lit(tree[node])) -> Column:
    """The tree as an expression: ``above(feature, bin)`` tells whether a row goes right."""
    at = tree.get(node)
    if not isinstance(at, tuple):
        return leaf(tree, node)
    return F.when(above(*at), _walk(tree, above, 2 * node + 2, leaf)).otherwise(_walk(tree, above, 2 * node + 1, leaf))


def _with_stats(rows: DataFrame, stats: dict[str, DataFrame], share: float) -> DataFrame:
    for e in ENDINGS:       # at most one row for each labelled url of the sample: bounded
        rows = rows.join(F.broadcast(stats[e]), e, "left").withColumns({
            f"{e}_share": F.coalesce(F.col(f"{e}_share"), F.lit(share)), f"{e}_seen": F.coalesce(F.col(f"{e}_seen"), F.lit(0.0))})
    return rows


def _best(sums: dict) -> tuple | None:
    """The split (gain, feature, bin, left value, right value) of a node from its (feature, bin) sums of gradient and curvature."""
    best = None
    for f in sorted({f for f, _ in sums}):
        bins = sorted(b for g, b in sums if g == f)
        total = [sum(sums[f, b][i] for b in bins) / UNIT for i in (0, 1)]
        left = [0.0, 0.0]
        for b in bins[:-1]:
            left = [left[i] + sums[f, b][i] / UNIT for i in (0, 1)]
            right = [total[i] - left[i] for i in (0, 1)]
            gain = sum(g * g / (h + L2) for g, h in (left, right)) - total[0] ** 2 / (total[1] + L2)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, b, *[-RATE * g / (h + L2) for g, h in (left, right)]
    return best


def _grow(data: DataFrame) -> dict:
    """One tree on ``data`` (bins, y, w, margin), by level."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    rows = data.withColumns({"g": F.round((p - F.col("y")) * UNIT).cast("bigint") * F.col("w"), "h": F.round(p * (1 - p) * UNIT).cast("bigint") * F.col("w")})
    tree: dict = {}
    for level in range(DEPTH):
        node = _walk(tree, lambda f, b: F.col("bins")[f] > b, leaf=lambda t, n: F.lit(None if n in t else n).cast("int"))
        table = (rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("f", "b")).where("node is not null")
                 .groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())     # 2^level x features x bins rows
        sums: dict = {}
        for r in table:
            sums.setdefault(r["node"], {})[r["f"], r["b"]] = (r["g"], r["h"])
        for n in sorted(sums):
            split = _best(sums[n])
            if split is None:
                some = [v for (f, _), v in sums[n].items() if f == 0]
                tree.setdefault(n, -RATE * sum(g for g, _ in some) / (sum(h for _, h in some) + L2 * UNIT))
            else:
                _, f, b, low, high = split
                tree[n] = (f, b)
                if level == DEPTH - 1:
                    tree[2 * n + 1], tree[2 * n + 2] = low, high
        if not any(isinstance(tree.get(n), tuple) for n in sums):
            break
    return tree


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """``labelled``: page_id, url, y (1: block), the endings and the lexical features."""
    bucket = F.pmod(F.xxhash64("url", "page_id"), F.lit(BUCKETS))
    held = dict(labelled.groupBy(bucket.alias("b")).count().collect())      # BUCKETS rows
    most, total = 0, 0
    for b in range(BUCKETS):
        total += held.get(b, 0)
        if total > max_labelled and total > held.get(b, 0):
            break
        most = b + 1
    sample = spool(labelled.where(bucket < most).withColumn("half", F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)))
                   .select("y", "half", *ENDINGS, *LEXICAL), "labelled_urls")
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n == 0 or blocked in (0, n):
        return Model(20.0 if n and blocked else -20.0)
    share = blocked / n
    stats = {e: sample.where("half = 0").groupBy(e).agg(((F.sum("y") + PRIOR * share) / (F.count("*") + PRIOR)).alias(f"{e}_share"),
                                                       F.log1p(F.count("*")).alias(f"{e}_seen")) for e in ENDINGS}
    model = Model(0.0, share, stats={e: spool(t, "url_endings") for e, t in stats.items()})
    rows = _with_stats(sample.where("half = 1"), model.stats, share)
    cuts = [(i + 1) / BINS for i in range(BINS - 1)]
    edges = rows.agg(*[F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES]).first()
    if edges[0] is None:
        return Model(-20.0 if share < 0.5 else 20.0)
    model.edges = [sorted(set(edges[f])) for f in FEATURES]
    bins = F.array(*[sum(((F.col(f) > e).cast("int") for e in cut), F.lit(0)) for f, cut in zip(FEATURES, model.edges)])
    data = spool(rows.select("y", bins.alias("bins")).groupBy("y", "bins").agg(F.count("*").alias("w")), "url_bins")
    pos, neg = data.agg(F.sum(F.col("y") * F.col("w")), F.sum((1 - F.col("y")) * F.col("w"))).first()
    model.base = log((pos + 0.5) / (neg + 0.5))
    margin = F.lit(model.base)
    for _ in range(TREES):
        # At most one row for each labelled url of the sample: one partition, so no level's aggregate shuffles.
        data = spool(data.withColumn("margin", margin).coalesce(1), "url_margins").coalesce(1)
        model.trees.append(_grow(data))
        margin = F.col("margin") + _walk(model.trees[-1], lambda f, b: F.col("bins")[f] > b)
    return model


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block) of every row."""
    rows = _featured(only(pages, page_id=page_id, url=column(pages, url).cast("string")), rules)
    labelled = rows.where("ruling is not null").withColumn("y", (F.col("ruling") == "block").cast("int"))
    model = fit(labelled, max_labelled)
    if model.trees:
        rows = _with_stats(rows, model.stats, model.share)
    margin = sum((_walk(tree, lambda f, b: F.col(FEATURES[f]) > model.edges[f][b]) for tree in model.trees), F.lit(model.base))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-margin)))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "score")


def op11_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
