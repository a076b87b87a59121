"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only.

A service that logs a conversation after every turn leaves many snapshots, each a prefix of
the next. Every turn has a hash of its place, role and text; a rolling exclusive-or over a
conversation's turns gives the hash of each of its prefixes (two 64-bit hashes together).
A conversation whose whole hash is that of a shorter prefix of another goes by an anti-join;
of equal conversations the one of the smallest id stays. What stays is rendered.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads
over many tasks: places and prefix hashes are running values inside a range plus what the
earlier ranges carry in. Only distinct prefixes are joined, so a first turn that very many
conversations share is one row. A rendered conversation comes in pieces of at most
``PIECE`` turns, in order; joining the pieces gives the whole.

Defined results: rows without a conversation id belong to no conversation; turns are in the
order of (turn, role, md5 of text), a null turn first; repeated rows are turns of their own;
a null or blank role is "unknown" and roles are lower-cased and trimmed; a null text is
empty; turn markers inside a text get a space after their "<", so no text can open or end
a turn; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import column, only, read, spool

#: Turns in a rendered piece.
PIECE = 256
OPEN, END = "<|im_start|>", "<|im_end|>"


def _rolling(value: Column) -> Column:
    return value.over(Window.partitionBy("part", "conv_id").orderBy("turn", "role", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _carried(value: Column) -> Column:
    """What the ranges before this one hold of the same conversation."""
    return value.over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def turns(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """part, conv_id, pos (from 1), role, text, h1, h2: the hash of the conversation up to each turn."""
    named = F.coalesce(F.nullif(F.lower(F.trim(column(table, role).cast("string"))), F.lit("")), F.lit("unknown"))
    rows = only(table, conv_id=conv_id, turn=turn, role=named, text=F.coalesce(column(table, text).cast("string"), F.lit(""))).where("conv_id is not null")
    order = ["conv_id", "turn", "role", "mark"]
    dealt = spool(rows.withColumn("mark", F.md5("text")).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = sizes.select("part", "conv_id", F.coalesce(_carried(F.sum("n")), F.lit(0)).alias("before"))
    placed = dealt.withColumn("pos", _rolling(F.count(F.lit(1)))).join(before, ["part", "conv_id"]).withColumn("pos", F.col("pos") + F.col("before")).drop("before")
    hashed = placed.withColumns({"g1": F.xxhash64("pos", "role", "text"), "g2": F.xxhash64("text", F.lit("second"), "role", "pos")})
    hashed = spool(hashed.withColumns({"h1": _rolling(F.bit_xor("g1")), "h2": _rolling(F.bit_xor("g2"))}), "placed")
    sums = hashed.groupBy("part", "conv_id").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    carried = sums.select("part", "conv_id", *[F.coalesce(_carried(F.bit_xor(f"g{i}")), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    whole = hashed.drop("g1", "g2").join(carried, ["part", "conv_id"])
    return whole.select("part", "conv_id", "pos", "role", "text", F.col("h1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("c2")).alias("h2"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: conversations that are no prefix of another; copies counts equal ones."""
    sizes = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    marked = rows.select("conv_id", "pos", "h1", "h2").join(sizes, "conv_id")
    ends = marked.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = marked.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< " + OPEN[1:])), F.lit(END), F.lit("< " + END[1:]))


def render(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, piece (from 0), n_turns, copies, text: the maximal conversations, rendered."""
    rows = spool(turns(table, conv_id, turn, role, text), "prefixes")
    kept = maximal(rows)
    line = F.concat(F.lit(OPEN), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(END + "\n"))
    lines = rows.join(kept, "conv_id").select("conv_id", F.floor((F.col("pos") - 1) / PIECE).cast("int").alias("piece"), "n_turns", "copies", F.struct("pos", line.alias("line")).alias("line"))
    pieces = lines.groupBy("conv_id", "piece").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list("line")).alias("lines"))
    return pieces.select("conv_id", "piece", "n_turns", "copies", F.array_join(F.col("lines.line"), "").alias("text"))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return render(read(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH rows AS (SELECT conv_id, turn, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM rows),
whole AS (SELECT conv_id, list(role || chr(0) || text ORDER BY pos) AS turns FROM placed GROUP BY conv_id),
one AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM whole GROUP BY turns),
kept AS (SELECT * FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.turns[1] = a.turns[1] AND len(b.turns) > len(a.turns) AND b.turns[1:len(a.turns)] = a.turns)),
lines AS (SELECT p.conv_id, p.pos, '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
                 || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS line, len(k.turns) AS n, k.copies
          FROM placed p JOIN kept k ON p.conv_id = k.conv_id)
SELECT conv_id, CAST((pos - 1) // 256 AS INTEGER) AS piece, CAST(max(n) AS BIGINT) AS n_turns, CAST(max(copies) AS BIGINT) AS copies, string_agg(line, '' ORDER BY pos) AS text
FROM lines GROUP BY conv_id, (pos - 1) // 256
"""
