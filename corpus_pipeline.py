"""Corpus pipeline: toxic documents go, low quality goes, one of each group of near copies
stays, benchmark passages go, and what is left is packed for training.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet and read
again as the next one's ``docs``; all but the last give the columns of ``documents``.
"""

from __future__ import annotations

from textbarge.llm import decontam, packing, quality, simhash, toxicity
from textbarge.llm.common import read, spool

#: Tokenizers, models and hash votes are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_low_quality(spark, docs, sf_dir):
    return quality.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    return simhash.keep_first(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
