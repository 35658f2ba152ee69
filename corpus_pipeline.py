"""A corpus pipeline: each stage works on all that the one before it kept.

Every stage returns the columns of ``documents`` but the last, which returns token ids. Decisions
are about single rows: rows that share a doc_id, or have none, are documents of their own, and
only repeated rows with the same doc_id and text are one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.llm import decontaminate, near_dups, quality, subwords, suffixes
from strata.llm.common import own_ids, read, read_sized
from strata.session import discard, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = "piece_bpe_32k.model"


def quality_rules(spark, docs, sf_dir):
    """Documents go that fail the base rules themselves or come from a failing host."""
    return quality.host_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, that with the smallest doc_id.

    Documents whose id is not theirs alone come after the others.
    """
    named = own_ids(docs.select(*COLUMNS))
    classes = near_dups.near_classes(named.select(F.col("own_id").alias("doc_id"), "text"))
    dropped = classes.filter("not kept").select(F.col("doc_id").alias("own_id"))
    # What is dropped grows with the corpus, so it is not broadcast at any size.
    return named.join(dropped.hint("merge"), "own_id", "left_anti").select(*COLUMNS)


def repeated_strings(spark, docs, sf_dir):
    """Strings of 100 bytes that start earlier in the corpus are cut out of the texts."""
    return suffixes.without_repeats(docs).select(*COLUMNS)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go, whether or not the item has an id."""
    named = own_ids(docs.select(*COLUMNS))
    items = read(spark, sf_dir, "benchmark").select(F.xxhash64("text").alias("item_id"), "text")
    found = decontaminate.leaks(named.select(F.col("own_id").alias("doc_id"), "text"), items)
    leaked = found.select(F.col("doc_id").alias("own_id")).distinct()
    return named.join(leaked.hint("merge"), "own_id", "left_anti").select(*COLUMNS)


def token_ids(spark, docs, sf_dir):
    """The remaining texts as token ids that decode to them."""
    import public_tokenizers

    return subwords.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("benchmark leaks", benchmark_leaks),
    ("token ids", token_ids),
]

#: Seeded subword ids and components of near-duplicates are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to ``documents``, each written and read again."""
    docs, before = read_sized(spark, sf_dir, "documents"), None
    spark = docs.sparkSession  # every stage shuffles in partitions of that size
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
