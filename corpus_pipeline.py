"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Toxic documents go; of equal texts one row stays; of each group of near-duplicates
one document stays; sources are mixed to their target weights, which repeats or
drops documents; what remains is encoded. Learned and hash-seeded stages can't be
expressed in SQL together; a test holds a run against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, common, exact_dedup, mixing, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.passed(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but the text, then n_tokens, token_ids and decoded_sha256, the digest of what the ids decode to.

    Where ``docs`` has such a column, the new one's name begins with "_".
    """
    ids = bpe.encoded(docs)
    back = bpe.decoded(ids, ids=ids.columns[-1])
    digest = F.sha2(F.col(f"`{back.columns[-1]}`"), 256).alias(common.free_names(docs, "decoded_sha256")[0])
    return back.select(*[F.col(f"`{c}`") for c in ids.columns if c != "text"], digest)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages the rows are written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs, f"stage-{name}")
    return docs
