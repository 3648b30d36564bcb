"""The corpus pipeline: language ID, line dedup, near duplicates, source mix, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``;
other columns of ``docs`` are left out.

Defined cases, stage by stage.  A null or empty text has no letters, so the
language stage drops its row, whatever its lang; rows with a null doc_id,
lang or source are kept like others.  Line dedup leaves rows without a doc_id
as they are, and rows that share a doc_id count as one document.  Of near
duplicates the smallest doc_id stays, with all rows that have it; rows
without a doc_id have no duplicates and stay.  The mix counts a null source
as one of its own, the last.  An empty table gives an empty result with the
same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op1_ngram_jaccard as near
from tidemark.llm import op3_language_id as language
from tidemark.llm import op4_source_mix as source_mix
from tidemark.llm import op6_bpe as bpe
from tidemark.llm import op8_line_dedup as lines
from tidemark.llm import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a lower posterior than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a learned language is recognised."""
    got = language.predict(docs.select(*COLUMNS), language.learned(docs))
    return got.filter((F.col("lang_pred") != language.NONE) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has; the rest of each document stays, its n_chars counted anew."""
    got = lines.dedup(docs.select(*COLUMNS))
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates (five words, similarity 0.8 or more)."""
    gone = near.similar(docs.select("doc_id", "text")).filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    gone = shared.checkpoint(gone)
    few = gone.count() <= near.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some repeatedly, so that each source's words come near its target."""
    return source_mix.mixed(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; the ids go on with digests of them and of the decoded text."""
    import public_tokenizers

    return bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("source_mix", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = shared.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.stored(docs)
            if i:  # nothing reads a stage's copy once the next one stands
                shared.removed(before)
    return docs


#: The cube method and BPE are beyond SQL; tests hold the stages against row-by-row versions.
ORACLE_SQL = None
