"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes each result as Parquet
to the shared folder and reads it back, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentscan.llm import common, decontaminate, line_dedup, mixing, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from `labels`.

    Null and empty texts are scored like any; without labels of both classes everything passes, unless all are 0. Rows of
    one score fall together, repeated rows stay repeated, an empty table stays empty. Columns pass unchanged.
    """
    return quality.accepted(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds; n_chars, where present, follows the text.

    A document may end up without lines; it stays, with an empty text. Null texts stay null. Rows of one doc_id do not
    take lines from each other; a null doc_id comes last. Other columns pass unchanged, whatever their names.
    """
    done = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return done.select(*(v.alias(c) for c, v in columns.items()))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-copy group.

    Texts without words form a group of their own. Of repeated rows one stays; of rows with one doc_id and different
    texts in a group, the one with the smaller hash. A null doc_id comes last.
    """
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of `benchmark`: at least 0.8 of its five-word shingles.

    Null and short texts and items match nothing; repeated rows go or stay together. Without items all stay.
    """
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each epoch that takes a document, with epoch and n_words to take.

    Null sources are a source, the last one; texts without words are never taken. Ties of the random key go by doc_id and
    text. Columns named epoch or n_words are replaced.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A trained classifier and hashes decide here, so the rows are compared with a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.spread(common.table(spark, sf_dir, "documents")), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop(before)  # nothing reads it again
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
