"""Documents to training windows in five stages.

Each stage works on all that the one before it kept, through one operator of
``joblattice.llm``, and its result is stored before the next one reads it:

1. ``quality_classifier`` drops the documents that the classifier rejects.
2. ``line_dedup`` cuts lines within two edits of an earlier line.
3. ``near_dedup`` keeps one document of each group of near-duplicates: documents whose sets of
   five-word shingles have a Jaccard similarity of 0.8 or more are linked. Pairs to verify are
   those that ``simhash`` links; as 64-bit fingerprints do not reach that far, bands of minimum
   hashes add the pairs further apart (``near_copies`` says why).
4. ``substring_dedup`` cuts passages of lines and sentences that stand earlier in the corpus.
5. ``packing`` tokenises what is left and packs it in windows of 4096 tokens.

Stages 1 to 4 return the columns of ``documents``; where a text is cut, ``n_chars`` is
counted anew, and a document that lost all its words to the cuts goes. Packing returns
pieces: doc_id, start, length, doc_tokens, sequence_id, offset and the ids.

The classifier's weights, the classes of near lines and the tokenizer's merges have no
form in SQL, so ``ORACLE_SQL`` is None; tests recompute the stages in plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm import line_dedup, near_copies, packing, quality_classifier, substring_dedup
from joblattice.llm.common import BLANKS, documents, stored

ORACLE_SQL = None


def _with_kept_text(found: DataFrame) -> DataFrame:
    """The rows of a cutting operator with their kept texts."""
    columns = found.select("row.*").columns
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    changed = F.size("removed") > 0
    rows = found.where(~changed | (F.translate("kept", BLANKS, "") != ""))
    return rows.select(
        *[
            F.when(changed, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new else F.col(f"row.{c}")
            for c in columns
        ]
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels).where("kept").select("row.*")


def cut_near_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_kept_text(line_dedup.dedup(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_kept_text(substring_dedup.dedup(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", cut_near_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_lines),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
