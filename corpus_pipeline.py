"""From raw documents to a training mixture: five operators in a row, each over all that the one before it kept.

Quality classifier, near duplicates (one document of each class stays), repeated passages (cut out of the texts),
benchmark contamination (contaminated documents go), mixture of sources. All stages but the last return the columns
of ``documents``; the last adds ``mix_*`` columns and returns a row for each reading of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorwatch.llm import decontamination, lsh_forest, mixing, quality_classifier, suffix_array
from motorwatch.llm.common import table
from motorwatch.session import stage

#: The classifier is trained and duplicates are found by near-exact sums and hashes that SQL does not have.
ORACLE_SQL = None


#: A repeated passage: 95 of 100 runs of 51 words of prose in each of the corpus' four languages are at least 268 bytes long, so
#: one of over 50 words holds a string of this length. Minimizers are taken over two thirds of it.
PASSAGE_BYTES, PASSAGE_KMER = 240, 160


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. NULL texts are judged as empty ones."""
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, weights).where("predicted = 1").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar texts."""
    return lsh_forest.one_per_class(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; ``text`` without the strings that occur twice, ``n_chars`` as it is then.

    A cut may leave part of a character behind, which goes too; nothing else does. A text may end up empty; NULL stays NULL.
    """
    found = suffix_array.remove_repeats(docs, length=PASSAGE_BYTES, kmer=PASSAGE_KMER, whole_characters=True)
    left = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    changed = {"text": left, "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length(left).cast("long"))}
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.clean(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document; of columns with equal names the added ones stay."""
    added = {"mix_tokens": "n_tokens", "mix_pass": "pass_no", "mix_block": "block", "mix_position": "position", "mix_weight_ppb": "weight_ppb"}
    mixed = mixing.mix(docs)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return mixed.select(*own, *[F.col(c).alias(name) for name, c in added.items()])


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("suffix-array dedup", without_repeated_passages),
    ("benchmark decontamination", not_contaminated),
    ("mixing sources", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stage(docs, f"stage{at + 1}")
    return docs
