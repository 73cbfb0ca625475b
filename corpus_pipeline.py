"""Documents on their way to training data, in five stages.

Each stage takes what the one before kept and returns the columns of ``documents``; the last
adds the place of each row in the training set. Between stages tables are written as Parquet.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm import quality
from prepkit.llm.curriculum import in_training_order
from prepkit.llm.decontamination import without_leaks
from prepkit.llm.jaccard import jaccard_components
from prepkit.llm.scratch import shared_folder
from prepkit.llm.sharding import shuffled_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share 80 % of their five-word shingles; op6_ngram_jaccard has 85 % of four words.
PERCENT, GRAM = 80, 5


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled ones outside the
    held-out third."""
    learnt = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = quality.fitted(learnt, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents
    without a word or an id are in no group and stay."""
    groups = jaccard_components(docs, percent=PERCENT, gram=GRAM)
    others = groups.where("n_shingles > 0 and doc_id != component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document as often as its source's target asks for."""
    return in_training_order(docs).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return shuffled_shards(docs)


STAGES = [
    ("quality classifier", of_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: The classifier is trained by gradient descent, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written to the shared
    folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
