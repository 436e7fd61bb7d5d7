"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next one.

Every stage takes tables with nulls in any column, repeated rows, ties and no rows at all (it then returns none), and passes
other columns through, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smokelake.llm.bpe_codec import encode_and_decode
from smokelake.llm.common import WORD, checked, materialize, shared_folder
from smokelake.llm.line_dedup import line_dedup
from smokelake.llm.mixing import repeated
from smokelake.llm.ngram_join import JaccardSettings, jaccard_labels
from smokelake.llm.quality_rules import quality_rules

TOKENIZER = "word_bpe_49k.json"
#: Five words and a similarity of 0.8.
NEAR = JaccardSettings(shingle=5, percent=80)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1 and so on, which no operator's new column is called, and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts, and those that repeat too much. Long texts are measured whole; rows are judged one by one."""
    rows, at = numbered(docs)
    return quality_rules(rows, text=at["text"]).filter("kept").select(*at.values()).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document that loses its last words that way goes too. n_chars follows the text.

    Null texts stay, empty texts too. Rows without an id or with a repeated one are documents of their own; rows that repeat
    id and text keep equal lines in both.
    """
    rows, at = numbered(docs)
    rows = line_dedup(rows, doc_id=at["doc_id"], text=at["text"]).filter((F.col("n_removed") == 0) | F.col(at["text"]).rlike(WORD))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return rows.select(*at.values()).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest id (null ids last), then text hash; of rows that repeat id and text the one of the smallest hash.

    Documents without words (null and empty texts among them) all stay.
    """
    found = materialize(jaccard_labels(docs, NEAR).filter("n > 0"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("first")
    rows = found.groupBy("label", "doc_id", "t").agg(F.count("*").alias("times"))
    rows = rows.join(found.groupBy("label").agg(first), "label")
    stays = (F.col("t") == F.col("first.t")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    # rows that go, and rows of which one of several equal ones stays; all others need no mark
    marks = materialize(rows.select(F.col("doc_id").alias("id"), "t", stays.alias("stays"), "times").filter("NOT stays OR times > 1").select("id", "t", "stays"))
    plain, at = numbered(docs)
    plain = plain.withColumn("t", F.xxhash64(at["text"]))
    marked = plain.withColumn("id", F.col(at["doc_id"])).join(checked(marks, NEAR.broadcast).withColumnsRenamed({"id": "of", "t": "of_t"}), F.col("id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")), "left")
    alone = marked.filter("stays IS NULL")
    several = marked.filter("stays").withColumn("row", F.row_number().over(Window.partitionBy("id", "t").orderBy(F.xxhash64(*at.values())))).filter("row = 1")
    return alone.select(*at.values()).unionByName(several.select(*at.values())).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as the mix of sources takes them. Null sources are one source; null texts have no words and get whole repetitions alone; rows of one id share their number of copies."""
    return repeated(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source, the token ids of every whole text (none for null and empty ones), their number, and the digest of what they decode to."""
    rows = encode_and_decode(docs, public_tokenizers.path(TOKENIZER), carry=["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Token merges can't be said in SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in any store that Spark can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents. The tables between the stages lie in the shared folder; each goes when the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
