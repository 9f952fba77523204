"""From raw documents to packed training sequences: language, quality, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.language import UNDETERMINED, identify, training_text
from lodestone.llm.near_duplicates import near_duplicates
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import apply_rules
from lodestone.llm.queries import WORD_VOCABULARY
from lodestone.llm.shared import written
from lodestone.llm.substrings import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter or with a null text go. Where no row has a label to
    learn from, every text with a letter stays, undetermined. Null ids and repeated rows are judged like others; an empty
    table gives no rows."""
    samples = training_text(docs)
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return identify(docs, samples, carry=True).filter(F.col("lang_pred") != UNDETERMINED).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule lets through; a null or empty text fails the base rule. Repeated rows and null ids are judged
    each; an empty table gives no rows."""
    return apply_rules(docs, carry=True).filter("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least id; rows without id stay, as do
    repeated rows of that id; a text without words is like no other. An empty table gives no rows."""
    gone = near_duplicates(docs, words=5, percent=80).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


#: Bytes of a passage that is removed where it repeats: nearly all windows of 51 words are longer.
PASSAGE_BYTES = 240


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE_BYTES`` bytes or more that are also elsewhere, in the same text or another;
    every place of such a passage goes. A null text stays null, a text that repeats as a whole becomes empty; ``n_chars``
    follows the text where it changes. Columns may have any name; an empty table gives no rows."""
    found = remove_repeats(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"]), length=PASSAGE_BYTES)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))
    own = {"text": text, "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars"))}
    return found.select(*(own.get(f.name, F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids, with their ids and a check sum. A null text is its end id alone; rows of one
    id are packed each; an empty table gives no rows."""
    return pack_documents(docs, WORD_VOCABULARY).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near), ("substrings", substrings), ("packing", packing)]

#: Tokenizers and automata are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
