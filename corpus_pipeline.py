"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the caller writes a stage's
rows as Parquet and reads them again as the next stage's docs. All but the last return the columns of documents, and pass
through others that docs may have. An empty table gives an empty table in every stage; rows are judged one by one where their ids repeat,
but for the two that look for repeats, where rows of one id count as one document. Stages bound the session's Arrow
and Parquet batches, since executors keep their JVM and their Python workers from one stage to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import bounded_batches, column, written
from feedloom.llm.jaccard import near_duplicates
from feedloom.llm.langid import UNKNOWN, language_id
from feedloom.llm.mixing import mix_sources
from feedloom.llm.packing import pack_documents
from feedloom.llm.queries import mix_arguments
from feedloom.llm.substring import substring_dedup


#: Letters from which a document's cosine says something, and what it must reach then; clean ones of the test tables have 0.17 and more.
LETTERS, LEAST_COSINE = 50, 0.1


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: a null text, one without a letter, and one of 50 letters or more that is like no
    learned language (cosine under 0.1). Shorter ones stay, and so do all with letters where nothing could be learned."""
    bounded_batches(spark)
    names = [f"__{k}" for k in range(len(docs.columns))]
    plain = docs.select(*[column(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    found = language_id(plain, text, lang)
    foreign = (F.col("lang_pred") != UNKNOWN) & (F.col("score") < LEAST_COSINE) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= LETTERS)
    kept = found.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & ~foreign)
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates (five words, 0.8); rows with a null id stay, as do null and blank texts."""
    bounded_batches(spark)
    parts = near_duplicates(docs, shingle=5, percent=80).where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(parts, docs["doc_id"].cast("long") == parts["__dropped"], "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that a document of smaller id holds; texts that lose nothing stay as they are, a text
    that is cut has single spaces, n_chars is the text's length (null for a null text). Rows with a null id lose nothing."""
    bounded_batches(spark)
    out = substring_dedup(docs, window=50)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else column(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it; null languages and sources are leaves of their own, texts of no token go."""
    bounded_batches(spark)
    copies = mix_sources(docs, **mix_arguments()).where("mix_copies > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), "mix_copies"))).select(*[column(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, copies of a document one after another."""
    import public_tokenizers

    bounded_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", by_language), ("near_duplicates", without_near_duplicates), ("substring_dedup", without_repeats), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the learned language, nor the tokenizer, nor the packing; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is written and read before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else written(docs), sf_dir)
    return docs
