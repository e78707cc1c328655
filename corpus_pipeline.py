"""The corpus pipeline: language, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last
return the columns of documents. Every row has its own verdict, also where its doc_id is null or
stands for several texts; only rows equal in doc_id, text, lang and source share one. Null texts
count as empty; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailmart.llm import jaccard, language, mixing, pii, queries as own
from retailmart.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key: the doc_id and 128 hash bits of text, lang and source."""
    said = ["text", "lang", "source"]
    parts = [*said, *[F.col(c).isNull() for c in said]]
    return docs.withColumn("row_key", F.concat_ws(":", "doc_id", F.xxhash64(*parts), F.xxhash64(F.lit("row"), *parts)))


def _of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed docs whose row_key is among the distinct keys, with the other columns of keys."""
    keys = stored(keys.withColumnRenamed("row_key", "__key"), "verdicts")
    return docs.join(keys, F.col("row_key") == F.col("__key")).drop("__key")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is established, with lang set to it."""
    own.ship(spark)
    docs = _keyed(docs)
    by_key = docs.withColumn("doc_id", F.col("row_key"))
    found = language.identify(own.document_evidence(by_key), own.text_model(by_key), id="doc_id")
    kept = found.where("kept").groupBy(F.col("doc_id").alias("row_key")).agg(F.min("language").alias("__language"))
    return _of_keys(docs, kept).withColumn("lang", F.col("__language")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    own.ship(spark)
    return jaccard.keep_rows(docs, n=5, percent=80).select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    own.ship(spark)
    done = pii.pseudonymise_documents(docs.select(*COLUMNS), own.PSEUDONYM_KEY)
    length = F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that source, language and topic have their target shares."""
    own.ship(spark)
    docs = _keyed(docs)
    rows, _ = mixing.mix(mixing.label(docs, id="row_key"), own.MIX_BUDGET, own.MIX_POWER)
    chosen = rows.where("sampled").select(F.col("id").alias("row_key")).distinct()
    return _of_keys(docs, chosen).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    own.ship(spark)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return own.packed(docs).select(*columns)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # byte n-gram models, keyed permutations and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
