"""A training corpus from `documents`: language ID, line dedup, near-dedup, decontamination, and token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All stages but the last return the columns of documents; other columns of docs, whatever their names, are
left behind. An empty table gives an empty table at every stage, and texts are handled whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import decontaminate, language_id, line_dedup, minhash_dedup, sentencepiece_codec
from itemloom.llm._store import sized, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of which 100 * shared 5-word shingles >= NEAR * those of either are near-duplicates.
NEAR = 80


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found; those with a null or empty text, or without letters, go.

    A null doc_id is learned from and kept like any other; a null lang teaches nothing and stays null. Equal scores do not
    matter here, as any language will do. Repeated rows are kept each. If no row has both text and lang, no language can
    be found, and all documents go."""
    docs = docs.select(COLUMNS)
    model = language_id.train(language_id.split(docs)[0])
    kept = language_id.predict(docs.withColumn("_text", F.col("text")), model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.withColumnRenamed("_text", "text").select(COLUMNS)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten documents or more share; n_chars is that of the new text.

    A document counts once for a line, however often its row is repeated; rows without a doc_id count as one document. A
    null text stays null, and a text that loses all its lines becomes empty. Empty lines stay."""
    docs = docs.select(COLUMNS)
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    text = F.when(F.col("n_dropped") > 0, F.array_join("kept_lines", "\n")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, of repeated rows one.

    Documents without words (null, empty or blank texts) are like no other and stay, as do rows without a doc_id. Rows
    with one doc_id and different texts are one document, of which each text stays once."""
    docs = docs.select(COLUMNS)
    near = stored(minhash_dedup.near_duplicates(docs, NEAR).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near")
    rest = docs.join(sized(near.where("NOT kept").select("doc_id")), "doc_id", "left_anti")
    again = sized(near.where("kept AND n > 1").select("doc_id"))
    once = rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(again, "doc_id", "left_anti").select(COLUMNS).unionByName(once.select(COLUMNS))


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs with at most an edit for ten characters.

    Null and empty texts, and null or blank items, match nothing; a document without a doc_id is judged by its text like
    any other, and so is each of its repeated rows."""
    docs = docs.select(COLUMNS)
    key = F.xxhash64("doc_id", "text")
    found = decontaminate.leaks(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = sized(stored(found.select(F.col("doc_id").alias("key")).distinct(), "leaks"))
    return docs.join(leaked, key == leaked["key"], "left_anti").select(COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text they decode to, for each document.

    A null text is encoded as an empty one, to no ids; a null doc_id stays null; repeated rows are encoded each."""
    import public_tokenizers

    coded = sentencepiece_codec.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]

#: Naive Bayes, MinHash and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
