"""Line dedup by Spark SQL functions alone: keep bitmaps for each document instead of its text.

Line keys are hashed to 128 bits. Occurrences are counted in three steps, so a line that a third of all documents
share never meets in one task: once for each key and document, then for each key and document shard (Spark combines
these before it shuffles them), then over hashes dealt out by ranges, with a secondary sort by document and position,
where the first occurrence streams out ahead of its repeats. What goes back to a document is a sparse bitmap: 64 lines to a word, only words with a
dropped line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space that keys are stripped of, and the letters that are lower-cased.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARDS = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), pos.cast("int").bitwiseAND(F.lit(63)))


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Lines to drop: doc_id, text_hash, dropped map<bigint, bigint> (line div 64 -> bits), one row for each document that loses lines.

    A line goes if its key has at least min_chars code points and stands in at least min_docs documents; with keep_first,
    its first occurrence by (doc_id, text_hash, position) stays. Null or empty texts hold one empty line, which is never
    dropped with min_chars of 1 or more. Rows with one doc_id count as one document, repeated or not, and so do all rows
    without a doc_id, which come first in order; each row loses its own lines. An empty table gives an empty table; other
    columns are not read.
    """
    hashed = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"))
    long = lambda k: F.length(k) >= min_chars
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.transform(_lines(F.col("text")), _key)).alias("pos", "k")).where(long(F.col("k")))
    lines = every.select("doc_id", "text_hash", "pos", hashed(F.col("k")).alias("h")).select("doc_id", "text_hash", "pos", "h.h1", "h.h2")
    # a document is counted once for a key, whatever copies of its rows there are: all its rows meet in one shard
    first = F.min(F.struct("text_hash", "pos")).alias("first")
    seen = lines.groupBy("h1", "h2", "doc_id").agg(first)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard")
    parts = seen.groupBy("h1", "h2", shard).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", F.col("first.text_hash").alias("text_hash"), F.col("first.pos").alias("pos"))).alias("first"))
    ranged = parts.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    by_key = Window.partitionBy("h1", "h2")
    repeated = (
        ranged.select("h1", "h2", "first", F.sum("n").over(by_key).alias("docs"), F.row_number().over(by_key.orderBy("first")).alias("rank"))
        .where((F.col("docs") >= min_docs) & (F.col("rank") == 1) & (F.col("docs") > (1 if keep_first and min_chars else 0)))
        .select("h1", "h2", "first")
    )
    gone = lines.join(repeated, ["h1", "h2"])
    if keep_first:
        gone = gone.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    bits = gone.groupBy("doc_id", "text_hash", F.shiftright(F.col("pos"), 6).cast("long").alias("word")).agg(
        F.bit_or(_bit(F.col("pos"))).alias("bits")
    )
    return bits.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with kept_lines (array of lines that stay), n_lines and n_dropped, which replace columns of these names; bitmaps
    from keep_bitmaps over the same docs. A null or empty text has one empty line; repeated rows come out each."""
    docs = docs.drop("kept_lines", "n_lines", "n_dropped")
    doc, text_hash, dropped = (_free(name, docs) for name in ("doc", "text_hash", "dropped"))
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("dropped").alias(dropped))
    both = docs.join(marks, (F.xxhash64(docs.text) == marks[text_hash]) & docs.doc_id.eqNullSafe(marks[doc]), "left").drop(doc, text_hash)
    word = lambda i: F.coalesce(F.try_element_at(dropped, F.shiftright(i, 6).cast("long")), F.lit(0).cast("long"))
    stays = lambda x, i: word(i).bitwiseAND(_bit(i)) == 0
    lines = _lines(F.col("text"))
    kept = F.when(F.col(dropped).isNull(), lines).otherwise(F.filter(lines, stays))
    return (
        both.withColumn("kept_lines", kept).withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.col("n_lines") - F.size("kept_lines")).drop(dropped)
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("kept_lines", "\n").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), g AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY k.doc_id
"""
