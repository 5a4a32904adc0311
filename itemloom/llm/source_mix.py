"""Mixing sources to target weights: word counts by source give repetition rates, and each document is emitted floor(rate)
times plus once more with a probability equal to the fraction, which a hash of the document decides.

Nothing about a document depends on another one, so a mix needs one aggregation, over a table of one small row for each
document, and one join with the sources. Targets are found by scalars alone: each round caps the sources that the level of
the last one lifts above their limit, and shares the rest again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import attach, in_order, stored

#: The contract's weights of sources, in their order, again and again; the share of all words; the most repeats of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Leading bits of a hash that make a coin.
_COIN_HEX = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin(seed: int) -> Column:
    """A number from 0 to below 1 that depends on the seed and the doc_id alone, or on the text where that is null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, _COIN_HEX), 16, 10).cast("double") / float(1 << 4 * _COIN_HEX)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, rate from sizes (source, size, one row for each document).

    Sources by code point, null last as a source of its own, weigh weights in turn. All targets come to share of all
    sizes, as far as no target is over `most` times its source's size: what is over is shared again by weight among the
    others until none is above. A source of size 0 has target and rate 0. An empty table gives no source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = in_order(sums, F.col("source").asc_nulls_last(), name="sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    goal = share * whole[0]
    level, capped = goal / whole[1] if whole[1] else 0.0, 0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("limit")
        n, full, rest = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:  # the sources above only become more, so this ends
            break
        level, capped = (goal - full) / rest, n
    target = F.least("limit", F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return stored(ranked.select("source", "source_size", target.alias("target"), rate.alias("rate")), "targets")


def with_copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (a stored table with source and coin) with source_size, target and copies: how often the mix takes each."""
    known = attach(rows, targets, {"source": "source"})
    whole = F.floor("rate")
    return known.withColumn("copies", whole + (F.col("coin") < F.col("rate") - whole).cast("long")).drop("rate")


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixed documents: all columns of docs, and `copy` from 0, which replaces a column of that name.

    docs: doc_id, text, source. A null text has no words. Repeated rows are documents of their own with one and the same
    coin; so are rows without a doc_id that have one text. The same rows and seed give the same mix, however they are
    divided. Texts are shuffled only for sources that hold less than one in HEAVY documents."""
    plain = docs.drop("copy")
    slim = stored(plain.select("source", word_count(F.col("text")).alias("size")), "sizes")
    clash = {c: f"_own_{c}" for c in plain.columns if c.lower() in ("size", "coin", "source_size", "target", "rate", "copies")}
    held = stored(plain.withColumnsRenamed(clash).withColumn("coin", coin(seed)), "mixed")
    taken = with_copies(held, source_targets(slim, weights, share, most)).where("copies > 0")
    every = taken.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return every.withColumnsRenamed({v: k for k, v in clash.items()} if clash else {}).select(*plain.columns, "copy")


def mix_plan(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """What mix takes, without the texts: doc_id, source, size, source_size, target, copies, for every row of docs."""
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), coin(seed).alias("coin")), "sizes")
    return with_copies(rows, source_targets(rows, weights, share, most)).drop("coin")


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5('0:' || coalesce(doc_id::VARCHAR, text, ''))[1:{_COIN_HEX}])::BIGINT / {1 << 4 * _COIN_HEX}.0::DOUBLE AS coin
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k, sum(source_size) OVER ()::BIGINT AS total FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), v AS (
  SELECT coalesce(min_by(level, k), 1e300) AS level FROM l WHERE level * w <= cap
), t AS (
  SELECT source, source_size, least(cap, w * level) AS target, CASE WHEN source_size > 0 THEN least(cap, w * level) / source_size ELSE 0 END AS rate FROM s, v
)
SELECT doc_id, size, source_size, target, floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT AS copies, size * copies AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
