"""Filter interaction audit on sorted posting lists: what every order of filters removes, and where filters overlap.

Documents are dealt into ranges of (part, doc_id), sorted, and cut into blocks. A block holds the sorted list of what each
filter fails in it; the lists are the table that the audit keeps. For each set of filters a block then has one k-way
union, built by galloping the next list into it, and for each filter what it fails beyond a union. Only the sizes of these
lists leave the block, and sizes add up over blocks; what an order of filters does follows from them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import attach, stored
from ._text import text_blocks, word_hashes, word_spans

POSTINGS = "part string, doc_ids array<bigint>, fails array<array<int>>, marks array<array<int>>"
#: More filters than this make too many sets of them.
MOST_FILTERS = 8
#: The characters of filter D.
SYMBOLS = "#$%&*|"
_SYMBOL_BYTES = np.frombuffer(SYMBOLS.encode(), np.uint8)


def gallop(ids: np.ndarray, probes: np.ndarray, span: int) -> np.ndarray:
    """For each probe, how many ids are below it. Both ascend and lie below span.

    A probe starts where it would stand if ids were spread evenly, doubles its step until it has passed its place, and
    halves it again; all probes move together."""
    n = len(ids)
    if not n or not len(probes):
        return np.zeros(len(probes), np.int64)
    padded = np.append(ids, span)
    low = probes.astype(np.int64) * n // max(span, 1)
    high, step = low.copy(), 1
    while (behind := (low > 0) & (padded[np.maximum(low - 1, 0)] >= probes)).any():
        low = np.where(behind, np.maximum(low - step, 0), low)
        step *= 2
    step = 1
    while (ahead := (high < n) & (padded[high] < probes)).any():
        high = np.where(ahead, np.minimum(high + step, n), high)
        step *= 2
    while (open_ := low < high).any():
        middle = (low + high) // 2
        right = padded[middle] < probes
        low, high = np.where(open_ & right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


def difference(ids: np.ndarray, other: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids that are not in other, where they would stand in it)."""
    at = gallop(other, ids, span)
    new = np.append(other, span)[at] != ids
    return ids[new], at[new]


def unions(lists: list[np.ndarray], span: int) -> tuple[list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """(the union of each set of lists, by its bits; for each (i, set without i), what list i has beyond the union)."""
    merged, beyond = [np.zeros(0, np.int64)] * (1 << len(lists)), {}
    for before in range(1 << len(lists)):
        for i, ids in enumerate(lists):
            if before >> i & 1:
                continue
            beyond[i, before], at = difference(ids, merged[before], span)
            if before < 1 << i:  # each set is built once, from the set without its last list
                merged[before | 1 << i] = np.insert(merged[before], at, beyond[i, before])
    return merged, beyond


def _lists(values: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n bits, the positions of the values that have it."""
    return [np.flatnonzero(values >> b & 1).astype(np.int32) for b in range(n)]


def posting_lists(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """The lists of each block of documents (see POSTINGS): fails holds one list for each filter and marks one for each
    mark, of ascending positions in doc_ids.

    rows: part, doc_id, and booleans named in filters (true: the document fails it) and marks; null is false. A null part is
    an empty string. Every row is a document, repeated or not, and so are rows without a doc_id, which come first."""
    bits = lambda names: sum((F.coalesce(F.col(n), F.lit(False)).cast("int") * (1 << i) for i, n in enumerate(names)), F.lit(0))
    slim = rows.select(F.coalesce("part", F.lit("")).alias("part"), "doc_id", bits(filters).alias("f"), bits(marks).alias("m"))
    dealt = slim.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    n_filters, n_marks = len(filters), len(marks)
    ints = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, at = pc.run_end_encode(batch.column("part")), 0
            for part, to in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                block = batch.slice(at, to - at)
                fails, held = (_lists(block.column(c).to_numpy(zero_copy_only=False), n) for c, n in (("f", n_filters), ("m", n_marks)))
                arrays = [pa.array([part]), pa.array([block.column("doc_id")], pa.list_(pa.int64())), pa.array([fails], ints), pa.array([held], ints)]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_ids", "fails", "marks"])
                at = to

    return dealt.mapInArrow(run, POSTINGS)


def set_sizes(lists: DataFrame, n_filters: int, marks: list[str]) -> DataFrame:
    """part, filter (its number), before (bits of a set of other filters), docs, fails, removed (by filter, beyond the set),
    gone (the union of the set and filter), and for each mark how many of the removed have it, from posting lists."""
    names = ["docs", "fails", "removed", "gone", *marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                span = len(batch.column("doc_ids")[row].values)
                fails, held = ([x.values.to_numpy().astype(np.int64) for x in batch.column(c)[row]] for c in ("fails", "marks"))
                merged, beyond = unions(fails, span)
                out = {n: [] for n in ("filter", "before", *names)}
                for (i, before), ids in beyond.items():
                    marked = [len(ids) - len(difference(ids, m, span)[0]) for m in held]
                    for n, v in zip(out, (i, before, span, len(fails[i]), len(ids), len(merged[before | 1 << i]), *marked), strict=True):
                        out[n].append(v)
                part = pa.array([batch.column("part")[row].as_py()] * len(beyond), pa.string())
                yield pa.RecordBatch.from_arrays([part, *(pa.array(v, pa.int64()) for v in out.values())], ["part", *out])

    sizes = lists.mapInArrow(run, ", ".join(["part string, filter long, before long", *(f"{n} long" for n in names)]))
    return sizes.groupBy("part", "filter", "before").agg(*(F.sum(n).alias(n) for n in names))


def audit(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """For each part, order of all filters, and step of it: part, filter_order (the filters' names joined), step (from 1),
    filter, kept, removed, redundant, unique_fails, shapley, and for each mark the removed that have it.

    rows as in posting_lists. The lists are kept as a table. An empty table gives no part."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters")
    lists = stored(posting_lists(rows, filters, marks), "postings")
    sizes = stored(set_sizes(lists, len(filters), marks), "sizes")
    steps = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(filters[j] for j in order), step, i, before))
            before |= 1 << i
    # a fixed number of rows for each number of filters
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter long, before long")
    every = (1 << len(filters)) - 1
    alone = F.col("before") == every - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("filter").cast("int"))
    told = sizes.join(F.broadcast(orders), ["filter", "before"])
    whole = told.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    unique = sizes.where(alone).select("part", "filter", F.col("removed").alias("unique_fails"))
    out = told.join(whole, ["part", "filter"]).join(unique, ["part", "filter"])
    name = F.element_at(F.array(*(F.lit(f) for f in filters)), (F.col("filter") + 1).cast("int"))
    return out.select(
        "part", "filter_order", "step", name.alias("filter"), (F.col("docs") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "shapley", *marks,
    )


def later_copies(rows: DataFrame, copy: str = "copy") -> DataFrame:
    """rows (a stored table with doc_id, h1, h2: the hash of a text) and whether a smaller doc_id has the same text. A row
    without a doc_id is not a copy and has none."""
    groups = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return attach(rows, stored(groups, "copies"), {"h1": "h1", "h2": "h2"}, outer=True).withColumn(copy, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first", "h1", "h2")


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["words", "distinct", "chars", "capitals", "symbols"]
    for batch in batches:
        for rows, data, offsets in text_blocks(batch):
            starts, ends, first = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends, lower=False)
            distinct = [len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
            # in UTF-8, these characters are bytes of no other one, and a code point has one byte that continues none
            per_row = [np.diff(np.concatenate([[0], np.cumsum(held)])[offsets]) for held in ((data & 0xC0) != 0x80, (data >= 65) & (data <= 90), np.isin(data, _SYMBOL_BYTES))]
            columns = [np.diff(first), distinct, *per_row]
            kept = rows.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.int64()) for c in columns)], [*kept.schema.names, *names])


def text_filters(docs: DataFrame) -> DataFrame:
    """doc_id, part, h1, h2 (the hash of the text) and the contract's filters A to D of whole texts (null: empty): under 100
    words; under 80 percent distinct words; over a tenth of upper-case letters; holds a symbol. Words are told apart by 64
    bits within a document."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"), text.alias("text"))
    counted = slim.mapInArrow(_figures, "doc_id long, part string, h1 long, h2 long, words long, distinct long, chars long, capitals long, symbols long")
    conditions = {"A": "words < 100", "B": "100 * distinct < 80 * words", "C": "100 * capitals > 10 * chars", "D": "symbols > 0"}
    return counted.select("doc_id", "part", "h1", "h2", *(F.expr(c).alias(n) for n, c in conditions.items()))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    flags = stored(text_filters(spark.read.parquet(f"{sf_dir}/documents.parquet")), "flags")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good_lost"), F.bool_or(F.col("toxic") == 1).alias("toxic_lost"))
    rows = attach(stored(later_copies(flags, "E"), "flags"), stored(labels, "labels"), {"doc_id": "doc_id"}, outer=True)
    return audit(rows, list("ABCDE"), ["good_lost", "toxic_lost"])


OP11_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[{SYMBOLS}]')::INT
    + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), p AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM d GROUP BY part, fails),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT list_aggregate(list_transform(o, lambda x: 'ABCDE'[x + 1]), 'string_agg', '') AS filter_order, step, o[step] AS i,
    list_sum(list_transform(o[1:step], lambda x: 1 << x)) - (1 << o[step]) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, 'ABCDE'[i + 1] AS filter,
    sum(n) FILTER (WHERE fails & (before | (1 << i)) = 0) AS kept,
    sum(n) FILTER (WHERE fails & before = 0 AND fails & (1 << i) > 0) AS removed,
    sum(n) FILTER (WHERE fails & before > 0 AND fails & (1 << i) > 0) AS redundant,
    sum(n) FILTER (WHERE fails = 1 << i) AS unique_fails,
    sum(good) FILTER (WHERE fails & before = 0 AND fails & (1 << i) > 0) AS good_lost,
    sum(toxic) FILTER (WHERE fails & before = 0 AND fails & (1 << i) > 0) AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, step, filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost
FROM r
"""
