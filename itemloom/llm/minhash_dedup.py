"""MinHash near-dedup: universal hash minima in bands, links confirmed on full shingle sets, components by alternating
large-star and small-star.

Documents with the same shingle set form a class, and only one of a class is compared, so a group of thousands of copies
costs one row. Within a bucket of a band, members are compared with two pivots (the member that shares most buckets, and
the smallest), not with one another. Where a bucket's members then still lie in several components, those outside its
largest one are compared with all members of other components, block by block on longer sketches, and only pairs that may
reach the threshold leave the block. A pair at the threshold misses
all bands with probability below 1e-6, for which a lower threshold gets more bands (85 percent 24, 80 percent 35); the
margins of both estimates are four standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import sized, stored
from ._text import mix, text_blocks, window_hashes, word_hashes, word_spans

SHINGLE = 5
#: Minima of a band, and the probability with which a pair at the threshold may miss all bands.
ROWS, MISS = 5, 1e-6
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
MARGIN = 0.13
#: Minima, a byte of each, in the sketches of documents that share a bucket, and their margin.
SKETCH, SKETCH_MARGIN = 1024, 0.045
#: Members outside a bucket's largest component, and members of any, that are compared with one another in one task.
BLOCK, OTHERS = 128, 2048

_FINGER = np.uint64(0x8C5FB3A1D2E94677)
_LONG = np.random.default_rng(85).integers(1, 1 << 63, (2, SKETCH), dtype=np.uint64) | np.uint64(1)


def bands_for(percent: int) -> int:
    """The fewest bands that a pair at the threshold misses with a probability below MISS."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    return 1 if percent == 100 else math.floor(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS))) + 1


def _parameters(n_bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and summands of the minima, and a seed of each band."""
    rng, n = np.random.default_rng(85), n_bands * ROWS
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(1, 1 << 63, n_bands, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 5-word shingles, lower-cased, and where each row's begin; a row of 1 to 4 words has one for the whole."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    hashes, at = window_hashes(words, first, SHINGLE)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = []
        for i in short:
            h = np.uint64(n[i])
            for w in words[first[i] : first[i + 1]]:
                h = mix(np.array([h ^ w], np.uint64))[0] ^ (w >> np.uint64(1))
            whole.append(h)
        hashes = np.insert(hashes, at[short], whole)
        count = np.diff(at)
        count[short] = 1
        at = np.concatenate([[0], np.cumsum(count)])
    return hashes, at


def _fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    both = np.array([mix(items).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(items ^ _FINGER))], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def _sign(batches: Iterator[pa.RecordBatch], n_bands: int) -> Iterator[pa.RecordBatch]:
    times, plus, seed = _parameters(n_bands)
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=1 << 19):
            hashes, at = shingles(data, offsets)
            full = np.flatnonzero(np.diff(at))
            n = rows.num_rows
            size, f1, f2 = (np.zeros(n, np.int64) for _ in range(3))
            signature, bands = np.zeros((n, len(times)), np.uint32), np.zeros((n, n_bands), np.uint64)
            for i in full:
                own = np.unique(hashes[at[i] : at[i + 1]])
                size[i] = len(own)
                f1[i], f2[i] = _fingerprint(own)
            if len(full):
                for p in range(len(times)):
                    signature[full, p] = np.minimum.reduceat(((hashes * times[p] + plus[p]) >> np.uint64(32)).astype(np.uint32), at[full])
                for b in range(n_bands):
                    h = np.full(n, seed[b])
                    for p in range(b * ROWS, (b + 1) * ROWS):
                        h = mix(h ^ signature[:, p])
                    bands[:, b] = h
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"), "n_shingles": size, "f1": f1, "f2": f2,
                    "signature": pa.array([x.tobytes() for x in signature], pa.binary()),
                    "bands": pa.ListArray.from_arrays(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32), bands.reshape(-1).view(np.int64)),
                }
            )


def signatures(docs: DataFrame, n_bands: int) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (fingerprint of the set), signature, bands."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _sign(it, n_bands), "doc_id long, n_shingles long, f1 long, f2 long, signature binary, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set and sketch of each text whose fingerprint is the one asked for."""
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=1 << 19):
            hashes, at = shingles(data, offsets)
            items, keep = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], []
            for i, (f1, f2) in enumerate(zip(rows.column("f1").to_pylist(), rows.column("f2").to_pylist(), strict=True)):
                if _fingerprint(items[i]) == (f1, f2):
                    keep.append(i)
            full, sketch = np.flatnonzero(np.diff(at)), np.zeros((rows.num_rows, SKETCH), np.uint8)
            for p in range(SKETCH if len(full) else 0):
                least = np.minimum.reduceat(((hashes * _LONG[0, p] + _LONG[1, p]) >> np.uint64(32)).astype(np.uint32), at[full])
                sketch[full, p] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            ids = rows.column("id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": ids, "items": pa.array([items[i].tobytes() for i in keep], pa.binary()), "sketch": pa.array([sketch[i].tobytes() for i in keep], pa.binary())})


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.array([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ia"), batch.column("ib"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    return both.select("a", "b", "ia", "ib").mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id with an edge (a, b), component being the smallest id reachable, by alternating
    large-star and small-star until nothing changes. Each round is a stored table; self-loops and repeats are allowed."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "small-star")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _block_pairs(table: pa.Table, least: float) -> pa.Table:
    """Pairs of one block that lie in different components and may reach the threshold."""
    ids, comps, first, main = (table.column(c).to_numpy() for c in ("id", "component", "first", "main"))
    marks = np.array([np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()])
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    a, b = [], []
    for x in left:
        other = right[(comps[right] != comps[x]) & (main[right] | (ids[right] > ids[x]))]
        other = other[(marks[other] == marks[x]).mean(axis=1) >= least]
        a.append(np.full(len(other), ids[x]))
        b.append(ids[other])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})


def leftover_blocks(placed: DataFrame) -> DataFrame:
    """Blocks in which members of one bucket in different components meet: (bucket, i, j, id, component, first, main) from
    (bucket, id, component). Rows for a bucket of n members, r of them outside its largest component, are n for each
    BLOCK of r and r for each OTHERS of n; a bucket whose members are all joined has none."""
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    split = counts.groupBy("bucket").agg(F.max(F.struct("c", F.bitwise_not("component").alias("minus"))).alias("top"), F.sum("c").alias("n")).where("n > top.c")
    rest = placed.join(split.select("bucket", F.bitwise_not("top.minus").alias("most"), "n", (F.col("n") - F.col("top.c")).alias("r")), "bucket")
    rest = rest.withColumn("main", F.col("component") == F.col("most"))
    i_parts, j_parts = (F.ceil(F.col(c) / size).cast("int") for c, size in (("r", BLOCK), ("n", OTHERS)))
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    i, j = F.pmod(F.xxhash64("id"), i_parts).cast("int"), F.pmod(F.xxhash64(F.lit("j"), "id"), j_parts).cast("int")
    first = rest.where("NOT main").select("bucket", i.alias("i"), every(j_parts).alias("j"), "id", "component", F.lit(True).alias("first"), "main")
    return first.unionByName(rest.select("bucket", every(i_parts).alias("i"), j.alias("j"), "id", "component", F.lit(False).alias("first"), "main"))


def _short(*more) -> Column:
    return F.xxhash64(*more, "f1", "f2", "n_shingles")


def with_classes(signed: DataFrame) -> DataFrame:
    """signed with id, which equal sets share and others do not: a short hash of the set's name (f1, f2, n_shingles), where
    several names have the same one, it stays with the smallest, and the others are hashed anew. Null without a set or a doc_id."""
    name = F.struct("f1", "f2", "n_shingles")
    named = signed.withColumn("id", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), _short()))
    several = named.where("id IS NOT NULL").groupBy("id").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high")
    several = stored(several.select("id", "low"), "shared-ids")
    if several.isEmpty():
        return named
    other = F.col("low").isNotNull() & (F.col("low") != name)
    return named.join(sized(several), "id", "left").withColumn("id", F.when(other, F.xxhash64(F.lit("again"), "f1", "f2", "n_shingles")).otherwise(F.col("id"))).drop("low")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (columns doc_id, text; others are not read).

    Words are those of whole texts with A-Z lower-cased; a text of 1 to 4 words is one shingle. Null, empty and blank
    texts have an empty set and link with nothing; each is a component of its own. Repeated rows come out as often as
    they go in. Rows with one doc_id and different texts are one document, linked with whatever any of its texts is. A null
    doc_id takes part in no component of others. component_id is the smallest doc_id of the component, so ties cannot
    arise. An empty table gives an empty table.
    """
    least = percent / 100 - MARGIN
    signed = with_classes(stored(signatures(docs, bands_for(percent)), "signatures"))
    full = signed.where("id IS NOT NULL")
    # id stands for a class of equal sets; its text is read from the smallest document
    classes = stored(full.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("f1").alias("f1"), F.min("f2").alias("f2")), "classes")
    own = full.join(classes.select("id", "doc_id"), ["id", "doc_id"], "left_semi").dropDuplicates(["id"])
    reps = stored(own.select("id", "signature", "bands"), "representatives")

    spread = reps.select("id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1")
    members = stored(spread.join(shared, "bucket"), "members")
    degrees = members.groupBy("id").agg(F.sum("n").alias("degree"))
    rated = members.join(degrees, "id")
    tops = rated.groupBy("bucket").agg(F.max(F.struct("degree", F.bitwise_not("id").alias("minus"))).alias("top")).select("bucket", F.bitwise_not("top.minus").alias("high"))
    pivots = members.join(tops, "bucket")
    stars = pivots.select("id", F.explode(F.array("low", "high")).alias("pivot")).where("id <> pivot")
    pairs = stars.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()

    active = sized(members.select("id").distinct().join(classes, "id"))
    wanted = docs.select("doc_id", "text").join(active, "doc_id").select("id", "f1", "f2", "text").mapInArrow(_sets, "id long, items binary, sketch binary")
    sets = stored(wanted, "sets").dropDuplicates(["id"])

    def alike(p: DataFrame) -> DataFrame:
        s = reps.select("id", "signature")
        both = p.join(s.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(lambda it: _estimated(it, least), "a long, b long")

    # a document with several texts links their classes
    several = full.select("doc_id", "id").distinct().groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = full.select("doc_id", "id").distinct().join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    links = stored(confirm(alike(pairs), sets, percent).unionByName(same), "links")
    found = stored(components(links), "components")

    placed = members.select("bucket", "id").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    blocks = leftover_blocks(placed).join(sets.select("id", "sketch"), "id")
    late = blocks.groupBy("bucket", "i", "j").applyInArrow(lambda t: _block_pairs(t, percent / 100 - SKETCH_MARGIN), "a long, b long").distinct()
    more = stored(confirm(late.join(pairs, ["a", "b"], "left_anti"), sets, percent), "more-links")
    if not more.isEmpty():
        found = stored(components(links.unionByName(more)), "components")

    joined = classes.join(found, "id").select("id", "component", "doc_id")
    smallest = joined.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named = joined.join(smallest, "component").select("id", "smallest")
    of_class = signed.join(classes.select("id", F.col("doc_id").alias("of_class")), "id", "left").join(named, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.coalesce("smallest", "of_class"))
    out = of_class.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
