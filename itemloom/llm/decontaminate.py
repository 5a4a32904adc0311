"""Benchmark decontamination by q-gram filtering and banded alignment.

An item of m characters that occurs in a text with at most e edits shares at least m - q + 1 - e * q q-grams with it, all
on diagonals that differ by at most 2e (the q-gram lemma). Each item has the largest q up to Q for which that is at least
1, so short items keep their edits. Shared q-grams are counted in diagonal bands of width 2 (2e + 1) that overlap by half,
so each occurrence lies whole in one band; bands under the bound are dropped, and the rest are verified by a banded
alignment of the item with that part of the text.

An item of over 2 * PART characters is looked for by its parts: if it occurs with at most e edits, then one of its parts
occurs with no more than its share of them. Where a part does, the whole item is aligned around it.

Up to half of the q-grams that the bound asks for may be left out of the index, if the bound falls by as many: the ones
most frequent in the benchmark go. Hits are expanded a bounded number at a time, in the order of the text; bands that end
before the next hit are judged and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import scratch
from ._text import _LOWER, _SPACE, mix, text_blocks

Q = 8
#: Edits for each character of an item that an occurrence may have, rounded down.
EDIT_RATE = 0.1
#: Benchmark characters that are indexed and broadcast at once; a larger benchmark takes several passes over the documents.
BLOCK_CHARS = 8_000_000
#: Characters of the parts of long items, at least.
PART = 512
#: Pairs of a hit and an item's q-gram that are counted at once.
PIECE = 500_000
#: Text bytes scanned at once.
SCAN_BYTES = 1 << 20
_FILTER_BITS = 20
_BASE = 0x9E3779B97F4A7C15
_FAR = 1 << 31


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 as code points, and where rows begin among them; bytes where all are ASCII."""
    if not len(data) or data.max() < 128:
        return data, offsets
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), heads[offsets]


def normalize(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, each run of white space as one blank."""
    low = np.minimum(chars, 255)
    space = _SPACE[low] & (chars < 256)
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(chars)]] = True
    at = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    out = np.where(chars < 256, _LOWER[low], chars).astype(chars.dtype)
    return np.where(space, chars.dtype.type(32), out)[keep], at[offsets]


def qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    have = {1: mix(np.arange(256, dtype=np.uint64))[chars] if chars.dtype == np.uint8 else mix(chars.astype(np.uint64))}
    for n in (2, 4, 8):
        if n <= q:
            half = have[n // 2]
            have[n] = half[: -(n // 2)] + half[n // 2 :] * np.uint64(pow(_BASE, n // 2, 1 << 64))
    out, size = None, 0
    for n in (8, 4, 2, 1):
        if q & n:
            out = have[n] if out is None else out[: len(have[n]) - size] + have[n][size:] * np.uint64(pow(_BASE, size, 1 << 64))
            size += n
    return out


class Grams:
    """The indexed q-grams of the items that have this q: sorted, each with its item and position."""

    def __init__(self, q: int, items: list[np.ndarray], own: np.ndarray, need: np.ndarray):
        self.q = q
        grams = [qgrams(items[i], q) for i in own]
        keys = np.concatenate(grams)
        item = np.repeat(own, [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams])
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        spare = np.zeros(len(items), np.int64)
        spare[own] = need[own] // 2
        order = np.lexsort((-count[back], item))  # each item's most frequent q-grams first
        first = np.searchsorted(item[order], item[order])
        left_out = (np.arange(len(order)) - first < spare[item[order]]) & (count[back[order]] > 1)
        np.subtract.at(need, item[order[left_out]], 1)
        order = order[~left_out]
        order = order[np.argsort(keys[order], kind="stable")]
        self.keys, self.item, self.pos = keys[order], item[order], pos[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position in chars, row, first of the equal index entries, how many) of each q-gram of a row that is indexed."""
        keys = qgrams(chars, self.q)
        hits = np.flatnonzero(self.filter[keys >> np.uint64(64 - _FILTER_BITS)])
        low = np.searchsorted(self.keys, keys[hits], "left")
        count = np.searchsorted(self.keys, keys[hits], "right") - low
        row = np.searchsorted(offsets, hits, "right") - 1
        whole = (count > 0) & (hits + self.q <= offsets[row + 1])
        return hits[whole], row[whole], low[whole], count[whole]


class Index:
    """Normalized items (wholes), each with its edits, and their parts (items) with the parts' edits and q-grams by q.

    Part i begins at offset[i] of whole of[i]; an item that is not long is its only part."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = EDIT_RATE):
        if not 0 <= rate < 1:
            raise ValueError("rate must be at least 0 and less than 1")
        self.wholes, self.ids, self.items, of, offset = [], [], [], [], []
        for i, text in zip(ids, texts, strict=True):
            raw = np.frombuffer((text or "").strip(" \t\n\x0b\x0c\r").encode(), np.uint8)
            if len(raw):
                whole = normalize(*_points(raw, np.array([0, len(raw)])))[0]
                n = len(whole) // PART if len(whole) > 2 * PART else 1
                cut = np.linspace(0, len(whole), n + 1).astype(np.int64)
                self.items += [whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                of += [len(self.wholes)] * n
                offset += cut[:-1].tolist()
                self.wholes.append(whole)
                self.ids.append(i)
        self.of, self.offset = of, offset
        budget = lambda size: (size * rate + 1e-9).astype(np.int64)
        self.whole_edits = budget(np.array([len(x) for x in self.wholes], np.int64))
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.edits = budget(self.size)
        q = np.minimum(self.size // (self.edits + 1), Q)
        self.need = self.size - q + 1 - self.edits * q
        self.grams = [Grams(int(n), self.items, np.flatnonzero(q == n), self.need) for n in np.unique(q)]


def _find(part: np.ndarray, item: np.ndarray) -> int:
    """Where item stands in part, or -1."""
    if part.dtype != item.dtype:
        part, item = part.astype(np.uint32), item.astype(np.uint32)
    hay, needle, size, at = part.tobytes(), item.tobytes(), item.dtype.itemsize, -1
    while True:
        at = hay.find(needle, at + 1)
        if at < 0 or at % size == 0:
            return at // size if at >= 0 else -1


def align(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int]:
    """Fewest edits between item and any part of region, if they are no more than `edits`, and where that part ends.

    A cell of the band is a diagonal of the region, with room for `edits` more on both sides."""
    m, width = len(item), max(len(region) - len(item), 0) + 2 * edits
    text = np.full(m + width, -1, np.int64)  # what no character equals
    text[edits : edits + len(region)] = region[: m + width - edits]
    steps = np.arange(width + 1)
    row = np.zeros(width + 1, np.int64)
    for i in range(m):
        best = row + (text[i : i + width + 1] != item[i])
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
        if i % 16 == 15 and row.min() > edits:  # it never falls again
            break
    t = int(row.argmin())
    return int(row[t]), min(max(m + t - edits, 0), len(region))


def _merge(group: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by (group, band), in their order."""
    order = np.lexsort((band, group))
    group, band = group[order], band[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(len(group), 1), bool), (group[1:] != group[:-1]) | (band[1:] != band[:-1])]))
    return group[head], band[head], np.add.reduceat(count[order], head) if len(head) else count[:0]


def _bands(index: Index, grams: Grams, chars: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, item, first diagonal) of each band that shares as many q-grams as the bound asks for."""
    hits, row, low, count = grams.hits(chars, offsets)
    n_items, edits, size = len(index.items), index.edits, index.size
    total = np.concatenate([[0], np.cumsum(count)])
    group, band, shared = (np.zeros(0, np.int64) for _ in range(3))
    at = 0
    while at < len(hits):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, "right")) - 1)
        n = count[at:to]
        entry = np.repeat(low[at:to] - (total[at:to] - total[at]), n) + np.arange(n.sum())
        item = grams.item[entry]
        diagonal = np.repeat(hits[at:to] - offsets[row[at:to]], n) - grams.pos[entry] + _FAR
        here = diagonal // (2 * edits[item] + 1)
        own = np.repeat(row[at:to], n) * n_items + item
        group, band, shared = _merge(
            np.concatenate([group, own, own]), np.concatenate([band, here, here - 1]), np.concatenate([shared, np.ones(2 * len(own), np.int64)])
        )
        at = to
        r, i = group // n_items, group % n_items
        if at < len(hits):
            done = (r < row[at]) | ((band + 2) * (2 * edits[i] + 1) - _FAR + size[i] <= hits[at] - offsets[row[at]])
        else:
            done = np.ones(len(group), bool)
        good = done & (shared >= index.need[i])
        yield from zip(r[good].tolist(), i[good].tolist(), (band[good] * (2 * edits[i[good]] + 1) - _FAR).tolist(), strict=True)
        group, band, shared = group[~done], band[~done], shared[~done]


def _nearest(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int]:
    """(fewest edits between item and a part of region, where it ends) if they are no more than edits, else more than that."""
    exact = _find(region, item)
    return (0, exact + len(item)) if exact >= 0 else (1, 0) if edits == 0 else align(item, region, edits)


def _leaks(data: np.ndarray, offsets: np.ndarray, index: Index) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item) -> (distance, end of the best occurrence, regions that held one)."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    chars, offsets = normalize(*_points(data, offsets))
    tried: set[tuple[int, int, int]] = set()
    for grams in index.grams:
        for r, i, from_ in _bands(index, grams, chars, offsets):
            e, m, item, text = int(index.edits[i]), int(index.size[i]), index.items[i], chars[offsets[r] : offsets[r + 1]]
            a = max(from_ - e, 0)
            region = text[a : max(from_ + 2 * (2 * e + 1) + m + e, 0)]
            if e and np.isin(qgrams(item, grams.q), qgrams(region, grams.q)).sum() < m - grams.q + 1 - e * grams.q:
                continue  # one q-gram of the item again and again
            distance, end = _nearest(item, region, e)
            if distance > e:
                continue
            w = index.of[i]
            if len(index.wholes[w]) > m:
                # the whole begins within its edits, and those of the part, of where the part's occurrence says
                e_part, e, whole = e, int(index.whole_edits[w]), index.wholes[w]
                near = (a + end - m - index.offset[i]) // (2 * e + 1)
                if (r, w, near) in tried:
                    continue
                tried.add((r, w, near))
                a = max(near * (2 * e + 1) - e - 8 * e_part, 0)
                region = text[a : max((near + 1) * (2 * e + 1) + 2 * e + 8 * e_part + len(whole), 0)]
                distance, end = _nearest(whole, region, e)
                if distance > e:
                    continue
            before = found.get((r, w), (distance, a + end, 0))
            found[r, w] = (*min(before[:2], (distance, a + end)), before[2] + 1)
    return found


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=SCAN_BYTES):
            ids = rows.column("doc_id")
            found = sorted(_leaks(data, offsets, index).items())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids.take(pa.array([r for (r, _), _ in found], pa.int64())),
                    "item_id": pa.array([index.ids[i] for (_, i), _ in found], pa.int64()),
                    "distance": pa.array([d for _, (d, _, _) in found], pa.int64()),
                    "item_chars": pa.array([len(index.wholes[i]) for (_, i), _ in found], pa.int64()),
                    "end": pa.array([e for _, (_, e, _) in found], pa.int64()),
                    "regions": pa.array([n for _, (_, _, n) in found], pa.int64()),
                }
            )


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """One row for each document and benchmark item that occurs in its whole text with at most rate edits a character:
    doc_id, item_id, distance (fewest edits), item_chars, end (of that occurrence, in characters of the normalized text),
    regions (those that held an occurrence).

    Case of A-Z and the amount of white space don't count, nor does white space around an item. Items of any length are
    looked for, those of under 1 / rate characters word for word. Null, empty and blank items match nothing, nor do null or
    empty texts. An item without an item_id is an item like any other and gives rows with a null item_id; so does a
    document without a doc_id. Repeated rows are reported as often as they stand in docs; repeated items each. Ties between
    occurrences go to the first end. Texts are searched whole, however long. An empty table on either side gives no row.
    Only doc_id, item_id and text are read. A benchmark of up to BLOCK_CHARS characters is one broadcast. A larger one is dealt into
    blocks of about that size (a longer item is never cut over blocks), one after another broadcast, held against all
    documents, written to a stored table and released: one index at a time is alive, on the driver and in the workers.
    """
    spark, columns = docs.sparkSession, "doc_id long, item_id long, distance long, item_chars long, end long, regions long"
    items, texts = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL"), docs.select("doc_id", "text")
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)

    def index(rows: DataFrame):
        own = rows.orderBy("item_id", "text").collect()
        return spark.sparkContext.broadcast(Index([r[0] for r in own], [r[1] for r in own], rate))

    if blocks <= 1:
        shared = index(items)
        return texts.mapInArrow(lambda it: _scan(it, shared), columns)
    dealt, found = scratch(spark, "benchmark"), scratch(spark, "leaks")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(dealt)
    kept = spark.read.schema("item_id long, text string, block int").parquet(dealt)
    for b in range(blocks):
        shared = index(kept.where(F.col("block") == b).select("item_id", "text"))
        texts.mapInArrow(lambda it, s=shared: _scan(it, s), columns).write.mode("append").parquet(found)
        shared.destroy()
    return spark.read.schema(columns).parquet(found)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
