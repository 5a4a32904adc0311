"""LM scoring by logistic context mixing of bit predictions.

A text is a sequence of bytes and an end byte that UTF-8 never uses; each byte is eight binary decisions. For contexts of
0 to 6 bytes, hashed tables hold how often each decision went either way in the training texts. Their log-odds are mixed
by weights that two gates select (the longest context seen before, with the place in the word; and the bits of this byte
so far), and the mixed probability is refined by an adaptive map of (bits, probability). Weights and map learn online
from all training texts of one fold, a ninth of them, while the tables have not seen it; then its counts join the tables.
Groups of texts learn side by side, dealt by hash of the row, and are averaged by how often each value was used. Scoring
uses the finished model, so a score does not depend on how Spark deals out texts, and the bits of all bytes add up to the
text's probability.

The model depends on the last six bytes and the next, so the corpus is gathered as counts of seven-byte strings: packed
by context, summed by Spark, turned into table cells there and quantized; the driver gets tables of a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import fold, spread, squeeze
from ._store import source_parts, stored
from ._text import crc32, mix, text_blocks, word_hashes, word_spans

ORDERS = 7
#: log2 of the cells of each order's table; orders 0 and 1 are exact.
CELL_BITS = (8, 16, 20, 21, 22, 22, 22)
PRIOR = 0.2
#: Stands for log-odds of 0 where decisions were seen, as 0 says that none were.
SEEN = 2.0**-14
END = 0xFF
#: log2 of the cells that are summed and sent as one row.
CHUNK_BITS = 16
#: The mixer's fold is learned in so many rounds, each text in one of them, with an average after each.
MIX_ROUNDS = 3
#: Bytes of the fold for each group of texts that learns by itself; groups are averaged in so many sums before the driver adds these.
MIX_BYTES, MIX_SUMS = 2 << 20, 64
#: Distinct strings a task holds before it passes them on.
HELD = 6_000_000
#: Most frequent words whose counts are broadcast; other words meet their counts by hash range.
FREQUENT = 1 << 18
_ORDER_SALT = np.random.default_rng(ORDERS).integers(1, 1 << 63, ORDERS, dtype=np.uint64)
_END_WORD = np.uint64(0x5EED0FE0D)
_BLOCK = 2 << 20


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each row and its end: the bytes just before it (0 before the text) and itself as one integer; where rows begin."""
    rows = len(offsets) - 1
    stop = offsets + np.arange(rows + 1)  # one end for each row
    padded = np.zeros(len(data) + 8 * rows, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded[np.arange(len(data)) + 8 * row + 7] = data
    padded[offsets[1:] + 8 * np.arange(1, rows + 1) - 1] = END
    for step in (1, 2, 4):
        padded = (padded[:-step] << np.uint64(8 * step)) | padded[step:]
    target = np.arange(stop[-1]) + 7 * np.repeat(np.arange(rows), np.diff(stop))
    return padded[target] & np.uint64((1 << 8 * ORDERS) - 1), stop


def _bases(order: int, context: np.ndarray) -> np.ndarray:
    """Where a context's cells begin: its 255 decisions stand in one block of 256 cells, in an order of its own."""
    if order < 2:
        return (context << np.uint64(8)).astype(np.int64)
    return (mix(context ^ _ORDER_SALT[order]) >> np.uint64(64 - CELL_BITS[order])).astype(np.int64)


def _cells(order: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return _bases(order, context) ^ node.astype(np.int64)


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    return (keys >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)


def _place(keys: np.ndarray) -> np.ndarray:
    """How many of the bytes just before belong to the current word."""
    out, inside = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for k in range(1, ORDERS):
        inside &= ((keys >> np.uint64(8 * k)) & np.uint64(255)) > 32
        out += inside
    return out


class Mixer:
    """tables: float16 log-odds of each order's cells, 0 where nothing was seen."""

    BUCKETS = 33

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.by_reach = np.full(((ORDERS + 1) * ORDERS, ORDERS), 0.25, np.float32)
        self.by_bits = np.zeros((256, ORDERS), np.float32)
        grid = np.linspace(-8, 8, self.BUCKETS)
        self.refined = np.broadcast_to(1 / (1 + np.exp(-grid)), (256, self.BUCKETS)).astype(np.float32).copy()
        self.used = [np.zeros(n, np.int64) for n in (len(self.by_reach), 256, self.refined.size)]
        self.scorer: Scorer | None = None

    def values(self) -> list[np.ndarray]:
        """What learn() moves; used[i] counts how often it moved each row of the i-th."""
        return [self.by_reach, self.by_bits, self.refined.reshape(-1, 1)]

    def _inputs(self, keys: np.ndarray):
        """Log-odds (order, bit, key), and for each bit of each key's last byte: its gate, its node and whether it is one."""
        byte, bit = (keys & np.uint64(255)).astype(np.int64), np.arange(8)[:, None]
        node = (1 << bit) | (byte >> (8 - bit))
        x, reach = np.empty((ORDERS, *node.shape), np.float32), np.zeros(node.shape, np.uint8)
        for k in range(ORDERS):
            x[k] = self.tables[k].take(_cells(k, _context(keys, k), node))
            np.maximum(reach, (x[k] != 0).view(np.uint8) * np.uint8(k + 1), out=reach)
        return x, reach.astype(np.int64) * ORDERS + _place(keys), node, ((byte >> (7 - bit)) & 1).astype(np.float32)

    def _predict(self, x, gate, node):
        mixed = np.zeros(gate.shape, np.float32)
        for own, by_reach, by_bits in zip(x, self.by_reach.T.copy(), self.by_bits.T.copy(), strict=True):
            weight = by_reach.take(gate)
            weight += by_bits.take(node)
            weight *= own
            mixed += weight
        mixed = mixed.clip(-12, 12)
        p = 1 / (1 + np.exp(-mixed))
        spot = (mixed.clip(-8, 8) + 8) * ((self.BUCKETS - 1) / 16)
        low = np.minimum(spot.astype(np.int32), self.BUCKETS - 2)
        part = spot - low.astype(np.float32)
        at, flat = node * self.BUCKETS + low, self.refined.reshape(-1)
        fine = flat.take(at) * (1 - part) + flat.take(at + 1) * part
        return p, at + (part > 0.5), (0.5 * p + 0.5 * fine).clip(1e-5, 1 - 1e-5)

    def learn(self, keys: np.ndarray, rate: float, step: int = 256) -> None:
        """Online, in the order of keys: predict a few bytes, then move weights and map toward what came."""
        for at in range(0, len(keys), step):
            inputs, gates, nodes, ones = self._inputs(keys[at : at + step])
            for bit in range(8):
                x, gate, node, y = inputs[:, bit], gates[bit], nodes[bit], ones[bit]
                p, spot, _ = self._predict(x, gate, node)
                move = rate * (y - p) * x
                low, high = 1 << bit, 2 << bit  # the nodes of this bit
                for own, weights, used in ((gate, self.by_reach, self.used[0]), (node - low, self.by_bits[low:high], self.used[1][low:high])):
                    total = np.stack([np.bincount(own, m, len(weights)) for m in move], axis=1)
                    count = np.bincount(own, minlength=len(weights))
                    weights += (total / np.sqrt(np.maximum(count, 1))[:, None]).astype(np.float32)
                    used += count
                low, high = low * self.BUCKETS, high * self.BUCKETS
                spot, flat = spot - low, self.refined.reshape(-1)[low:high]
                count = np.bincount(spot, minlength=len(flat))
                mean = np.bincount(spot, y, len(flat)) / np.maximum(count, 1)
                flat += ((1 - 0.99**count) * (mean - flat)).astype(np.float32)  # as count moves by a hundredth of the way
                self.used[2][low:high] += count
                np.clip(flat, 1e-4, 1 - 1e-4, out=flat)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each key's last byte takes after those before it."""
        x, gate, node, y = self._inputs(keys)
        p, total = self._predict(x, gate, node)[2], np.zeros(len(keys), np.float64)
        for bit in np.log2(np.where(y > 0, p, 1 - p)):
            total -= bit
        return total


class Scorer:
    """A mixer with the bits of recent keys remembered in a direct-mapped table."""

    SLOTS = 22

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        self.keys = np.full(1 << self.SLOTS, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(1 << self.SLOTS, np.float64)

    @classmethod
    def of(cls, mixer: Mixer) -> Scorer:
        """The scorer of a finished mixer, kept with it: a worker's tasks share one broadcast mixer, and so what is remembered."""
        if mixer.scorer is None:
            mixer.scorer = cls(mixer)
        return mixer.scorer

    def bits(self, keys: np.ndarray) -> np.ndarray:
        slot = (mix(keys) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out, new = self.values[slot], self.keys[slot] != keys
        if new.any():
            distinct, back = np.unique(keys[new], return_inverse=True)
            value = np.concatenate([self.mixer.bits(distinct[i : i + 2048]) for i in range(0, len(distinct), 2048)])
            out[new] = value[back]
            slot = (mix(distinct) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            self.keys[slot], self.values[slot] = distinct, value
            clash = self.keys[slot] != distinct  # of keys that share a slot the last stays
            self.values[slot[~clash]] = value[~clash]
        return out


def _gather(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of seven-byte strings, dealt out by their last four context bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def send():
        keys, counts = fold(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        part = (mix(_context(keys, 4)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cut))
        own = [order[cut[p] : cut[p + 1]] for p in full]
        return pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "packed": pa.array([squeeze(np.diff(keys[o].view(np.int64), prepend=0), counts[o]) for o in own], pa.binary())})

    for batch in batches:
        for _, data, offsets in text_blocks(batch, limit=_BLOCK):
            keys, counts = np.unique(grams(data, offsets)[0], return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size >= HELD:
                keys, counts = fold(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held, size = [(keys, counts)], len(keys)
                if size >= HELD // 2:
                    yield send()
                    held, size = [], 0
    if held:
        yield send()


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = [spread(x.as_py()) for x in table.column("packed")]
    return fold(np.concatenate([np.cumsum(k) for k, _ in got]), np.concatenate([c for _, c in got]))


def _to_cells(key, table: pa.Table, salts: int = 1) -> pa.Table:
    """Counts of decisions in the tables' cells, in chunks; a part's share of a chunk is first summed with those of its salt."""
    keys, counts = _unpack(table)
    keys = keys.view(np.uint64)
    out = {"chunk": [], "packed": []}
    for k in range(ORDERS):
        short, n = fold(keys & np.uint64((1 << (8 * k + 8)) - 1), counts)  # the last k bytes and the next
        context, byte = short >> np.uint64(8), short & np.uint64(255)
        cell, one, zero = [], [], []
        for bit in range(8):
            y = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
            c, a, b = fold(_cells(k, context, np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))), n * y, n * (1 - y))
            cell.append(c)
            one.append(a)
            zero.append(b)
        cell, one, zero = fold(*(np.concatenate(x) for x in (cell, one, zero)))
        chunk = cell >> CHUNK_BITS
        cut = np.searchsorted(chunk, np.arange((1 << max(CELL_BITS[k] - CHUNK_BITS, 0)) + 1))
        for c in np.flatnonzero(np.diff(cut)):
            own = slice(cut[c], cut[c + 1])
            out["chunk"].append((k << 16) + int(c))
            out["packed"].append(squeeze(np.diff(cell[own], prepend=0), one[own], zero[own]))
    salt = pa.array([key[0].as_py() % salts if key else 0] * len(out["chunk"]), pa.int32())
    return pa.table([pa.array(out["chunk"], pa.int32()), salt, pa.array(out["packed"], pa.binary())], ["chunk", "salt", "packed"])


def _log_odds(key, table: pa.Table) -> pa.Table:
    got = [spread(x.as_py()) for x in table.column("packed")]
    cell, one, zero = fold(np.concatenate([np.cumsum(c) for c, _, _ in got]), *(np.concatenate([g[i] for g in got]) for i in (1, 2)))
    order, chunk = divmod(key[0].as_py(), 1 << 16)
    values = np.zeros(1 << min(CELL_BITS[order], CHUNK_BITS), np.float16)
    odds = np.log((one + PRIOR) / (zero + PRIOR))
    values[cell - (chunk << CHUNK_BITS)] = np.where(odds == 0, SEEN, odds)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([values.tobytes()], pa.binary())})


def _add_cells(key, table: pa.Table) -> pa.Table:
    """The sum of a chunk's pieces; key is (chunk, salt)."""
    got = [spread(x.as_py()) for x in table.column("packed")]
    cell, one, zero = fold(np.concatenate([np.cumsum(c) for c, _, _ in got]), *(np.concatenate([g[i] for g in got]) for i in (1, 2)))
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([squeeze(np.diff(cell, prepend=0), one, zero)], pa.binary())})


def _tables(cells: DataFrame) -> list[np.ndarray]:
    tables = [np.zeros(1 << b, np.float16) for b in CELL_BITS]
    for row in cells.groupBy("chunk").applyInArrow(lambda key, t: _log_odds(key, t), "chunk int, cells binary").collect():
        order, chunk = divmod(row["chunk"], 1 << 16)
        values = np.frombuffer(row["cells"], np.float16)
        tables[order][chunk << CHUNK_BITS : (chunk << CHUNK_BITS) + len(values)] = values
    return tables


def _learn_groups(batches: Iterator[pa.RecordBatch], tables, start: list[np.ndarray], before: int) -> Iterator[pa.RecordBatch]:
    """What each group's mixer comes to from the start values; rows of a group follow one another. `before` bytes were learned earlier."""
    group, mixer, size = None, None, 0

    def result():
        learned = [v * n[:, None] for v, n in zip((v.astype(np.float64) for v in mixer.values()), mixer.used, strict=True)]
        return _learned(group, 1, size, learned, mixer.used)

    for batch in batches:
        groups = batch.column("group").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            if a == z:
                continue
            if groups[a] != group:
                if mixer is not None:
                    yield result()
                group, mixer, size = int(groups[a]), Mixer(tables.value), 0
                for own, value in zip(mixer.values(), start, strict=True):
                    own[:] = value
            for _, data, offsets in text_blocks(batch.slice(a, z - a), limit=_BLOCK):
                keys, at = grams(data, offsets)[0], 0
                while at < len(keys):
                    done = before + size
                    step = min(max(256, done >> 6), 4096)
                    some = keys[at : at + 16 * step]
                    mixer.learn(some, 0.005 / (1 + done / 40_000) + 0.001, step)
                    at, size = at + len(some), size + len(some)
    if mixer is not None:
        yield result()


_LEARNED = "group int, groups int, bytes long, learned array<binary>"


def _learned(group: int, groups: int, size: int, values: list[np.ndarray], used: list[np.ndarray]) -> pa.RecordBatch:
    """Values, each times its uses, and the uses, of one group or a sum of groups."""
    return pa.RecordBatch.from_pydict(
        {
            "group": pa.array([group], pa.int32()), "groups": pa.array([groups], pa.int32()), "bytes": pa.array([size], pa.int64()),
            "learned": pa.array([[a.tobytes() for a in (*values, *used)]], pa.list_(pa.binary())),
        }
    )


def _totals(rows: list[dict], start: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over rows of _learned, in the order of their groups, so that rounding does not depend on how they arrive."""
    total, used = [np.zeros(v.shape) for v in start], [np.zeros(len(v), np.int64) for v in start]
    for row in sorted(rows, key=lambda r: r["group"]):
        for i, v in enumerate(start):
            total[i] += np.frombuffer(row["learned"][i], np.float64).reshape(v.shape)
            used[i] += np.frombuffer(row["learned"][len(start) + i], np.int64)
    return total, used


def _adder(start: list[np.ndarray]):
    return lambda table: _add_groups(table.to_pylist(), start)


def _add_groups(rows: list[dict], start: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_batches([_learned(min(r["group"] for r in rows), sum(r["groups"] for r in rows), sum(r["bytes"] for r in rows), *_totals(rows, start))])


def _average(rows: list, start: list[np.ndarray]) -> list[np.ndarray]:
    """Each value's mean over the groups, weighted by its uses there; one that no group used stays."""
    return [np.where(n[:, None] > 0, t / np.maximum(n, 1)[:, None], v).astype(np.float32) for t, n, v in zip(*_totals(rows, start), start, strict=True)]


def train(docs: DataFrame) -> Mixer:
    """Tables from whole texts of all training documents; weights online from all of one fold, before the tables have it."""
    spark = docs.sparkSession
    fold_of = F.expr(f"{crc32('doc_id')} % 10")
    parts = max(64, 2 * source_parts(docs))
    salts = math.isqrt(parts)

    def cells(some: DataFrame) -> DataFrame:
        counts = some.select("text").mapInArrow(lambda it: _gather(it, parts), "part int, packed binary")
        pieces = counts.groupBy("part").applyInArrow(lambda key, t: _to_cells(key, t, salts), "chunk int, salt int, packed binary")
        return pieces.groupBy("chunk", "salt").applyInArrow(lambda key, t: _add_cells(key, t), "chunk int, packed binary")

    first = stored(cells(docs.where(fold_of > 1)), "cells")
    own = stored(docs.where(fold_of == 1).select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text"), "mixer-texts")
    groups = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MIX_BYTES))
    own = own.withColumn("group", F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int"))
    tables, values, before = spark.sparkContext.broadcast(_tables(first)), Mixer([]).values(), 0
    for r in range(MIX_ROUNDS):
        some = own.where(F.pmod("h", F.lit(MIX_ROUNDS)) == r).repartition(groups, "group").sortWithinPartitions("group", "h", "doc_id", "text").select("group", "text")
        learned = some.mapInArrow(lambda it, start=values, before=before: _learn_groups(it, tables, start, before), _LEARNED)
        rows = learned.groupBy(F.col("group") % MIX_SUMS).applyInArrow(_adder(values), _LEARNED).collect()
        values = _average(rows, values)
        before += sum(x["bytes"] for x in rows) // max(sum(x["groups"] for x in rows), 1)
    tables.destroy()
    mixer = Mixer(_tables(first.unionByName(stored(cells(docs.where(fold_of == 1)), "more-cells"))))
    for mine, value in zip(mixer.values(), values, strict=True):
        mine[:] = value
    return mixer


def _count_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of training words and ends by hash range."""
    held, size = [], 0

    def send():
        keys, counts = fold(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        part = (keys % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cut))
        own = [order[cut[p] : cut[p + 1]] for p in full]
        return pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "packed": pa.array([squeeze(np.diff(keys[o].view(np.int64), prepend=0), counts[o]) for o in own], pa.binary())})

    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=_BLOCK):
            starts, ends, _ = word_spans(data, offsets)
            words = np.concatenate([word_hashes(data, starts, ends, lower=True), np.full(rows.num_rows, _END_WORD)])
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
            if size >= HELD:
                yield send()
                held, size = [], 0
    if held:
        yield send()


def _vocabulary(key, table: pa.Table) -> pa.Table:
    got = [spread(x.as_py()) for x in table.column("packed")]
    keys, counts = fold(np.concatenate([np.cumsum(k) for k, _ in got]).view(np.uint64), np.concatenate([c for _, c in got]))
    levels = np.bincount(np.log2(counts).astype(np.int64), minlength=64)
    return pa.table(
        {
            "part": pa.array([key[0].as_py()], pa.int32()), "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()),
            "levels": pa.array([levels.tolist()], pa.list_(pa.int64())), "packed": pa.array([squeeze(keys.view(np.int64), counts)], pa.binary()),
        }
    )


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("packed"):
            keys, counts = spread(x.as_py())
            yield pa.RecordBatch.from_pydict({"word": keys[counts >= least], "n": counts[counts >= least]})


def _score(batches: Iterator[pa.RecordBatch], shared, parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its frequent words counted, and packed rows of its other words by hash range."""
    mixer, frequent, counts, logs = shared.value
    scorer, task, n_rows = Scorer.of(mixer), TaskContext.get().partitionId(), 0
    names = ["part", "packed", "row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score"]
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=_BLOCK):
            n = rows.num_rows
            starts, ends, first = word_spans(data, offsets)
            words = word_hashes(data, starts, ends, lower=True)
            doc = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.arange(n)])
            words = np.concatenate([words, np.full(n, _END_WORD)])
            at = np.minimum(np.searchsorted(frequent, words), max(len(frequent) - 1, 0))
            hit = frequent[at] == words if len(frequent) else np.zeros(len(words), bool)
            known = np.bincount(doc[hit], minlength=n)
            base = np.bincount(doc[hit], logs[at[hit]], minlength=n)
            keys, stop = grams(data, offsets)
            score = -np.add.reduceat(scorer.bits(keys), stop[:-1]) * np.log10(2)
            ids = np.arange(n_rows, n_rows + n, dtype=np.int64) + (task << 40)
            n_rows += n
            none = lambda m, t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays(
                [none(n, pa.int32()), none(n, pa.binary()), pa.array(ids), rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(first) + 1), pa.array(np.diff(stop)), pa.array(known), pa.array(base), pa.array(score)], names
            )
            words, doc = words[~hit], doc[~hit]
            part = (words % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((doc, part))
            words, doc, part = words[order], doc[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            packed = [squeeze(words[cut[p] : cut[p + 1]].view(np.int64), np.diff(ids[doc[cut[p] : cut[p + 1]]], prepend=0)) for p in full]
            m = len(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(packed, pa.binary()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.bool_()), *(none(m, pa.int64()) for _ in range(3)), *(none(m, pa.float64()) for _ in range(2))], names
            )


def _meet(key, asked: pa.Table, vocabulary: pa.Table, total: int, distinct: int) -> pa.Table:
    """Counts for the rarer words of one hash range, summed by row and packed by the task that read the row."""
    if not asked.num_rows:
        return pa.table({"task": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
    got = [spread(x.as_py()) for x in asked.column("packed")]
    words, rows = np.concatenate([w for w, _ in got]).view(np.uint64), np.concatenate([np.cumsum(r) for _, r in got])
    count = np.zeros(len(words), np.int64)
    for x in vocabulary.column("packed"):
        keys, counts = spread(x.as_py())
        at = np.minimum(np.searchsorted(keys.view(np.uint64), words), len(keys) - 1)
        count = np.where(keys.view(np.uint64)[at] == words, counts[at], 0)
    rows, known, base = fold(rows, (count > 0).astype(np.int64), np.log10((count + 0.1) / (total + 0.1 * (distinct + 1))))
    task = (rows >> 40).astype(np.int32)
    cut = np.append(np.flatnonzero(np.diff(task, prepend=-1)), len(task))
    packed = [squeeze(np.diff(rows[a:b], prepend=0), known[a:b], base[a:b].view(np.int64)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"task": pa.array(task[cut[:-1]], pa.int32()), "packed": pa.array(packed, pa.binary())})


def _per_row(key, table: pa.Table) -> pa.Table:
    got = [spread(x.as_py()) for x in table.column("packed")]
    rows, known, base = fold(np.concatenate([np.cumsum(r) for r, _, _ in got]), np.concatenate([k for _, k, _ in got]), np.concatenate([b.view(np.float64) for _, _, b in got]))
    return pa.table({"row": rows, "more_known": known, "more_base": base})


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs (doc_id, text).

    Learns from documents whose crc32(doc_id as text) mod 10 is not 0; null doc_ids are scored and teach nothing. A null
    text counts as an empty one: an end alone, in training too. score is the log10 probability of a text's bytes and their
    end, bits_per_byte the same in bits, for each byte, the end counted as one. Words are compared by 64-bit hashes. A
    repeated row teaches again and is scored again. Texts are scored whole, however long. Columns other than doc_id and
    text are not read. An empty table gives an empty table."""
    spark = docs.sparkSession
    held = F.expr(f"{crc32('doc_id')} % 10 = 0")
    parts = max(64, 2 * source_parts(docs))
    words = docs.where(~held).select("text").mapInArrow(lambda it: _count_words(it, parts), "part int, packed binary")
    vocabulary = stored(words.groupBy("part").applyInArrow(lambda key, t: _vocabulary(key, t), "part int, distinct long, total long, levels array<long>, packed binary"), "vocabulary")
    sums = vocabulary.agg(F.sum("distinct"), F.sum("total"), *(F.sum(F.col("levels")[i]) for i in range(64))).first()
    distinct, total = sums[0] or 0, sums[1] or 0
    level, taken = 63, 0
    while level >= 0 and taken + (sums[2 + level] or 0) <= FREQUENT:
        taken += sums[2 + level] or 0
        level -= 1
    table = vocabulary.select("packed").mapInArrow(lambda it: _frequent(it, 1 << (level + 1)), "word long, n long").toPandas()
    frequent = table["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, counts = frequent[order], table["n"].to_numpy(np.int64)[order]
    logs = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
    shared = spark.sparkContext.broadcast((train(docs), frequent, counts, logs))
    schema = "part int, packed binary, row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double"
    every = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    scored = stored(every.mapInArrow(lambda it: _score(it, shared, parts), schema), "scored")
    asked = scored.where("part IS NOT NULL").select("part", "packed")
    met = asked.groupBy("part").cogroup(vocabulary.select("part", "packed").groupBy("part")).applyInArrow(lambda key, a, v: _meet(key, a, v, total, distinct), "task int, packed binary")
    more = met.groupBy("task").applyInArrow(lambda key, t: _per_row(key, t), "row long, more_known long, more_base double")
    out = scored.where("row IS NOT NULL").join(more, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_context_mixing(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
