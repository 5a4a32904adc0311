"""Substring dedup on a de Bruijn graph of words.

Every window of k consecutive words is an edge, from its first to its last k - 1 words. Edges meet by hash range; an edge
that also starts in a document with a smaller doc_id carries a source coordinate, the document and word position of an
earlier occurrence. Edges of a document that follow one another while their source coordinates do too are a nonbranching
path; a branch, in the document or at the source, ends it. Paths are compacted within tiles of TILE positions first, then
by joins of each piece with the one that begins where it ends, doubling the reach each round. Joins with the texts at
both coordinates verify each span word for word. Words under a verified span go.

Edges travel packed, about 10 bytes each: one row for each block of documents and hash range, holding sorted-out hashes
and compressed coordinates. A window that several documents of a block share is sent for the smallest of them alone: the
others have their source in the block. The same holds for windows that earlier blocks of the task were found to share. So
a passage that a third of all documents hold costs its hash range a few rows a task, not one for each document.

Rows of one doc_id with different texts are variants of it, told apart by a hash of the text: edges, paths and spans belong
to a variant, and so do the words that go. Ranges and tiles are dealt to a number of tasks that grows with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import spread, squeeze
from ._store import sized, source_parts, stored
from ._text import mix, text_blocks, window_hashes, word_hashes, word_spans

K = 13
#: Text bytes whose edges are packed together.
PACK_BYTES = 2 << 20
#: log2 of the positions of a document in whose tiles paths are compacted before pieces are joined.
TILE_BITS = 8
#: Shared windows that a task remembers from block to block; beyond it, those of the last block.
REMEMBERED = 1 << 17
#: Hash ranges for each task that reads documents: a range holds about a sixteenth of one task's edges.
RANGES_PER_TASK = 16
#: Tasks that ranges, and then tiles, are dealt to, for each task that reads documents.
TASKS_PER_TASK = 4
#: Spans, about, whose digests one row asks a text for: a source of more of them is read by several rows.
SPANS_A_ROW = 4096


def _tiles(docs: np.ndarray, pos: np.ndarray, parts: int) -> np.ndarray:
    return (mix(docs.view(np.uint64) ^ mix((pos >> TILE_BITS).view(np.uint64))) % np.uint64(parts)).astype(np.int32)


def _sourced(docs: np.ndarray, kinds: np.ndarray, pos: np.ndarray, source: np.ndarray, its: np.ndarray, start: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Packed edges with the coordinates of their sources, by tile. kinds and its are variants, of the edges and the sources."""
    part = _tiles(docs, pos, parts)
    order = np.lexsort((pos, kinds, docs, part))
    docs, kinds, pos, source, its, start, part = (x[order] for x in (docs, kinds, pos, source, its, start, part))
    cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    packed = [
        squeeze(np.diff(docs[a:b], prepend=0), kinds[a:b], np.diff(pos[a:b], prepend=0), docs[a:b] - source[a:b], its[a:b], pos[a:b] - start[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)
    ]
    return part[cut[:-1]], packed


class _Shared:
    """Windows that several documents of a task share, each with its smallest document so far and the position there."""

    def __init__(self):
        self.hashes, self.docs, self.kinds, self.pos = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, hashes: np.ndarray, docs: np.ndarray, kinds: np.ndarray, pos: np.ndarray) -> None:
        new = (hashes, docs, kinds, pos)
        if len(self.hashes) + len(hashes) <= REMEMBERED:
            new = tuple(np.concatenate(both) for both in zip((self.hashes, self.docs, self.kinds, self.pos), new, strict=True))
        order = np.lexsort((new[3], new[2], new[1], new[0]))
        hashes = new[0][order]
        head = np.ones(len(hashes), bool)
        head[1:] = hashes[1:] != hashes[:-1]
        self.hashes, self.docs, self.kinds, self.pos = (x[order][head][:REMEMBERED] for x in new)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are known, and where)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[at] == hashes)
        return known, at[known]


def _within(hashes: np.ndarray, docs: np.ndarray, kinds: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges that also start in a smaller document of the same arrays, the first place of each)."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    many = np.zeros(len(hashes), bool)
    many[:-1] |= same
    many[1:] |= same
    some = order[many]
    some = some[np.lexsort((pos[some], kinds[some], docs[some], hashes[some]))]
    own = hashes[some]
    head = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))
    source = some[np.repeat(head, np.diff(head, append=len(some)))]
    late = docs[some] > docs[source]
    return some[late], source[late]


def _edges(batches: Iterator[pa.RecordBatch], k: int, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed edges by hash range, and as part -1 - tile those whose source was found on the way."""
    shared = _Shared()
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=PACK_BYTES):
            starts, ends, first = word_spans(data, offsets)
            hashes, at = window_hashes(word_hashes(data, starts, ends, lower=False), first, k)
            if not len(hashes):
                continue
            docs, kinds = (np.repeat(rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at)) for c in ("doc_id", "variant"))
            pos = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
            source, its, start = docs.copy(), kinds.copy(), pos.copy()
            late, first_place = _within(hashes, docs, kinds, pos)
            source[late], its[late], start[late] = docs[first_place], kinds[first_place], pos[first_place]
            known, where = shared.find(hashes)
            earlier = shared.docs[where] < docs[known]
            known, where = known[earlier], where[earlier]
            source[known], its[known], start[known] = shared.docs[where], shared.kinds[where], shared.pos[where]
            places = np.unique(first_place)
            shared.add(hashes[places], docs[places], kinds[places], pos[places])
            sent = source < docs
            tile, packed = _sourced(*(x[sent] for x in (docs, kinds, pos, source, its, start)), parts)
            out = {"part": (-1 - tile).tolist(), "edges": [None] * len(packed), "places": packed}
            order = np.flatnonzero(~sent)
            part = (hashes[order] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            by_part = np.argsort(part, kind="stable")
            order, part = order[by_part], part[by_part]
            cut = np.searchsorted(part, np.arange((1 << bits) + 1))
            low = hashes[order].view(np.uint8).reshape(-1, 8)[:, :7]  # the range stands for the top byte
            for p in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[p] : cut[p + 1]]
                heads = np.flatnonzero(np.concatenate([[True], (docs[own[1:]] != docs[own[:-1]]) | (kinds[own[1:]] != kinds[own[:-1]])]))
                out["part"].append(p)
                out["edges"].append(low[cut[p] : cut[p + 1]].tobytes())
                out["places"].append(squeeze(np.diff(docs[own[heads]], prepend=0), kinds[own[heads]], np.diff(heads, append=len(own)), np.diff(pos[own], prepend=0)))
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["edges"], pa.binary()), pa.array(out["places"], pa.binary())], list(out))


def _repeats(key, table: pa.Table, parts: int) -> pa.Table:
    """Edges of one hash range that start in a document smaller than theirs, with the first place they start at, by tile."""
    part = key[0].as_py()
    if part < 0:
        tile, packed = [-1 - part] * table.num_rows, table.column("places").combine_chunks()
        return pa.table([pa.array(tile, pa.int32()), packed], ["part", "places"])
    low, docs, kinds, pos = [], [], [], []
    for edges, places in zip(table.column("edges"), table.column("places"), strict=True):
        flat = np.frombuffer(edges.as_py(), np.uint8).reshape(-1, 7)
        wide = np.zeros((len(flat), 8), np.uint8)
        wide[:, :7] = flat
        low.append(wide.reshape(-1).view(np.uint64))
        d, v, n, p = spread(places.as_py())
        docs.append(np.repeat(np.cumsum(d), n))
        kinds.append(np.repeat(v, n))
        pos.append(np.cumsum(p))
    low, docs, kinds, pos = (np.concatenate(x) for x in (low, docs, kinds, pos))
    late, source = _within(low, docs, kinds, pos)
    tile, packed = _sourced(docs[late], kinds[late], pos[late], docs[source], kinds[source], pos[source], parts)
    return pa.table([pa.array(tile, pa.int32()), pa.array(packed, pa.binary())], ["part", "places"])


def _pieces(key, table: pa.Table) -> pa.Table:
    """Maximal runs, within a tile, of repeated edges whose source coordinates advance with their own."""
    docs, kinds, pos, back, its, lag = cells = [[] for _ in range(6)]
    for places in table.column("places"):
        for cell, values, summed in zip(cells, spread(places.as_py()), (True, False, True, False, False, False), strict=True):
            cell.append(np.cumsum(values) if summed else values)
    docs, kinds, pos, back, its, lag = (np.concatenate(x) for x in cells)
    order = np.lexsort((its, -lag, -back, pos, kinds, docs))
    docs, kinds, pos, back, its, lag = (x[order] for x in (docs, kinds, pos, back, its, lag))
    once = np.ones(len(docs), bool)
    once[1:] = (docs[1:] != docs[:-1]) | (kinds[1:] != kinds[:-1]) | (pos[1:] != pos[:-1])
    docs, kinds, pos, back, its, lag = (x[once] for x in (docs, kinds, pos, back, its, lag))
    start = np.ones(len(docs), bool)
    start[1:] = (pos[1:] != pos[:-1] + 1) | (pos[1:] >> TILE_BITS << TILE_BITS == pos[1:])
    for same in (docs, kinds, back, its, lag):
        start[1:] |= same[1:] != same[:-1]
    at = np.flatnonzero(start)
    return pa.table({"doc_id": docs[at], "variant": kinds[at], "start": pos[at], "end": pos[at] + np.diff(at, append=len(docs)), "back": back[at], "source_variant": its[at], "lag": lag[at]})


def compact(pieces: DataFrame) -> DataFrame:
    """Pieces of paths (doc_id, start, end, back, lag and, if there, variants; edges start to end - 1) as whole paths: a
    piece is joined with the one that begins where it ends, on the same document and source, and reaches twice as far each
    round."""
    columns = pieces.columns
    pieces, chain = stored(pieces, "pieces"), [c for c in columns if c not in ("start", "end")]
    border = (F.col("start") % (1 << TILE_BITS) == 0) | (F.col("end") % (1 << TILE_BITS) == 0)
    now = pieces.where(border)
    heads = now.join(now.select(*chain, F.col("end").alias("start")), [*chain, "start"], "left_anti").select(*chain, "start")
    while True:
        after = now.select(*chain, F.col("start").alias("end"), F.col("end").alias("to"))
        now = now.join(after, [*chain, "end"], "left")
        now = stored(now.select(*chain, "start", F.coalesce("to", "end").alias("end"), F.col("to").isNotNull().alias("moved")), "paths")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    whole = now.join(heads, [*chain, "start"], "left_semi").select(columns)
    return pieces.where(~border).unionByName(whole)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"doc_id": [], "variant": [], "start": [], "n": [], "digest": []}
        for doc, kind, text, spans in zip(*(batch.column(c) for c in ("doc_id", "variant", "text", "spans")), strict=True):
            words = (text.as_py() or "").encode().split()
            for s in spans.as_py():
                own = words[s["start"] : s["start"] + s["n"]]
                out["doc_id"].append(doc.as_py())
                out["variant"].append(kind.as_py())
                out["start"].append(s["start"])
                out["n"].append(s["n"])
                out["digest"].append(hashlib.blake2b(b" ".join(own), digest_size=16).digest() if len(own) == s["n"] else b"")
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "digest" else pa.int64()) for c, v in out.items()], list(out))


def _variants(docs: DataFrame) -> DataFrame:
    """doc_id, text, variant: a hash of the text where a doc_id has several texts, else 0. Rows with a null doc_id go."""
    rows, own = docs.where("doc_id IS NOT NULL").select("doc_id", "text"), F.xxhash64("text")
    several = stored(rows.groupBy("doc_id").agg(F.min(own).alias("_low"), F.max(own).alias("_high")).where("_low != _high").select("doc_id", F.lit(True).alias("_several")), "several")
    if several.isEmpty():
        return rows.withColumn("variant", F.lit(0).cast("long"))
    return rows.join(sized(several), "doc_id", "left").select("doc_id", "text", F.when(F.col("_several"), own).otherwise(F.lit(0)).alias("variant"))


def _spans_of(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Rows of docs with the marks (_doc, variant, spans) of their variants."""
    own = (docs.doc_id == marks["_doc"]) & ((marks.variant == 0) | (marks.variant == F.xxhash64(docs.text)))
    return docs.join(marks, own, how)


def _by_doc(spans: DataFrame, *more: str) -> DataFrame:
    """One row for each variant of a document."""
    return spans.groupBy(F.col("doc_id").alias("_doc"), "variant", *more).agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _verify(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans whose words are those at their source, and the others."""
    there = spans.select(F.col("source_id").alias("doc_id"), F.col("source_variant").alias("variant"), F.col("source_start").alias("start"), "n")
    asked = stored(spans.select("doc_id", "variant", "start", "n").unionByName(there).distinct(), "asked")
    crowded = asked.groupBy("doc_id", "variant").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SPANS_A_ROW)
    many = asked.join(crowded.select("doc_id", "variant", F.ceil(F.col("_n") / SPANS_A_ROW).alias("_rows")), ["doc_id", "variant"], "left")
    salted = many.withColumn("_salt", F.pmod(F.xxhash64("start", "n"), F.coalesce("_rows", F.lit(1))))
    texts = _spans_of(docs.select("doc_id", "text"), _by_doc(salted, "_salt"), "inner").select("doc_id", "variant", "text", "spans")
    key = ["doc_id", "variant", "start", "n"]
    digests = stored(texts.mapInArrow(_digests, "doc_id long, variant long, start long, n long, digest binary").dropDuplicates(key), "digests")
    own = digests.select(*key, F.col("digest").alias("own"))
    source = digests.select(F.col("doc_id").alias("source_id"), F.col("variant").alias("source_variant"), F.col("start").alias("source_start"), "n", F.col("digest").alias("its"))
    both = stored(spans.join(own, key).join(source, ["source_id", "source_variant", "source_start", "n"]), "verified")
    good = (F.col("own") == F.col("its")) & (F.length("own") > 0)
    return both.where(good).select(spans.columns), both.where(~good).select(spans.columns)


def repeated_spans(docs: DataFrame, k: int = K, variants: bool = False) -> DataFrame:
    """doc_id, start, n, source_id, source_start: words start to start + n of doc_id that stand word for word in source_id,
    a smaller doc_id, from source_start on. Every k-word window of a document that also starts in a smaller document lies
    in one of its spans. A span's source is a smaller document that holds it, not always the smallest that does. Texts with
    fewer than k words, null, empty and blank texts and rows with a null doc_id have none; a repeated row is the same
    document. Rows of one doc_id with different texts are each judged by their own words, and each is a source for documents
    with larger ids; with variants, columns variant and source_variant tell which text is meant: its xxhash64, 0 where the
    doc_id has one text alone. Other columns are not read. Texts are read whole, however long. An empty table gives no
    spans."""
    rows = _variants(docs)
    tasks = source_parts(docs)
    dealt, tiles = TASKS_PER_TASK * tasks, 4 * tasks
    bits = min(20, max(8, (RANGES_PER_TASK * tasks - 1).bit_length()))
    packed = rows.mapInArrow(lambda it: _edges(it, k, bits, tiles), "part int, edges binary, places binary").repartition(dealt, "part")
    places = packed.groupBy("part").applyInArrow(lambda key, t: _repeats(key, t, tiles), "part int, places binary").repartition(dealt, "part")
    paths = compact(places.groupBy("part").applyInArrow(lambda key, t: _pieces(key, t), "doc_id long, variant long, start long, end long, back long, source_variant long, lag long"))
    source = [(F.col("doc_id") - F.col("back")).alias("source_id"), (F.col("start") - F.col("lag")).alias("source_start"), "source_variant"]
    spans = paths.select("doc_id", "start", (F.col("end") - F.col("start") + (k - 1)).alias("n"), *source, "variant")
    good, bad = _verify(rows, stored(spans, "spans"))
    if not bad.isEmpty():
        # two texts met in one hash: judge their spans window by window
        each = bad.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("_i")).withColumns({c: F.col(c) + F.col("_i") for c in ("start", "source_start")})
        good = good.unionByName(_verify(rows, each.withColumn("n", F.lit(k).cast("long")).drop("_i"))[0])
    return good.select("doc_id", "start", "n", "source_id", "source_start", *(("variant", "source_variant") if variants else ()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, words_of, gone = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if spans.as_py():
                drop = np.zeros(n, bool)
                for s in spans.as_py():
                    drop[s["start"] : s["start"] + s["n"]] = True
                words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            words_of.append(n)
            gone.append(n - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words_of, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by blanks) for each row of docs; null texts have no
    words. Spans with a variant hold for that text of the doc_id alone, spans without one for all of its texts."""
    if "variant" not in spans.columns:
        spans = spans.withColumn("variant", F.lit(0).cast("long"))
    both = _spans_of(docs.select("doc_id", "text"), _by_doc(spans), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, repeated_spans(docs, variants=True))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
