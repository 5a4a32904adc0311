"""Token ids in Arrow files: record batches of fixed-size lists, so that any sequence and its mask is a slice of the file.

Texts are dealt out by ranges of doc_id and sorted, encoded with the tokenizers library, and written in shards of whole
documents. A shard is an Arrow IPC file with columns ids (fixed-size list of unsigned integers), mask (fixed-size list of
booleans: false is padding), ends (fixed-size list: the last id of a document) and docs (doc_ids that end in the
sequence). Ids take 16 bits if the vocabulary allows. Spark's text writer commits the files, so that lost tasks leave none
behind, and any file system that Spark reaches will do: a row is a whole file but for its closing magic string, which the
writer adds as the line separator.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import scratch, stored
from ._text import text_blocks

SEQUENCE = 1024
#: Ids after which a shard is closed with the document at hand.
SHARD_IDS = 1 << 21
#: Sequences in a record batch.
BATCH = 256
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 800_000
MAGIC = "ARROW1"

#: A blank before further white space or the end: there, splitting at blanks could change the ids.
_LOOSE = re.compile(r" (?:\s|\Z)")


#: Letters of two fixed blocks, then at most one mark: byte-level BPE always parts them there, and merges each alone.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)\Z")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next beyond 255 (a published fixed rule)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """The tokenizers library on texts cut at single blanks, with the ids of pieces remembered.

    Byte-level BPE splits a text before each blank that white space or the end does not follow, and merges nothing
    across; so the ids of such pieces, each with its blank, are the ids of the text. Other texts are encoded whole, and
    so are all texts for a tokenizer of another kind.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        told = json.loads(self.tokenizer.to_str())
        split = told["pre_tokenizer"] or {}
        self.by_piece = told["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.letters = _byte_letters()
        self.blank, self.merge, self.code = chr(self.letters[32]), self.tokenizer.model.tokenize, np.dtype(self.dtype).char
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.remembered = remembered

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a blank and letters, which no rule splits: the library's merges alone."""
        written = self.blank + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return array(self.code, [t.id for t in self.merge(written)]).tobytes()

    def _pieces(self, new: set[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for piece in new:
            plain = _PLAIN.match(piece)
            if plain is None:
                rest.append(piece)
                continue
            word, mark = plain.groups()
            if mark not in self.marks:
                self.marks[mark] = self._encode([mark])[0]
            out[piece] = (self.known.get(word) or out.get(word) or self._word(word)) + self.marks[mark]
        out.update(zip(rest, self._encode([" " + p for p in rest]), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = lambda t: not self.by_piece or _LOOSE.search(t) or any(x in t for x in self.special)
        cut = [None if whole(t) else t.split(" ") for t in texts]
        known = self.known
        extra = self._pieces({p for pieces in cut if pieces for p in pieces[1:] if p not in known})
        if len(known) + len(extra) <= self.remembered:
            known.update(extra)
            extra = {}
        heads = iter(self._encode([t if pieces is None else pieces[0] for t, pieces in zip(texts, cut, strict=True)]))
        out = []
        for pieces in cut:
            head = next(heads)
            if pieces is None:
                out.append(head)
            elif extra:
                out.append(b"".join([head, *[known.get(p) or extra[p] for p in pieces[1:]]]))
            else:
                out.append(b"".join([head, *map(known.__getitem__, pieces[1:])]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shard_file(docs: list[tuple[int | None, np.ndarray]], length: int, shard: tuple[int, int]) -> bytes:
    """An Arrow IPC file of whole documents (doc_id, ids)."""
    dtype = docs[0][1].dtype
    stop = np.cumsum([len(x) for _, x in docs])
    total = int(stop[-1])
    rows = max(1, -(-total // length))
    ids, mask, ends = np.zeros(rows * length, dtype), np.zeros(rows * length, bool), np.zeros(rows * length, bool)
    ids[:total] = np.concatenate([x for _, x in docs])
    mask[:total] = True
    ends[stop - 1] = True
    per_row = np.searchsorted((stop - 1) // length, np.arange(rows + 1))
    fixed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a), length)
    columns = [fixed(ids), fixed(mask), fixed(ends), pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.array([d for d, _ in docs], pa.int64()))]
    table = pa.record_batch(columns, ["ids", "mask", "ends", "docs"]).replace_schema_metadata({"shard": "%d %d" % shard, "ids": str(total)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        for at in range(0, rows, BATCH):
            writer.write_batch(table.slice(at, BATCH))
    return sink.getvalue().to_pybytes()


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    tool, task, shard = encoder(path), TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0

    def close():
        raw = shard_file(held, length, (task, shard))
        assert raw.endswith(MAGIC.encode())
        return pa.RecordBatch.from_pydict({"file": pa.array([raw[: -len(MAGIC)]], pa.binary())})

    for batch in batches:
        for rows, _, _ in text_blocks(batch):
            texts = [x or "" for x in rows.column("text").to_pylist()]
            for doc, raw in zip(rows.column("doc_id").to_pylist(), tool.encode(texts), strict=True):
                ids = np.append(np.frombuffer(raw, tool.dtype), tool.dtype(end_id))
                held.append((doc, ids))
                size += len(ids)
                if size >= SHARD_IDS:
                    yield close()
                    held, size, shard = [], 0, shard + 1
    if held:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, length: int = SEQUENCE) -> None:
    """Writes the ids of each whole text, and end_id after it, in ascending doc_id order to Arrow files under path.

    Null and empty texts are the end id alone. Rows with a null doc_id come first, repeated rows each with all of its ids,
    in any order among themselves. An empty table writes no Arrow file. A text of any length stays in one shard."""
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = ranged.mapInArrow(lambda it: _shards(it, tokenizer, end_id, length), "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(path)


def open_shard(raw) -> pa.ipc.RecordBatchFileReader:
    """Random access to a shard's sequences without copying: reader.get_batch(i).column("ids")[j]."""
    return pa.ipc.open_file(pa.py_buffer(raw))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            reader = open_shard(content.as_buffer())
            task, shard = map(int, reader.schema.metadata[b"shard"].split())
            table = reader.read_all()
            ids, mask, ends = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(x).chunks]) for x in ("ids", "mask", "ends"))
            ids, stop = ids[mask], np.flatnonzero(ends[mask]) + 1
            docs = table.column("docs").combine_chunks().flatten()
            start = np.concatenate([[0], stop[:-1]])
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(start, stop, strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_pydict(
                {"task": np.full(n, task), "shard": np.full(n, shard), "total": np.full(n, len(ids)), "doc_id": docs, "at": start, "n_tokens": stop - start, "ids_crc32": pa.array(crc, pa.int64())}
            )


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32, from the files under path. Only totals of shards, not ids, meet in one place."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    docs = stored(files.mapInArrow(_documents, "task long, shard long, total long, doc_id long, at long, n_tokens long, ids_crc32 long"), "documents")
    shards = docs.where("at = 0").select("task", "shard", "total").distinct()
    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    first = shards.select("task", "shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return docs.join(first, ["task", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
