"""SentencePiece encoding and decoding for merge-type vocabularies.

A score-ordered agenda of adjacent symbol pairs: the pair whose joint piece has the highest score merges first, the
leftmost of equals, until no pair is a piece; what is no piece falls back to bytes. No piece of such a vocabulary has a
blank after another character, so a text is cut before each run of blanks, and each distinct part is merged once in a
worker. Short parts go through the agenda side by side in numpy, long ones by a heap. In every Arrow batch, new parts are
checked against the sentencepiece library; texts with a part that differs take the library's ids, and agrees is false.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import held, text_blocks

BLANK = "▁"
#: Parts whose ids a worker remembers.
REMEMBERED = 250_000
#: Text bytes encoded at once; their ids are Python lists, several times the size of the text.
CODE_BYTES = 1 << 19
#: Symbols of a part beyond which its agenda is a heap.
SIDE_BY_SIDE = 48
_PARTS = re.compile(r" *[^ ]+| +")


class Codec:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != 2 or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not trained.byte_fallback:
            raise ValueError("a merge-type model is needed, with a leading blank, byte fallback and no other normalization")
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece has a blank after another character")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # symbols: ids of pieces, then further single characters as they come
        self.symbols, self.texts = dict(self.pieces), {i: p for p, i in self.pieces.items()}
        self.next = len(model.pieces)
        order = sorted(self.pieces.values(), key=lambda i: (-model.pieces[i].score, i))
        self.rank = np.full(len(model.pieces), len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array([*order, -1], np.int64)
        pairs = {}
        for piece, i in self.pieces.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if (a in self.pieces or cut == 1) and (b in self.pieces or cut == len(piece) - 1):
                    pairs[(self._symbol(a) << 32) | self._symbol(b)] = int(self.rank[i])
        keys = np.array(list(pairs), np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks = keys[by], np.array(list(pairs.values()), np.int64)[by]
        self.none = len(order)
        self.decimal = [str(i).encode() for i in range(len(model.pieces))]
        self.code = np.uint16 if len(model.pieces) <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _symbol(self, text: str) -> int:
        i = self.symbols.get(text)
        if i is None:
            i = self.symbols[text] = self.next
            self.texts[i] = text
            self.next += 1
        return i

    def _ids(self, symbols) -> tuple[int, ...]:
        n = len(self.rank)
        return tuple(chain.from_iterable((s,) if s < n else (self.bytes[b] for b in self.texts[s].encode()) for s in symbols))

    def agenda(self, text: str) -> tuple[int, ...]:
        """Ids of one text whose blanks are marked, by a heap of pairs; a pair that has since changed is passed over."""
        symbols = [self._symbol(c) for c in text]
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap = []

        def add(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (r := self._rank_of_pair(symbols[i], symbols[j])) < self.none:
                heap.append((r, i, symbols[i], symbols[j])) if not live else heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        live = False
        for i in range(len(symbols)):
            add(i)
        heapq.heapify(heap)
        live = True
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.by_rank[r]), -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            add(left[i])
            add(i)
        return self._ids(s for s in symbols if s >= 0)

    def _rank_of_pair(self, a: int, b: int) -> int:
        key = (a << 32) | b
        at = int(self.keys.searchsorted(key))
        return int(self.ranks[at]) if at < len(self.keys) and self.keys[at] == key else self.none

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def agendas(self, texts: list[str]) -> list[tuple[int, ...]]:
        """The same for many short texts: in each round, every text merges its best pair."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = "".join(texts)
        points, inverse = np.unique(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        symbols = np.array([self._symbol(chr(p)) for p in points.tolist()], np.int64)[inverse]
        owner = np.repeat(np.arange(len(texts)), sizes)
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), self.none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank_of(symbols[inner], symbols[inner + 1])
        while len(symbols):
            n = len(symbols)
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank * n + np.arange(n), head)
            goes = best < self.none * n
            if not goes.all():  # texts without a pair are done
                stay = np.repeat(goes, np.diff(head, append=n))
                done_symbols.append(symbols[~stay])
                done_owner.append(owner[~stay])
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                continue
            at = best % n
            symbols[at] = self.by_rank[rank[at]]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at = new[at]
            for i in (at, at[at > 0] - 1):  # the pairs on both sides of what has merged
                last = (i + 1 >= len(symbols)) | (owner[np.minimum(i + 1, len(symbols) - 1)] != owner[i])
                j = i[~last]
                rank[i[last]] = self.none
                rank[j] = self._rank_of(symbols[j], symbols[j + 1])
        if not done_symbols:
            return []
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, cut = symbols[order], np.searchsorted(owner[order], np.arange(len(texts) + 1)).tolist()
        plain = symbols.tolist()
        wild = np.zeros(len(texts), bool)
        wild[owner[order][symbols >= len(self.rank)]] = True
        return [self._ids(plain[a:b]) if w else tuple(plain[a:b]) for a, b, w in zip(cut[:-1], cut[1:], wild.tolist(), strict=True)]

    def _learn(self, parts: list[str]) -> tuple[dict[str, bytes], set[str]]:
        """Packed ids of each part, and the parts on which the library differs."""
        marked = [BLANK + p.replace(" ", BLANK) for p in parts]
        short = [i for i, m in enumerate(marked) if len(m) <= SIDE_BY_SIDE]
        ids: list = [None] * len(parts)
        for i, x in zip(short, self.agendas([marked[i] for i in short]), strict=True):
            ids[i] = x
        for i, m in enumerate(marked):
            if ids[i] is None:
                ids[i] = self.agenda(m)
        off = {p for p, x, y in zip(parts, ids, self.library.encode(parts, num_threads=1), strict=True) if p and list(x) != y}
        return {p: array(np.dtype(self.code).char, x).tobytes() for p, x in zip(parts, ids, strict=True)}, off

    def encode(self, texts: list[str]) -> list[tuple[bytes, list[int], bool]]:
        """(ids in decimal joined by commas, ids, whether the agenda agrees with the library) of each text."""
        cut = []
        for t in texts:
            t = t.replace(BLANK, " ")
            if not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                cut.append([p[1:] for p in _PARTS.findall(" " + t)])
            else:
                cut.append(t.split(" "))
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        extra, off = self._learn(new) if new else ({}, set())
        if not off and len(known) + len(extra) <= self.remembered:
            known.update(extra)
            get = known.__getitem__
        else:
            get = lambda p: known.get(p) or extra[p]
        out = []
        for t, parts in zip(texts, cut, strict=True):
            agrees = not off or off.isdisjoint(parts)
            ids = np.frombuffer(b"".join(map(get, parts)), self.code).tolist() if agrees else self.library.encode(t)
            out.append((b",".join([self.decimal[i] for i in ids]), ids, agrees))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tool = held(("sentencepiece", path), lambda: Codec(path))
    for batch in batches:
        for rows, _, _ in text_blocks(batch, limit=CODE_BYTES):
            got = tool.encode([x or "" for x in rows.column("text").to_pylist()])
            texts = tool.decode([x[1] for x in got])
            arrays = {
                "doc_id": rows.column("doc_id"),
                "n_tokens": pa.array([len(x[1]) for x in got], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                "agrees": pa.array([x[2] for x in got], pa.bool_()),
            }
            if with_ids:
                arrays |= {"ids": pa.array([x[1] for x in got], pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(arrays)


def round_trip(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encodes each whole text without begin or end ids and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256,
    agrees, and with_ids also ids and decoded.

    Null and empty texts have no ids and decode to the empty text. Each row stands for itself, so repeated rows come out
    as often as they go in; a null doc_id is passed on. Only doc_id and text are read; an empty table gives an empty one."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lambda it: _round_trip(it, model, with_ids), schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
