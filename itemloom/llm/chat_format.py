"""Chat formatting over a prefix tree: conversations that share initial turns share their formatted text.

Conversations are dealt out by ranges of their sequence of turns and sorted, so those that share initial turns follow one
another and a frequent first turn spreads over as many tasks as it fills. Each task walks its conversations as a tree,
depth first: a turn that stands on the current path is not emitted again. What is emitted goes to packs of bounded size;
a pack is complete in itself. It holds the text, and for each node its parent, place, position id of its first character
(its distance from the root along the path), the intervals of its ancestors, which with its own earlier characters are all
it may attend to, and the characters under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import scratch

#: Characters after which a pack is closed with the conversation at hand.
PACK_CHARS = 1 << 16
#: The control strings of the template.
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
_ESCAPED = re.compile(r"\\|</?s>|\[/?INST\]")
_UNESCAPED = re.compile(r"\\(\\|</?s>|\[/?INST\])")
#: A control string, or one behind the escape character.
_TOKEN = re.compile(r"\\(?:\\|</?s>|\[/?INST\])|</?s>|\[/?INST\]")

PACK = (
    "pack_id string, text string, "
    "nodes array<struct<parent: int, start: int, length: int, position: int, ancestors: array<struct<start: int, stop: int>>, loss: array<struct<start: int, stop: int>>>>, "
    "conversations array<struct<conv_id: bigint, leaf: int>>"
)
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_NODE = pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("position", pa.int32()), ("ancestors", pa.list_(_SPAN)), ("loss", pa.list_(_SPAN))])
_CONV = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as the template writes it, and where the part to learn lies: an assistant's text, else nothing."""
    head = OPEN + escape(role).replace("%", "%25").replace("\n", "%0A") + "\n"
    body = escape(text)
    if role == "user":
        return f"{head}{ASK} {body} {ASKED}{CLOSE}", 0, 0
    whole = head + body + CLOSE
    return (whole, len(head), len(head) + len(body)) if role == "assistant" else (whole, 0, 0)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        stop = next(m.start() for m in _TOKEN.finditer(text, at + len(OPEN)) if m[0] == CLOSE)
        role, body = text[at + len(OPEN) : stop].split("\n", 1)
        role = unescape(role.replace("%0A", "\n").replace("%25", "%"))
        if role == "user":
            body = body[len(ASK) + 1 : -len(ASKED) - 1]
        turns.append((role, unescape(body)))
        at = stop + len(CLOSE)
    return turns


class _Pack:
    def __init__(self):
        self.parts, self.nodes, self.convs, self.size = [], [], [], 0
        self.path: list[tuple[tuple[str, str], int]] = []  # turns of the conversation at hand, and their nodes

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        depth = 0
        while depth < min(len(turns), len(self.path)) and self.path[depth][0] == turns[depth]:
            depth += 1
        del self.path[depth:]
        for turn in turns[depth:]:
            text, a, b = format_turn(*turn)
            parent = self.path[-1][1] if self.path else -1
            position, ancestors = 0, []
            if parent >= 0:
                up = self.nodes[parent]
                position = up["position"] + up["length"]
                ancestors = [dict(x) for x in up["ancestors"]]
                if ancestors and ancestors[-1]["stop"] == up["start"]:
                    ancestors[-1]["stop"] += up["length"]
                else:
                    ancestors.append({"start": up["start"], "stop": up["start"] + up["length"]})
            loss = [{"start": self.size + a, "stop": self.size + b}] if b > a else []
            self.path.append((turn, len(self.nodes)))
            self.nodes.append({"parent": parent, "start": self.size, "length": len(text), "position": position, "ancestors": ancestors, "loss": loss})
            self.parts.append(text)
            self.size += len(text)
        self.convs.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def batch(self) -> pa.RecordBatch:
        text = "".join(self.parts)
        name = hashlib.blake2b(f"{self.convs[0]['conv_id']} {self.convs[-1]['conv_id']} {len(self.convs)} ".encode() + text.encode(), digest_size=16).hexdigest()
        arrays = [pa.array([name]), pa.array([text]), pa.array([self.nodes], pa.list_(_NODE)), pa.array([self.convs], pa.list_(_CONV))]
        return pa.RecordBatch.from_arrays(arrays, ["pack_id", "text", "nodes", "conversations"])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = _Pack()
    for batch in batches:
        for conv_id, turns in zip(batch.column("conv_id"), batch.column("turns"), strict=True):
            pack.add(conv_id.as_py(), [(t["role"] or "", t["text"] or "") for t in turns.as_py()])
            if pack.size >= PACK_CHARS:
                yield pack.batch()
                pack = _Pack()
    if pack.convs:
        yield pack.batch()


def pack_conversations(rows: DataFrame) -> DataFrame:
    """Packs (see PACK) of all conversations in rows (conv_id, turn, role, text; other columns are not read).

    Null texts and roles are empty. Turns go by number, nulls first, then by role and text; a repeated row is a turn of
    its own. A row with a null conv_id is a conversation by itself. An empty table gives no pack. Texts of any length are
    formatted whole. A conversation is never cut: it is one row of output, so its turns are gathered; a pack exceeds
    PACK_CHARS by one conversation at most."""
    turn = F.struct("turn", "role", "text")
    convs = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))
    path = F.transform("turns", lambda t: F.xxhash64(F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit(""))))
    ranged = convs.withColumn("path", path).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ranged.select("conv_id", "turns").mapInArrow(_packs, PACK)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.to_pylist():
            text, nodes = pack["text"], pack["nodes"]
            out = {"conv_id": [], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for conv in pack["conversations"]:
                learned, i = [], conv["leaf"]
                whole = ""
                if i >= 0:
                    leaf = nodes[i]
                    whole = "".join(text[a["start"] : a["stop"]] for a in leaf["ancestors"]) + text[leaf["start"] : leaf["start"] + leaf["length"]]
                while i >= 0:
                    learned += [unescape(text[s["start"] : s["stop"]]) for s in nodes[i]["loss"]]
                    i = nodes[i]["parent"]
                turns, learned = parse(whole), "".join(reversed(learned))
                out["conv_id"].append(conv["conv_id"])
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learned))
                out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
                out["formatted_chars"].append(len(whole))
            kind = lambda c: pa.string() if c.endswith("256") else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(v, kind(c)) for c, v in out.items()], list(out))


def read_back(packs: DataFrame) -> DataFrame:
    """Digests of each conversation, recovered from packs by the intervals and loss spans they hold."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return packs.mapInArrow(_read_back, schema)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    path = scratch(spark, "packs")
    pack_conversations(rows.unionByName(extra)).write.parquet(path)
    return read_back(spark.read.parquet(path))
