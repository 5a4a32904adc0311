"""The trie of conversations' turns, and sums over its subtrees by parallel tree contraction.

Turns are sorted by ranges of (conversation, turn), so a conversation of any length spreads over as many ranges as it fills;
a segment is what one range holds of one conversation. What a turn needs to know of the turns before it (how many there
are, and the exclusive or of their hashes, which names the prefix) comes from within its segment and from the few rows of
earlier segments. Nodes are aggregates of equal prefixes. Sums over subtrees take rounds of joins: a compress replaces every
unary chain by a link from its top's parent to its end, by pointer doubling; a rake adds leaves to their parents. As then
every inner node has two children, leaves at least halve each round. The rounds' tables are then read backwards: a chain's
nodes get the total of its end and what lies above that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import attach, stored
from ._text import crc32

#: A conversation takes its first turns from that of its group of this many ids, and how many from a hash of its id.
GROUP, HEAD = 5, 9
_BEFORE = (Window.unboundedPreceding, -1)


def _hashes(*values) -> tuple:
    return F.xxhash64(*values), F.xxhash64(F.lit("trie"), *values)


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, segment, position (from 1), turns (of the conversation), t1, t2 (the hash of role and text), bytes (of the
    text), as a stored table.

    Turns go by number, nulls first, then by role and text, null ones being empty; a repeated row is a turn of its own.
    Rows without a conv_id belong to no conversation and are left out. Other columns are not read."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    named = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # borders are sampled, so they hold no whole texts: what ties in these three columns is of one range
    ranged = named.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16)).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    t1, t2 = _hashes("role", F.lit("\n"), "text")
    dealt = stored(ranged.select("conv_id", t1.alias("t1"), t2.alias("t2"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at")), "turns")
    dealt = dealt.withColumn("segment", F.shiftright("at", 33) + 1)
    conv = Window.partitionBy("conv_id")
    segments = dealt.groupBy("conv_id", "segment").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(conv.orderBy("segment").rowsBetween(*_BEFORE)), F.lit(0))
    segments = segments.select("conv_id", "segment", (before + 1 - F.col("first")).alias("shift"), F.sum("n").over(conv).alias("turns"))
    return dealt.join(segments, ["conv_id", "segment"]).withColumn("position", F.col("at") + F.col("shift")).drop("at", "shift")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations: conv_id, turns): each conversation c of turns_of(…) rebuilt from the first h turns of conversation
    c - c % GROUP (fewer if it has fewer, none if it is absent) and its own from h + 1 on, where h = crc32(c) % HEAD.
    c % GROUP has the sign of c, as in SQL."""
    head = F.expr(f"{crc32('conv_id')} % {HEAD}")
    convs = stored(turns.groupBy("conv_id").agg(F.first("turns").alias("own")).select("conv_id", "own", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")), "convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    convs = stored(convs.join(bases, "base", "left").select("conv_id", "base", "own", "head", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("lent")), "convs")
    # a conversation's own turns need what one row of it says, which its segments carry to them
    segments = turns.select("conv_id", "segment").distinct().join(convs.select("conv_id", "head", "lent"), "conv_id")
    own = turns.join(segments, ["conv_id", "segment"]).where(F.col("position") > F.col("head"))
    own = own.select("conv_id", "segment", (F.col("position") - F.col("head") + F.col("lent")).alias("position"), "t1", "t2", "bytes")
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("position") < HEAD)).select(F.col("conv_id").alias("base"), "position", "t1", "t2", "bytes")
    lent = first.join(convs.select("base", "conv_id", "head"), "base").where(F.col("position") <= F.col("head")).select("conv_id", F.lit(0).cast("long").alias("segment"), "position", "t1", "t2", "bytes")
    size = F.col("lent") + F.greatest(F.col("own") - F.col("head"), F.lit(0))
    return own.unionByName(lent), convs.select("conv_id", size.alias("turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2 (the name of the first depth turns), p1, p2 (that of one turn less), bytes, as a stored table."""
    e1, e2 = _hashes("position", "t1", "t2")
    named = turns.select("conv_id", "segment", F.col("position").alias("depth"), e1.alias("e1"), e2.alias("e2"), "bytes")
    carried = named.groupBy("conv_id", "segment").agg(F.bit_xor("e1").alias("c1"), F.bit_xor("e2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(*_BEFORE)
    carried = carried.select("conv_id", "segment", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")))
    within = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = named.select("*", F.bit_xor("e1").over(within).alias("r1"), F.bit_xor("e2").over(within).alias("r2")).join(carried, ["conv_id", "segment"])
    x1, x2 = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    return stored(running.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("e1")).alias("p1"), x2.bitwiseXOR(F.col("e2")).alias("p2"), "bytes"), "prefixes")


def nodes_of(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie as a stored table: id, parent (null: root), parent_conv_id, conv_id (the smallest member), depth, n_convs,
    bytes (of the last text), x1, x2. The root has all conversations; without any there is no node."""
    deep = paths.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes"))
    none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*none("depth", "x1", "x2"), "conv_id", "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), *none("bytes"))
    every = stored(deep.unionByName(root).select("*", F.monotonically_increasing_id().alias("id"), (F.col("depth") - 1).alias("above")), "nodes")
    ups = every.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("d"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    return stored(attach(every, ups, {"above": "d", "p1": "y1", "p2": "y2"}, outer=True).drop("above", "p1", "p2"), "nodes")


def _plus(a: str, b: str, names: list[str]) -> list:
    return [(F.coalesce(F.col(f"{a}.{n}"), F.lit(0)) + F.coalesce(F.col(f"{b}.{n}"), F.lit(0))).alias(n) for n in names]


def _link(chain: DataFrame, names: list[str]) -> DataFrame:
    """id, end, and sums from id to above end, of the nodes of chains (id, end: the only child, own values): ends move on until
    each is outside the chains."""
    inside = chain.join(chain.select(F.col("id").alias("end")), "end", "left_semi").isEmpty()
    while not inside:
        a, b = chain.alias("a"), chain.alias("b")
        moved = a.join(b, F.col("a.end") == F.col("b.id"), "left").select("a.id", F.coalesce("b.end", "a.end").alias("end"), F.col("b.id").isNotNull().alias("moved"), *_plus("a", "b", names))
        moved = stored(moved, "links")
        chain, inside = moved.drop("moved"), moved.where("moved").isEmpty()
    return chain


def subtree_sums(tree: DataFrame, names: list[str]) -> DataFrame:
    """id, and for each of names the sum of this column (long) over the node's subtree, itself included.

    tree: id, parent (null for roots), names; a stored table of distinct ids without cycles."""
    live, rounds = tree.select("id", "parent", *names), []
    while True:
        children = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("only"))
        live = stored(live.join(children, "id", "left"), "live")
        inner = live.where("k = 1 AND parent IS NOT NULL")
        # compress
        links = _link(inner.select("id", F.col("only").alias("end"), *names), names)
        below = inner.select(F.col("only").alias("id"))
        tops = stored(inner.select("id", "parent").join(below, "id", "left_anti").join(links, "id"), "tops")
        others = live.where("k IS NULL OR k > 1 OR parent IS NULL").join(tops.select(F.col("end").alias("id"), F.col("parent").alias("moved")), "id", "left")
        others = stored(others.withColumn("parent", F.coalesce("moved", "parent")).drop("moved", "only"), "others")
        # rake
        leaves = others.where("k IS NULL").drop("k")
        more = tops.select("parent", *names).unionByName(leaves.select("parent", *names)).where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(*(F.sum(n).alias(n) for n in names))
        kept = others.where("k IS NOT NULL").alias("a").join(more.alias("b"), F.col("a.id") == F.col("b.id"), "left").select("a.id", "a.parent", *_plus("a", "b", names))
        live = stored(kept, "live")
        rounds.append((links, leaves.select("id", *names)))
        if live.isEmpty():
            break
    known = None
    for links, leaves in reversed(rounds):
        known = leaves if known is None else known.unionByName(leaves)
        if links.isEmpty():
            continue
        ends = known.select(F.col("id").alias("of"), *(F.col(n).alias(f"end_{n}") for n in names))
        inner = attach(links, ends, {"end": "of"}).select("id", *((F.col(n) + F.col(f"end_{n}")).alias(n) for n in names))
        known = known.unionByName(stored(inner, "totals"))
    return known


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one id in sorted (id, conv_id), as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("id"))
        ends, convs = runs.run_ends.to_pylist(), batch.column("conv_id").cast(pa.string()).to_pylist()
        starts = [0, *ends[:-1]]
        ids = pa.array([",".join(convs[a:b]) for a, b in zip(starts, ends, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([runs.values, batch.column("conv_id").take(pa.array(starts, pa.int64())), ids], ["id", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each id, of its pieces one after the other."""
    at, digest = None, None
    for batch in batches:
        out = ([], [])
        for i, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if i == at:
                digest.update(b",")
            else:
                if digest:
                    out[0].append(at)
                    out[1].append(digest.hexdigest())
                at, digest = i, hashlib.sha256()
            digest.update(ids.encode())
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["id", "digest"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["id", "digest"])


def member_digests(members: DataFrame) -> DataFrame:
    """id, digest: SHA-256 of the conv_ids of each id, ascending and comma-joined, from rows (id, conv_id).

    Ids are written out by ranges, a piece of at most one Arrow batch each; a digest is a sequence by nature, so one task
    runs over an id's pieces, holding one at a time."""
    sorted_ = members.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").select("id", "conv_id")
    pieces = sorted_.mapInArrow(_pieces, "id long, first long, ids string")
    return pieces.repartition("id").sortWithinPartitions("id", "first").select("id", "ids").mapInArrow(_digests, "id long, digest string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of the turns (conv_id, segment, position, t1, t2, bytes) of conversations (conv_id, turns): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns are members of the root alone. Prefixes are told apart by 128 bits. An empty table gives
    no node."""
    paths = prefixes(turns)
    nodes = nodes_of(paths, conversations)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    values = nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(stored(values, "tree"), ["n_leaves", "saved_tokens"])
    # the node at which a conversation ends is that of its longest prefix
    last = conversations.where("turns > 0").join(paths, [conversations.conv_id == paths.conv_id, conversations.turns == paths.depth]).select(paths.conv_id, "depth", "x1", "x2")
    last = last.unionByName(conversations.where("turns = 0").select("conv_id", *(F.lit(0).cast("long").alias(n) for n in ("depth", "x1", "x2"))))
    named = nodes.select("id", F.col("depth").alias("d"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    ends = member_digests(stored(attach(stored(last, "last"), named, {"depth": "d", "x1": "y1", "x2": "y2"}).select("id", "conv_id"), "ends"))
    out = nodes.join(sums, "id").join(ends, "id", "left")
    digest = F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = stored(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(*with_shared_heads(turns))


#: crc32 of a decimal number: bits of each character, and the reflected polynomial.
_CRC32 = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295)"
)
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC32} % {HEAD} AS h, conv_id - conv_id % {GROUP} AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, i) AS d, sha256(role || chr(10) || text) AS turn, strlen(text) AS bytes
  FROM c JOIN (SELECT c.conv_id, t.i, t.role, t.text, 1 AS own FROM c JOIN t ON t.conv_id = c.conv_id AND i > h
               UNION ALL SELECT c.conv_id, t.i, t.role, t.text, 0 FROM c JOIN t ON t.conv_id = base AND i <= h) x ON x.conv_id = c.conv_id
), p AS (
  SELECT conv_id, d, sha256(string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS k, bytes FROM r
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM c
), n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM p GROUP BY d, k
), up AS (
  SELECT n.d, n.k, n.conv_id, n.n_convs, n.bytes, p.d AS ud, p.k AS uk FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d
), kids AS (SELECT ud AS d, uk AS k, count(*) AS n_children FROM up WHERE ud = d - 1 GROUP BY ALL),
leaf AS (SELECT n.d, n.k, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.d = kids.d AND n.k = kids.k),
sums AS (
  SELECT ud AS d, uk AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM up JOIN leaf ON up.d = leaf.d AND up.k = leaf.k GROUP BY ALL
), ends AS (
  SELECT d, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(d) AS d, max_by(k, d) AS k FROM p GROUP BY conv_id) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, leaf.n_children::BIGINT AS n_children,
  sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN leaf ON n.d = leaf.d AND n.k = leaf.k JOIN sums ON n.d = sums.d AND n.k = sums.k LEFT JOIN ends ON n.d = ends.d AND n.k = ends.k
LEFT JOIN up ON up.d = n.d AND up.k = n.k AND up.ud = n.d - 1 LEFT JOIN n parent ON parent.d = up.ud AND parent.k = up.uk
"""
