"""Prefix tries of conversations: one row for each distinct beginning.

A conversation becomes one row of turn digests and text sizes, and equal conversations become one row
with their number. These rows are dealt by the digest of their first turn; what a task gets is built
into a trie of pointers. A first turn with too many turns behind it is dealt again by the next turn at
which its conversations differ, and so on; the nodes above such a split come from sums of those below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.durable import discard, stored

#: Turns that a task's tries are made of, summed over different conversations; a group of more is dealt again.
TURNS = 200_000
#: Conversation ids of one end that are joined to a text before they are hashed in order; a power of two.
IDS = 4096
#: Bytes of a turn's digest.
DIGEST = 16

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_TOP = "level int, parent string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the role's length keeps role and text apart."""
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(both.cast("binary"), 256), 1, 2 * DIGEST))


def conversations_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its turns in order, as (key, bytes). Only digests are moved."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).isNotNull().alias("numbered"), F.col(turn_col).alias("turn"), role.alias("role"),
                 turn_digest(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    put = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return put.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def with_shared_heads(conversations: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % ``family`` (all, if
    that has fewer; none, if it is absent); h is the CRC-32 of c in decimal modulo ``longest``."""
    c, none = F.col("conv_id"), F.array().cast(conversations.schema["turns"].dataType)
    base, h = c - c % family, (F.crc32(c.cast("string").cast("binary")) % longest).cast("int")
    shared = F.first(F.when(c == F.col("base"), F.slice("turns", 1, longest - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    both = conversations.withColumns({"base": base, "h": h}).withColumn("head", F.coalesce(shared, none))
    own = F.when(F.size("turns") > F.col("h"), F.expr("slice(turns, h + 1, size(turns) - h)")).otherwise(none)
    return both.select("conv_id", F.concat(F.expr("slice(head, 1, h)"), own).alias("turns"))


def _joined(turns: Column | str) -> Column:
    """The digests of some turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.hex(t["key"])), "")


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of turns: seq, turns, n_convs, conv_id (the least) and the
    SHA-256 of its ids in order. Ids are joined to texts of at most IDS, which are hashed one after the
    other as they come sorted: no task holds the ids of a sequence."""
    part = F.shiftright("conv_id", IDS.bit_length() - 1)
    pieces = conversations.select("conv_id", "turns", F.sha2(_joined("turns"), 256).alias("seq"), part.alias("part")).groupBy("seq", "part").agg(
        F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    turns_type = conversations.schema["turns"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, digest = None, None, None
        out: list[tuple] = []
        for batch in batches:
            seqs, ns, leasts, ids = (batch.column(c).to_pylist() for c in ("seq", "n", "least", "ids"))
            for i, own in enumerate(seqs):
                if own != seq:
                    if held:
                        out.append((*held, digest.hexdigest()))
                    seq, held, digest = own, [own, batch.column("turns").slice(i, 1), 0, leasts[i]], hashlib.sha256()
                else:
                    digest.update(b",")
                held[2] += ns[i]
                digest.update(ids[i].encode())
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if held:
            out.append((*held, digest.hexdigest()))
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.concat_arrays([r[1] for r in rows]), *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3)), pa.array([r[4] for r in rows])],
            names=["seq", "turns", "n_convs", "conv_id", "ends"])

    schema = f"seq string, turns {turns_type.simpleString()}, n_convs long, conv_id long, ends string"
    return pieces.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "turns", "n", "least", "ids").mapInArrow(run, schema)


class Trie:
    """Nodes as lists by number, children as one dictionary of pointers (node, digest) -> node."""

    def __init__(self) -> None:
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.bytes = [-1], [0], [0]
        self.convs, self.least, self.ends = [0], [None], [None]

    def add(self, at: int, depth: int, keys: list[bytes], sizes: list[int], convs: int, least: int, ends: str) -> None:
        """Walk a sequence from the node ``at``, whose depth is ``depth``."""
        for key, size in zip(keys, sizes):
            depth += 1
            node = self.child.get((at, key))
            if node is None:
                node = self.child[at, key] = len(self.parent)
                self.parent.append(at)
                self.depth.append(depth)
                self.bytes.append(size)
                self.convs.append(0)
                self.least.append(least)
                self.ends.append(None)
            self.convs[node] += convs
            self.least[node] = min(self.least[node], least)
            at = node
        self.ends[at] = ends

    def sums(self) -> tuple[list[int], list[int], list[int]]:
        """(children, leaves, saved) of each node. A node's number is above its parent's, so that going
        down the numbers is a postorder without recursion."""
        n = len(self.parent)
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for node in range(n - 1, 0, -1):
            leaves[node] += not children[node]
            saved[node] += (self.convs[node] - 1) * self.bytes[node]
            up = self.parent[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        return children, leaves, saved


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries that some groups' sequences make; a group's first node names what it hangs below.

    ``above`` is the depth over a group's first node; there the trie gets one node of the group's own,
    with the group's name for its key, that isn't part of the result."""
    trie, over = Trie(), {}
    for row in rows.itertuples(index=False):
        if row.group not in over:
            trie.add(0, row.above - 1, [row.group.encode()], [0], 0, row.conv_id, None)
            over[row.group] = (len(trie.parent) - 1, row.level, row.parent, row.parent_conv_id)
        keys = [row.keys[i : i + DIGEST] for i in range(0, len(row.keys), DIGEST)]
        trie.add(over[row.group][0], row.above, keys, row.sizes.tolist(), row.n_convs, row.conv_id, row.ends)
    children, leaves, saved = trie.sums()
    first = {node: rest for node, *rest in over.values()}
    out = []
    for node in range(1, len(trie.parent)):
        if node not in first:
            up = trie.parent[node]
            level, parent, conv = first.get(up, (None, None, trie.least[up]))
            out.append((trie.least[node], trie.depth[node], conv, trie.convs[node], children[node], leaves[node], saved[node], trie.ends[node] or _NOTHING, level, parent))
    return pd.DataFrame(out, columns=[f.split()[0] for f in f"{NODE}, {_TOP}".split(", ")])


def prefix_nodes(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """Every distinct beginning of the conversations (conv_id, turns): one row per node of their trie.

    conv_id is the node's smallest member; depth its number of turns; parent_conv_id the parent's
    conv_id (null at the root); n_convs its members; n_children its children; n_leaves the nodes
    without children at or below it; saved_tokens the sum at and below it of (n_convs - 1) times the
    bytes of a node's last text; ends_sha256 the digest of the ids, in order and joined by commas, of
    the conversations that end there. No conversations give no node.

    Groups start as the conversations of one first turn. One whose different conversations hold more
    than ``turns`` turns is split where they first differ, that is after the common beginning of the
    lexicographically least and greatest: a chain of nodes above the split, and a group for each next
    turn. Each round is one aggregate over what is still too large. A group of one conversation is
    never split, so a conversation's digests must fit a task.
    """
    spark = conversations.sparkSession
    whole = stored(distinct_sequences(conversations))
    held = [whole]
    turnless = F.size("turns") == 0
    root = whole.agg(F.sum("n_convs").alias("convs"), F.min("conv_id").alias("least"), F.max(F.when(turnless, F.col("ends"))).alias("ends")).first()
    if root.convs is None:
        discard(whole)
        return spark.createDataFrame([], NODE)

    row = ["turns", "n_convs", "conv_id", "ends", "group", "parent", "parent_conv_id", "top"]
    open_rows = whole.where(~turnless).select(
        "turns", "n_convs", "conv_id", "ends", _group(F.lit(1)).alias("group"), F.lit("").alias("parent"), F.lit(root.least).cast("long").alias("parent_conv_id"), F.lit(1).cast("long").alias("top"))
    done, chains = [], []
    while True:
        large = stored(open_rows.groupBy("group").agg(
            *(F.first(c).alias(c) for c in ("parent", "parent_conv_id", "top")), F.sum("n_convs").alias("convs"), F.min("conv_id").alias("least"),
            F.sum(F.size("turns") - F.col("top") + 1).alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > turns) & (F.col("n") > 1)))
        held.append(large)
        if not large.count():
            break
        bounds = open_rows.join(large.select("group"), "group", "left_semi").groupBy("group").agg(F.min("turns").alias("low"), F.max("turns").alias("high"))
        chain = stored(large.join(bounds, "group").withColumn("split", _common("low", "high")).select(
            "group", "parent", "parent_conv_id", "top", "convs", "least", "split", F.expr("transform(slice(low, 1, cast(split AS int)), t -> t.bytes)").alias("sizes")))
        inside = open_rows.join(chain.select("group", "split", "least"), "group")
        ends = inside.where(F.size("turns") == F.col("split")).select("group", "ends")
        below = stored(inside.where(F.size("turns") > F.col("split")).select(
            "turns", "n_convs", "conv_id", "ends", _group(F.col("split") + 1).alias("next"), F.col("group").alias("parent"), F.col("least").alias("parent_conv_id"), (F.col("split") + 1).alias("top"))
            .withColumnRenamed("next", "group").select(row))
        chain_ends = stored(chain.join(ends, "group", "left"))
        held += [chain, below, chain_ends]
        done.append(open_rows.join(large.select("group"), "group", "left_anti").select(row))
        chains.append(chain_ends)
        open_rows = below
    done.append(open_rows.select(row))

    # rows of round r hang below chains of round r - 1, those of round 0 below the root
    ready = None
    for level, rows in enumerate(done):
        some = rows.select(
            F.lit(level - 1).alias("level"), "group", "parent", "parent_conv_id", (F.col("top") - 1).alias("above"), "n_convs", "conv_id", "ends",
            F.unhex(_joined(F.expr("slice(turns, cast(top AS int), size(turns))"))).alias("keys"), F.expr("transform(slice(turns, cast(top AS int), size(turns)), t -> t.bytes)").alias("sizes"))
        ready = some if ready is None else ready.unionByName(some)
    size = ready.agg(F.sum(F.size("sizes"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(2 * size / turns))
    nodes = stored(ready.groupBy(F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket")).applyInPandas(_built, f"{NODE}, {_TOP}"))
    held.append(nodes)
    names = [f.split()[0] for f in NODE.split(", ")]
    top = ["level", "parent", "n_leaves", "saved_tokens"]
    out, tops = nodes.select(names), nodes.where(F.col("level").isNotNull()).select(top)
    for level in range(len(chains) - 1, -1, -1):
        links = stored(_chain_nodes(chains[level], _below(tops, level), level - 1))
        held.append(links)
        out = out.unionByName(links.select(names))
        tops = tops.unionByName(links.where(F.col("level").isNotNull()).select(top))
    last = _below(tops, -1).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "below")))
    out = out.unionByName(last.select(
        F.lit(root.least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root.convs).cast("long").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"), F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("below").cast("long").alias("saved_tokens"),
        F.lit(root.ends or _NOTHING).alias("ends_sha256")))
    result = stored(out)
    for table in held:
        discard(table)
    return result


def _group(depth: Column) -> Column:
    """The key of a sequence's group: its first ``depth`` turns."""
    return F.sha2(_joined(F.slice("turns", F.lit(1), depth.cast("int"))), 256)


def _common(low: str, high: str) -> Column:
    """Number of turns with which both sequences begin."""
    least = f"least(size({low}), size({high}))"
    return F.expr(f"cast(filter(sequence(0, {least}), i -> i = {least} OR get({low}, i).key <> get({high}, i).key)[0] AS long)")


def _below(tops: DataFrame, level: int) -> DataFrame:
    """What hangs below each group of one round, summed."""
    return tops.where(F.col("level") == level).groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))


def _chain_nodes(chains: DataFrame, below: DataFrame, level: int) -> DataFrame:
    """Nodes from a split group's first one down to its split. All have the same members and leaves;
    each adds its own last text to what is saved below it."""
    at_end, at_top = F.col("depth") == F.col("split"), F.col("depth") == F.col("top")
    up = Window.partitionBy("group").orderBy(F.desc("depth"))
    each = chains.join(below.withColumnRenamed("parent", "group"), "group").withColumn("depth", F.explode(F.sequence("top", "split")))
    own = (F.col("convs") - 1) * F.expr("get(sizes, cast(depth AS int) - 1)")
    return each.select(
        F.col("least").alias("conv_id"), "depth", F.when(at_top, F.col("parent_conv_id")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.when(at_end, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("below") + F.sum(own).over(up)).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends", F.lit(_NOTHING))).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
        F.when(at_top, F.lit(level)).alias("level"), "parent")


def conversation_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group_turns: int = TURNS) -> DataFrame:
    """The prefix trie of rebuilt conversations, a row per node (see ``prefix_nodes``).

    Turns are ordered by ``turn_col``, null first; a null role or text is empty. Turns of equal number
    are ordered by role, then by the digest of role and text; repeated rows are turns of their own.
    Rows without a conversation id take no part. Conversations that become turnless count at the root.
    Other columns are not read. An empty table gives an empty result.
    """
    return prefix_nodes(with_shared_heads(conversations_of(turns, id_col, turn_col, role_col, text_col)), group_turns)
