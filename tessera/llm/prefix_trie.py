"""Conversation prefixes as succinct level-order tries (Jacobson's LOUDS, 1989).

A conversation is the sequence of its turns, a turn the digest of its role and
text (128 bits of SHA-256); only digests and byte counts are shuffled after the
first sort. Every prefix gets a running digest as its name, so the conversations
that share it are counted with partial sums.

Prefixes of one conversation alone are a chain below some shared prefix: all
that is asked of them follows from one row, so they never enter a trie. Shared
prefixes of at most ``shard_convs`` conversations are dealt out by the first
such prefix of their conversations, the shard, and numpy builds each task's
shards into one level-order trie: a bit string with a one for each child and a
zero after each node, a label array in the same order, parents by rank and
select, and sums over subtrees by ``add.at`` from the last level up. Heavier
prefixes are the upper levels. Each has more than ``shard_convs`` members, so
they are at most (turns / shard_convs); that number rises with the table to keep
them under ``upper``. One more trie of just those merges what the shards' tops
and the chains below them hand up.

Defined cases: a turn without a conv_id belongs to no conversation; a null role
or text is empty; turns with equal numbers go by role, then text, and repeated
rows are turns each; texts of any length take part by digest; an empty table has
no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()


class Louds:
    """A level-order trie: ``bits`` has a one for each child and a zero after each node; ``rows[i]`` is the input row of node ``i`` (node 0 stands above all tops)."""

    def __init__(self, parent: np.ndarray, labels: np.ndarray) -> None:
        """``parent[i]`` is the row above row ``i`` or -1; ``labels`` order the children of a node."""
        n = len(parent)
        rank, levels = np.zeros(n, np.int64), []
        order = np.argsort(parent, kind="stable")
        starts = np.searchsorted(parent[order], np.arange(-1, n + 1))
        level, base = order[: starts[1]], 1
        while len(level):
            above = np.where(parent[level] < 0, 0, rank[parent[level]])
            level = level[np.lexsort((labels[level, 1], labels[level, 0], above))]
            rank[level] = np.arange(base, base + len(level))
            levels.append((base, base + len(level)))
            base += len(level)
            level = np.concatenate([order[starts[r + 1] : starts[r + 2]] for r in level])
        self.levels, self.rank = levels, rank
        self.rows = np.argsort(rank, kind="stable")
        self.labels = labels[self.rows]
        above = np.where(parent < 0, 0, rank[parent])
        degree = np.bincount(above, minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """The node above each node from 1 on: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        """The children of each node: the ones between two zeros."""
        return np.diff(np.concatenate(([-1], np.flatnonzero(~self.bits)))) - 1

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of what each node has (``values[0]`` is above all tops)."""
        out, above = values.copy(), self.parents()
        for low, high in reversed(self.levels):
            np.add.at(out, above[low - 1 : high - 1], out[low:high])
        return out


def _ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, at`` (from 0), label and text bytes of every turn; a conversation of any length is cut over tasks."""
    role, said = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), said.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    label = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, 16)
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", label.alias("label"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("__at"))
    placed = materialize(placed.withColumn("__part", F.shiftright("__at", 33)), "turns")
    parts = placed.groupBy("conv_id", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    return materialize(placed.join(parts, ["conv_id", "__part"]).select("conv_id", (F.col("__at") + F.col("__base")).alias("at"), "label", "bytes"), "ordered")


def _rebuilt(turns: DataFrame, stride: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Turns after taking each conversation's head from the first of its ``stride``; and the conversations with their new sizes."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", head).withColumn("from", F.col("conv_id") - F.col("conv_id") % stride)
    lent = convs.select(F.col("conv_id").alias("from"), F.col("n").alias("__lent"))
    convs = convs.join(lent, "from", "left").withColumn("taken", F.least("h", F.coalesce("__lent", F.lit(0))))
    convs = convs.select("conv_id", "from", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    convs = materialize(convs, "convs")
    heads = turns.where(F.col("at") < longest).select(F.col("conv_id").alias("from"), F.col("at").alias("pos"), "label", "bytes")
    taken = convs.where("taken > 0").join(heads, "from").where("pos < h").select("conv_id", "pos", "label", "bytes", "size")
    own = turns.join(convs, "conv_id").where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("pos"), "label", "bytes", "size")
    return taken.unionByName(own), convs


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The running digest of each prefix; rows are sorted by conversation and place."""
    conv, key = None, ROOT
    for batch in batches:
        keys, above = [], []
        for c, label in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c != conv:
                conv, key = c, ROOT
            above.append(key)
            key = hashlib.blake2b(key + label, digest_size=16).digest()
            keys.append(key)
        pos = batch.column(1).to_numpy()
        last = pa.array(pos + 1 == batch.column(4).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos + 1), batch.column(2), batch.column(3), last, pa.array(keys, pa.binary()), pa.array(above, pa.binary())], names=["conv_id", "depth", "label", "bytes", "last", "key", "parent"])


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top binary"
_COLUMNS = ["key", "parent", "label", "conv_id", "depth", "n", "bytes", "below", "leaves", "saved", "ends"]


def _solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Nodes with what their subtrees hold; ``top`` names what is above a node that has no parent here."""
    t = pa.Table.from_batches(held)
    keys, above = t["key"].to_pylist(), t["parent"].to_pylist()
    at = {k: i for i, k in enumerate(keys)}
    parent = np.fromiter((at.get(p, -1) if k != ROOT else -1 for k, p in zip(keys, above, strict=True)), np.int64, len(keys))
    labels = np.frombuffer(b"".join(t["label"].to_pylist()), ">u8").reshape(-1, 2)
    number = lambda c: t[c].to_numpy().astype(np.int64)
    conv, n, below = number("conv_id"), number("n"), number("below")
    trie = Louds(parent, labels)
    spread = lambda x: np.concatenate(([0], x[trie.rows]))
    degree = trie.degrees()
    below = spread(below) + degree
    leaves = spread(number("leaves")) + (below == 0)
    leaves[0] = 0
    leaves, saved = trie.totals(leaves), trie.totals(spread(number("saved") + (n - 1) * number("bytes")))
    up = trie.parents()
    convs = spread(conv)
    tops = [a if p == 0 else None for a, p in zip((above[i] for i in trie.rows), up, strict=True)]
    ends = t["ends"].to_pylist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(convs[1:]),
            pa.array(number("depth")[trie.rows]),
            pa.array(convs[up], mask=up == 0),
            pa.array(n[trie.rows]),
            *(pa.array(x[1:]) for x in (below, leaves, saved)),
            pa.array([ends[i] or _EMPTY for i in trie.rows], pa.string()),
            pa.array(tops, pa.binary()),
        ],
        names=[c.split()[0] for c in _NODE.split(", ")],
    )


def _shards(size: int):  # noqa: ANN202
    """Builds whole shards, as many at a time as have ``size`` nodes; rows are sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            shard = batch.column(0).to_pylist()
            low = 0
            for i in range(batch.num_rows):
                if shard[i] != last:
                    if rows + i - low >= size:
                        held.append(batch.slice(low, i - low).select(_COLUMNS))
                        yield _solved(held)
                        held, rows, low = [], 0, i
                    last = shard[i]
            held.append(batch.slice(low).select(_COLUMNS))
            rows += batch.num_rows - low
        if rows:
            yield _solved(held)

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b.select(_COLUMNS) for b in batches if b.num_rows]
    if held:
        yield _solved(held)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each key as pieces of text, one or more a batch."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[a] for a, _ in spans], pa.binary()), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())], names=["key", "first", "text"]
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces, which arrive in order; one piece is held at a time."""
    key, held = None, hashlib.sha256()
    one = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([held.hexdigest()])], names=["key", "ends"])
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield one()
                key, held = k, hashlib.sha256()
            else:
                held.update(b",")
            held.update(text.encode())
    if key is not None:
        yield one()


def prefixes(conversations: DataFrame, stride: int = 5, longest_head: int = 9, shard_convs: int = 4096, upper: int = 100_000, build: int = 200_000) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with what its subtree holds."""
    turns, convs = _rebuilt(_ordered(conversations), stride, longest_head)
    named = turns.select("conv_id", "pos", "label", "bytes", "size").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    rows = materialize(named.mapInArrow(_names, "conv_id long, depth long, label binary, bytes long, last boolean, key binary, parent binary"), "prefixes")
    # More than this many members make a prefix one of the upper levels, which are then at most ``upper``.
    limit = max(shard_convs, rows.count() // upper)
    heavy = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key", F.lit(True).alias("heavy")), "heavy")
    rows = rows.join(F.broadcast(heavy), "key", "left")
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = materialize(rows.withColumn("shard", F.first(F.when(F.col("heavy").isNull(), F.col("key")), True).over(path)), "sharded")
    nodes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min(F.struct("depth", "parent", "label", "bytes", "shard")).alias("s"), F.count_if("last").alias("n_ends"))
    nodes = materialize(nodes.select("key", "n", "conv_id", "s.*", "n_ends"), "nodes")

    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(ROOT).alias("parent"), F.lit(ROOT).alias("label"), "conv_id", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("bytes"))
    top = materialize(nodes.join(F.broadcast(heavy.select("key")), "key", "left_semi").select(*root.columns).unionByName(root), "upper")
    names = F.broadcast(top.select(F.col("key").alias("top"), F.col("conv_id").alias("__above")))
    light = nodes.where(F.col("shard").isNotNull())

    # Chains: prefixes of one conversation, whose parent is either in the chain or shared.
    shared = light.where("n > 1")
    above = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("__shared"))
    alone = light.where("n = 1").join(names, F.col("parent") == F.col("top"), "left").join(above, "parent", "left")
    alone = materialize(alone.withColumn("__up", F.coalesce("__above", "__shared")), "chains")
    ends = F.sha2(F.when(F.col("n_ends") > 0, F.col("conv_id").cast("string")).otherwise(F.lit("")).cast("binary"), 256)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = alone.select("conv_id", "depth", F.coalesce("__up", "conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("n_ends") > 0, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"))
    hung = alone.where("__up is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("below"))

    # Shards of shared prefixes, of which none has more than ``limit`` members.
    few = rows.where(F.col("last") & F.col("heavy").isNull()).join(shared.select("key"), "key", "left_semi")
    few = few.groupBy("key").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").cast("binary"), 256).alias("ends"))
    full = shared.join(hung, "key", "left").join(few, "key", "left").withColumn("below", F.coalesce("below", none)).withColumns({"leaves": F.col("below"), "saved": none})
    built = full.select("shard", *_COLUMNS).repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(build), _NODE)
    built = materialize(built, "tries")
    handed = built.where("top is not null").groupBy(F.col("top").alias("key")).agg(F.count("*").alias("__tops"), F.sum("n_leaves").alias("__leaves"), F.sum("saved_tokens").alias("__saved"))

    # The upper levels, bounded by ``upper``: one trie in one task.
    many = rows.where(F.col("last") & F.col("heavy").isNotNull()).select("key", "conv_id").unionByName(convs.where("size = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    many = many.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_fragments, "key binary, first long, text string")
    many = many.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")
    joined = top.join(hung, "key", "left").join(handed, "key", "left").join(many, "key", "left")
    zero = lambda c: F.coalesce(c, none)
    joined = joined.withColumns({"leaves": zero("below") + zero("__leaves"), "saved": zero("__saved"), "below": zero("below") + zero("__tops")})
    merged = joined.select(*_COLUMNS).repartition(1).mapInArrow(_whole, _NODE)

    columns = chains.columns
    placed = built.join(names, "top", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__above"))
    return chains.unionByName(placed.select(*columns)).unionByName(merged.select(*columns))
