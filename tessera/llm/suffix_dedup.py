"""Exact repeated substrings by an enhanced suffix array's common-prefix intervals.

:func:`maximal_repeats` is the method itself: suffixes sorted by prefix
doubling, adjacent common prefixes from the ranks of each round, a stack scan
over them that walks the tree of common-prefix intervals, and a test of the
bytes ahead of each interval's suffixes. An interval with two different ones is
a maximal repeat, given with all its occurrences, not just with neighbours.

To run it on a corpus, only what can repeat is brought together, without loss.
Of the 32-byte grams inside each ``length``-byte window the one with the least
hash is its anchor, so equal windows have equal anchors at equal places. The
windows of one anchor are cut into ``slices`` by where they start relative to
it; all windows of a slice share the bytes between its last start and its first
end, the *block*. Windows can only be equal within one slice and one block, so
the block's hash is the key that brings slices together, and of the text only the
flanks beside the block are sent: a slice becomes ``left + block hash + right``,
and windows of ``length`` bytes become substrings shorter by the block. Keys that
occur once are dropped before any text moves. Equal slices travel as one with a
multiplicity; where all slices of a key are equal, their one interval is the
whole slice and no text moves at all.

A key with more than ``group`` different slices is sliced again, finer, as often
as needed down to single windows, which are all equal. So no task gathers an
unbounded group, whatever share of the corpus holds a passage.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose
nothing; very long texts are cut into slices like any other, and no array holds
more than ``chunk`` bytes beyond one key's items; of equal least hashes in a
window the first is the anchor, so ties cut equal windows alike; repeated rows repeat all their windows, so from ``length`` bytes on they
lose all; an empty table gives an empty table; other columns are not read. Rows
are known by a 64-bit hash of id and text, and blocks by one of their bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, merged_runs, text_bytes

GRAM = 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


# ---------------------------------------------------------------- suffix array


class SuffixArray:
    """Suffixes of several byte strings, sorted, with adjacent common prefixes."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.data)
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        #: Bytes from each place to the end of its string.
        self.rest = self.starts[1:][self.owner] - np.arange(n)
        longest = int(sizes.max(initial=0))
        rank = self.data.astype(np.int64)
        ranks, depth = [rank], 1
        order = np.argsort(rank, kind="stable")
        while depth < longest:
            after = np.full(n, -1, np.int64)
            inside = np.flatnonzero(self.rest > depth)
            after[inside] = rank[inside + depth]
            key = rank * (n + 256) + after + 1
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else []
            ranks.append(rank)
            depth *= 2
        self.order = order
        self.common = self._common(ranks)

    def _common(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order; 0 for the first."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(len(self.order), np.int64)
        left_a, left_b = self.rest[a].copy(), self.rest[b].copy()
        last = max(0, len(self.data) - 1)
        for level in range(len(ranks) - 1, -1, -1):
            for _ in range(2 if level == len(ranks) - 1 else 1):
                depth = 1 << level
                rank = ranks[level]
                same = (left_a >= depth) & (left_b >= depth) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
                step = np.where(same, depth, 0)
                out[1:] += step
                a += step
                b += step
                left_a -= step
                left_b -= step
        return out

    def ahead(self) -> np.ndarray:
        """The byte ahead of each sorted suffix, -1 - string where it starts its string."""
        at = self.order
        first = self.starts[:-1][self.owner[at]] == at
        return np.where(first, -1 - self.owner[at], self.data[np.maximum(at - 1, 0)].astype(np.int64))


def maximal_repeats(strings: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """``(length, [(string, place), ...])`` for each maximal repeat of ``least`` bytes or more."""
    array = SuffixArray(strings)
    common, ahead = array.common, array.ahead()
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return
    # Runs of suffixes that share ``least`` bytes: each is one subtree of the intervals.
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    firsts, lasts = deep[np.concatenate([[0], cuts])] - 1, deep[np.concatenate([cuts - 1, [len(deep) - 1]])]
    differs = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        if differs[first] == differs[last]:
            continue  # one byte stands ahead of all: nothing here is maximal on the left
        stack: list[tuple[int, int]] = []
        for k in range(first + 1, last + 2):
            depth = int(common[k]) if k <= last else 0
            begin = k - 1
            while stack and stack[-1][0] > depth:
                deeper, begin = stack.pop()
                if differs[begin] != differs[k - 1]:
                    places = array.order[begin:k]
                    yield deeper, list(zip(array.owner[places].tolist(), (places - array.starts[:-1][array.owner[places]]).tolist()))
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


# --------------------------------------------------------------------- anchors


def _least(x: np.ndarray, width: int, pick, run) -> np.ndarray:
    """Sliding minimum or maximum: both ends' running ones over blocks of ``width``."""
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, x[-1], x.dtype)]).reshape(-1, width)
    before = run(rows, axis=1).ravel()
    after = run(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(after[:n], before[width - 1 : width - 1 + n])


def _gram_hashes(data: bytes) -> np.ndarray:
    words = np.empty(len(data) - 7, np.uint64)
    for r in range(8):
        part = words[r::8]
        part[:] = np.frombuffer(data, "<u8", len(part), r)
    n = len(data) - GRAM + 1
    h = words[:n] * _MIX[0]
    for k in (1, 2, 3):
        h += words[8 * k : 8 * k + n] * _MIX[k]
    h ^= h >> np.uint64(29)
    h *= _MIX[4]
    h ^= h >> np.uint64(32)
    return h


def anchor_runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: ``(anchor, first start, last start)``.

    Of equal least hashes in a window the first is the anchor.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    h = _gram_hashes(data)
    width = length - GRAM + 1
    least = _least(h, width, np.minimum, np.minimum.accumulate)
    # Places that are least in some window: those that the greatest least around them equals.
    edge = np.zeros(width - 1, np.uint64)
    around = _least(np.concatenate([edge, least, edge]), width, np.maximum, np.maximum.accumulate)
    places = np.flatnonzero(around == h)
    starts = np.arange(len(least))
    # The first chosen place in a window may be a lesser window's: go on to the first equal one.
    k = np.searchsorted(places, starts)
    wrong = np.flatnonzero(h[places[k]] != least)
    while len(wrong):
        k[wrong] += 1
        wrong = wrong[h[places[k[wrong]]] != least[wrong]]
    anchor = places[k]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return anchor[cut], cut, np.concatenate([cut[1:], [len(starts)]]) - 1


def _slices(data: bytes, length: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``(key, flanks, block start, left length, right length)`` of every slice."""
    digest = xxhash.xxh64_intdigest
    reach = length - GRAM
    for anchor, first, last in zip(*(x.tolist() for x in anchor_runs(data, length))):
        base = anchor - reach
        for j in range((first - base) // width, (last - base) // width + 1):
            low = base + j * width
            at = low + width - 1  # the last start of the slice: where the block begins
            lo, hi = max(first, low), min(last, at)
            key = digest(data[at : low + length], j)
            yield key, digest(data[lo : hi + length], at - lo), at, at - lo, hi - low


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _cut(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "key", "ctx", "at", "ll", "rl"]
        for batch in batches:
            rid: list[int] = []
            out: list[tuple[int, int, int, int, int]] = []

            def flush() -> pa.RecordBatch:
                c = list(zip(*out)) if out else [()] * 5
                return pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), _signed(c[0]), _signed(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], names=names
                )

            for i in range(batch.num_rows):
                got = list(_slices(batch.column(1)[i].as_py(), length, width))
                rid += [batch.column(0)[i].as_py()] * len(got)
                out += got
                if len(out) > 30_000:
                    yield flush()
                    rid, out = [], []
            yield flush()

    return run


# ------------------------------------------------------------------ resolution

_ITEM = "key long, ctx long, m long, left binary, right binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flanks of the wanted slices, from the packed text of their row."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for packed, want in zip(batch.column("packed"), batch.column("want")):
            data = unpack.decompress(packed.as_py())
            for w in want.as_py():
                at, end = w["at"], w["at"] + w["block"]
                out.append((w["key"], w["ctx"], w["m"], data[at - w["ll"] : at], data[end : end + w["rl"]]))
        c = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds)], names=["key", "ctx", "m", "left", "right"])


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``packed``, the column ``data`` compressed, to move less of it."""
    rows = docs.select(*columns, "data")
    schema = rows.drop("data").schema.add("packed", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([pack.compress(x.as_py()) for x in batch.column(len(columns))], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _joined(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Disjoint runs of the integers that the inclusive ``spans`` hold, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


#: Windows of a slice that occur elsewhere: disjoint runs, first and last included.
_RUNS = "key long, ctx long, runs array<struct<i1:int,i2:int>>"


def _repeats(spread: int, chunk: int):
    """Covered windows of each slice, from sorted items; a window takes ``spread`` flank bytes."""

    def solve(items: dict[tuple[int, int], tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = list(items)
        strings = [items[k][1] + k[0].to_bytes(8, "little", signed=True) + items[k][2] for k in keys]
        found: dict[int, set[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            m, left, right = items[k]
            if m > 1:
                found[i] = {(spread - len(right), len(left))}
        for size, places in maximal_repeats(strings, spread + 8):
            for i, place in places:
                n = len(items[keys[i]][1])
                found.setdefault(i, set()).add((n - (place + size - spread - 8), n - place))
        rows = [(*keys[i], [{"i1": a, "i2": b} for a, b in _joined(spans)]) for i, spans in found.items()]
        c = list(zip(*rows)) if rows else [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("i1", pa.int32()), ("i2", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds)], names=["key", "ctx", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, bytes, bytes]] = {}
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size > chunk and row["key"] != last:
                    yield solve(held)
                    held, size = {}, 0
                last = row["key"]
                held[row["key"], row["ctx"]] = (row["m"], row["left"], row["right"])
                size += len(row["left"]) + len(row["right"]) + 8
        yield solve(held)

    return run


def _finer(spread: int, width: int):
    """Items of large keys as slices of ``width`` windows, each with the windows it came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                low, high = spread - len(right), len(left)
                for k in range(-(-(spread + 1) // width)):
                    one = min(k * width, spread + 1 - width)  # the last may overlap the one ahead
                    two = one + width - 1
                    if one > high or two < low:
                        continue
                    block = left[high - one :] if one <= high and one else b""
                    block += right[: spread - two]
                    a, b = left[max(0, high - two) : high - one], right[spread - two : spread - one]
                    key = digest(row["key"].to_bytes(8, "little", signed=True) + block, k)
                    out.append((row["key"], row["ctx"], one, key, digest(a + b, len(a)), row["m"], a, b))
            c = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), None, None, pa.int64(), pa.binary(), pa.binary())
            columns = [_signed(list(x)) if k is None else pa.array(list(x), k) for x, k in zip(c, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["key0", "ctx0", "base", "key", "ctx", "m", "left", "right"])

    return run


def _tasks(df: DataFrame) -> int:
    """As many tasks as the session shuffles to: items are small, the work on them is not."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _resolve(items: DataFrame, spread: int, widths: list[int], group: int, chunk: int) -> DataFrame:
    """``key, ctx, runs``, one row per slice that has windows which occur elsewhere."""
    sizes = items.groupBy("key").agg(F.count_distinct("ctx").alias("n"))
    large = materialize(sizes.where(F.col("n") > group).select("key"), "large-keys")
    if large.isEmpty() or spread == 0:
        return items.repartition(_tasks(items), "key").sortWithinPartitions("key").mapInArrow(_repeats(spread, chunk), _RUNS)
    small = items.join(large, "key", "left_anti").repartition(_tasks(items), "key").sortWithinPartitions("key")
    done = small.mapInArrow(_repeats(spread, chunk), _RUNS)
    width = widths[0]
    finer = items.join(large, "key", "left_semi").dropDuplicates(["key", "ctx"])
    finer = materialize(finer.mapInArrow(_finer(spread, width), f"key0 long, ctx0 long, base int, {_ITEM}"), "finer-slices")
    met = finer.groupBy("key").agg(F.sum("m").alias("all")).where("all > 1").select("key")
    finer = finer.join(met, "key", "left_semi")
    # ``first`` is right for the flanks: equal key and ctx mean equal flanks.
    distinct = materialize(finer.groupBy("key", "ctx").agg(F.sum("m").alias("m"), F.first("left").alias("left"), F.first("right").alias("right")), "finer-items")
    whole = F.array(F.struct(F.lit(0).alias("i1"), F.lit(0).alias("i2")))
    inner = distinct.where("m > 1").select("key", "ctx", whole.alias("runs")) if width == 1 else _resolve(distinct, width - 1, widths[1:], group, chunk)
    # One row per finer slice on either side of the join, so it makes no more rows than there are.
    moved = F.transform("runs", lambda r: F.struct((F.col("base") + r["i1"]).cast("int").alias("i1"), (F.col("base") + r["i2"]).cast("int").alias("i2")))
    back = finer.join(inner, ["key", "ctx"]).select("key0", "ctx0", moved.alias("runs"))
    back = back.groupBy("key0", "ctx0").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return done.union(back.select(F.col("key0").alias("key"), F.col("ctx0").alias("ctx"), merged_runs(F.col("runs"), "i1", "i2", "int").alias("runs")))


def repeated_spans(docs: DataFrame, rid: Column, text_col: str, length: int, slices: int, group: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``rid, spans`` of covered stretches, one row per slice, and the rows as ``rid, data`` with their columns."""
    reach = length - GRAM
    width = -(-(reach + 1) // slices)
    spread = width - 1
    rows = docs.select("*", rid.alias("rid"), text_bytes(text_col).alias("data"))
    cut = rows.where(F.octet_length("data") >= length).select("rid", "data").mapInArrow(_cut(length, width), "rid long, key long, ctx long, at long, ll int, rl int")
    cut = materialize(cut, "slices")
    keys = cut.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).where("n > 1").select("key", (F.col("c1") == F.col("c2")).alias("equal"))
    keys = materialize(keys, "met-keys")  # else count and join share a stage, and a hot key one of its tasks
    met = materialize(cut.join(keys, "key"), "met-slices")
    block = length - spread
    whole = met.where("equal").select("rid", F.array(F.struct((F.col("at") - F.col("ll")).alias("s"), (F.col("at") + block + F.col("rl")).alias("e"))).alias("spans"))
    other = met.where("not equal").drop("equal")
    wanted = other.groupBy("key", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("rid", "at", "ll", "rl")).alias("x"))
    wanted = wanted.groupBy("x.rid").agg(F.collect_list(F.struct("key", "ctx", "m", "x.at", "x.ll", "x.rl", F.lit(block).alias("block"))).alias("want"))
    texts = _packed(rows.where(F.octet_length("data") >= length), ["rid"])
    items = materialize(texts.join(wanted, "rid").select("packed", "want").mapInArrow(_fetch, _ITEM), "slice-items")
    widths = [w for w in (16, 4, 1) if w < width]
    found = _resolve(items, spread, widths, group, chunk)
    covered = F.transform("runs", lambda r: F.struct((F.col("at") - r["i2"]).alias("s"), (F.col("at") - r["i1"] + length).alias("e")))
    part = other.join(found, ["key", "ctx"]).select("rid", covered.alias("spans"))
    return whole.union(part), rows


_SPACE, _WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]")


def _whole_words(data: bytes, s: int, e: int) -> tuple[int, int]:
    """The part of a stretch that holds whole words only; empty if there is none."""
    if s and not _SPACE.match(data, s) and not _SPACE.match(data, s - 1):
        cut = _SPACE.search(data, s, e)
        s = cut.start() if cut else e
    if s < e < len(data) and not _SPACE.match(data, e) and not _SPACE.match(data, e - 1):
        last = None
        for last in _SPACE.finditer(data, s, e):
            pass
        e = last.end() if last else s
    word = _WORD.search(data, s, e)
    return (word.start() if word else e), e  # white space ahead stays, to part the words around


def _apply(names: list[str], with_text: bool, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for packed, spans in zip(batch.column("packed"), batch.column("spans")):
                data = unpack.decompress(packed.as_py())
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for part in spans.as_py() or [] for x in part):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                if least_words:
                    merged = [[s, e] for s, e in (_whole_words(data, *x) for x in merged) if len(data[s:e].split()) >= least_words]
                kept, at = [], 0
                for s, e in merged:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), len(data) - len(rest), len(merged), rest.decode("utf-8", "ignore") if with_text else hashlib.sha256(rest).hexdigest()))
            c = list(zip(*out)) if out else [()] * 4
            made = [pa.array(list(x), k) for x, k in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            held = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*held, *made], names=names)

    return run


def _without(docs: DataFrame, carried: list[str], id_col: str, text_col: str, length: int, slices: int, group: int, chunk: int, last: str, least_words: int = 0) -> DataFrame:
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    spans, rows = repeated_spans(docs, rid, text_col, length, slices, group, chunk)
    spans = spans.groupBy("rid").agg(F.collect_set("spans").alias("spans"))
    joined = _packed(rows, ["rid", *carried]).join(spans, "rid", "left").select(*carried, "packed", "spans")
    schema = joined.select(*carried).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add(last, "string")
    return joined.mapInArrow(_apply(schema.names, last == "__text", least_words), schema)


def digest(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", slices: int = 3, group: int = 300, chunk: int = 1 << 18) -> DataFrame:
    """One row per row of ``docs``: bytes, bytes removed, removed runs, digest of the rest."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    got = _without(rows, ["__id"], "__id", "__t", length, slices, group, chunk, "kept_sha256")
    return got.withColumnRenamed("__id", id_col)


def clean(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", slices: int = 3, group: int = 300, chunk: int = 1 << 18, least_words: int = 0) -> DataFrame:
    """``docs`` without the covered bytes, in the same columns.

    With ``least_words``, covered runs are first narrowed to whole words, and only
    those of so many words or more go: passages are then a matter of words, and
    ``length`` a lower bound of their bytes.
    A character that a cut leaves incomplete goes too. ``chars_col``, where
    present, gets the new text's length.
    """
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns if x != text_col]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t"))
    got = _without(rows, ["__row"], "__id", "__t", length, slices, group, chunk, "__text", least_words)
    out = []
    for x in docs.columns:
        if x == text_col:
            out.append(F.col("__text").alias(x))
        elif x == chars_col:
            out.append(F.length("__text").cast(docs.schema[x].dataType).alias(x))
        else:
            out.append(F.col("__row")[x].alias(x))
    return got.select(*out)
