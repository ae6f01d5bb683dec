"""Near-duplicate passages by compact windows (Feng and Deng, 2021).

The elements of a text are its shingles of ``width`` words. Under a hash
function, a place c that is least in some subsequence stands for all of those in
which it is: from the place after the last lesser one on its left, to the one
before the next lesser one on its right. These *compact windows* are the nodes
of the Cartesian tree over the hashes. Only nodes that span ``min_words`` words
matter, and all nodes above such a node are such nodes, so the tree is built by a
stack over sliding minima alone. A window is cut to the subsequences of that
least length that hold c: anything longer holds one of them.

Windows of one text that have one hash at places near each other (a line that is
repeated) are taken as one, from the first place to the last.

Passages that resemble each other share a least hash with a chance equal to their
similarity, under each of ``hashes`` functions; windows with one signature are
joined where they lie around their common place, and verified: the best stretch
of one and of the other, of ``min_words`` or more, must have a Jaccard
similarity of shingles of ``similarity`` at least.

Windows with equal content are one item; where several texts have it, all of it
is a passage. Items are left out that have no stretch of which enough shingles
stand in any other text's item of the signature, as nothing can be like them. Of
the others every pair is verified that is not in one class yet. The passages of an
item are the stretches that the items of its class and signature hold: of two sets
of one size such a share makes the similarity; the lesser share that a verified
pair can have counts in texts without other passages. So neither the order of the
items nor who compares them changes a result.

A signature with ``group`` items or less is solved in one task. Of a larger one,
shingles that a block of ``block`` items holds twice are settled in it, those left
of several blocks are counted in a shuffle; items that are left are compared with one of
them as leader, and those not of its class with all, in blocks. So no task gathers
an unbounded group, and no pair is passed over.

Returned are the documents that share a passage with another one. Defined
cases: a null text counts as empty; very long texts have windows like any other,
and a line repeated through all of a text is one window; of equal least hashes the first is the place of a window; texts under ``min_words`` words share
nothing; repeated rows of one id count as one document, rows with a null id as
one where their texts are equal; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_bytes
from .components import connected

_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(6).integers(1 << 62, 1 << 63, 64, dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    width: int = 5
    min_words: int = 50
    similarity: float = 0.8
    hashes: int = 2
    group: int = 200
    #: Items of one signature whose shingles are compared in one task.
    block: int = 4000

    @property
    def least(self) -> int:
        """Shingles of the shortest passage."""
        return self.min_words - self.width + 1


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """64-bit hashes of word shingles, from hashes of the words."""
    words = data.lower().split()
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _ODD[k]
        out ^= out >> np.uint64(31)
    return out


def _under(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ _ADD[k]) * _ODD[63 - k]
    x ^= x >> np.uint64(29)
    x *= _ODD[31]
    return x ^ (x >> np.uint64(32))


def compact_windows(h: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``(place, first, last)`` of the Cartesian tree's nodes that span ``least`` places.

    Of equal hashes the first counts as the least.
    """
    yield from zip(*(x.tolist() for x in _nodes(h, least)))


def _nodes(h: np.ndarray, least: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of ``compact_windows``; ``h`` may hold several texts of ``sizes`` places, one after another."""
    n = len(h)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    starts = np.zeros(1, np.int64) if sizes is None else np.cumsum(sizes) - sizes
    rows = np.concatenate([h, np.full(-n % least, h[-1], h.dtype)]).reshape(-1, least)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(after[: n - least + 1], before[least - 1 : n])
    if len(starts) > 1:  # a window lies in one text
        across = np.repeat(starts[1:] - least + 1, least - 1) + np.tile(np.arange(least - 1), len(starts) - 1)
        low[across[(across >= 0) & (across < len(low))]] = 0
    edge = np.zeros(least - 1, h.dtype)
    top = np.concatenate([edge, low, edge])
    rows = np.concatenate([top, np.zeros(-len(top) % least, h.dtype)]).reshape(-1, least)
    before = np.maximum.accumulate(rows, axis=1).ravel()
    after = np.maximum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = np.flatnonzero(np.maximum(after[:n], before[least - 1 : least - 1 + n]) == h)
    # The place ahead of each text stands there as less than all others.
    at = np.searchsorted(chosen, starts)
    values, places = np.insert(h[chosen], at, 0).tolist(), np.insert(chosen, at, starts - 1).tolist()
    walls = set((at + np.arange(len(starts))).tolist())
    stack: list[int] = []
    first = [0] * len(places)
    last = [n - 1] * len(places)
    for k, value in enumerate(values):
        if k in walls:
            for i in stack:
                last[i] = places[k]
            stack = [k]
            continue
        while len(stack) > 1 and values[stack[-1]] > value:
            last[stack.pop()] = places[k] - 1
        first[k] = places[stack[-1]] + 1
        stack.append(k)
    inner = np.ones(len(places), bool)
    inner[list(walls)] = False
    firsts, lasts = np.array(first, np.int64)[inner], np.array(last, np.int64)[inner]
    wide = lasts - firsts + 1 >= least
    return chosen[wide], firsts[wide], lasts[wide]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Places whose windows are cut in one pass over several texts.
_PLACES = 1 << 15


def _cut(s: Settings):
    names = ["rid", "sig", "ctx", "c", "e", "lo", "hi"]

    def windows(rids: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
        digest, out = xxhash.xxh64_intdigest, []
        whole, sizes = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.array([len(h) for h in hashes], np.int64)
        raw, starts, rid = whole.tobytes(), np.cumsum(sizes) - sizes, np.array(rids, np.int64)
        for f in range(s.hashes):
            text, sig, c, e, lo, hi = _windows(_under(whole, f), s.least, sizes)
            ahead = (c - lo) + (e - c << 20)
            ctx = [digest(raw[i:j], k) for i, j, k in zip((8 * lo).tolist(), (8 * hi + 8).tolist(), ahead.tolist())]
            at = starts[text]
            out.append((rid[text], sig.view(np.int64), np.array(ctx, np.uint64).view(np.int64), c - at, e - at, lo - at, hi - at))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids: list[int] = []
        hashes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingle_hashes(text.as_py(), s.width)
                if len(h) < s.least:
                    continue
                rids.append(rid)
                hashes.append(h)
                held += len(h)
                if held > _PLACES:
                    yield windows(rids, hashes)
                    rids, hashes, held = [], [], 0
        yield windows(rids, hashes)

    return run


def _windows(g: np.ndarray, least: int, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text and columns of ``_runs`` for several texts, one after another."""
    c, first, last = _nodes(g, least, sizes)
    text = np.searchsorted(np.cumsum(sizes), c, side="right")
    sig, lows, highs = g[c], np.maximum(first, c - least + 1), np.minimum(last, c + least - 1)
    order = np.lexsort((sig, text))
    again = (sig[order[1:]] == sig[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    if not again.any():
        return text, sig, c, c, lows, highs
    mixed = np.zeros(len(sizes), bool)
    mixed[text[order[1:]][again]] = True
    mixed = mixed[text]
    made = [(t, *x) for t in np.unique(text[mixed]).tolist() for x in _as_one(*(y[text == t] for y in (sig, c, lows, highs)), least)]
    alone = (text, sig, c, c, lows, highs)
    return tuple(np.concatenate([x[~mixed], np.array(y, x.dtype)]) for x, y in zip(alone, zip(*made)))


def _runs(g: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Hash, first place, last place, first and last of cut windows, those of one hash and near places as one."""
    return _windows(g, least, np.array([len(g)], np.int64))[1:]


def _as_one(sig: np.ndarray, c: np.ndarray, lows: np.ndarray, highs: np.ndarray, least: int) -> list[list[int]]:
    """Windows of one text, those of one hash and near places as one."""
    out: list[list[int]] = []
    latest: dict[int, list[int]] = {}
    for key, at, lo, hi in zip(sig.tolist(), c.tolist(), lows.tolist(), highs.tolist()):
        x = latest.get(key)
        if x is not None and at - x[2] <= least and lo <= x[4] + 1:
            x[2], x[4] = at, max(hi, x[4])
            continue
        x = latest[key] = [key, at, at, lo, hi]
        out.append(x)
    return out


_KINDS = {"sig": pa.int64(), "ctx": pa.int64(), "rid": pa.int64(), "label": pa.int64(), "whole": pa.bool_(), "a": pa.int64(), "e": pa.int64(), "lo": pa.int64(), "h": pa.binary()}
_ITEM = "sig long, ctx long, rid long, label long, whole boolean, a long, e long, lo long, h binary"


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds.values())], names=list(kinds))


def _fetch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for rid, packed, want in zip(batch.column("rid").to_pylist(), batch.column("packed"), batch.column("want")):
                # Half of each hash tells the shingles of two windows apart.
                h = (shingle_hashes(unpack.decompress(packed.as_py()), width) >> np.uint64(32)).astype("<u4")
                for w in want.as_py():
                    out.append((w["sig"], w["ctx"], rid, w["label"], w["whole"], w["c"] - w["lo"], w["e"] - w["lo"], w["lo"], h[w["lo"] : w["hi"] + 1].tobytes()))
            yield _batch(out, _KINDS)

    return run


def stretches(hits: np.ndarray, a: int, e: int, least: int, need: float) -> list[tuple[int, int]]:
    """Stretches around the places ``a`` to ``e`` of which ``need`` are hits.

    Of each run of dense starts the first best one, lengthened by the hits beside it.
    """
    low, high = max(0, a - least + 1), min(e, len(hits) - least)
    if low > high:
        return []
    total = np.concatenate([[0], np.cumsum(hits)])
    got = total[low + least : high + least + 1] - total[low : high + 1]
    dense = np.flatnonzero(got >= need * least)
    if not len(dense):
        return []
    out: list[tuple[int, int]] = []
    misses = None
    for part in np.split(dense, np.flatnonzero(np.diff(dense) > 1) + 1) if dense[-1] - dense[0] >= len(dense) else [dense]:
        i = low + int(part[got[part].argmax()])
        j = i + least
        if misses is None:
            misses = np.flatnonzero(~hits)
        if i and hits[i - 1]:
            k = int(np.searchsorted(misses, i))
            i = int(misses[k - 1]) + 1 if k else 0
        if j < len(hits) and hits[j]:
            k = int(np.searchsorted(misses, j))
            j = int(misses[k]) if k < len(misses) else len(hits)
        if not out or out[-1] != (i, j):
            out.append((i, j))
    return out


def _alike_share(s: Settings) -> float:
    """Sets of equal size n that share m have similarity m / (2 n - m)."""
    return 2 * s.similarity / (1 + s.similarity)


def _need(s: Settings) -> float:
    return _alike_share(s) * 0.9


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is one of ``y``; quicker than ``isin`` on short arrays."""
    y = np.sort(y)
    return y[np.minimum(y.searchsorted(x), len(y) - 1)] == x


def _one_way(x: np.ndarray, at: tuple[int, int], y: np.ndarray, by: tuple[int, int], s: Settings) -> bool:
    for i, j in stretches(_within(x, y), *at, s.least, _need(s)):
        p = set(x[i:j].tolist())
        for k, m in stretches(_within(y, x[i:j]), *by, s.least, _need(s)):
            q = set(y[k:m].tolist())
            if len(p & q) >= s.similarity * len(p | q):
                return True
    return False


def alike(x: np.ndarray, at: tuple[int, int], y: np.ndarray, by: tuple[int, int], s: Settings) -> bool:
    """Whether verified stretches of both lie around their common places, whichever comes first."""
    return _one_way(x, at, y, by, s) or _one_way(y, by, x, at, s)


def _fewest(h: np.ndarray, a: int, e: int, least: int) -> int:
    """Different shingles of the poorest stretch of the least length around the places."""
    low, high = max(0, a - least + 1), min(e, len(h) - least)
    if low > high:
        return least
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
    if not len(again):
        return least
    # A shingle is counted where it stands first: from behind its last occurrence on.
    before, at = order[again - 1], order[again]
    near = at - before < least
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, np.maximum(0, at[near] - least + 1), 1)
    np.add.at(change, before[near] + 1, -1)
    return least - int(np.cumsum(change)[low : high + 1].max())


_FOUND = "rid long, other long, first long, last long"
_FOUND_KINDS = {"rid": pa.int64(), "other": pa.int64(), "first": pa.int64(), "last": pa.int64()}


def _root(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _shared(codes: np.ndarray, owner: np.ndarray, group: np.ndarray, rids: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether each code stands in another text's item of its group: two texts, or one item of several, hold it."""
    key = codes
    if (group != group[0]).any():
        key = np.unique(group[owner] * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    least = np.full(int(key.max(initial=-1)) + 1, len(rids))
    most = np.full(len(least), -1)
    np.minimum.at(least, key, rids[owner])
    np.maximum.at(most, key, rids[owner])
    held = least < most
    held[key[whole[owner]]] = True
    return held[key]


def _dense(items: list[dict], h: list[np.ndarray], codes: np.ndarray, often: np.ndarray, member: np.ndarray, near: np.ndarray, s: Settings) -> np.ndarray:
    """Pairs of ``near`` of which each item has a dense stretch of the other's shingles, as ``alike`` asks first of all."""
    column = np.where(often, np.cumsum(often), 0)[codes]
    member = np.concatenate([np.zeros((len(items), 1), bool), member], axis=1)
    out = np.zeros(near.shape, bool)
    both, begin = near | near.T, 0
    for i, x in enumerate(items):
        places, n = column[begin : begin + len(h[i])], len(h[i])
        begin += n
        low, high = max(0, x["a"] - s.least + 1), min(x["e"], n - s.least)
        others = np.flatnonzero(both[i])
        if low > high or not len(others):
            continue
        total = np.zeros((len(others), n + 1), np.int32)
        np.cumsum(member[np.ix_(others, places)], axis=1, out=total[:, 1:])
        got = total[:, low + s.least : high + s.least + 1] - total[:, low : high + 1]
        out[i, others] = got.max(axis=1) >= _need(s) * s.least
    return out & out.T


def _linked(items: list[dict], h: list[np.ndarray], codes: np.ndarray, root: list[int], s: Settings, against: set[int] | None = None) -> list[tuple[int, int]]:
    """Verified pairs of items that join two parts, until no alike pair is in two; ``root`` is brought up to date."""
    out: list[tuple[int, int]] = []
    n = len(items)
    if len({_root(root, i) for i in range(n)}) < 2:
        return out
    if n > 2:
        # A shingle of one place alone is shared by nobody.
        often = np.bincount(codes) > 1
        held = often[codes]
        member = np.zeros((n, int(often.sum())), np.float32)
        member[np.repeat(np.arange(n), [len(x) for x in h])[held], (np.cumsum(often) - 1)[codes[held]]] = 1
        fewest = np.array([_fewest(x, it["a"], it["e"], s.least) for x, it in zip(h, items)])
        both = member @ member.T
        near = np.tril(both >= 0.99 * s.similarity * np.maximum(fewest[:, None], fewest[None, :]), -1)
        labels = np.array([_root(root, i) for i in range(n)])
        near &= labels[:, None] != labels[None, :]
        if against is not None:
            one = np.array([i in against for i in range(n)])
            near &= one[:, None] | one[None, :]
        at, by = np.nonzero(near & _dense(items, h, codes, often, member > 0, near, s))
        # Those that share most come first: they join parts, and pairs inside a part need no look.
        order = np.argsort(-both[at, by], kind="stable")
        pairs = np.column_stack([at[order], by[order]]).tolist()
    else:
        pairs = [[1, 0]]
    for i, j in pairs:
        x, y = items[i], items[j]
        if _root(root, i) != _root(root, j) and alike(h[i], (x["a"], x["e"]), h[j], (y["a"], y["e"]), s):
            out.append((i, j))
            root[_root(root, i)] = _root(root, j)
    return out


def _solved(items: list[dict], s: Settings, kept: bool = False) -> list[tuple]:
    """Links of a signature's items, and the passages of each: stretches that the items linked with it hold.

    ``kept``: items that can't be linked are gone already.
    """
    if len(items) < 2:
        return []
    h = [np.frombuffer(x["h"], "<u4") for x in items]
    if len(items) == 2:
        return _solved_pair(*items, *h, s)
    if not kept:
        codes, owner, rids, whole = _columns(items, h)
        hits = np.split(_shared(codes, owner, np.zeros(len(items), np.int64), rids, whole), np.cumsum([len(x) for x in h])[:-1])
        live = [i for i, x in enumerate(items) if stretches(hits[i], x["a"], x["e"], s.least, _need(s))]
        if len(live) < 2:
            return []
        items, h = [items[i] for i in live], [h[i] for i in live]
    codes, owner, rids, whole = _columns(items, h)
    first: dict[int, int] = {}
    root = [first.setdefault(x["label"], i) for i, x in enumerate(items)]
    out: list[tuple] = [(items[i]["rid"], items[j]["rid"], None, None) for i, j in _linked(items, h, codes, root, s)]
    if whole.all():
        return out
    parts = np.array([_root(root, i) for i in range(len(items))])
    hits = np.split(_shared(codes, owner, parts, rids, whole), np.cumsum([len(x) for x in h])[:-1])
    for x, held in zip(items, hits):
        if not x["whole"]:  # else all of it is a passage already
            out += _passages(x, held, s)
    return out


def _solved_pair(x: dict, y: dict, h: np.ndarray, g: np.ndarray, s: Settings) -> list[tuple]:
    """``_solved`` of two items."""
    if x["rid"] == y["rid"] and not x["whole"] and not y["whole"]:
        return []
    one, two = _within(h, g), _within(g, h)
    for z, hits in ((x, one), (y, two)):
        if not z["whole"] and not stretches(hits, z["a"], z["e"], s.least, _need(s)):
            return []
    out: list[tuple] = []
    if x["label"] != y["label"]:
        if not alike(h, (x["a"], x["e"]), g, (y["a"], y["e"]), s):
            return []
        out.append((x["rid"], y["rid"], None, None))
    for z, hits in ((x, one), (y, two)):
        if not z["whole"]:
            out += _passages(z, hits, s)
    return out


def _columns(items: list[dict], h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.unique(np.concatenate(h), return_inverse=True)[1]
    rids = np.unique(np.array([x["rid"] for x in items]), return_inverse=True)[1]
    return codes, np.repeat(np.arange(len(items)), [len(x) for x in h]), rids, np.array([x["whole"] for x in items])


def _passages(x: dict, hits: np.ndarray, s: Settings) -> list[tuple]:
    """Stretches that the items of x's class hold; those of the lesser share (``other`` null) count in texts without any."""
    at, lo, rid = (x["a"], x["e"], s.least), x["lo"], x["rid"]
    firm = [(rid, rid, lo + i, lo + j - 1) for i, j in stretches(hits, *at, _alike_share(s))]
    return firm or [(rid, None, lo + i, lo + j - 1) for i, j in stretches(hits, *at, _need(s))]


def _by_signature(s: Settings, kept: bool):
    """Links and passages of each run of rows with one signature, from rows sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                if held and held[0]["sig"] != row["sig"]:
                    rows += _solved(held, s, kept)
                    held = []
                held.append(row)
            yield _batch(rows, _FOUND_KINDS)
        yield _batch(_solved(held, s, kept), _FOUND_KINDS)

    return run


_MARKED = _ITEM + ", part long, hits binary"


def _block_hits(items: list[dict]) -> list[tuple[dict, np.ndarray]]:
    h = [np.frombuffer(x["h"], "<u4") for x in items]
    codes, owner, rids, whole = _columns(items, h)
    return list(zip(items, np.split(_shared(codes, owner, np.zeros(len(items), np.int64), rids, whole), np.cumsum([len(x) for x in h])[:-1])))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with a mark at each shingle that another text's item of their block holds, too, from rows sorted by block."""
    kinds = _KINDS | {"part": pa.int64(), "hits": pa.binary()}
    held: list[dict] = []
    block = lambda x: (x["sig"], x["part"], x["block"])

    def rows(items: list[dict]) -> list[tuple]:
        return [(*(x[k] for k in _KINDS), x["part"], hits.tobytes()) for x, hits in _block_hits(items)] if items else []

    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if held and block(held[0]) != block(row):
                out += rows(held)
                held = []
            held.append(row)
        yield _batch(out, kinds)
    yield _batch(rows(held), kinds)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item and different shingle."""
    for batch in batches:
        codes = [np.unique(np.frombuffer(x.as_py(), "<u4")).astype(np.int64) for x in batch.column("h")]
        rows = pa.array(np.repeat(np.arange(len(codes)), [len(x) for x in codes]), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.drop_columns("h").take(rows).columns, pa.array(np.concatenate([np.zeros(0, np.int64), *codes]))], names=["sig", "rid", "part", "whole", "code"])


def _unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item and different shingle that only it holds in its block."""
    for batch in batches:
        codes = [np.unique(np.frombuffer(h.as_py(), "<u4")[~np.frombuffer(m.as_py(), bool)]).astype(np.int64) for h, m in zip(batch.column("h"), batch.column("hits"))]
        rows = pa.array(np.repeat(np.arange(len(codes)), [len(x) for x in codes]), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["h", "hits"]).take(rows).columns, pa.array(np.concatenate([np.zeros(0, np.int64), *codes]))], names=["sig", "ctx", "rid", "part", "code"])


def _with_shared(items: DataFrame, block: int) -> DataFrame:
    """``items``, with a mark at each shingle that other texts' items of their signature and part hold, too.

    Blocks of bounded size settle what they hold twice themselves; of signatures
    of several blocks only what is left is looked up in the counts of all.
    """
    sizes = materialize(items.groupBy("sig", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "window-blocks")
    dealt = items.join(sizes, ["sig", "part"]).withColumn("block", F.pmod(F.xxhash64("ctx", "rid"), F.col("blocks")).cast("int"))
    keys = ["sig", "part", "block"]
    marked = materialize(dealt.select(*_KINDS, "part", "block").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_marked, _MARKED), "marked-items")
    several = sizes.where("blocks > 1").select("sig", "part")
    if several.isEmpty():
        return marked.withColumn("shared", F.lit(None).cast("array<bigint>"))
    apart = materialize(marked.join(several, ["sig", "part"], "left_semi"), "items-of-blocks")
    codes = apart.select("sig", "rid", "part", "whole", "h").mapInArrow(_codes, "sig long, rid long, part long, whole boolean, code long")
    held = codes.groupBy("sig", "part", "code").agg(F.min("rid").alias("r1"), F.max("rid").alias("r2"), F.bool_or("whole").alias("several")).where("r1 < r2 or several").select("sig", "part", "code")
    rest = apart.select("sig", "ctx", "rid", "part", "h", "hits").mapInArrow(_unmarked, "sig long, ctx long, rid long, part long, code long")
    shared = rest.join(held, ["sig", "part", "code"]).groupBy("sig", "ctx", "rid").agg(F.collect_list("code").alias("shared"))
    return marked.join(shared, ["sig", "ctx", "rid"], "left")


def _hits(row: dict) -> np.ndarray:
    hits = np.frombuffer(row["hits"], bool)
    return hits | np.isin(np.frombuffer(row["h"], "<u4"), np.array(row["shared"], np.int64).astype(np.uint32)) if row["shared"] else hits


def _live(s: Settings):
    """Items with a stretch that some other text could hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(stretches(_hits(x), x["a"], x["e"], s.least, _need(s))) for x in batch.to_pylist()]
            yield batch.drop_columns(["hits", "shared"]).filter(pa.array(keep, pa.bool_()))

    return run


def _covered(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([p for x in batch.to_pylist() for p in _passages(x, _hits(x), s)], _FOUND_KINDS)

    return run


_JOINED = "sig long, l1 long, l2 long, rid long, other long"
_JOINED_KINDS = {"sig": pa.int64(), "l1": pa.int64(), "l2": pa.int64(), "rid": pa.int64(), "other": pa.int64()}


def _led(s: Settings):
    """Links of items with their signature's leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for x in batch.to_pylist():
                y = x["lead"]
                if alike(np.frombuffer(x["h"], "<u4"), (x["a"], x["e"]), np.frombuffer(y["h"], "<u4"), (y["a"], y["e"]), s):
                    rows.append((x["sig"], x["label"], y["label"], x["rid"], y["rid"]))
            yield _batch(rows, _JOINED_KINDS)

    return run


def _blocks(s: Settings):
    def run(table: pa.Table) -> pa.Table:
        items = table.to_pylist()
        odd = {i for i, x in enumerate(items) if x["odd"]}
        h = [np.frombuffer(x["h"], "<u4") for x in items]
        first: dict[int, int] = {}
        root = [first.setdefault(x["label"], i) for i, x in enumerate(items)]
        got = _linked(items, h, _columns(items, h)[0], root, s, odd) if len(items) > 1 and odd else []
        return pa.Table.from_batches([_batch([(items[i]["sig"], items[i]["label"], items[j]["label"], items[i]["rid"], items[j]["rid"]) for i, j in got], _JOINED_KINDS)])

    return run


def _resolved(items: DataFrame, s: Settings) -> DataFrame:
    """Verified links and passages of items by signature; ``group`` decides who compares, not what is found."""
    sizes = items.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > s.group).select("sig")
    large = materialize(sizes, "large-signatures")
    done = items.join(large, "sig", "left_anti").repartition("sig").sortWithinPartitions("sig").mapInArrow(_by_signature(s, False), _FOUND)
    if large.isEmpty():
        return done
    live = _with_shared(items.join(large, "sig", "left_semi").withColumn("part", F.lit(0).cast("long")), s.block)
    live = materialize(live.select(*_KINDS, "hits", "shared").mapInArrow(_live(s), _ITEM), "live-items")
    lead = F.min(F.struct("ctx", "rid", "label", "a", "e", "h")).alias("lead")
    sizes = materialize(live.groupBy("sig").agg(F.count("*").alias("n"), lead), "live-signatures")
    few = live.join(sizes.where(F.col("n") <= s.group).select("sig"), "sig", "left_semi").repartition("sig").sortWithinPartitions("sig")
    done = done.union(few.select(*_KINDS).mapInArrow(_by_signature(s, True), _FOUND))
    hot = live.join(sizes.where(F.col("n") > s.group), "sig")
    led = materialize(hot.where("label <> lead.label").select(*_KINDS, "lead").mapInArrow(_led(s), _JOINED), "led")
    with_lead = led.select("sig", F.col("l1").alias("label"), F.col("l2").alias("joined")).distinct()
    hot = hot.join(with_lead, ["sig", "label"], "left").withColumn("label", F.coalesce("joined", "label"))
    hot = hot.withColumn("odd", F.col("label") != F.col("lead.label")).select(*_KINDS, "n", "odd")
    hot = materialize(hot, "hot-items")
    # Items not of the leader's class meet all, in blocks of bounded size.
    odd = hot.where("odd").groupBy("sig").agg(F.ceil(F.count("*") / s.group).cast("int").alias("parts"))
    rest = hot.join(odd, "sig")
    mine, all_ = F.pmod(F.xxhash64("ctx", "rid"), F.col("parts")).cast("int"), F.ceil(F.col("n") / s.group).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    at = F.pmod(F.xxhash64("rid", "ctx"), all_).cast("int")
    keep = [*_KINDS, "odd", "bi", "bj"]
    met = rest.where("odd").withColumn("bi", mine).withColumn("bj", upto(all_)).select(*keep)
    met = met.union(rest.withColumn("bj", at).withColumn("bi", upto(F.col("parts"))).select(*keep)).dropDuplicates(["sig", "ctx", "rid", "bi", "bj"])
    joined = materialize(met.groupBy("sig", "bi", "bj").applyInArrow(_blocks(s), _JOINED), "joined-items")
    node = lambda label: F.xxhash64("sig", label)
    parts = connected(joined.select(node("l1").alias("a"), node("l2").alias("b")))
    hot = hot.join(parts, node("label") == F.col("node"), "left").withColumn("part", F.coalesce("component", node("label")))
    spans = _with_shared(hot.select(*_KINDS, "part"), s.block).where("not whole").select(*_KINDS, "hits", "shared").mapInArrow(_covered(s), _FOUND)
    none = F.lit(None).cast("long")
    return done.union(led.union(joined).select("rid", "other", none.alias("first"), none.alias("last"))).union(spans)


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Documents that share a passage: id, class, number of passages, words and word ranges."""
    from .suffix_dedup import _packed

    s = settings
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), text_bytes(text_col).alias("data"))
    long_enough = rows.where(F.octet_length("data") >= 2 * s.min_words - 1)
    cut = materialize(long_enough.select("rid", "data").mapInArrow(_cut(s), "rid long, sig long, ctx long, c long, e long, lo long, hi long"), "windows")
    keys = cut.groupBy("sig").agg(F.min("rid").alias("r1"), F.max("rid").alias("r2"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).where("r1 < r2")
    keys = materialize(keys.select("sig", F.col("r1").alias("leader"), (F.col("c1") == F.col("c2")).alias("equal")), "window-keys")
    met = materialize(cut.join(keys, "sig"), "met-windows")
    discard(cut, keys)
    span = [F.col("lo").alias("first"), F.col("hi").alias("last")]
    whole = met.where("equal").select("rid", F.col("leader").alias("other"), *span)
    reps = met.where("not equal").groupBy("sig", "ctx").agg(F.min(F.struct("rid", "c", "e", "lo", "hi")).alias("x"), F.max("rid").alias("r2"))
    held = reps = materialize(reps.select("sig", "ctx", "x.*", (F.col("x.rid") < F.col("r2")).alias("many")), "window-items")
    same = met.where("not equal").select("sig", "ctx", "rid", *span).join(reps.where("many").select("sig", "ctx", F.col("rid").alias("other")), ["sig", "ctx"]).select("rid", "other", "first", "last")
    # Items whose window is a passage as a whole, all of one part, need no text; all others go on.
    plain = materialize(whole.union(same).distinct(), "equal-passages")
    discard(met)
    parts = connected(plain.where("rid <> other").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    reps = reps.join(parts, F.col("rid") == F.col("node"), "left").select("sig", "ctx", "rid", "c", "e", "lo", "hi", F.col("many").alias("whole"), F.coalesce("component", "rid").alias("label"))
    reps = materialize(reps, "labelled-items")
    discard(held)
    split = materialize(reps.groupBy("sig").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.every("whole").alias("settled")).where("l1 < l2 or not settled").select("sig"), "split-signatures")
    labelled, reps = reps, reps.join(split, "sig", "left_semi")
    wanted = reps.groupBy("rid").agg(F.collect_list(F.struct("sig", "ctx", "label", "whole", "c", "e", "lo", "hi")).alias("want"))
    texts = _packed(long_enough, ["rid"]).dropDuplicates(["rid"])
    items = texts.join(wanted, "rid").select("rid", "packed", "want").mapInArrow(_fetch(s.width), _ITEM)
    items = materialize(items, "items")
    discard(labelled, split)
    spanned = materialize(plain.union(_resolved(items, s)).distinct(), "passages")
    discard(items, plain)
    found = spanned.where("rid <> other")
    classes = connected(found.select(F.col("rid").alias("a"), F.col("other").alias("b")))
    span = F.struct("first", "last")
    spans = spanned.where("first is not null").groupBy("rid").agg(F.collect_set(F.when(F.col("other").isNotNull(), span)).alias("firm"), F.collect_set(F.when(F.col("other").isNull(), span)).alias("loose"))
    spans = spans.select("rid", F.when(F.size("firm") > 0, F.col("firm")).otherwise(F.col("loose")).alias("spans"))
    ids = rows.select("__id", "rid").distinct()
    named = ids.join(classes, F.col("rid") == F.col("node")).select("__id", "rid", "component")
    least = named.groupBy("component").agg(F.min("__id").alias("component_id"))
    merged = F.aggregate(
        F.sort_array("spans"),
        F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, F.when(F.size(out) > 0, F.lit(-1)).otherwise(1))["last"] + 1 >= x["first"]), F.concat(
            F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))),
            F.array(F.struct(F.try_element_at(out, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(out, F.lit(-1))["last"], x["last"]).alias("last"))),
        )).otherwise(F.concat(out, F.array(F.struct(x["first"].alias("first"), x["last"].alias("last"))))),
    )
    out = named.join(least, "component").join(spans, "rid", "left")
    return out.withColumn("spans", F.when(F.col("spans").isNotNull(), merged).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))).select(
        F.col("__id").alias(id_col),
        "component_id",
        F.size("spans").cast("long").alias("n_passages"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + s.width).alias("n_words"),
        F.transform("spans", lambda x: F.struct(x["first"].alias("first_word"), (x["last"] + s.width - 1).alias("last_word"))).alias("passages"),
    )
