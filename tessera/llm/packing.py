"""Packing documents into fixed-length sequences by repeated length patterns.

After "non-negative least squares histogram packing" (Krell et al., 2021):
patterns of two to four lengths that fill a sequence exactly are enumerated by
pricing, a few rounds of the best pattern through each length; active-set
non-negative least squares fits how often to repeat each so that the patterns
together reproduce the histogram of lengths; counts are rounded, as far as there
are pieces, and what is left is packed best-fit, longest first. Several shares of
the fitted counts are tried, a half at least, and the plan with the fewest
sequences wins, of equal ones that with most patterns.

Only the histogram (at most ``size`` numbers) reaches the driver, however many
documents there are, and the plan is bounded by ``size`` too. A piece finds its
place from its length and its rank among pieces of that length. Ranks come from
counts per input partition and length, so no length is gathered in one task,
even one that a third of all pieces share.

Defined cases: a null text counts as empty and gives one piece of one id; very
long texts are tokenized whole and cut into pieces; pieces of one length are
alike, so ties between them are broken by the input's order; repeated rows are packed one by one; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import gc
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_bytes

#: Marks that the public tokenizer splits from letters before them.
_MARKS = b".,;:!?"
#: Below this code point normalization keeps a letter one letter.
_PLAIN_BELOW = "\u0250"
Slots = list[tuple[tuple[int, ...], int]]


class WordIds(dict):
    """Packed ids of words between ASCII white space, from the public tokenizer.

    The tokenizer matches within such words only, so ids of a text are those of
    its words in turn. Holds at most twice ``limit`` words.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in a text they are ordinary text
        #: The merges alone: lower-case ASCII letters pass all steps ahead of them unchanged.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.limit = limit
        self.older: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether each id ends a word; None where the vocabulary does not tell.
        self.ends: np.ndarray | None = None
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def learn(self, words: set[bytes]) -> None:
        """Makes the ids of lower-cased ``words`` known."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        fresh = words.difference(self)
        older = fresh.intersection(self.older)
        self.update(zip(older, map(self.older.__getitem__, older)))
        fresh.difference_update(older)
        plain: set[bytes] = set()
        other: set[bytes] = set()
        joint: list[tuple[bytes, bytes, bytes]] = []
        for word in fresh:
            if word.isalpha():  # ASCII letters only
                plain.add(word)
                continue
            core = word.rstrip(_MARKS)
            if not core.isalpha():
                text = core.decode("utf-8", "replace").lower()
                if not text.isalpha() or max(text) >= _PLAIN_BELOW:
                    other.add(word)
                    continue
            plain.add(core)
            if len(core) < len(word):  # letters and marks after them are tokenized apart
                joint.append((word, core, word[len(core) :]))
        other.update({marks for _, _, marks in joint})
        for held in (plain, other):
            held.difference_update(self)
            older = held.intersection(self.older)
            self.update(zip(older, map(self.older.__getitem__, older)))
            held.difference_update(older)
        ascii_ = {word for word in plain if word.isascii()}
        self._apart(list(ascii_), self.bare)
        self._apart(list(plain - ascii_), self.tokenizer)
        self._tokenize(list(other))
        for word, core, marks in joint:
            self[word] = self[core] + self[marks]

    def _apart(self, words: list[bytes], tokenizer, joined: int = 256) -> None:  # noqa: ANN001
        """Words of letters only, many in one text: each ends with a token that ends a word."""
        if self.ends is None:
            self._tokenize(words)
            return
        parts = [words[k : k + joined] for k in range(0, len(words), joined)]
        got = tokenizer.encode_batch_fast([b" ".join(x).decode() for x in parts], add_special_tokens=False)
        for part, one in zip(parts, got, strict=True):
            ids = np.array(one.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                self._tokenize(part)
                continue
            raw, at = ids.tobytes(), 0
            for word, cut in zip(part, cuts):
                self[word] = raw[at:cut]
                at = cut

    def _tokenize(self, fresh: list[bytes]) -> None:
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            for word, one in zip(part, got, strict=True):
                self[word] = np.array(one.ids, "<u4").tobytes()

    def encode(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


_WORDS: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 50, 1000)  # the tables hold no cycles
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pieces(docs: DataFrame, path: str, size: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Every text's ids with ``end_id`` after them, cut where longer than ``size``.

    ``__part`` and ``__local`` number pieces of one length within a partition.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("__text"))
    schema = rows.select("__id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("__part", "integer"), ("__local", "long")):
        schema = schema.add(name, kind)
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        held, arrow = _word_ids(path), to_arrow_schema(schema)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                split = [x.as_py().lower().split() for x in some.column(1)]  # the tokenizer lower-cases too
                held.learn(set().union(*split))
                at: list[int] = []
                out: list[tuple[int, int, int, int, int]] = []
                for i, words in enumerate(split):
                    ids = held.encode(words) + closing
                    for p, start in enumerate(range(0, len(ids), 4 * size)):
                        one = ids[start : start + 4 * size]
                        n = len(one) // 4
                        at.append(i)
                        out.append((p, start // 4, n, zlib.crc32(one), int(seen[n])))
                        seen[n] += 1
                columns = list(zip(*out))
                made = [columns[0], columns[1], columns[2], columns[3], [part] * len(at), columns[4]]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(at)).cast(arrow[0].type), *(pa.array(list(c), f.type) for c, f in zip(made, list(arrow)[1:]))],
                    names=arrow.names,
                )

    return rows.mapInArrow(run, schema)


def _priced(gain: np.ndarray, size: int) -> set[tuple[int, ...]]:
    """The best pattern of two, three and four lengths through each length."""
    lengths = np.arange(1, size)
    out = {tuple(sorted((int(a), int(size - a)))) for a in lengths if gain[a] + gain[size - a] > 0}
    sums = np.full(size, -np.inf)  # the best two lengths that add up to m
    halves = np.zeros(size, np.int64)
    for m in range(2, size):
        a = lengths[: m // 2]
        got = gain[a] + gain[m - a]
        best = int(got.argmax())
        sums[m], halves[m] = got[best], a[best]
    for a in range(1, size):
        m = size - a
        if m >= 2 and gain[a] + sums[m] > 0:
            out.add(tuple(sorted((a, int(halves[m]), int(m - halves[m])))))
        if a >= 2 and m >= 2 and sums[a] + sums[m] > 0:
            out.add(tuple(sorted((int(halves[a]), int(a - halves[a]), int(halves[m]), int(m - halves[m])))))
    return out


def _least_squares(index: np.ndarray, start: np.ndarray, target: np.ndarray, steps: int) -> np.ndarray:
    """Counts whose sum of patterns is nearest to ``target``, by conjugate gradients.

    Row k of ``index`` has the lengths of pattern k; place 0 stands for none.
    """
    size = len(target)

    def lengths_of(counts: np.ndarray) -> np.ndarray:
        out = np.bincount(index.ravel(), np.repeat(counts, index.shape[1]), minlength=size)
        out[0] = 0
        return out

    x = start.copy()
    miss = target - lengths_of(x)
    down = miss[index].sum(axis=1)
    way, norm = down.copy(), float(down @ down)
    least = 1e-12 * max(1.0, norm)
    for _ in range(steps):
        if norm <= least:
            break
        moved = lengths_of(way)
        step = norm / float(moved @ moved)
        x += step * way
        miss -= step * moved
        down = miss[index].sum(axis=1)
        before, norm = norm, float(down @ down)
        way = down + norm / before * way
    return x


def _fitted(histogram: np.ndarray, size: int, rounds: int, steps: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Patterns and non-negative repeat counts that best reproduce the histogram.

    Active-set non-negative least squares (Lawson and Hanson, 1974) with priced
    columns: each round the patterns of greatest gain that share no length enter
    the set, the set is solved without bounds, and while a count comes out
    negative, the step stops at the first bound met and that pattern leaves. So
    the solution is sparse: no more patterns than it needs.
    """
    target = histogram.astype(float).copy()
    target[size] = 0  # whole sequences already
    pool = np.zeros((0, 4), np.int64)
    counts = np.zeros(0)
    for _ in range(rounds):
        fit = np.bincount(pool.ravel(), np.repeat(counts, 4), minlength=size + 1)
        gain = target - fit
        gain[target == 0] = -1.0 - target.max()  # lengths that do not occur
        gain[0] = 0.0
        used, new = np.zeros(size + 1, bool), []
        known = set(map(tuple, pool.tolist()))
        for pattern in sorted(_priced(gain, size), key=lambda p: (-gain[list(p)].sum() / len(p), p)):
            row = (*pattern, *[0] * (4 - len(pattern)))
            if gain[list(pattern)].sum() > 0.5 and not used[list(pattern)].any() and row not in known:
                used[list(pattern)] = True
                new.append(row)
        if not new:
            break
        pool = np.concatenate([pool, np.array(new, np.int64)])
        counts = np.concatenate([counts, np.zeros(len(new))])
        while len(pool):
            free = _least_squares(pool, counts, target, steps)
            below = free <= 1e-9
            if not below.any():
                counts = free
                break
            share = float((counts[below] / np.maximum(counts[below] - free[below], 1e-12)).min())
            counts = counts + min(1.0, share) * (free - counts)
            stay = ~(below & (counts <= 1e-9))
            pool, counts = pool[stay], np.maximum(counts[stay], 0.0)
    return [tuple(x for x in row if x) for row in pool.tolist()], counts


def _best_fit(left: np.ndarray, size: int) -> Slots:
    """Best-fit, longest first, over the histogram: equal sequences move together."""
    room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(free: int, pattern: tuple[int, ...], n: int) -> None:
        if free not in room:
            room[free] = []
            insort(rooms, free)
        room[free].append([pattern, n])

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                per = size // length
                full, rest = divmod(n, per)
                if full:
                    put(size - per * length, (length,) * per, full)
                if rest:
                    put(size - rest * length, (length,) * rest, 1)
                break
            free = rooms[k]
            pattern, have = room[free][-1]
            use = min(n, have)
            if use == have:
                room[free].pop()
                if not room[free]:
                    del room[free]
                    del rooms[k]
            else:
                room[free][-1][1] -= use
            put(free - length, (*pattern, length), use)
            n -= use
    return [(pattern, n) for free in rooms for pattern, n in room[free]]


def plan(histogram: np.ndarray, size: int, rounds: int = 16, steps: int = 200) -> tuple[Slots, int]:
    """Patterns and how many sequences follow each, for counts by length (index 0 unused).

    The second value is how many of the slots, the first ones, are fitted patterns.
    """
    pool, counts = _fitted(histogram, size, rounds, steps)
    best: tuple[Slots, int] | None = None
    for share in (1.0, 0.9, 0.75, 0.5):
        left = histogram.astype(np.int64).copy()
        chosen: Slots = []
        for k in np.argsort(-counts, kind="stable"):
            want = int(counts[k] * share + 0.5)
            if want == 0:
                continue
            need = {x: pool[k].count(x) for x in pool[k]}
            want = min([want, *(int(left[x]) // c for x, c in need.items())])
            if want:
                chosen.append((pool[k], want))
                for x, c in need.items():
                    left[x] -= c * want
        slots = chosen + _best_fit(left, size)
        if best is None or sum(n for _, n in slots) < sum(n for _, n in best[0]):
            best = slots, len(chosen)
    return best or ([], 0)


@dataclass(frozen=True)
class Places:
    """For each length, ranges of ranks with the first sequence and the offset there."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int
    #: Sequences below this number follow fitted patterns.
    fitted: int

    @classmethod
    def of(cls, slots: Slots, patterns: int) -> Places:
        found: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for pattern, n in slots:
            offset = 0
            for length in pattern:
                rank = taken.get(length, 0)
                found.setdefault(length, []).append((rank, base, offset))
                taken[length] = rank + n
                offset += length
            base += n
        return cls({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in found.items()}, base, sum(n for _, n in slots[:patterns]))

    def at(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                first, base, place = self.by_length[int(lengths[rows[0]])]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows] = base[k] + ranks[rows] - first[k]
                offset[rows] = place[k]
        return sequence, offset


def pack(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece, with its sequence, the offset there, and whether a fitted pattern placed it."""
    staged = materialize(pieces(docs, path, size, id_col, text_col, end_id), "pack-pieces")
    counts = staged.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect():  # at most ``size`` rows
        histogram[row["length"]] = row["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places.of(*plan(histogram, size)))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = staged.join(bases, ["__part", "length"]).select(
        "__id", "piece", "start", "length", "ids_crc32", (F.col("__base") + F.col("__local")).alias("__rank")
    )
    schema = ranked.drop("__rank").schema.add("sequence_id", "long").add("offset", "long").add("fitted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.at(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), pa.array(sequence < places.value.fitted)], names=schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
