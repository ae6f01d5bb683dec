"""Language-model scores from a hierarchical Pitman-Yor model of words, their contexts and their bytes.

A token is seated in the restaurant of the token ahead of it: every token of the
training texts has one, and every token that follows it there is a dish of its
own. The ``contexts`` most frequent tokens share a dense table: its dishes are the
frequent tokens, one for each of ``slots`` parts (by hash) of the other known
words, and one for words unknown to training; its restaurants are those of the
frequent tokens and one for the state after any other word. They share a parent
(a table opened in one is a customer there), whose base is the restaurant of
single words. Every pair that the table does not hold by itself has its own
restaurant and dish below: a word after a frequent token is chosen in the
restaurant of that token and the word's part, with the part's single words as the
base; any token after another word in that word's own restaurant, with the table's
row for other words as the base.

The customers of the restaurant of single words are their occurrences in training
texts; its base spells them: a byte is drawn in the restaurant of the bytes ahead
of it (up to ``order``), whose parent is the restaurant of one byte less, down to
one that all share, over a uniform base; a byte's customers are the words of the
vocabulary. As in the unigram score beside it, words unknown to training are one
class: its probability is what the base spells beside the known words. So the
probabilities of all known words and that class after any token add up to one.

Seating is sampled by Gibbs: a first seating from the number of tables the
process would open, then moves that take a customer from a table, chosen by size,
and seat it anew by the restaurant's rule. Moves run on all dishes at once with
the counts of tables renewed in between, as in distributed Gibbs samplers.
Predictive probabilities are averaged over ``samples`` seatings after
``burn_in``. Discounts come from counts of counts. Random numbers are drawn from
a hash of the dish, so neither the layout of the data nor a task that runs twice
changes a score.

What grows with the corpus stays distributed: the vocabulary is a table, its
seating is sampled partition by partition given the total of tables of the pass
before. Tokens whose pair is not in the dense table travel once, in blocks, to
the bucket of their restaurant. A bucket holds its restaurants whole: there pairs
are counted, seated and looked up at once, and the sums of each text go back.
Its discounts come from its own counts of counts; words that are not ``common``
are seated there by their mean probability, and scored by their own.
Collected and broadcast is only what has a fixed bound: counts of the dense table
(at most (contexts + 1) * (contexts + slots), one matrix of 18 MB), byte grams (at
most 256^(order + 1), 16.8 million by default) and the ``common`` most frequent
words; occurrences of others join the table of words. Words are known by 63 bits
of a hash, and pairs in a bucket by 64.

Defined cases: a null text counts as empty and scores its end alone; very long
texts are scored whole; with no training text at all every word is of the unknown
class; of words that tie for the last restaurant the first in byte order has it;
repeated rows are scored each; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .common import discard, materialize, text_bytes

#: Ends a text as a token, and a word as a byte; no word holds it.
END = b"\n"


@dataclass(frozen=True)
class Settings:
    order: int = 2
    contexts: int = 2047
    burn_in: int = 4
    samples: int = 4
    moves: int = 4
    strength: float = 1.0
    common: int = 200_000
    flush: int = 200_000
    slots: int = 32  # a power of two
    chunk: int = 600_000
    bucket: int = 1_000_000
    seed: int = 11


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Draws:
    """Uniform numbers of each dish from its key, whatever dishes are beside it."""

    def __init__(self, keys: np.ndarray, seed: int):
        self.keys = _mixed(keys.astype(np.uint64) + np.uint64(seed * int(_STEP) % (1 << 64)))
        self.drawn = np.zeros(len(keys), np.uint64)

    def uniform(self, dishes: np.ndarray) -> np.ndarray:
        """One number in [0, 1) for each of ``dishes``, which are all different."""
        self.drawn[dishes] += np.uint64(1)
        return self._unit(self.keys[dishes] + self.drawn[dishes] * _STEP)

    def several(self, dishes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For dishes that may be equal, by ``place`` within the dish."""
        return self._unit(_mixed(self.keys[dishes]) + place.astype(np.uint64) * _STEP)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (_mixed(x) >> np.uint64(11)).astype(float) * 2.0**-53


class Seating:
    """Tables of many dishes in many restaurants, sampled together.

    ``group`` numbers each dish's restaurant, ``base`` is the parent's
    probability of the dish, ``total`` fixes the number of tables of the
    restaurants where they are not all here, of all of them or for each dish.
    """

    def __init__(self, counts: np.ndarray, group: np.ndarray, base: np.ndarray, d: float, strength: float, draws: Draws, total: float | np.ndarray | None = None):
        self.counts, self.group, self.base, self.d, self.strength, self.draws, self.total = counts.astype(np.int64), group, base, d, strength, draws, total
        opened = self._weights(np.minimum(self.counts, 1))
        room = np.maximum(self.counts - 1, 0)
        more = opened * np.log1p(room / np.maximum(opened, 1e-12))
        more = np.floor(np.minimum(more, 1e9) + draws.uniform(np.arange(len(counts)))).astype(np.int64)
        self._seat(np.minimum(self.counts, np.minimum(self.counts, 1) + more))

    def _seat(self, tables: np.ndarray) -> None:
        """Tables of each dish with customers shared out in proportion to random weights."""
        self.dish = np.repeat(np.arange(len(tables)), tables)
        firsts = np.cumsum(tables) - tables
        weight = 1e-12 - np.log1p(-self.draws.several(self.dish, np.arange(len(self.dish)) - firsts[self.dish]))
        sums = np.bincount(self.dish, weight, minlength=len(tables))
        spare = (self.counts - tables)[self.dish]
        self.sizes = 1 + np.floor(spare * weight / sums[self.dish]).astype(np.int64)
        lost = self.counts - np.bincount(self.dish, self.sizes, minlength=len(tables)).astype(np.int64)
        first = np.flatnonzero(np.diff(self.dish, prepend=-1))
        self.sizes[first] += lost[self.dish[first]]

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=len(self.counts))

    def _weights(self, tables: np.ndarray) -> np.ndarray:
        """Weight of a new table for each dish."""
        if self.total is not None:
            return (self.strength + self.d * self.total) * self.base
        held = np.bincount(self.group, tables)
        return (self.strength + self.d * held[self.group]) * self.base

    def move(self) -> None:
        """One customer of every dish of two or more is taken away and seated anew."""
        live = np.flatnonzero(self.counts > 1)
        if not len(live):
            return
        starts = np.flatnonzero(np.diff(self.dish, prepend=-1))
        of = np.full(len(self.counts), -1, np.int64)
        of[self.dish[starts]] = starts
        ends = np.cumsum(self.sizes)
        before = ends[of[live]] - self.sizes[of[live]]
        taken = np.searchsorted(ends, before + (self.draws.uniform(live) * self.counts[live]).astype(np.int64), side="right")
        self.sizes[taken] -= 1
        open_ = self.sizes > 0
        tables = np.bincount(self.dish, open_, minlength=len(self.counts))
        new = self._weights(tables)[live]
        old = self.counts[live] - 1 - self.d * tables[live]
        fresh = self.draws.uniform(live) * (new + old) < new
        # Existing tables by size less the discount: draw by size, keep with the share left.
        # Where one table is left, that is it.
        ends = np.cumsum(self.sizes)
        only = live[~fresh & (tables[live] == 1)]
        joined = [np.searchsorted(ends, ends[of[only]] - self.sizes[of[only]], side="right")]
        stay = np.flatnonzero(~fresh & (tables[live] > 1))
        while len(stay):
            dishes = live[stay]
            before = ends[of[dishes]] - self.sizes[of[dishes]]
            pick = np.searchsorted(ends, before + (self.draws.uniform(dishes) * (self.counts[dishes] - 1)).astype(np.int64), side="right")
            ok = self.draws.uniform(dishes) * self.sizes[pick] < self.sizes[pick] - self.d
            joined.append(pick[ok])
            stay = stay[~ok]
        for pick in joined:
            self.sizes[pick] += 1  # one customer of each dish moves: no table twice
        keep = self.sizes > 0
        dish = np.concatenate([self.dish[keep], live[fresh]])
        sizes = np.concatenate([self.sizes[keep], np.ones(int(fresh.sum()), np.int64)])
        order = np.argsort(dish, kind="stable")
        self.dish, self.sizes = dish[order], sizes[order]

    def predictive(self) -> np.ndarray:
        tables = self.tables()
        if self.total is not None:
            raise ValueError("restaurants are not whole here")
        c, t = np.bincount(self.group, self.counts), np.bincount(self.group, tables)
        g = self.group
        return (self.counts - self.d * tables + (self.strength + self.d * t[g]) * self.base) / (self.strength + c[g])


# ------------------------------------------------------------- spelling of words


class Speller:
    """Averaged probabilities of a byte after up to ``order`` bytes."""

    def __init__(self, grams: dict[int, int], settings: Settings):
        """``grams``: counts of (context, byte) as integers of ``order + 1`` bytes."""
        self.order = settings.order
        code = np.array(sorted(grams), np.uint64)
        counts = np.array([grams[int(x)] for x in code], np.int64)
        #: Per level, from whole contexts down to none: gram codes, context numbers, parents' places.
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(self.order, -1, -1):
            context = code >> np.uint64(8)
            numbers = np.unique(context, return_inverse=True)[1]
            shorter = code & np.uint64((1 << (8 * k)) - 1) if k else code
            parent = np.unique(shorter, return_inverse=True)[1]
            levels.append((code, numbers, parent))
            code = np.unique(shorter)
        self.codes = [x[0] for x in levels]
        self.mean = [np.zeros(len(x[0])) for x in levels]
        #: For each context at each level, the averaged weight that goes to the parent.
        self.back = [np.zeros(int(x[1].max(initial=-1)) + 1) for x in levels]
        self.contexts = [np.unique(x[0] >> np.uint64(8)) for x in levels]
        base = [np.full(len(x[0]), 1 / 256) for x in levels]
        for step in range(settings.burn_in + settings.samples):
            held, now = [], counts
            for k, (codes, numbers, parent) in enumerate(levels):
                d = discount(int((now == 1).sum()), int((now == 2).sum()))
                seats = Seating(now, numbers, base[k], d, settings.strength, Draws(codes, settings.seed + 97 * step + k))
                for _ in range(settings.moves):
                    seats.move()
                held.append(seats)
                if k < self.order:
                    now = np.bincount(parent, seats.tables(), minlength=len(levels[k + 1][0])).astype(np.int64)
            probability = np.zeros(0)
            for k in range(self.order, -1, -1):
                seats, numbers = held[k], levels[k][1]
                seats.base = np.full(len(seats.counts), 1 / 256) if k == self.order else probability[levels[k][2]]
                base[k] = seats.base
                probability = seats.predictive()
                if step >= settings.burn_in:
                    self.mean[k] += probability / settings.samples
                    c, t = np.bincount(numbers, seats.counts), np.bincount(numbers, seats.tables())
                    self.back[k] += (seats.strength + seats.d * t) / (seats.strength + c) / settings.samples

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word, its end included."""
        n = self.order
        data = np.frombuffer(b"".join(END * n + w + END for w in words), np.uint8).astype(np.uint64)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + n)[:-1]])
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts + n, sizes)
        code = np.zeros(len(at), np.uint64)
        for j in range(n, -1, -1):
            code = code << np.uint64(8) | data[at - j]
        scale = np.ones(len(at))
        out = np.zeros(len(at))
        left = np.arange(len(at))
        for k in range(n + 1):
            if not len(left) or not len(self.codes[k]):
                continue
            part = code[left] & np.uint64((1 << (8 * (n - k + 1))) - 1)
            place = np.minimum(np.searchsorted(self.codes[k], part), len(self.codes[k]) - 1)
            hit = self.codes[k][place] == part
            out[left[hit]] = scale[left[hit]] * self.mean[k][place[hit]]
            left, part = left[~hit], part[~hit]
            # A known context passes its share to the parent; an unknown one all.
            where = np.minimum(np.searchsorted(self.contexts[k], part >> np.uint64(8)), len(self.contexts[k]) - 1)
            known = self.contexts[k][where] == part >> np.uint64(8)
            scale[left[known]] *= self.back[k][where[known]]
        out[left] = scale[left] / 256
        return np.add.reduceat(np.log10(out), np.cumsum(sizes) - sizes) if len(words) else np.zeros(0)


# ------------------------------------------------------------- contexts of words


def context_matrix(pairs: np.ndarray, counts: np.ndarray, base: np.ndarray, settings: Settings) -> np.ndarray:
    """Averaged probabilities of class ``w`` after class ``u``: row u, column w.

    ``pairs`` are numbers ``u * width + w`` with their counts, ``base`` the
    probabilities of the ``width`` classes as single words. Restaurants are moved a
    few at a time, as moves take several times the memory of what they leave.
    """
    width = len(base)
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    u, w = pairs // width, pairs % width
    d = discount(int((counts == 1).sum()), int((counts == 2).sum()))
    cuts = np.unique(np.searchsorted(u, u[::200_000])).tolist() + [len(u)]
    parts = [slice(i, j) for i, j in zip(cuts, cuts[1:])]
    seated = [Seating(counts[x], u[x], base[w[x]], d, settings.strength, Draws(pairs[x], settings.seed)) for x in parts]
    tables = np.zeros(len(u), np.int64)
    held = np.bincount(u, counts, minlength=width)
    out = np.zeros((width, width))
    for step in range(settings.burn_in + settings.samples):
        for x, seats in zip(parts, seated):
            for _ in range(settings.moves):
                seats.move()
            tables[x] = seats.tables()
        opened = np.bincount(w, tables, minlength=width).astype(np.int64)
        above = discount(int((opened == 1).sum()), int((opened == 2).sum()))
        shared = Seating(opened, np.zeros(width, np.int64), base, above, settings.strength, Draws(np.arange(width), settings.seed + 1 + step))
        for _ in range(settings.moves):
            shared.move()
        parent = shared.predictive()
        for x, seats in zip(parts, seated):
            seats.base = parent[w[x]]
        if step >= settings.burn_in:
            back = (settings.strength + d * np.bincount(u, tables, minlength=width)) / (settings.strength + held)
            out += back[:, None] * parent[None, :]
            out[u, w] += (counts - d * tables) / (settings.strength + held[u])
    return out / settings.samples


def word_hash(word: bytes) -> int:
    """63 bits of a hash, below a set bit: as a signed number it is negative, which no code is."""
    return xxhash.xxh64_intdigest(word) | 1 << 63


class Vocabulary(dict[bytes, int]):
    """Words of a task, numbered as they come; the end of a text is the first."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []
        self[END]

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self.hashes)
        self.hashes.append(word_hash(word))
        return got

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


@dataclass
class Known:
    """The common words by code, from 1; all others by their hash alone."""

    hashes: np.ndarray  # sorted
    codes: np.ndarray  # of the sorted hashes
    n: np.ndarray
    #: Column of the dense table, and log share of the word in it.
    column: np.ndarray
    share: np.ndarray
    #: Per slot, log share of a word that is not common, on average.
    mean: np.ndarray

    def look(self, hashes: np.ndarray) -> np.ndarray:
        """Codes; 0 for words that are not common."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.codes[place], 0)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def _pairs(frequent, slots: int, flush: int):  # noqa: ANN001
    """Counts of the dense table in training texts; the end of the text before is ahead of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = {word_hash(word): k for k, (word, _) in enumerate(frequent.value, slots + 1)}
        width = slots + 1 + len(column)
        words, chain, size = Vocabulary(), [], 0

        def out() -> pa.RecordBatch:
            to = np.array([column.get(h, h & slots - 1) for h in words.hashes], np.int64)
            to = to[np.concatenate([np.zeros(1, np.int32), *chain])]
            pairs, counts = np.unique(np.where(to > slots, to, 0)[:-1] * width + to[1:], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for text in batch.column(0):
                found = text.as_py().lower().split()
                found.append(END)
                chain.append(words.numbers(found))
                size += len(found)
                if size > flush or len(words) > flush:
                    yield out()
                    words, chain, size = Vocabulary(), [], 0
        yield out()

    return run


def _grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for word in batch.column(0):
                data = END * order + word.as_py() + END
                for i in range(len(data) - order):
                    found[int.from_bytes(data[i : i + order + 1], "big")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    return run


# -------------------------------------------------------------------- the corpus


def _words(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        other: set[bytes] = set()

        def out() -> pa.RecordBatch:
            words = [*train, *(other - train.keys())]
            counts = [train[w] for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            for learned, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().lower().split()
                words.append(END)
                (train if learned else other).update(words)
                if len(train) + len(other) > flush:
                    yield out()
                    train, other = Counter(), set()
        yield out()

    return run


def vocabulary(docs: DataFrame, learn: Column, text_col: str, flush: int) -> DataFrame:
    """Every word of every text with its count in training texts."""
    rows = docs.select(F.coalesce(learn, F.lit(False)).alias("learn"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(_words(flush), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _sampled(speller_of, d: float, strength: float, total_words: int, total_tables: float, settings: Settings):  # noqa: ANN001
    """Adds each word's spelled log probability, averaged tables and averaged log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            counts = batch.column(1).to_numpy()
            spelled = speller_of.value.log10(words)
            base = np.power(10.0, spelled)
            hashes = np.array([word_hash(w) for w in words], np.uint64)
            several = np.flatnonzero(counts > 1)  # one customer sits at one table
            seats = Seating(counts[several], np.zeros(len(several), np.int64), base[several], d, strength, Draws(hashes[several], settings.seed), total_tables)
            tables = np.minimum(counts, 1).astype(float)
            tables[several] = 0
            for step in range(settings.burn_in + settings.samples):
                for _ in range(settings.moves):
                    seats.move()
                if step >= settings.burn_in:
                    tables[several] += seats.tables() / settings.samples
            probability = np.maximum(counts - d * tables, 0) / (strength + total_words)
            share = (strength + d * total_tables) / (strength + total_words)
            log = np.log10(probability + share * base + 1e-300)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts), pa.array(tables), pa.array(np.where(counts > 0, base, 0.0)), pa.array(log)], names=["h", "n", "tables", "spelled", "log_p"])

    return run


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers by place, since most high ones are zero."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: From here on a restaurant's number holds a frequent token's code and, above it, a slot.
_INNER = 1 << 32


def _scored(known, matrix, floor: float, buckets: int, settings: Settings, names: list[str]):  # noqa: ANN001
    """Per text the sums over the dense table and its common words; blocks of the tokens that go to a bucket.

    The texts' rows go along to any bucket, so that nothing is written twice.
    """
    slots = settings.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, after = known.value, matrix.value
        pack = zstandard.ZstdCompressor(level=1)
        words = Vocabulary()
        part, made = TaskContext.get().partitionId() << 40, 0

        def out(rows: pa.RecordBatch, chain: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            rid, made = part | made << 21, made + 1
            hashes = np.array(words.hashes, np.uint64)
            code = table.look(hashes)
            common = code > 0
            column = np.where(common, table.column[code], _slot(hashes, slots))
            row = np.where(column > slots, column, 0)
            share = np.where(common, table.share[code], 0.0)
            base = np.where(common, np.log10(table.n[code] + 0.1) - floor, 0.0)
            code = np.where(common, code, hashes.view(np.int64))
            sizes = np.array([len(x) for x in chain], np.int64)
            doc = np.repeat(np.arange(len(chain)), sizes)
            w = np.concatenate(chain)
            u = np.concatenate([np.zeros(1, np.int32), w[:-1]])
            score = np.bincount(doc, after[row[u], column[w]] + share[w], minlength=len(chain))
            sums = [pa.array(sizes), pa.array(np.bincount(doc, common[w], minlength=len(chain)).astype(np.int64)), pa.array(np.bincount(doc, base[w], minlength=len(chain))), pa.array(score)]
            away = np.flatnonzero((row[u] == 0) | (column[w] <= slots))
            u, w, doc = u[away], w[away], doc[away]
            room = np.where(row[u] > 0, code[u] + (column[w] + 1) * _INNER, code[u])
            learned = rows.column(rows.num_columns - 2).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = (doc * 2 + learned[doc]).astype(np.int32)
            bucket = (_mixed(room.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            room, dish, doc, bucket = room[order], code[w][order], doc[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            blocks = [pack.compress(_planes(room[i:j]) + _planes(dish[i:j]) + _planes(doc[i:j])) for i, j in zip(cuts, cuts[1:])]
            n, m = len(chain), len(blocks)
            held = [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in rows.columns[:-2]]
            rids = pa.array(np.concatenate([rid + np.arange(n), np.full(m, rid)]))
            sums = [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in sums]
            at = pa.array(np.concatenate([np.full(n, ((rid >> 40) + made) % buckets), bucket[cuts[:-1]]]))
            return pa.RecordBatch.from_arrays([*held, rids, *sums, at, pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(blocks, pa.binary())])], names=names)

        for batch in batches:
            first, chain, size = 0, [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                found = text.as_py().lower().split()
                found.append(END)
                chain.append(words.numbers(found))
                size += len(found)
                if size > settings.chunk or i == batch.num_rows - 1:
                    yield out(batch.slice(first, i + 1 - first), chain)
                    first, chain, size = i + 1, [], 0
                    if len(words) > settings.flush:
                        words = Vocabulary()

    return run


def _tables(counts: np.ndarray, group: np.ndarray, base: np.ndarray, keys: np.ndarray, d: float, settings: Settings) -> np.ndarray:
    """Averaged tables of each dish in restaurants that are whole here. One customer sits at one table."""
    out = np.ones(len(counts))
    several = np.flatnonzero(counts > 1)
    if len(several):
        alone = np.bincount(group, counts == 1)
        at = group[several]
        seats = Seating(counts[several], at, base[several], d, settings.strength, Draws(keys[several], settings.seed), np.bincount(group)[at])
        out[several] = 0
        for step in range(settings.burn_in + settings.samples):
            for _ in range(settings.moves):
                seats.move()
            opened = seats.tables()
            seats.total = (alone + np.bincount(at, opened, minlength=len(alone)))[at]
            if step >= settings.burn_in:
                out[several] += opened / settings.samples
    return out


_FOUND = StructType().add("texts", ArrayType(IntegerType())).add("sums", ArrayType(DoubleType())).add("h", "long").add("seen", "double").add("back", "double").add("lost", "double")


def _seated(known, matrix, settings: Settings):  # noqa: ANN001
    """Counts, seats and looks up the pairs of one bucket, and hands on the rows of texts.

    Per chunk of texts the sums of those that have common words here; a row for each token of
    another word: what its pair adds beside its share (``seen``), the part that
    goes by the share (``back``), and what the text gets if the word is unknown.
    """
    slots = settings.slots

    def run(group: pa.Table) -> pa.Table:
        table, after = known.value, matrix.value
        unpack = zstandard.ZstdDecompressor()
        texts, group = group.filter(pc.is_null(group.column("block"))), group.filter(pc.is_valid(group.column("block")))
        texts = texts.drop_columns(["bucket", "block"])
        rooms, dishes, docs, chunks = [], [], [], group.column("rid").to_numpy()
        if not len(chunks):
            return _handed_on(texts, None)
        for block in group.column("block"):
            data = unpack.decompress(block.as_py())
            n = len(data) // 20
            rooms.append(_numbers(data[: 8 * n], np.int64))
            dishes.append(_numbers(data[8 * n : 16 * n], np.int64))
            docs.append(_numbers(data[16 * n :], np.int32))
        sizes = np.array([int(x.max()) // 2 + 1 for x in docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        doc = np.concatenate([x // 2 + np.int64(s) for x, s in zip(docs, starts)])
        learned = np.concatenate(docs) & 1
        room, dish = np.concatenate(rooms), np.concatenate(dishes)
        del rooms, dishes, docs
        keys, first, pair = np.unique(_mixed(_mixed(room.view(np.uint64)) + dish.view(np.uint64)), return_index=True, return_inverse=True)
        counts = np.bincount(pair, learned).astype(np.int64)
        room, dish = room[first], dish[first]
        place = np.unique(room, return_inverse=True)[1]
        inner, common = room >= _INNER, dish > 0
        code = np.where(common, dish, 0)
        slot = _slot(dish.view(np.uint64), slots)
        share = np.where(common, table.share[code], table.mean[slot])
        column = np.where(common, table.column[code], slot)
        outer = np.where(inner, 0.0, after[0, column])
        base = np.power(10.0, share + outer)
        seen, opened, held = np.zeros(len(dish)), np.zeros(len(dish)), np.zeros(int(place.max()) + 1)
        for part in (inner, ~inner):
            here = np.flatnonzero(part & (counts > 0))
            n = counts[here]
            d = discount(int((n == 1).sum()), int((n == 2).sum()))
            tables = _tables(n, np.unique(place[here], return_inverse=True)[1], base[here], keys[here], d, settings)
            seen[here], opened[here] = n - d * tables, d * tables
        held += np.bincount(place, counts)
        total = (settings.strength + held)[place]
        back = (settings.strength + np.bincount(place, opened))[place] / total
        seen /= total
        gain = np.where(common, np.log10(seen / base + back), 0.0)
        sums = np.bincount(doc, gain[pair], minlength=int(sizes.sum()))
        # Words that are not common: after a frequent token an unknown one is a dish of the dense table.
        row = np.where(inner, table.column[np.where(inner, room % _INNER, 0)], 0)
        lost = after[row, slots] - after[row, slot] + np.where(inner, 0.0, np.log10(back))
        rare = np.flatnonzero(~common[pair])
        p = pair[rare]
        rid = np.repeat(chunks, sizes)[doc[rare]] + doc[rare] - np.repeat(starts, sizes)[doc[rare]]
        n, m = len(chunks), len(rare)
        there = np.flatnonzero(sums)
        cuts = pa.array(np.searchsorted(there, np.concatenate([starts, [len(sums)]])).astype(np.int32))
        columns = [pa.array(np.concatenate([chunks, rid]))]
        for x in ((there - np.repeat(starts, sizes)[there]).astype(np.int32), sums[there]):
            lists = pa.ListArray.from_arrays(cuts, pa.array(x))
            columns.append(pa.concat_arrays([lists, pa.nulls(m, lists.type)]))
        for x in (dish[p], (seen / np.power(10.0, outer))[p], back[p], lost[p]):
            columns.append(pa.concat_arrays([pa.nulls(n, pa.array(x[:0]).type), pa.array(x)]))
        return _handed_on(texts, pa.table(columns, names=["rid", *_FOUND.names]))

    return run


def _handed_on(texts: pa.Table, found: pa.Table | None) -> pa.Table:
    kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    for name, kind in zip(_FOUND.names, kinds):
        texts = texts.append_column(name, pa.nulls(texts.num_rows, kind))
    if found is None:
        return texts
    rest = [found.column(x.name) if x.name in found.column_names else pa.nulls(found.num_rows, x.type) for x in texts.schema]
    return pa.concat_tables([texts, pa.table(rest, schema=texts.schema)])


def _chunk_sums(group: pa.Table) -> pa.Table:
    """One row per text of a chunk, its sums of all buckets added up."""
    texts, sums = (np.concatenate([x.values.to_numpy() for x in group.column(name)]) for name in ("texts", "sums"))
    there = np.unique(texts)
    return pa.table([pa.array(group.column("rid")[0].as_py() + there.astype(np.int64)), pa.array(np.bincount(texts, sums)[there].astype(float))], names=["rid", "gain"])


def _frequent(words: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach, from a histogram of a few hundred steps."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    got = words.where("n > 0").groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    held, least = 0, 1 << 62
    for row in sorted(got, key=lambda r: -r["step"]):
        held += row["words"]
        if held > most:
            break
        least = row["least"]
    return least


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: token counts, a smoothed unigram score and the model's."""
    spark = docs.sparkSession
    words = materialize(vocabulary(docs, learn, text_col, settings.flush), "words")
    seen = F.col("n") > 0
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(seen), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    total, distinct = int(totals[0]), int(totals[1])
    d = discount(int(totals[2]), int(totals[3]))
    grams = words.where(seen).select("word").mapInArrow(_grams(settings.order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    speller = spark.sparkContext.broadcast(Speller({r["gram"]: r["n"] for r in grams.collect()}, settings))
    tables, passes = float(distinct), []
    for _ in range(2):  # the total of tables settles on the pass before
        sampled = words.mapInArrow(_sampled(speller, d, settings.strength, total, tables, settings), "h long, n long, tables double, spelled double, log_p double")
        sampled = materialize(sampled, "word-scores")
        passes.append(sampled)
        sums = sampled.agg(F.coalesce(F.sum("tables"), F.lit(0.0)), F.coalesce(F.sum("spelled"), F.lit(0.0))).first()
        used, tables = tables, float(sums[0])
    # Unknown words are one class: all that the base spells beside the known ones.
    unknown = math.log10((settings.strength + d * used) / (settings.strength + total) * max(1e-6, 1.0 - float(sums[1])))
    discard(*passes[:-1])
    sampled = sampled.select("h", "n", F.when(seen, F.col("log_p")).otherwise(F.lit(unknown)).alias("log_p"))
    top = words.where(seen).orderBy(F.col("n").desc(), "word").limit(settings.contexts).collect()
    frequent = spark.sparkContext.broadcast([(bytes(r["word"]), r["n"]) for r in top])
    slots = settings.slots
    numbers = {word_hash(w) - (1 << 64): k for k, (w, _) in enumerate(frequent.value, slots + 1)}
    least = _frequent(sampled, settings.common)
    often, listed = F.col("n") >= least, F.col("h").isin(list(numbers))
    common = sampled.where(often | listed).orderBy(F.col("n").desc(), "h").toArrow()
    slot = F.col("h").bitwiseAND(slots - 1).cast("int")
    others = sampled.where(seen & ~listed).groupBy(slot.alias("slot")).agg(F.sum(F.pow(F.lit(10.0), "log_p")).alias("p"), F.count_if(~often).alias("n"), F.sum(F.when(~often, F.pow(F.lit(10.0), "log_p"))).alias("rare")).collect()
    base = np.zeros(slots + 1 + len(numbers))
    base[slots] = 10.0**unknown
    mean = np.full(slots, -9.0)
    for row in others:
        base[row["slot"]] = row["p"]
        if row["n"]:
            mean[row["slot"]] = math.log10(row["rare"] / row["n"] / row["p"])
    hashes = common.column("h").to_numpy()
    column = np.array([numbers.get(h, h & slots - 1) for h in hashes.tolist()], np.int64)
    log_p = common.column("log_p").to_numpy()
    dense = column > slots
    base[column[dense]] = np.power(10.0, log_p[dense])
    with np.errstate(divide="ignore"):
        inside = np.log10(base)
    share = np.where(dense, 0.0, log_p - inside[column])
    order = np.argsort(hashes.view(np.uint64))
    padded = lambda x: np.concatenate([np.zeros(1, x.dtype), x])
    known = Known(hashes.view(np.uint64)[order], order + 1, padded(common.column("n").to_numpy()), padded(column), padded(share), mean)
    known = spark.sparkContext.broadcast(known)
    trained = docs.where(F.coalesce(learn, F.lit(False))).select(text_bytes(text_col).alias("text"))
    pairs = trained.mapInArrow(_pairs(frequent, slots, 10 * settings.flush), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = context_matrix(pairs.column("pair").to_numpy(), pairs.column("n").to_numpy(), base / base.sum(), settings)
    # A slot without words has no probability, and is not asked for.
    matrix = spark.sparkContext.broadcast(np.log10(np.maximum(matrix, 1e-30)).astype(np.float32))
    floor = math.log10(total + 0.1 * (distinct + 1))
    buckets = 1 + total // settings.bucket

    rows = docs.select(F.col(id_col).alias("__id"), (~learn if held_out is None else held_out).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("__learn"), text_bytes(text_col).alias("__text"))
    schema = rows.drop("__learn", "__text").schema.add("rid", "long").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("bucket", "long").add("block", "binary")
    parts = rows.mapInArrow(_scored(known, matrix, floor, buckets, settings, schema.names), schema)
    kept = StructType([*schema.fields[:-2], *_FOUND.fields])
    found = materialize(parts.groupBy("bucket").applyInArrow(_seated(known, matrix, settings), kept), "pair-scores")
    whole = found.where("n_tokens is not null").drop(*_FOUND.names)
    gains = found.where("sums is not null").select("rid", "texts", "sums").groupBy("rid").applyInArrow(_chunk_sums, "rid long, gain double")
    inside = F.element_at(F.array(*[F.lit(float(x)) for x in inside[:slots]]), slot + 1)
    own = sampled.select("h", "n", (F.col("log_p") - inside).alias("share"))
    rare = found.where("h is not null").select("rid", "h", "seen", "back", "lost").join(own, "h")
    rare = rare.groupBy("rid").agg(
        F.count_if(seen).alias("k"),
        F.sum(F.log10(F.col("n") + 0.1) - floor).alias("b"),
        F.sum(F.when(seen, F.col("share") + F.log10(F.col("seen") / F.pow(F.lit(10.0), "share") + F.col("back"))).otherwise(F.col("lost"))).alias("s"),
    )
    return whole.join(gains, "rid", "left").join(rare, "rid", "left").select(
        F.col("__id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
