"""Phrase collocations by suffix-sigma (Berberich and Bedathur, 2013).

Every position of a piece starts a suffix of at most ``max_words`` words. The
suffixes are shuffled by language and first word, sorted in reverse
lexicographic order, and one stack counts all their prefixes in one pass: a
prefix is complete when the order leaves it. The shuffle is a range partitioning
on (language, first word, the words after it), so a language or first word that
holds a third of all rows is split over as many tasks as it needs; only the
prefixes open at the two ends of a task's range are in parts, which a grouped
sum joins afterwards. To place the ranges Spark reads the texts once more.

Before the shuffle, suffixes end where two neighbouring words can't be frequent:
a first pass counts single words exactly and pairs in ``2**filter_bits`` hashed
buckets, and a pair whose bucket stays below ``filter_least`` (at most ``least``)
is in no phrase of ``least`` occurrences. The filter has a fixed size, has no
false negatives, and only saves rows. It asks for less than ``least`` so that
what it saves changes little with the size of the table. Equal suffixes of a chunk are sent once with their count.

Scores are of whole numbers of 38 digits, so products may pass 64 bits.

Defined cases: a null text is empty, a null language is ``und``; repeated rows
count each; ties are broken by the phrase, in UTF-8 order; texts of any length
are read whole, a chunk at a time or alone where they are longer; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: The characters that end a piece, and those between words.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: A byte that is in no UTF-8 text stands for the end of a piece.
_END = 255
_CHUNK = 8 << 20
_BLOCK = 1 << 16


def lowered(ends: bytes, blanks: bytes) -> np.ndarray:
    """A table of bytes: A-Z lower-cased, piece ends and blanks as one byte each."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(ends)], table[list(blanks)] = _END, 32
    return table


def chunks(batches: Iterator[pa.RecordBatch], size: int = _CHUNK) -> Iterator[tuple[str, bytes]]:
    """Texts by language (columns 0 and 1), joined to about ``size`` bytes; no more than that and one text is held."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if body:
                held[lang].append(body)
                sizes[lang] += len(body)
            if sum(sizes.values()) >= size:
                most = max(sizes, key=sizes.__getitem__)
                del sizes[most]
                yield most, b"\xff".join(held.pop(most))
    for lang, bodies in held.items():
        yield lang, b"\xff".join(bodies)


def tokens(body: bytes, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes in order, the words that they stand for, and the piece of each."""
    raw = table[np.frombuffer(body, np.uint8)]
    gap = (raw == 32) | (raw == _END)
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    kind = pa.large_binary()
    words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[~gap])])
    held = words.dictionary_encode()
    piece = np.cumsum(raw == _END, dtype=np.int64)[starts]
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary, piece


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _buckets(h: np.ndarray, codes: np.ndarray, lang: str, bits: int) -> np.ndarray:
    """The filter's bucket of each pair of neighbours in a chunk."""
    import xxhash

    with np.errstate(over="ignore"):
        x = h[codes[:-1]] * np.uint64(0x9E3779B97F4A7C15) + h[codes[1:]] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x165667B19E3779F9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _first_pass(bits: int, top: int):  # noqa: ANN202
    """Word counts of each chunk, and the task's pair counts in blocks of the filter, up to ``top``."""
    table = lowered(PIECE_ENDS, BLANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint32)
        for lang, body in chunks(batches):
            codes, words, piece = tokens(body, table)
            if not len(codes):
                continue
            pairs = _buckets(_hashes(words), codes, lang, bits)[piece[1:] == piece[:-1]]
            at, n = np.unique(pairs, return_counts=True)
            seen[at] = np.minimum(seen[at] + n, top)
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), words.cast(pa.string()), pa.array(n), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.binary())], names=["lang", "word", "n", "block", "seen"])
        seen = seen.astype(np.uint32 if top > 65535 else np.uint8 if top < 256 else np.uint16)
        for i in range(0, 1 << bits, _BLOCK):
            part = seen[i : i + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([i // _BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["lang", "word", "n", "block", "seen"])

    return run


def _summed(top: int, least: int | None = None):  # noqa: ANN202
    """Blocks of one number summed up to ``top``; with ``least``, the bits of what reached it."""
    kind = np.uint32 if top > 65535 else np.uint8 if top < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, seen in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(seen.as_buffer(), kind).astype(np.int64)
                held[block] = np.minimum(held.get(block, 0) + part, top)
        for block, seen in held.items():
            body = np.packbits(seen >= least).tobytes() if least is not None else seen.astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([body], pa.binary())], names=["block", "seen"])

    return run


def pair_filter(counted: DataFrame, least: int, bits: int) -> bytes:
    """The bits of all buckets of ``least`` pairs or more: ``2**bits`` of them at most, whatever the input."""
    top = max(least, 255)
    blocks = counted.where("block is not null").select("block", "seen").mapInArrow(_summed(top), "block int, seen binary")
    rows = blocks.repartition("block").mapInArrow(_summed(top, least), "block int, seen binary").collect()
    size = min(_BLOCK, 1 << bits)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        at = r["block"] * size // 8
        out[at : at + size // 8] = np.frombuffer(bytes(r["seen"]), np.uint8)
    return out.tobytes()


def _suffixes(kept, bits: int, max_words: int):  # noqa: ANN001, ANN202
    """Suffixes of two words or more that the filter lets pass, each once a chunk with its count."""
    table = lowered(PIECE_ENDS, BLANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.unpackbits(np.frombuffer(kept.value, np.uint8)).astype(bool)
        for lang, body in chunks(batches):
            codes, words, piece = tokens(body, table)
            if len(codes) < 2:
                continue
            goes_on = (piece[1:] == piece[:-1]) & allowed[_buckets(_hashes(words), codes, lang, bits)]
            length = np.ones(len(codes), np.int64)
            for _ in range(max_words - 1):
                longer = np.ones_like(length)
                longer[:-1] += np.where(goes_on, length[1:], 0)
                length = longer
            at = np.flatnonzero(length >= 2)
            if not len(at):
                continue
            end = len(codes) - 1
            columns = [np.where(length[at] > k, codes[np.minimum(at + k, end)], -1) for k in range(max_words)]
            key = columns[0]
            for c in columns[1:]:
                _, where, key, n = np.unique(key * (len(words) + 1) + c + 1, return_index=True, return_inverse=True, return_counts=True)
            parts = [words.take(pa.array(c[where], mask=c[where] < 0)) for c in columns]
            empty = pa.array([b""] * len(where), pa.large_binary())
            joined = pc.binary_join_element_wise(*parts, empty, pa.scalar(b" ", pa.large_binary()), null_handling="skip").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where)), joined, pa.array(n)], names=["lang", "suffix", "n"])

    return run


def count_prefixes(rows: Iterator[tuple[str, bytes, int]], least: int) -> Iterator[tuple[str, str, int]]:
    """Prefixes of two words or more with their counts, from suffixes in reverse order.

    One stack holds the prefixes of the suffix at hand. Those that the first or
    the last suffix has may go on in a neighbouring range, and are given whatever
    their count; others only from ``least`` on.
    """
    path: list = []
    counts: list[int] = []
    edge: int | None = None

    def close(depth: int, last: bool = False) -> Iterator[tuple[str, str, int]]:
        while len(path) > depth:
            n = counts.pop()
            if len(path) > 2 and (n >= least or last or len(path) <= edge):
                yield path[0], b" ".join(path[1:]).decode(), n
            path.pop()
            if counts:
                counts[-1] += n

    for lang, suffix, n in rows:
        new = [lang, *suffix[:-1].split(b" ")]
        same = 0
        for a, b in zip(path, new, strict=False):
            if a != b:
                break
            same += 1
        if edge is not None:
            yield from close(same)
            edge = min(edge, same)
        else:
            edge = len(new)
        path.extend(new[same:])
        counts.extend([0] * (len(new) - same))
        counts[-1] += n
    yield from close(0, True)


def _counted(least: int):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["lang", "phrase", "n"])
        for row in count_prefixes(rows(batches), least):
            out.append(row)
            if len(out) >= 20000:
                yield pack()
                out.clear()
        if out:
            yield pack()

    return run


def frequent(docs: DataFrame, least: int = 100, max_words: int = 5, filter_bits: int = 24, filter_least: int = 25, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``max_words`` words with ``least`` occurrences or more (lang, phrase, words, f), and each language's words (lang, n)."""
    if least < 1 or max_words < 2 or not 16 <= filter_bits <= 30:
        raise ValueError("least is 1 or more, max_words 2 or more, filter_bits 16 to 30")
    floor = min(least, filter_least)
    source = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("body"))
    counted = materialize(source.mapInArrow(_first_pass(filter_bits, max(floor, 255)), "lang string, word string, n long, block int, seen binary"), "words")
    single = counted.where("block is null").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    single = materialize(single, "single")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = docs.sparkSession.sparkContext.broadcast(pair_filter(counted, floor, filter_bits))
    discard(counted)
    suffixes = source.mapInArrow(_suffixes(kept, filter_bits, max_words), "lang string, suffix binary, n long")
    # A suffix starts with its first word, so this is by language and first word, and beyond it where one is hot.
    order = [F.desc("lang"), F.desc("suffix")]
    # Equal suffixes meet in one range, so they are summed there without another shuffle:
    # a range partitioning on just these two columns, which no rule can fold, satisfies the grouping.
    parts = suffixes.repartitionByRange(*order).groupBy("lang", "suffix").agg(F.sum("n").alias("n")).sortWithinPartitions(*order).mapInArrow(_counted(least), "lang string, phrase string, n long")
    phrases = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    both = single.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f").unionByName(phrases)
    return materialize(both.withColumn("words", F.size(F.split("phrase", " "))), "phrases"), totals


def mine(docs: DataFrame, least: int = 100, max_words: int = 5, top: int = 2000, cover: int = 100, filter_bits: int = 24, filter_least: int = 25, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language by the least of their cuts' scores.

    A cut after ``k`` words scores floor(1000 a n / (l r)). A phrase goes where a
    longer one around it has ``cover`` percent of its occurrences or more; as
    counts only fall with length, one word more decides that.
    """
    counts, totals = frequent(docs, least, max_words, filter_bits, filter_least, lang_col, text_col)
    words = F.split("phrase", " ")
    longer = counts.where("words > 2").select("lang", "f", F.explode(F.array(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1))).alias("w"))
    longer = longer.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("f").alias("__longer"))
    held = counts.where("words > 1").join(longer, ["lang", "phrase"], "left")
    held = held.where(F.col("__longer").isNull() | (100 * F.col("__longer") < cover * F.col("f"))).select("lang", "phrase", F.col("f").alias("a"), "words")
    cut = held.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("__left"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("__right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cut = cut.join(of("__left", "l"), ["lang", "__left"]).join(of("__right", "r"), ["lang", "__right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("__over", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")).withColumn("__under", big("l") * big("r")).withColumn("score", F.expr("__over div __under"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # The first rows of each of 32 parts of a language, then of those: no task sorts a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    best = best.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(32))).withColumn("__r", rank("__part")).where(F.col("__r") <= top)
    best = best.withColumn("rank", rank().cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
