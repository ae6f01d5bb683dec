"""Personal data, and the terms that give it away (after Sanchez and Batet, 2016).

Four kinds of entities are found by pattern. A term near an entity is a risk if
it tells more about that entity than the entity's generalisation does: with
PMI(entity; term) >= IC(generalisation), which is P(entity | term) >=
P(entity | generalisation), a comparison of whole counts. The generalisation of
an email is its domain, of an ip its network of two parts, of a card its six
first digits, of a phone its country code.

Counts are of lines, over the whole corpus: how many have the term, the entity,
the generalisation, and the term within ``window`` terms of the entity. Two more
bounds keep chance out: ``support`` different lines have the two together (a line
that is copied is one witness), and the entity is near in ``share`` of the term's
lines. A term that passes is marked where it stands near that entity; base spans
stay, and terms inside them are not looked at. ``sanitise`` puts a base span's
generalisation in its place and takes terms out.

One pass finds entities and the terms near them, in Arrow batches; a second one
counts the lines of the terms in question, which a filter of a fixed number of
bits picks out in each task, so that only sums are shuffled. An entity or term
that very many rows hold is a sum with partial sums; joins have pairs of entity
and term as keys. Nothing is gathered per entity.

Defined cases: a null or empty text has no spans; a null or repeated id is a row
like any other, and equal rows are marked alike; texts of any length are read
whole, in linear time; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collocations import chunks, lowered, tokens
from .common import materialize

#: The kinds and their patterns. Possessive digits keep ip linear; an email is found from its @.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A term: ASCII letters and digits, and whatever is not ASCII.
_TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BITS = 22

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    past = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        past = found.end() if found else at + 1
        if found:
            yield start, past
        at = text.find("@", past)


def addresses(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.groups())):
            yield m.span()


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right counts twice."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost first and without overlap in a kind."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": list(emails(text)) if "@" in text else [],
        "ip": list(addresses(text)) if digits else [],
        "card": list(cards(text)) if digits else [],
        "phone": list(phones(text)) if digits and "+" in text else [],
    }


def general(kind: str, value: str) -> str:
    """What is left of an entity when it is generalised."""
    if kind == "email":
        return value.rpartition("@")[2].lower()
    if kind == "ip":
        return ".".join(value.split(".")[:2])
    if kind == "card":
        return re.sub("[^0-9]", "", value)[:6]
    return re.match(r"\+[0-9]+", value)[0]


def entity(kind: str, value: str) -> str:
    return value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def near_terms(text: str, spans: dict[str, list[Span]], window: int) -> list[dict]:
    """Terms of two letters or more beside each entity, on its line and outside all base spans."""
    every = sorted((a, b, k) for k, v in spans.items() for a, b in v)
    covered: list[list[int]] = []
    for a, b, _ in every:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, line, terms, starts, digest, i = [], (0, -1), [], [], 0, 0
    for a, b, kind in every:
        if not line[0] <= a <= line[1]:
            start = text.rfind("\n", 0, a) + 1
            end = text.find("\n", a)
            line = (start, len(text) if end < 0 else end)
            digest = int.from_bytes(hashlib.blake2b(text[line[0] : line[1]].encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            terms = []
            for m in _TERM.finditer(text, *line):
                while i < len(covered) and covered[i][1] <= m.start():
                    i += 1
                inside = i < len(covered) and covered[i][0] < m.end()
                if not inside and sum(map(str.isalpha, m[0][:64])) >= 2:
                    terms.append((m.start(), m.end(), m[0].translate(_LOWER)))
            starts = [t[0] for t in terms]
        lo = bisect.bisect_left(starts, a)
        value = text[a:b]
        beside = terms[max(0, lo - window) : lo + window]
        out.append({"kind": kind, "entity": f"{kind}:{entity(kind, value)}", "general": f"{kind}:{general(kind, value)}", "line": digest, "terms": [{"term": t, "start": x, "end": y} for x, y, t in beside]})
    return out


_NEAR = "array<struct<kind:string,entity:string,general:string,line:bigint,terms:array<struct<term:string,start:bigint,end:bigint>>>>"
_NEAR_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("entity", pa.string()), ("general", pa.string()), ("line", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
)


def _find(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            listed, near = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                for k in KINDS:
                    counts[k].append(len(spans[k]))
                listed.append(_listed([(k, a, b) for k in KINDS for a, b in spans[k]]))
                near.append(near_terms(text, spans, window) if listed[-1] else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(listed, pa.string()), pa.array(near, _NEAR_TYPE)], names=["id", *(f"n_{k}" for k in KINDS), "base", "near"])

    return run


def _places(terms: list[bytes], bits: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) >> (64 - bits) for t in terms), np.int64, len(terms))


def _blanked() -> np.ndarray:
    """Bytes of terms lower-cased, of line ends as piece ends, of all others as blanks."""
    other = bytes(b for b in range(128) if not chr(b).isalnum() and b != 10)
    return lowered(b"\n", other)


def _line_counts(kept):  # noqa: ANN001, ANN202
    """For each term whose bit is set, the lines of a chunk that have it."""
    table = _blanked()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.unpackbits(np.frombuffer(kept.value, np.uint8)).astype(bool)
        for _, body in chunks(batches):
            codes, words, line = tokens(body, table)
            if not len(codes):
                continue
            asked = np.flatnonzero(allowed[_places(words.to_pylist(), _BITS)])
            if not len(asked):
                continue
            rank = np.full(len(words), -1)
            rank[asked] = np.arange(len(asked))
            at = np.flatnonzero(rank[codes] >= 0)
            once = np.unique(line[at] * len(asked) + rank[codes[at]])
            yield pa.RecordBatch.from_arrays([words.take(pa.array(asked)).cast(pa.string()), pa.array(np.bincount(once % len(asked), minlength=len(asked)))], names=["term", "n"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the terms' places, in blocks of 2**16."""
    seen = np.zeros(1 << _BITS, bool)
    for batch in batches:
        seen[_places([t.encode() for t in batch.column(0).to_pylist()], _BITS)] = True
    for i in range(0, 1 << _BITS, 1 << 16):
        if seen[i : i + (1 << 16)].any():
            yield pa.RecordBatch.from_arrays([pa.array([i >> 16], pa.int32()), pa.array([np.packbits(seen[i : i + (1 << 16)]).tobytes()], pa.binary())], names=["block", "seen"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[block] = held.get(block, 0) | np.frombuffer(seen, np.uint8)
    for block, seen in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen.tobytes()], pa.binary())], names=["block", "seen"])


def _filter(terms: DataFrame) -> bytes:
    """2**22 bits, half a megabyte, in which every term's bit is set."""
    rows = terms.mapInArrow(_marks, "block int, seen binary").repartition("block").mapInArrow(_either, "block int, seen binary").collect()
    out = np.zeros((1 << _BITS) // 8, np.uint8)
    for r in rows:
        out[r["block"] * 8192 : (r["block"] + 1) * 8192] = np.frombuffer(bytes(r["seen"]), np.uint8)
    return out.tobytes()


def disclosing(found: DataFrame, docs: DataFrame, support: int, share: float, text_col: str) -> DataFrame:
    """Pairs ``entity, term`` in which the term tells as much as the generalisation does, or more."""
    each = found.select(F.explode("near").alias("e")).select("e.*")
    pair = each.select("entity", "general", "line", F.explode(F.array_distinct("terms.term")).alias("term"))
    lines = pair.groupBy("entity", "general", "term", "line").agg(F.count("*").alias("n"))
    pairs = lines.groupBy("entity", "general", "term").agg(F.sum("n").alias("both"), F.count("*").alias("witnesses")).where(F.col("witnesses") >= support)
    pairs = materialize(pairs, "pairs")
    kept = docs.sparkSession.sparkContext.broadcast(_filter(pairs.select("term")))
    body = docs.select(F.lit("").alias("lang"), F.col(text_col).cast("binary").alias("body"))
    having = body.mapInArrow(_line_counts(kept), "term string, n long").groupBy("term").agg(F.sum("n").alias("with_term"))
    of_entity = each.groupBy("entity").agg(F.count("*").alias("with_entity"))
    of_general = each.groupBy("general").agg(F.count("*").alias("with_general"))
    counted = pairs.join(having, "term").join(of_entity, "entity").join(of_general, "general")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    told = big("both") * big("with_general") >= big("with_entity") * big("with_term")
    return counted.where(told & (F.col("both") >= share * F.col("with_term"))).select("entity", "term")


def detect(docs: DataFrame, window: int = 8, support: int = 3, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row the counts of the base kinds, the base spans and all spans, as text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = F.struct(F.col(id_col).alias("id"), *(c.alias(n) for n, c in (keep or {}).items()))
    source = docs.select(carried.alias("carried"), text.alias("text"))
    kind = source.schema["carried"].dataType.simpleString()
    found = source.mapInArrow(_find(window), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, near {_NEAR}")
    found = materialize(found.withColumn("__row", F.monotonically_increasing_id()), "found")
    risky = disclosing(found, docs, support, share, text_col)
    each = found.where("base <> ''").select("__row", F.explode("near").alias("e")).select("__row", "e.entity", F.explode("e.terms").alias("t"))
    hits = each.select("__row", "entity", F.col("t.term").alias("term"), F.col("t.start").alias("a"), F.col("t.end").alias("b")).join(risky, ["entity", "term"], "left_semi")
    # A row's terms are those beside its own entities: no more than the row itself holds.
    hits = hits.groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("t"))
    terms = F.array_join(F.transform("t", lambda s: F.concat(F.lit("term:"), s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",")
    got = found.drop("near").join(hits.select("__row", terms.alias("__terms")), "__row", "left")
    return got.select(F.col("id.id").alias(id_col), *(f"id.{n}" for n in keep or {}), *(f"n_{k}" for k in KINDS), F.col("base").alias("base_spans"), F.concat_ws(",", F.nullif("base", F.lit("")), "__terms").alias("spans"))


def digest(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    got = detect(docs, **options)
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def cleaned(text: str, spans: str) -> str:
    """The text with base spans generalised and terms taken out; where spans overlap, the first one counts."""
    out, past = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= past:
            out += [text[past:a], f"[{kind}]" if kind == "term" else f"[{kind} {general(kind, text[a:b])}]"]
            past = b
    return "".join([*out, text[past:]])


def sanitise(docs: DataFrame, window: int = 8, support: int = 3, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, spans, and the text without what is personal or gives it away."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if not s or t is None else cleaned(t, s) for t, s in zip(texts, spans, strict=True)])

    got = detect(docs, window, support, share, id_col, text_col, {"__text": F.col(text_col)})
    return got.select(id_col, "spans", clean("__text", "spans").alias("text"))
