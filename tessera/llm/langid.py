"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is lower-cased, its ASCII non-letters become spaces, and every byte
2-gram, 3-gram and 4-gram is hashed to one of ``buckets`` embeddings. The mean
embedding goes through one linear layer and a softmax. Embeddings and layer are
trained by mini-batch gradient descent in numpy on the driver, from sparse
bucket counts of a bounded sample: at most about ``per_class`` documents of each
label, chosen by a hash of the id (counts per document are bounded by
``buckets``). A quarter of the sample is held back to fit a temperature and the
rejection threshold.

Since mean and layer are both linear, prediction sums one row of a
(buckets x labels) table per gram, so whole texts of any length are scored in
one pass with bounded memory, and there is no shuffle.

Defined cases: a null text or one without a letter gets ``und`` with score 0 and
is rejected; with no labelled row at all every text does; ties between labels go
to the first in sorted order; repeated rows get equal predictions; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_PAD = 3
#: ASCII bytes that are not letters become spaces; bytes over 127 stay.
_SPACED = bytes(b if b > 127 or 97 <= b <= 122 or b == 0 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 16
    per_class: int = 700
    epochs: int = 6
    batch: int = 32
    rate: float = 40.0
    seed: int = 7
    reject_share: float = 0.001


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    threshold: float = 0.0
    buckets: int = 1 << 15


def _buckets(buffer: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the 2-, 3- and 4-grams that start at each byte but the last three of the buffer."""
    n = len(buffer) - _PAD
    b = buffer.astype(np.uint32)
    shift = np.uint32(33 - buckets.bit_length())
    gram = b[:n] * np.uint32(0x101) + b[1 : n + 1] * np.uint32(0x10001)
    for k, extra in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
        if k > 2:
            gram = gram * np.uint32(31) + b[k - 1 : n + k - 1]
        yield ((gram * np.uint32(0x9E3779B1) ^ np.uint32(extra)) * np.uint32(0x85EBCA6B)) >> shift


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, ``_PAD`` zero bytes after each, and their starts.

    No gram that starts inside a text reaches the next one, so what a text gets
    depends on it alone, wherever it stands in a batch.
    """
    gap = b"\0" * _PAD
    starts = np.cumsum([0] + [len(t) + _PAD for t in texts[:-1]])
    return np.frombuffer(gap.join(texts) + gap + gap, np.uint8), starts


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_SPACED)


def _chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts with a letter, in groups of about ``limit`` bytes."""
    at: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            at.append(i)
            held.append(prepared(text))
            size += len(held[-1])
            if size >= limit:
                yield at, held
                at, held, size = [], [], 0
    if at:
        yield at, held


def _counts(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, calibrate = batch.column("label").to_pylist(), batch.column("calibrate").to_pylist()
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text and _LETTER.search(text):
                    buffer, _ = _buffer([prepared(text)])
                    total = np.zeros(settings.buckets, np.int64)
                    for ids in _buckets(buffer, settings.buckets):
                        total += np.bincount(ids[: len(ids) - _PAD], minlength=settings.buckets)
                    held = np.flatnonzero(total)
                    rows.append((labels[i], calibrate[i], held.astype(np.int32), (total[held] / total.sum()).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.bool_()),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                    pa.array([r[3].tobytes() for r in rows], pa.binary()),
                ],
                names=["label", "calibrate", "ids", "weights"],
            )

    return run


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, settings: Settings = Settings()) -> Model | None:
    """Train on rows where ``learn`` holds and the label is not null; None if there are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.col(text_col).alias("text"), (F.lit(True) if learn is None else learn).alias("__learn"))
    rows = rows.where("__learn and label is not null and text is not null").drop("__learn")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 30))
    chosen = F.lit(False)
    for name, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("label") == name) & (draw < int(min(1.0, settings.per_class / n) * (1 << 30))))
    sample = rows.where(chosen).select("label", "text", (F.pmod(F.xxhash64("id", F.lit(settings.seed + 1)), F.lit(4)) == 0).alias("calibrate"))
    got = sample.mapInArrow(_counts(settings), "label string, calibrate boolean, ids binary, weights binary").collect()
    got = sorted(got, key=lambda r: (r["label"], bytes(r["ids"]), bytes(r["weights"])))
    if not got:
        return None
    return _train(got, settings)


def _train(rows: list, settings: Settings) -> Model:
    labels = sorted({r["label"] for r in rows})
    place = {x: i for i, x in enumerate(labels)}
    data = [(place[r["label"]], r["calibrate"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in rows]
    train = [d for d in data if not d[1]] or data
    held = [d for d in data if d[1]] or data
    rng = np.random.default_rng(settings.seed)
    embed = rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (settings.dim, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)

    def dense(part: list) -> np.ndarray:
        x = np.zeros((len(part), settings.buckets), np.float32)
        for i, d in enumerate(part):
            x[i, d[2]] = d[3]
        return x

    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        order = rng.permutation(len(train))
        for k in range(0, len(order), settings.batch):
            part = [train[i] for i in order[k : k + settings.batch]]
            x, y = dense(part), np.array([d[0] for d in part])
            mean = x @ embed
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            down = error @ layer.T
            layer -= 0.1 * rate * (mean.T @ error)
            bias -= 0.1 * rate * error.sum(axis=0)
            embed -= rate * (x.T @ down)
    table = embed @ layer
    logits = np.vstack([(table[d[2]] * d[3][:, None]).sum(axis=0) + bias for d in held]).astype(np.float64)
    truth = np.array([d[0] for d in held])
    best = min(
        ((-np.log(_softmax(logits * s)[np.arange(len(truth)), truth] + 1e-12).mean(), s) for s in np.geomspace(0.25, 8, 41)),
        key=lambda x: x[0],
    )[1]
    sure = _softmax(logits * best)
    right = sure.max(axis=1)[sure.argmax(axis=1) == truth]
    threshold = min(0.5, float(np.quantile(right, settings.reject_share))) if len(right) else 0.0
    return Model(labels, (table * best).astype(np.float32), (bias * best).astype(np.float32), threshold, settings.buckets)


def score_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    for at, held in _chunks(texts):
        buffer, starts = _buffer(held)
        sizes = np.array([len(t) for t in held])
        cuts = np.column_stack([starts, starts + sizes]).ravel()
        total = np.zeros((len(held), len(model.labels)))
        for ids in _buckets(buffer, model.buckets):
            for c in range(len(model.labels)):
                total[:, c] += np.add.reduceat(model.table[:, c].astype(np.float64)[ids], cuts)[::2]
        sure = _softmax(total / (3 * sizes)[:, None] + model.bias)
        for i, p in zip(at, sure, strict=True):
            out[i] = (model.labels[int(p.argmax())], float(min(1.0, p.max())))
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``carried`` columns, lang_pred, score, accepted."""
    carried = {id_col: F.col(id_col)} | (carried or {})
    names = [*carried, "lang_pred", "score", "accepted"]
    rows = docs.select(*[c.alias(k) for k, c in carried.items()], F.col(text_col).alias("__text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = score_texts(held, texts) if held is not None else [(UNDETERMINED, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([x[0] for x in got], pa.string()),
                    pa.array([x[1] for x in got], pa.float64()),
                    pa.array([held is not None and x[0] != UNDETERMINED and x[1] >= held.threshold for x in got], pa.bool_()),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)
