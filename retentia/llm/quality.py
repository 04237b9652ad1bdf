"""Document quality by gated attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by what its
characters and words look like; an embedding layer and a gated attention layer are learned
from the document labels alone; the score comes from the attention-weighted mean of the passages'
embeddings. The fit minimises the loss over all passages of all labelled documents, as scoring covers every word of every document.
Only its first weights come from fewer: ``bound`` labelled documents, those of lowest id hash, and of each at most
``PASSAGES`` passages, evenly spaced over the whole text. Where that is not all, the features' scaling is counted over all passages and
quasi-Newton steps (L-BFGS) go on, each from gradients summed on the executors over all passages, until the loss hardly falls.

Null texts count as empty; a text without words is one passage without content, and gets the score the
model gives that. Without labels of both classes every document scores the share of label 1 (0.5
without any). An id that is labelled more than once counts with its mean label, one that several rows have with its least text. Null ids and null
labels are never learned from. An empty table gives an empty result. Only id and text are read,
so that no other column can be an input.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import slices, text_of
from retentia.sources.tables import materialize, scratch_scope

PASSAGE = 96
BIGRAMS = 48
CLASSES = 13
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 1 << 30])
FEATURES = CLASSES + len(LENGTHS) + 8 + BIGRAMS
#: Labelled documents that the first weights come from at most, and passages of each of them.
BOUND, PASSAGES = 3_000, 256
#: Passes over all passages at most, and the share by which the loss must fall in one of three steps.
PASSES, FALL = 30, 1e-2


def _classes() -> np.ndarray:
    """The class of every character of the basic plane; others count as other letters."""
    out = np.full(1 << 16, 10, np.uint8)
    for i in range(1 << 16):
        kind = unicodedata.category(chr(i))
        if kind == "Ll":
            out[i] = 2
        elif kind in ("Lu", "Lt"):
            out[i] = 3
        elif kind[0] == "N":
            out[i] = 4
        elif kind[0] in "PS":
            out[i] = 9
        elif kind[0] == "C":
            out[i] = 11
    for marks, k in ((".", 5), (",;:", 6), ("!?", 7), ("|", 8), ("#$%&*@^~_=+<>\\{}[]", 12), (" \t\x0b\x0c\r\x85\xa0", 0), ("\n", 1)):
        for c in marks:
            out[ord(c)] = k
    return out


def encode(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the index of the text that each belongs to."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[np.minimum(code, 0xFFFF)]
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(size)
    white = kind <= 1
    start = np.flatnonzero(~white & np.r_[True, white[:-1]])
    stop = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    doc = np.searchsorted(ends, start, side="right")
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    number = (np.arange(len(start)) - first[doc]) // PASSAGE
    count = np.maximum(1, -(-words // PASSAGE))
    offset = np.cumsum(count) - count
    passage = offset[doc] + number
    n = int(count.sum())
    owner = np.repeat(np.arange(len(texts)), count)
    out = np.zeros((n, FEATURES), np.float32)
    if len(start):
        # White space belongs to the word before it in the same text; a text's leading white space to nothing.
        spans = np.diff(np.r_[start, len(code)])
        at, text = np.repeat(passage, spans), np.repeat(np.arange(len(texts)), size)[start[0] :]
        inside = text == np.repeat(doc, spans)
        own = kind[start[0] :].astype(np.int64)
        chars = np.bincount(at[inside] * CLASSES + own[inside], minlength=n * CLASSES).reshape(n, CLASSES)
        total = np.maximum(chars.sum(axis=1, keepdims=True), 1)
        out[:, :CLASSES] = chars / total
        held = np.maximum(np.bincount(passage, minlength=n), 1)[:, None]
        length = stop - start
        bin_of = np.searchsorted(LENGTHS, length)
        at_word = CLASSES + len(LENGTHS)
        sizes = np.bincount(passage * len(LENGTHS) + bin_of, minlength=n * len(LENGTHS)).reshape(n, -1)
        out[:, CLASSES:at_word] = sizes / held
        position = np.arange(len(code)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(code)]))
        mixed = np.where(white, 0, (code.astype(np.uint64) + 1) * (position.astype(np.uint64) * 2 + 1) * np.uint64(0x9E3779B97F4A7C15))
        word = np.add.reduceat(mixed, start)
        last, head = kind[stop - 1], kind[start]
        upper = np.add.reduceat((kind == 3).astype(np.int32), start) == length
        marked = np.add.reduceat((kind >= 8).astype(np.int32), start) > 0
        same = np.r_[False, (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])]
        key = np.sort((passage.astype(np.uint64) << np.uint64(32)) | (word >> np.uint64(32)))
        fresh = np.r_[True, key[1:] != key[:-1]]
        distinct = np.bincount((key[fresh] >> np.uint64(32)).astype(np.int64), minlength=n)
        for k, flag in enumerate((upper & (length > 1), marked, same, (last >= 7) & (last != 10), last == 5, head == 3, head == 4)):
            out[:, at_word + k] = np.bincount(passage[flag], minlength=n) / held[:, 0]
        out[:, at_word + 7] = distinct / held[:, 0]
        low = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint32)[start[0] :]
        two = (low[:-1] * np.uint32(2654435761) + low[1:] * np.uint32(40503)) >> np.uint32(7)
        pair = inside[:-1] & (text[1:] == text[:-1])
        grams = np.bincount(at[:-1][pair] * BIGRAMS + (two[pair] % BIGRAMS).astype(np.int64), minlength=n * BIGRAMS)
        out[:, at_word + 8 :] = grams.reshape(n, BIGRAMS) / total
    return out, owner


@dataclass
class Model:
    """Feature scaling, embedding, gated attention and output weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def bags(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The score of each text from its passages (every text has one at least)."""
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return 1 / (1 + np.exp(-_forward(self.weights, self.scaled(x), starts, owner)["logit"]))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def _forward(w: dict, x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> dict:
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["w"]
    bag = np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    alpha = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(alpha[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "bag": bag, "alpha": alpha, "z": z, "logit": z @ w["c"] + w["c0"]}


def _gradient(w: dict, x: np.ndarray, starts: np.ndarray, owner: np.ndarray, y: np.ndarray, n: int) -> tuple[float, dict]:
    """What these bags add to the mean cross entropy of ``n`` bags and to its gradient."""
    f = _forward(w, x, starts, owner)
    h, t, s, bag, alpha = f["h"], f["t"], f["s"], f["bag"], f["alpha"]
    d_logit = (1 / (1 + np.exp(-f["logit"])) - y) / n
    d_bag = (d_logit[:, None] * w["c"])[bag]
    d_alpha = (h * d_bag).sum(axis=1)
    d_e = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, starts)[bag])
    d_t, d_s = np.outer(d_e, w["w"]) * s * (1 - t**2), np.outer(d_e, w["w"]) * t * s * (1 - s)
    d_h = (alpha[:, None] * d_bag + d_t @ w["V"].T + d_s @ w["U"].T) * (1 - h**2)
    loss = float((np.logaddexp(0, f["logit"]) - y * f["logit"]).sum() / n)
    return loss, {
        "W": x.T @ d_h, "b": d_h.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s,
        "w": (t * s).T @ d_e, "c": f["z"].T @ d_logit, "c0": d_logit.sum(),
    }


def _start(d: int, hidden: int = 24, gate: int = 12) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    return {
        "W": rng.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden),
        "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "c0": np.zeros(()),
    }


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, steps: int = 250, hidden: int = 24, gate: int = 12) -> Model:
    """Full-batch Adam on the cross entropy of the bags, from a fixed start."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = Model(mean, scale, {})
    if len(y) == 0 or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    w = _start(x.shape[1], hidden, gate)
    x = model.scaled(x).astype(np.float64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, steps + 1):
        _, grad = _gradient(w, x, starts, owner, y, len(y))
        for k, g in grad.items():
            g = g + (0 if w[k].ndim < 2 else 1e-4 * w[k])
            a, b = moment[k]
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            moment[k] = a, b
            w[k] = w[k] - 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model.weights = {k: np.asarray(v, np.float64) for k, v in w.items()}
    return model


def _spread(a: int, b: int, most: int) -> np.ndarray:
    """The numbers from ``a`` up to ``b``, or ``most`` of them at even distances."""
    return np.arange(a, b) if b - a <= most else a + np.arange(most) * (b - a) // most


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(3)) == 1


def _bags(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages, and the document of each."""
    held = np.array([len(p) // (4 * FEATURES) for p in packed], np.int64)
    return np.frombuffer(b"".join(packed), np.float32).reshape(-1, FEATURES), np.repeat(np.arange(len(packed)), held)


def _total(rows: DataFrame, function, size: int) -> np.ndarray:
    """The sum over all batches of a vector of fixed size, added up on the executors in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in slices(batches, "x", 1 << 20):
            total += function(*_bags(batch.column("x").to_pylist()), batch.column("y").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = rows.mapInArrow(run, "task int, v binary").repartition(1).sortWithinPartitions("task")
    return np.frombuffer(parts.mapInArrow(add, "v binary").first()["v"])


def _descend(value, x: np.ndarray, passes: int, fall: float, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps from ``x``, for ``passes`` values at most and until three steps in a row lower them by less than the share ``fall``."""
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    passes, slow = passes - 1, 0
    while passes > 0 and slow < 3:
        d, scale = -g, []
        for s, y in reversed(pairs):
            scale.append((s @ d) / (s @ y))
            d = d - scale[-1] * y
        d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1])) if pairs else d / max(1.0, 10 * np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(scale), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step, slope = 1.0, g @ d
        while passes > 0:
            f_next, g_next = value(x + step * d)
            passes -= 1
            if f_next <= f + 1e-4 * step * slope:
                break
            step /= 4
        else:
            return x
        s, y, before = step * d, g_next - g, f
        x, f, g = x + s, f_next, g_next
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        slow = slow + 1 if before - f <= fall * abs(before) else 0
    return x


def _refine(model: Model, rows: DataFrame, bags: int, passages: int) -> Model:
    """The model that minimises the loss over all ``rows``, from the weights of ``model``."""

    def moments(x, owner, y) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x.sum(axis=0), (x**2).sum(axis=0)])

    mean, square = np.split(_total(rows, moments, 2 * FEATURES) / passages, 2)
    scale = np.sqrt(np.maximum(0, square - mean**2)) + 1e-3
    # A model of labels of one class has no weights yet.
    first = dict(model.weights or _start(FEATURES))
    # The first weights saw features scaled by another mean and deviation.
    first["b"] = first["b"] + (mean - model.mean) / model.scale @ first["W"]
    first["W"] = first["W"] * (scale / model.scale)[:, None]
    out = Model(mean, scale, {})
    shapes = {k: v.shape for k, v in first.items()}
    ends = np.cumsum([int(np.prod(v)) for v in shapes.values()])

    def parts(flat: np.ndarray, kind: type) -> dict[str, np.ndarray]:
        return {k: p.reshape(v).astype(kind) for (k, v), p in zip(shapes.items(), np.split(flat, ends[:-1]), strict=True)}

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = parts(flat, np.float32)

        def run(x, owner, y) -> np.ndarray:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            loss, grad = _gradient(w, out.scaled(x).astype(np.float32), starts, owner, y.astype(np.float32), bags)
            return np.concatenate([[loss], *(np.ravel(grad[k]) for k in shapes)])

        total = _total(rows, run, int(ends[-1]) + 1)
        decay = np.concatenate([1e-4 * np.ravel(v) if v.ndim > 1 else np.zeros(v.size) for v in parts(flat, np.float64).values()])
        return total[0] + decay @ flat / 2, total[1:] + decay

    out.weights = parts(_descend(value, np.concatenate([np.ravel(v) for v in first.values()]), PASSES, FALL), np.float64)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", bound: int = BOUND, passages: int = PASSAGES,
) -> Model:
    """Learns from all labelled documents that are not held out; the first weights from ``bound`` of them at most, ``passages`` from each."""
    known = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    classes = _classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x, owner = encode(batch.column("text").to_pylist(), classes)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            packed = [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "x"]
            )

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 1 << 24):
            bags = (np.frombuffer(p, np.float32).reshape(-1, FEATURES) for p in batch.column("x").to_pylist())
            packed = [x[_spread(0, len(x), passages)].tobytes() for x in bags]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "x"])

    kind = "doc_id bigint, y double, x binary"
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    times = texts.groupBy("doc_id").agg(F.count("*").alias("times"))
    with scratch_scope(docs.sparkSession):
        # Spark knows the size of a written table, so that texts move only for more labels than can be broadcast.
        known = materialize(known.join(times, "doc_id"), "labels")
        rows = texts.join(known.filter("times = 1"), "doc_id").select("doc_id", "y", "text")
        if not (repeated := known.filter("times > 1")).isEmpty():
            # An id that many rows repeat is learned from once.
            rows = rows.unionByName(texts.join(repeated, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))
        rows = materialize(rows.mapInArrow(run, kind), "bags")
        size = F.octet_length("x") / (4 * FEATURES)
        bags, held, most, low, high = rows.agg(F.count("x"), F.sum(size), F.max(size), F.min("y"), F.max("y")).first()
        if not bags:
            return train(np.zeros((1, FEATURES), np.float32), np.zeros(1, np.int64), np.zeros(0))
        first = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = rows if bags <= bound else rows.join(F.broadcast(first), "doc_id", "left_semi")
        got = chosen.mapInArrow(few, kind).toArrow().to_pylist()
        got.sort(key=lambda r: (r["doc_id"], r["x"]))
        x, owner = _bags([r["x"] for r in got])
        model = train(x, owner, np.array([r["y"] for r in got]))
        done = bags <= bound and most <= passages or low == high
        return model if done or model is None else _refine(model, rows, bags, held)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    classes = _classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x, owner = encode(batch.column("text").to_pylist(), classes)
            p = model.bags(x, owner)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
    bound: int = BOUND,
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns and without a shuffle."""
    model, classes = fit(docs, labels, id_col, text_col, bound=bound), _classes()
    whole = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            x, owner = encode([t or "" for t in batch.column(text_col).to_pylist()], classes)
            yield batch.filter(pa.array(model.bags(x, owner) >= threshold))

    return docs.mapInArrow(run, whole)
