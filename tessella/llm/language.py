"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, forwards and backwards, and gives every byte
a probability for each language; a document's probabilities are the mean over all its bytes. It
is trained in numpy by backpropagation through time, on a bounded sample of labelled rows: about
``per_label`` documents of each language, drawn by a hash of their id, a few windows from all
over each text. Labelling is one pass of all whole texts without a shuffle.

Results in odd cases: a null text, or one without a letter, gets ``und`` and score 0; a text of
any length is read whole, in windows, so memory is bounded; rows without a language, or with an
empty text, are not learned from; where nothing can be learned (an empty table, or no labels)
every row is ``und``; repeated rows and ties change nothing (a tie goes to the language that
sorts first); extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, sliced

#: Bound of the training sample: documents of each language (expected), windows of each, languages.
PER_LABEL, WINDOWS, LABELS = 500, 6, 256
HIDDEN, STEPS, BATCH, SPAN, RATE = 8, 300, 256, 48, 0.02
#: Bytes of a window when labelling, and windows that are read side by side.
READ, SIDE = 128, 2048
#: A document of a learned language is as sure as a window of it, but for this much.
MARGIN = 0.1
UNDECIDED = "und"
_PLAIN = re.compile("[A-Za-z]").search


@dataclass
class Network:
    """Weights. ``table`` [direction, gate row, byte], ``turn`` [direction, gate row, hidden],
    ``out`` [label, both directions' hidden], ``bias`` [label]. Gate rows: update, reset, new.
    ``floor``: a score below that of every window that it was trained on, by ``MARGIN`` at least."""

    labels: list[str]
    table: np.ndarray
    turn: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    floor: float = 0.0


def _begin(labels: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    turn = rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden))
    table = rng.normal(0, 0.3, (2, 3 * hidden, 256))
    out = rng.normal(0, 0.3, (len(labels), 2 * hidden))
    return Network(labels, *(x.astype(np.float32) for x in (table, turn, out, np.zeros(len(labels)))))


def _forward(table: np.ndarray, turn: np.ndarray, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States [time, hidden, side] of bytes [time, side]; ``trace`` gets what backpropagation needs."""
    k = turn.shape[1]
    h = np.zeros((k, x.shape[1]), np.float32)
    states = np.empty((x.shape[0], k, x.shape[1]), np.float32)
    for t in range(x.shape[0]):
        seen = table.take(x[t], axis=1)
        held = turn @ h
        gates = held[: 2 * k]
        gates += seen[: 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r, fresh = gates[:k], gates[k:], seen[2 * k :]
        n = np.multiply(r, held[2 * k :])
        n += fresh
        np.tanh(n, out=n)
        if trace is not None:
            trace.append((h, z, r, n, held[2 * k :]))
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
    return states


def _backward(turn: np.ndarray, x: np.ndarray, trace: list, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and turn, from the loss's gradient ``into`` for every state."""
    k = turn.shape[1]
    d_turn = np.zeros_like(turn)
    d_seen = np.empty((x.shape[0], 3 * k, x.shape[1]), np.float32)
    back = np.zeros((k, x.shape[1]), np.float32)
    for t in range(x.shape[0] - 1, -1, -1):
        before, z, r, n, held = trace[t]
        d = into[t] + back
        d_new = d * (1 - z) * (1 - n * n)
        d_update = d * (before - n) * z * (1 - z)
        d_reset = d_new * held * r * (1 - r)
        d_held = np.concatenate([d_update, d_reset, d_new * r])
        d_seen[t] = np.concatenate([d_update, d_reset, d_new])
        d_turn += d_held @ before.T
        back = d * z + turn.T @ d_held
    flat = x.ravel()
    d_table = np.stack([np.bincount(flat, d_seen[:, g, :].ravel(), 256) for g in range(3 * k)])
    return d_table.astype(np.float32), d_turn


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of all positions of bytes [time, side] with answers [side], and its
    gradient for each weight."""
    hidden = net.turn.shape[2]
    traces: tuple[list, list] = ([], [])
    ahead = _forward(net.table[0], net.turn[0], x, traces[0])
    behind = _forward(net.table[1], net.turn[1], x[::-1], traces[1])[::-1]
    both = np.concatenate([ahead, behind], axis=1)
    logits = net.out @ both + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    side = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[:, y, side], 1e-30)).mean())
    p[:, y, side] -= 1
    p /= p.shape[0] * p.shape[2]
    d_both = net.out.T @ p
    a = _backward(net.turn[0], x, traces[0], d_both[:, :hidden])
    b = _backward(net.turn[1], x[::-1], traces[1], d_both[::-1, hidden:])
    return loss, {"table": np.stack([a[0], b[0]]), "turn": np.stack([a[1], b[1]]), "out": np.einsum("tlb,tkb->lk", p, both), "bias": p.sum(axis=(0, 2))}


def train(windows: np.ndarray, answers: np.ndarray, labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 1) -> Network:
    """Adam on the cross entropy of every position. ``windows`` [n, time] bytes, ``answers`` [n]."""
    net = _begin(labels, hidden, seed)
    rng = np.random.default_rng(seed + 1)
    weights = {name: getattr(net, name) for name in ("table", "turn", "out", "bias")}
    first, second = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
    share = np.bincount(answers, minlength=len(labels)).astype(float)
    chance = (1 / share[answers]) / np.sum(1 / share[answers])  # every language as often
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), BATCH, p=chance)
        _, grads = gradients(net, windows[pick].T, answers[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def least_score(net: Network, windows: np.ndarray) -> float:
    """The least score among windows [n, time], whose padding is zero bytes."""
    lengths = windows.shape[1] - (windows[:, ::-1] != 0).argmax(axis=1)
    parts = [(windows[k : k + SIDE], lengths[k : k + SIDE]) for k in range(0, len(windows), SIDE)]
    return float(min((label_windows(net, np.ascontiguousarray(w.T), n).max(axis=0) / n).min() for w, n in parts))


def label_windows(net: Network, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over the first ``lengths`` positions of each window of every position's language
    probabilities: [label, side] of bytes [time, side]. Backward states start at the right end
    of the window, whose padding is zero bytes."""
    k = net.turn.shape[2]
    ahead = _forward(net.table[0], net.turn[0], x)
    behind = _forward(net.table[1], net.turn[1], x[::-1])[::-1]
    total = np.zeros((len(net.labels), x.shape[1]), np.float32)
    for t in range(x.shape[0]):
        logits = net.out[:, :k] @ ahead[t]
        logits += net.out[:, k:] @ behind[t]
        logits += net.bias[:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits *= (t < lengths) / logits.sum(axis=0)
        total += logits
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and (_PLAIN(text) is not None or any(map(str.isalpha, text)))


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, from the mean of its positions' probabilities."""
    sums = np.zeros((len(net.labels), len(texts)))
    sizes = np.zeros(len(texts), np.int64)
    pending: list[tuple[int, bytes]] = []  # a text's number and a stretch of at most SIDE windows
    held = 0

    def read() -> None:
        counts = [-(-len(raw) // READ) for _, raw in pending]
        x = np.zeros((sum(counts), READ), np.uint8)
        lengths, of, at = np.full(len(x), READ), np.empty(len(x), np.int64), 0
        for (number, raw), n in zip(pending, counts, strict=True):
            x[at : at + n].reshape(-1)[: len(raw)] = np.frombuffer(raw, np.uint8)
            lengths[at + n - 1] = len(raw) - READ * (n - 1)
            of[at : at + n] = number
            at += n
        for start in range(0, len(x), SIDE):
            part = slice(start, start + SIDE)
            found = label_windows(net, np.ascontiguousarray(x[part].T), lengths[part])
            for label, row in zip(sums, found, strict=True):
                label += np.bincount(of[part], row, len(texts))
        pending.clear()

    for number, text in enumerate(texts):
        if not has_letter(text):
            continue
        raw = text.encode("utf-8", "surrogatepass")
        sizes[number] = len(raw)
        for start in range(0, len(raw), READ * SIDE):
            pending.append((number, raw[start : start + READ * SIDE]))
            held += -(-len(pending[-1][1]) // READ)
            if held >= SIDE:
                read()
                held = 0
    if pending:
        read()
    best = sums.argmax(axis=0)
    score = np.clip(sums[best, np.arange(len(texts))] / np.maximum(sizes, 1), 0, 1)
    return [net.labels[b] if n else UNDECIDED for b, n in zip(best, sizes, strict=True)], [float(s) if n else 0.0 for s, n in zip(score, sizes, strict=True)]


def training_sample(docs: DataFrame, learn: Column, per_label: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of bytes and the number of their label. A document is in the sample if a hash of
    its id is below its language's share; its windows lie evenly over its whole text."""
    text, label = F.col(f"`{text_col}`"), F.col(f"`{label_col}`")
    rows = docs.where(learn & label.isNotNull() & (F.length(text) > 0))
    counts = {r["label"]: r["n"] for r in rows.groupBy(label.cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(LABELS + 1).collect()}
    if len(counts) > LABELS:
        raise ValueError(f"more than {LABELS} languages")
    if not counts:
        return np.empty((0, SPAN), np.uint8), np.empty(0, np.int64), []
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_label / n)) for k, n in counts.items()], "language__label string, language__share double")
    chance = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.join(F.broadcast(shares), label.cast("string") == F.col("language__label")).where(chance < F.col("language__share"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: (1 + k * F.greatest(F.length(text) - SPAN, F.lit(0)) / (WINDOWS - 1)).cast("int"))
    cut = picked.select("language__label", F.transform(starts, lambda s: F.encode(F.substring(text, s, F.lit(SPAN)), "utf-8")).alias("windows"))
    # LABELS * per_label rows are expected at most; a bound on rows keeps repeated ids in check
    got = cut.limit(4 * per_label * len(counts)).toPandas()
    labels = sorted(counts)
    number = {k: i for i, k in enumerate(labels)}
    x, y = [], []
    for label_, windows in sorted(zip(got["language__label"], (sorted(bytes(w) for w in ws) for ws in got["windows"]), strict=True)):
        for w in dict.fromkeys(windows):
            x.append(np.frombuffer(w[:SPAN].ljust(SPAN, b"\0"), np.uint8))
            y.append(number[label_])
    return np.stack(x), np.array(y), labels


def fit(docs: DataFrame, learn: Column, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """A network for the rows where ``learn`` holds; None where they have no label."""
    x, y, labels = training_sample(docs, learn, per_label, id_col, text_col, label_col)
    if not labels:
        return None
    net = train(x, y, labels)
    net.floor = min(0.5, least_score(net, x) - MARGIN)
    return net


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``language__pred`` and ``language__score``."""
    if net is None:
        return docs.withColumns({"language__pred": F.lit(UNDECIDED), "language__score": F.lit(0.0)})
    own = [F.col(f"`{c}`") for c in docs.columns]
    frame = docs.select(*own, F.col(f"`{text_col}`").cast("string").alias("language__text"))
    schema = T.StructType([*docs.schema.fields, T.StructField("language__pred", T.StringType()), T.StructField("language__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            found, scores = predict(net, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "language__pred", "language__score"])

    return frame.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; those of fold 2 of 4 are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold(F.col("doc_id"), 4) == 2
    net = fit(docs, ~held)
    found = identify(docs.select("doc_id", held.alias("held_out"), "text"), net)
    return found.select("doc_id", "held_out", F.col("language__pred").alias("lang_pred"), F.col("language__score").alias("score"))
