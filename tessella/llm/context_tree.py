"""LM scoring by context-tree weighting over bytes.

A text is its lower-cased words with single spaces and an end. Every byte is eight binary
decisions; a decision has a node for each context of 0 to ``DEPTH`` preceding bytes, with counts
of both outcomes, Krichevsky-Trofimov estimates, and the weight that context-tree weighting
gives the node's own estimate against all deeper ones. The probability of a decision mixes the
estimates along its path; a context that was never seen takes over its parent's estimate.

The whole tree takes part, whatever its size, and no part of it is one task. Documents are dealt
into stretches. A stretch tells its distinct grams (``DEPTH`` bytes and the next) and words, each
once with the number of times that it is learned from; these are summed over the stretches as
they are shuffled, so a gram of every text is as many rows as there are stretches. The tree falls
apart below the two nearest bytes, and below the third where two bytes have many grams: what
shares them is a slot. Slots first tell what their nodes add to the nodes of two bytes, from which
those of one byte and none follow (65 535 at most, which are broadcast); then each slot, with its
nodes of two bytes, answers with the probabilities of its grams. Answers for grams and words join
what the stretches have asked, and meet the texts of their stretch by one exchange of the texts.

Results in odd cases: a null or empty text has the end as its only token; with nothing to learn
from, every decision has probability 1/2 and the base score is 0 for each token; repeated ids
and rows are scored one by one; a null id counts as the empty string for its fold; texts are
read whole, in stretches; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_step, fold, settle, sliced

DEPTH = 5
#: Bytes that are looked at together; rows of a batch; grams held before they are summed.
STRETCH, ROWS, COUNTED = 1_000_000, 1000, 1_500_000
#: Characters of a stretch of documents, and stretches at most (beyond, neighbours are one);
#: grams of a slot; answers packed at a time; bytes of texts that look up their words together;
#: stretches whose numbers are broadcast (16 bytes each; beyond, joined).
SPAN, STRETCHES, PER_SLOT, PACKED, HELD, NUMBERS = 24_000_000, 1 << 16, 30_000, 1_000_000, 12_000_000, 1 << 20
END, BLANK = b"\n", b" "
#: What a gram leaves free in 64 bits: the texts that are sorted with their grams.
_FREE = np.uint64(64 - 8 * (DEPTH + 1))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0: Stirling's series after eight steps up."""
    y, shift = x + 8.0, np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - 1.1447298858494002


class Tokens:
    """The lower-cased words of texts, without a Python object for any of them: ``data`` holds
    their bytes, ``bounds`` where each begins (and the last ends), ``first`` the first of each text
    (and the number of all)."""

    def __init__(self, texts: pa.Array):
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.binary())
        _, offsets, flat = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        flat = np.frombuffer(flat, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        solid = (flat != 32) & (flat - np.uint8(9) > 4)
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        at = offsets[:-1][np.diff(offsets) > 0]
        begins[at] = solid[at]
        self.data = flat[solid]
        self.data += (self.data - np.uint8(65) < 26) * np.uint8(32)
        self.bounds = np.append(np.flatnonzero(begins[solid]), len(self.data)).astype(np.int32)
        self.first = np.searchsorted(np.flatnonzero(begins), offsets)
        self.counts = np.diff(self.first)
        #: bytes that each text codes: its words with single spaces between, and its end
        self.sizes = np.diff(self.bounds[self.first]).astype(np.int64) + np.maximum(self.counts, 1)

    def words(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self.bounds) - 1, [None, pa.py_buffer(self.bounds), pa.py_buffer(self.data)])

    def stretches(self) -> Iterator[tuple[int, int]]:
        """Runs of texts of STRETCH bytes at most, or of one text, and no more of them than a gram
        leaves bits for."""
        ends, start, most = np.cumsum(self.sizes), 0, 1 << int(_FREE)
        while start < len(ends):
            stop = int(np.searchsorted(ends, ends[start] - self.sizes[start] + STRETCH, "right"))
            stop = min(max(stop, start + 1), start + most)
            yield start, stop
            start = stop

    def grams(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes of the DEPTH + 1 bytes that end at each byte of texts a to b and their ends (before
        a text stand ends), and which text that is (the first is 0); a long text in pieces."""
        first, counts, sizes = self.first[a : b + 1], self.counts[a:b], self.sizes[a:b]
        bounds = self.bounds[first[0] : first[-1] + 1].astype(np.int64)
        begins = np.cumsum(sizes + DEPTH) - sizes
        ends = begins + sizes - 1
        # a word is followed by a space; the last one of a text, or a text without one, by the end
        blanks = np.repeat(begins - self.bounds[first[:-1]] - first[:-1], counts) + bounds[1:] + np.arange(first[0], first[-1])
        flat = np.full(7 + int(ends[-1]) + 1, END[0], np.uint8)
        body = flat[7:]
        body[blanks] = BLANK[0]
        body[ends] = END[0]
        plain = np.ones(len(body), bool)
        plain[blanks] = plain[ends] = False
        kept = np.ones(len(body), bool)
        for k in range(1, DEPTH + 1):
            plain[begins - k] = kept[begins - k] = False
        body[plain] = self.data[bounds[0] : bounds[-1]]
        for p in range(0, len(body), 2 * STRETCH):
            q = min(p + 2 * STRETCH, len(body))
            code = np.ndarray(q - p, ">u8", flat, p, strides=(1,)).astype(np.uint64)[kept[p:q]]
            code &= np.uint64((1 << 8 * (DEPTH + 1)) - 1)
            yield code, np.repeat(np.arange(b - a, dtype=np.uint64), np.maximum(np.minimum(ends + 1, q) - np.maximum(begins, p), 0))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], [np.add.reduceat(v[order], first) for v in values]


_ESTIMATE = np.dtype([("one", "<f4"), ("own", "<f4")])


def _packed(p: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of p and 1 - p the lesser one, with a minus for 1 - p: as a short float p alone would be 1
    where a node of millions of ones has seen no zero, and a zero there impossible."""
    return np.where(p <= rest, p, -rest)


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p and 1 - p."""
    x = x.astype(float)
    low = np.signbit(x)
    return np.where(low, 1 + x, x), np.where(low, -x, 1 - x)


def _nodes(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and weights of nodes (packed), and their log weighted probabilities. ``deeper``:
    the sums of the children's, None for leaves."""
    block = kt_block(zeros, ones)
    total = block if deeper is None else np.logaddexp(block, deeper) - np.log(2)
    rows = np.empty(len(key), _ESTIMATE)
    rows["one"] = _packed((ones + 0.5) / (zeros + ones + 1.0), (zeros + 0.5) / (zeros + ones + 1.0))
    rows["own"] = -0.0 if deeper is None else _packed(*(np.exp(np.minimum(x - np.log(2) - total, 0)) for x in (block, deeper)))
    return rows, total


def _up(depth: int, key: np.ndarray) -> np.ndarray:
    """Keys of the parents: the farthest context byte goes."""
    return key & np.uint64((1 << 8 * depth) - 1)


def _levels(gram: np.ndarray, n: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], tuple]:
    """All nodes with contexts of DEPTH to 3 bytes for grams of which those that share the three
    nearest are together: keys in ascending order with estimates by depth; then key, zeros, ones
    and the sum of the log weighted probabilities below, for the nodes with two bytes."""
    byte, context = gram & np.uint64(255), gram >> np.uint64(8) << np.uint64(8)
    keys, bits = [], []
    for k in range(8):
        keys.append(context | np.uint64(1 << k) | byte >> np.uint64(8 - k))
        bits.append((byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool))
    bit, n = np.concatenate(bits), np.tile(n.astype(float), 8)
    key, (zeros, ones) = _sum_by(np.concatenate(keys), np.where(bit, 0, n), np.where(bit, n, 0))
    rows, log = _nodes(key, zeros, ones, None)
    levels = {DEPTH: (key, rows)}
    for depth in range(DEPTH - 1, 1, -1):
        key, (zeros, ones, log) = _sum_by(_up(depth + 1, key), zeros, ones, log)
        if depth > 2:
            rows, log = _nodes(key, zeros, ones, log)
            levels[depth] = key, rows
    return levels, (key, zeros, ones, log)


class Tree:
    """log10 probabilities of grams under nodes that ``find(depth, key)`` gives: whether they are
    there, their estimates of a one, and the weights of these (packed)."""

    def find(self, depth: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def gram_log10(self, gram: np.ndarray) -> np.ndarray:
        if len(gram) > 1 << 16:
            return np.concatenate([self.gram_log10(gram[k : k + (1 << 16)]) for k in range(0, len(gram), 1 << 16)])
        byte, context = gram & np.uint64(255), gram >> np.uint64(8) << np.uint64(8)
        total = np.zeros(len(gram))
        for k in range(8):
            key = context | np.uint64(1 << k) | byte >> np.uint64(8 - k)
            bit = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            estimates, weights = [], []  # those of the bit that comes, and (own, deeper)
            seen, last = np.ones(len(gram), bool), np.full(len(gram), 0.5)
            for depth in range(DEPTH + 1):
                there, one, own = self.find(depth, key & np.uint64((1 << 8 * (depth + 1)) - 1))
                seen = seen & there
                last = np.where(seen, np.where(bit, *_unpacked(one)), last)
                estimates.append(last)
                weights.append(_unpacked(np.where(seen, own, -0.0)))
            p = estimates[DEPTH]
            for depth in range(DEPTH - 1, -1, -1):
                p = weights[depth][0] * estimates[depth] + weights[depth][1] * p
            total += np.log10(p)
        return total


class Slot(Tree):
    """All nodes of a slot by depth (keys in ascending order, estimates), and those with one byte
    of context or none (estimate and weight by key; nan where there is no node)."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], upper: list[tuple[np.ndarray, np.ndarray]]):
        self.levels, self.upper = levels, upper

    def find(self, depth: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if depth < 2:
            one, own = (x[key.astype(np.int64)] for x in self.upper[depth])
            return ~np.isnan(one), one, own
        if depth not in self.levels or not len(self.levels[depth][0]):
            none = np.zeros(len(key))
            return none > 0, none, none
        keys, rows = self.levels[depth]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, rows["one"][at], rows["own"][at]


_ADDED = "key long, zeros double, ones double, log double"


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a slot's grams add to the nodes with two bytes of context."""
    key, zeros, ones, log = _levels(pdf["gram"].to_numpy().astype(np.uint64), pdf["n"].to_numpy())[1]
    return pd.DataFrame({"key": key.astype(np.int64), "zeros": zeros, "ones": ones, "log": log})


def _with_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes with two bytes: estimate, weight, counts and log weighted probability."""
    for pdf in batches:
        zeros, ones = pdf["zeros"].to_numpy(), pdf["ones"].to_numpy()
        rows, log = _nodes(pdf["key"].to_numpy(), zeros, ones, pdf["log"].to_numpy())
        yield pd.DataFrame({"key": pdf["key"], "one": rows["one"], "own": rows["own"], "zeros": zeros, "ones": ones, "log": log})


def _uppermost(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Estimates and weights by key of the nodes without context, then of those with one byte,
    from what those with two bytes add to the latter."""
    upper = []
    for depth in (1, 0):
        one, own = (np.full(1 << 8 * (depth + 1), np.nan, np.float32) for _ in range(2))
        if len(key):
            key, (zeros, ones, log) = _sum_by(key if depth else _up(1, key), zeros, ones, log)
            rows, log = _nodes(key, zeros, ones, log)
            one[key.astype(np.int64)], own[key.astype(np.int64)] = rows["one"], rows["own"]
        upper.insert(0, (one, own))
    return upper


def _answer(shipped):
    """A slot's grams and nodes with two bytes to (gram, log10 of its probability)."""

    def run(grams_: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        gram, n = grams_["gram"].to_numpy().astype(np.uint64), grams_["n"].to_numpy()
        if not len(gram):
            return pd.DataFrame({"gram": [], "log": []})
        levels = _levels(gram[n > 0], n[n > 0])[0] if n.any() else {}
        two = two.sort_values("key")
        rows = np.empty(len(two), _ESTIMATE)
        rows["one"], rows["own"] = two["one"], two["own"]
        levels[2] = two["key"].to_numpy().astype(np.uint64), rows
        return pd.DataFrame({"gram": grams_["gram"], "log": Slot(levels, shipped.value).gram_log10(gram).astype(np.float32)})

    return run


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, Tokens, bool]]:
    """Rows (stretch, learn, text) to runs (stretch, learn by text, tokens, whether another stretch
    begins)."""
    current = None
    for batch in batches:
        stretches, learned = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        turns = [*_firsts(stretches).tolist(), len(stretches)]
        for a, b in zip(turns, turns[1:]):
            yield int(stretches[a]), learned[a:b], Tokens(batch.column(2).slice(a, b - a)), stretches[a] != current
            current = stretches[a]


def _rows_of(stretch: int, name: str, keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(n), stretch, np.int32)), keys, pa.array(n, pa.int64())], names=["stretch", name, "n"])
    return sliced([rows], 1 << 16)


def _ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stretch, gram, n): the distinct grams of a stretch and how often they are learned from
    there. Of a stretch whose rows lie in several tasks each tells its own."""
    found, held, at = [], 0, None

    def summed() -> None:
        nonlocal found, held
        code, (n,) = _sum_by(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        found, held = [(code, n)], len(code) // 2

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal found
        if found:
            summed()
            (code, n), found = found[0], []
            yield from _rows_of(at, "gram", pa.array(code.astype(np.int64)), n)

    for stretch, learned, tokens, new in _runs_of(batches):
        if new:
            yield from told()
            at, held = stretch, 0
        for a, b in tokens.stretches():
            for key, of in tokens.grams(a, b):
                key <<= np.uint64(1)
                key |= learned[a:b][of]
                key.sort()
                code = key >> np.uint64(1)
                first = _firsts(code)
                found.append((code[first], np.add.reduceat((key & np.uint64(1)).astype(np.int64), first)))
                held += len(first)
                if held >= COUNTED:
                    summed()
    yield from told()


def _ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stretch, word, n): the distinct tokens of a stretch (the end as the empty one) and how
    often they are learned from."""
    found, held, at = [], 0, None

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal found, held
        if found:
            coded = pa.concat_arrays([tokens.words() for tokens, _ in found]).dictionary_encode()
            learns = np.concatenate([np.repeat(learned, tokens.counts) for tokens, learned in found])
            n = np.bincount(coded.indices.to_numpy()[learns], minlength=len(coded.dictionary))
            end = sum(int(learned.sum()) for _, learned in found)
            found, held = [], 0
            yield from _rows_of(at, "word", pa.concat_arrays([coded.dictionary, pa.array([b""], pa.binary())]), np.append(n, end))

    for stretch, learned, tokens, new in _runs_of(batches):
        if new or held + len(tokens.data) > SPAN:
            yield from told()
            at = stretch
        found.append((tokens, learned))
        held += len(tokens.data)
    yield from told()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stretch, key, value) to (stretch, keys, values) in bytes, words with ends between."""
    held, n = [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        if held:
            stretch, key, value = pa.Table.from_batches(held).combine_chunks().columns
            stretch = stretch.to_numpy()
            order = np.argsort(stretch, kind="stable")
            numbers, first = np.unique(stretch[order], return_index=True)
            cut = lambda x: pa.array([p.tobytes() for p in np.split(x.to_numpy()[order], first[1:])], pa.binary())
            if pa.types.is_binary(key.type):
                lists = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), key.take(pa.array(order)).combine_chunks())
                keys = pc.binary_join(lists, pa.scalar(END, pa.binary()))
            else:
                keys = cut(key)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), keys, cut(value)], names=["stretch", "keys", "values"])
            held, n = [], 0

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield from packed()
    yield from packed()


class Answers:
    """log10 probabilities of the grams of one stretch, and of its words that are known (the end as
    the empty one)."""

    def __init__(self, gram: list[bytes], logs: list[bytes], known: list[pa.Array], counts: list[bytes], floor: float):
        code = np.frombuffer(b"".join(gram), np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, self.logs = code[order], np.frombuffer(b"".join(logs), np.float32)[order].astype(float)
        self.known = pa.concat_arrays([pa.array([], pa.binary()), *known])
        # the last one: of what is not known
        self.word = np.log10((np.append(np.frombuffer(b"".join(counts), np.int64), 0) + 1) / floor)

    def scores(self, tokens: Tokens) -> np.ndarray:
        """log10 probability of each text. Grams are sorted with the numbers of their texts: those
        that are equal are looked up once, in order."""
        out = [np.empty(0)]
        for a, b in tokens.stretches():
            out.append(np.zeros(b - a))
            for key, of in tokens.grams(a, b):
                key <<= _FREE
                key |= of
                key.sort()
                code = key >> _FREE
                first = _firsts(code)
                code = code[first]
                at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                if not (self.code[at] == code).all():
                    raise ValueError("a gram without an answer")
                logs = np.repeat(self.logs[at], np.diff(np.append(first, len(key))))
                out[-1] += np.bincount((key & np.uint64((1 << int(_FREE)) - 1)).astype(np.int64), logs, b - a)
        return np.concatenate(out)

    def bases(self, found: list[Tokens]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the tokens, those known, and the log10 of the smoothed word frequencies."""
        every = pa.chunked_array([*(t.words() for t in found), pa.array([b""], pa.binary())])
        at = pc.fill_null(pc.index_in(every, value_set=self.known), -1).to_numpy()
        end, start = at[-1], 0
        for t in found:
            own, start = at[start : start + len(t.bounds) - 1], start + len(t.bounds) - 1
            of = np.repeat(np.arange(len(t.counts)), t.counts)
            known = np.bincount(of[own >= 0], minlength=len(t.counts)) + (end >= 0)
            yield t.counts + 1, known, np.bincount(of, self.word[own], len(t.counts)) + self.word[end]


_SCORES = [("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64())]


def _read_answers(total: int, distinct: int, text_at: int, own: int):
    """Rows (stretch, kind, grams, logs, words, counts, .., text perhaps) in order of (stretch,
    kind), the answers (kind 0) before the texts (kind 1), to (.., the columns of ``_SCORES``)."""
    floor = float(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, answers, told, parts, held = None, None, ([], [], [], []), [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            nonlocal answers, told, parts, held
            if not parts:
                return
            if answers is None:
                answers, told = Answers(*told, floor), ([], [], [], [])
            found = [Tokens(part.column(6 + text_at)) for part in parts]
            for part, tokens, base in zip(parts, found, answers.bases(found), strict=True):
                made = (*base, answers.scores(tokens), tokens.sizes)
                yield pa.RecordBatch.from_arrays([*part.columns[6 : 6 + own], *(pa.array(x, t) for x, (_, t) in zip(made, _SCORES, strict=True))], names=[*part.schema.names[6 : 6 + own], *(f"tree__{c}" for c, _ in _SCORES)])
            parts, held = [], 0

        for batch in batches:
            stretches, kinds = (batch.column(k).to_numpy() for k in (0, 1))
            turns = [*_firsts(stretches.astype(np.int64) << 1 | kinds).tolist(), len(kinds)]
            for a, b in zip(turns, turns[1:]):
                part = batch.slice(a, b - a)
                if stretches[a] != current:
                    yield from scored()
                    current, answers, told = stretches[a], None, ([], [], [], [])
                if kinds[a] == 0:
                    for k in (0, 1, 3):
                        told[k].extend(x for x in part.column((2, 3, 4, 5)[k]).to_pylist() if x)
                    some = pc.greater(pc.binary_length(part.column(5)), 0)  # the end stands between words as the empty one
                    told[2].append(pc.split_pattern(part.column(4).filter(some), END).flatten())
                    continue
                parts.append(part)
                held += part.nbytes
                if held >= HELD:
                    yield from scored()
        yield from scored()

    return run


def gram_answers(counts: DataFrame) -> DataFrame:
    """(gram, log) for every row of ``counts(gram, n)``: the log10 probability of its last byte
    after the others, under the tree of all grams with their counts n."""
    spark = counts.sparkSession
    two, third = F.expr("shiftright(gram, 8) & 65535"), F.expr("shiftright(gram, 24) & 255")
    sizes = counts.groupBy(two.alias("two")).agg(F.count(F.lit(1)).alias("size")).collect()  # 65 536 rows at most
    slots = int(max(12, -(-sum(r["size"] for r in sizes) // PER_SLOT)))
    cuts = F.broadcast(spark.createDataFrame([(r["two"], min(256, -(-r["size"] // PER_SLOT))) for r in sizes], "two long, cuts int"))
    slot = lambda cut: F.pmod(F.xxhash64("two", cut), F.lit(slots)).cast("int").alias("slot")
    dealt = counts.withColumn("two", two).join(cuts, "two").select("gram", "n", slot(F.pmod(F.xxhash64(third), "cuts")))
    added = dealt.where("n > 0").groupBy("slot").applyInPandas(_added, _ADDED)
    nodes = settle(added.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log"))).mapInPandas(_with_two, "key long, one float, own float, zeros double, ones double, log double"))
    # 255 nodes for each byte at most
    top = nodes.groupBy(F.expr("key & 65535").alias("key")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log"))).toPandas().sort_values("key")
    upper = spark.sparkContext.broadcast(_uppermost(top["key"].to_numpy().astype(np.uint64), *(top[c].to_numpy().astype(float) for c in ("zeros", "ones", "log"))))
    # nodes with two bytes go to every slot that has grams of theirs
    spread = nodes.withColumn("two", F.expr("shiftright(key, 8)")).join(cuts, "two").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    spread = spread.select("key", "one", "own", slot(F.col("cut").cast("long")))
    return dealt.groupBy("slot").cogroup(spread.groupBy("slot")).applyInPandas(_answer(upper), "gram long, log float")


def score(docs: DataFrame, learn: Column, text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``docs`` plus ``tree__tokens``, ``tree__known``, ``tree__all`` (tokens learned from),
    ``tree__base`` (log10 of smoothed word frequencies), ``tree__score`` (log10 probability of the
    text under the tree), ``tree__bytes`` (that it codes) and ``tree__bits`` (code length a byte)."""
    spark = docs.sparkSession
    fields, own = docs.schema.fields, [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(f"`{text_col}`")
    frame = docs.select(*own, F.coalesce(learn, F.lit(False)).alias("tree__learn"), F.coalesce(F.length(text), F.lit(0)).alias("tree__chars"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, held = TaskContext.get().partitionId() << 33, 0
        for batch in sliced(batches, ROWS):
            stretches = []
            for n in batch.column(batch.num_columns - 1).to_pylist():
                if held >= span:
                    stretch, held = stretch + 1, 0
                held += n
                stretches.append(stretch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stretches, pa.int64())], names=[*batch.schema.names[:-1], "tree__stretch"])

    step = partial(settle, codec="zstd")
    done = step(frame.mapInArrow(deal, T.StructType([*frame.schema.fields[:-1], T.StructField("tree__stretch", T.LongType())])))
    # a row for each stretch; numbered, neighbours together where there are very many
    ids = np.sort(done.select("tree__stretch").distinct().toPandas()["tree__stretch"].to_numpy())
    together = -(-len(ids) // STRETCHES) or 1
    stretches = -(-len(ids) // together) or 1
    numbers = spark.createDataFrame([(int(i), k // together) for k, i in enumerate(ids)], "tree__stretch long, tree__at int")
    rows = done.join(F.broadcast(numbers) if len(ids) <= NUMBERS else numbers, "tree__stretch")
    texts = rows.select("tree__at", "tree__learn", text.cast("string").alias("tree__text"))

    # in the joins below both sides grow with the corpus: never a broadcast, at no size
    asked = step(texts.mapInArrow(_ask_words, "stretch int, word binary, n long"))
    vocabulary = step(asked.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    told = asked.select("stretch", "word").join(vocabulary.hint("merge"), "word").select("stretch", "word", "n")
    known = step(told.mapInArrow(_pack, "stretch int, keys binary, values binary"))
    del told
    drop_step(asked)
    drop_step(vocabulary)

    asked = step(texts.mapInArrow(_ask_grams, "stretch int, gram long, n long"))
    counts = step(asked.groupBy("gram").agg(F.sum("n").alias("n")))
    told = asked.select("stretch", "gram").join(gram_answers(counts).hint("merge"), "gram").select("stretch", "gram", "log")
    answers = step(told.mapInArrow(_pack, "stretch int, keys binary, values binary"))
    del told
    drop_step(asked)
    drop_step(counts)

    texts_too = [] if dict(docs.dtypes)[text_col] == "string" else [text.cast("string").alias("tree__text")]
    none = lambda *kinds: [F.lit(None).cast(k) for k in kinds]
    gone = none(*(f.dataType for f in fields), *("string" for _ in texts_too))
    union = answers.select("stretch", F.lit(0), "keys", "values", *none("binary", "binary"), *gone)
    union = union.union(known.select("stretch", F.lit(0), *none("binary", "binary"), "keys", "values", *gone))
    union = union.union(rows.select("tree__at", F.lit(1), *none("binary", "binary", "binary", "binary"), *own, *texts_too))
    union = union.toDF("tree__at", "tree__kind", "tree__grams", "tree__logs", "tree__words", "tree__counts", *docs.columns, *("tree__text" for _ in texts_too))
    met = union.repartitionById(stretches, F.col("tree__at")).sortWithinPartitions("tree__at", "tree__kind")
    kinds = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([*fields, *(T.StructField(f"tree__{c}", kinds[t]) for c, t in _SCORES)])
    text_at = len(fields) if texts_too else docs.columns.index(text_col)
    found = met.mapInArrow(_read_answers(total, distinct, text_at, len(fields)), schema)
    return found.select(*own, "tree__tokens", "tree__known", F.lit(int(total)).cast("long").alias("tree__all"), "tree__base", "tree__score", "tree__bytes", (F.col("tree__score") * -np.log2(10) / F.col("tree__bytes")).alias("tree__bits"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, and its code length in bits a byte; those of fold
    2 of 7 are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    done = score(docs.withColumn("held_out", held), ~F.col("held_out"))
    return done.select("doc_id", "held_out", F.col("tree__tokens").alias("n_tokens"), F.col("tree__known").alias("n_known"), F.col("tree__all").alias("train_tokens"), F.col("tree__base").alias("base_score"), F.col("tree__score").alias("score"), F.col("tree__bits").alias("bits_per_byte"))
