"""Suffix-array dedup: bytes of matches of 50 bytes or more with earlier documents go.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller
id. Each string has one minimizer, the least hash of its 20-byte grams, and equal strings have
equal minimizers; so strings are dealt out by minimizer, and a string whose minimizer occurs in
no other document has no match and does not travel. What remains goes in batches, in order of
document id, into a logarithmic family of suffix arrays: a batch's suffixes are sorted to the
length of a match, merge-scanned against every level (both ascend, so each search goes on from
where the one before ended), then become a level themselves, and levels of equal size merge into
one of twice the size. As levels hold smaller ids only, a
hit means a match with an earlier document. A level keeps equal suffixes once.

Exact copies are settled by text hash first, so a group of copies enters the family once.
Minimizers and suffixes that repeat inside one stretch of documents are settled there and sent
on once, so a passage in a third of all documents arrives as often as there are stretches.

Results in odd cases: a null or empty text has no bytes; texts shorter than 50 bytes lose
nothing; documents with equal ids never match each other, each text under an id loses its own
matches, and rows that repeat an id and text are alike; a null id matches nothing; very long texts are read whole; extra columns pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, sliced

LENGTH, GRAM = 50, 20
#: Suffixes of a batch; bytes of text for each shard of minimizers and of suffixes; bytes of a stretch.
BATCH, PER_BUCKET, PER_SHARD, STRETCH = 200_000, 8 << 20, 4 << 20, 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: A text is known by its document's id and its hash (key), so texts under one id stay apart.
_POST = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("nth", "<u4")])
_SEGMENT = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("windows", "<i4")])


def minimizers(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of each minimizer: it is that of the strings that start at first..last."""
    if len(text) < length:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(2)))
    h, size, powers = text.astype(np.uint64) + np.uint64(1), 1, {}
    while size <= gram:
        powers[size] = h
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    whole, at = None, 0
    for size in sorted(powers, reverse=True):
        if gram & size:
            part = powers[size][at : at + len(text) - gram + 1]
            whole = part if whole is None else whole * np.uint64(pow(_BASE, size, 1 << 64)) + part
            at += size
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(29)
    # the order is by the upper half of the hash, then by place: equal grams in a string are told
    # apart alike wherever the string stands
    low = whole >> np.uint64(32) << np.uint64(32) | np.arange(len(whole), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(text) - length + 1], low[width - size : width - size + len(text) - length + 1])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return whole[place[first]], first, np.concatenate([first[1:], [len(place)]]) - 1


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns (.., text as bytes) of stretches of about STRETCH bytes; the text is the last."""
    columns, held = None, 0
    for batch in sliced(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = _raw(row[-1])
            columns = columns or [[] for _ in row]
            for column, value in zip(columns, (*row[:-1], text), strict=True):
                column.append(value)
            held += len(text)
            if held >= STRETCH:
                yield columns
                columns, held = None, 0
    if columns:
        yield columns


def _posted(buckets: int):
    """Minimizers of texts (doc, key, text): rows (bucket, postings) for those met in one document
    of a stretch, one posting for those met in several, whose texts are told at once (known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _stretches(batches):
            parts = []
            for i, key, text in zip(ids, keys, texts, strict=True):
                h, _, _ = minimizers(text)
                rows = np.empty(len(h), _POST)
                rows["hash"], rows["doc"], rows["key"], rows["nth"] = h, i, key, np.arange(len(h))
                parts.append(rows)
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows["doc"], rows["hash"]))]
            first, several = _groups(rows)
            group = np.cumsum(first) - 1
            send = rows[first | ~several[group]]
            told = rows[several[group]]
            out = [(b, s.tobytes(), False) for b, s in _dealt(send, send["hash"] % np.uint64(buckets))]
            out += [(b, s.tobytes(), True) for b, s in _dealt(told, told["key"].astype(np.uint64) % np.uint64(buckets))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.bool_())], names=["bucket", "rows", "known"])

    return run


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ordered by (hash, doc): which begin a hash, and for each hash if it has several documents."""
    first = np.concatenate([[True], rows["hash"][1:] != rows["hash"][:-1]]) if len(rows) else np.empty(0, bool)
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:], [len(rows)]]) - 1
    return first, rows["doc"][at] != rows["doc"][last] if len(rows) else np.empty(0, bool)


def _dealt(rows: np.ndarray, to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    if not len(rows):
        return []
    order = np.argsort(to, kind="stable")
    numbers, first = np.unique(to[order], return_index=True)
    return list(zip((int(n) for n in numbers), np.split(rows[order], first[1:]), strict=True))


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc, key, place in its list of minimizers) for all minimizers met in several documents."""
    told = [np.frombuffer(r, _POST) for r, known in zip(pdf["rows"], pdf["known"], strict=True) if known]
    rows = np.concatenate([np.frombuffer(r, _POST) for r, known in zip(pdf["rows"], pdf["known"], strict=True) if not known] or [np.empty(0, _POST)])
    rows = rows[np.lexsort((rows["doc"], rows["hash"]))]
    first, several = _groups(rows)
    found = np.concatenate([rows[several[np.cumsum(first) - 1]] if len(rows) else rows, *told])
    found = found[np.argsort(found["doc"], kind="stable")]
    return pd.DataFrame({"doc": found["doc"], "key": found["key"], "nth": found["nth"].astype(np.int32)})


def _keys(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffixes at ``starts`` to the length of a match. UTF-8 has no byte 255, so a byte
    more leaves their order alone and no key has a trailing NUL."""
    rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts] + np.uint8(1)
    return np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()


class IndexFamily:
    """Suffix arrays of geometrically growing sizes, each a sorted array of distinct suffixes."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def scan(self, ordered: np.ndarray) -> np.ndarray:
        """Which of the ordered suffixes stand in some level."""
        hit = np.zeros(len(ordered), bool)
        for level in self.levels:
            at = np.searchsorted(level, ordered)
            at[at == len(level)] = 0
            hit |= level[at] == ordered
        return hit

    def add(self, ordered: np.ndarray) -> None:
        """A new level of distinct ordered suffixes; while the last level is no larger, they merge."""
        while self.levels and len(self.levels[-1]) <= len(ordered):
            both = np.concatenate([self.levels.pop(), ordered])
            both.sort(kind="stable")  # two runs: a linear merge
            ordered = both[np.concatenate([[True], both[1:] != both[:-1]])]
        if len(ordered):
            self.levels.append(ordered)


def matched(docs: np.ndarray, keys: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Which suffixes also occur in a smaller document. ``docs`` ascend."""
    family, out, start = IndexFamily(), np.zeros(len(keys), bool), 0
    while start < len(keys):
        end = min(start + batch, len(keys))
        if end < len(keys):  # a document is not split between batches, so none meets itself in a level
            end = max(int(np.searchsorted(docs, docs[end], "left")), start)
            if end == start:
                end = int(np.searchsorted(docs, docs[start], "right"))
        order = np.argsort(keys[start:end], kind="stable")  # the batch's suffix array; equal ones by document
        ordered = keys[start:end][order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        own = docs[start:end][order]
        earlier = own > own[np.flatnonzero(first)][np.cumsum(first) - 1]
        distinct = ordered[first]
        earlier |= family.scan(distinct)[np.cumsum(first) - 1]
        out[start + order] = earlier
        family.add(distinct)
        start = end
    return out


def _runs(segments: np.ndarray, flags: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc, key, packed (start, end) of covered bytes) of windows flagged in segments."""
    at = np.repeat(segments["start"], segments["windows"]) + _within(segments["windows"])
    doc, key = (np.repeat(segments[c], segments["windows"])[flags] for c in ("doc", "key"))
    at = at[flags]
    order = np.lexsort((at, key, doc))
    at, doc, key = at[order], doc[order], key[order]
    if not len(at):
        return []
    text = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    first = np.flatnonzero(text | np.concatenate([[True], at[1:] != at[:-1] + 1]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    pairs = np.stack([at[first], at[last] + LENGTH], axis=1).astype(np.int64)
    cut = np.flatnonzero(text[first])
    return [(int(doc[first[c]]), int(key[first[c]]), p.tobytes()) for c, p in zip(cut, np.split(pairs, cut[1:]), strict=True)]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[0]-1, 0, 1, .."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _sent(shards: int):
    """Texts (doc, key, nths, text) to the strings under shared minimizers: rows (shard, segments,
    bytes) for the segments with a string that no smaller document of the stretch holds, and
    covered runs (known; bytes with their doc and key) for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, places, texts in _stretches(batches):
            order = np.argsort(np.array(ids), kind="stable")
            segments, hashes, pieces = [], [], []
            for k in order:
                h, first, last = minimizers(texts[k])
                nth = np.unique(np.array(places[k], np.int64))
                own = np.empty(len(nth), _SEGMENT)
                own["doc"], own["key"], own["start"], own["windows"] = ids[k], keys[k], first[nth], last[nth] - first[nth] + 1
                segments.append(own)
                hashes.append(h[nth])
                pieces += [texts[k][a : b + LENGTH] for a, b in zip(first[nth], last[nth], strict=True)]
            segments, hashes = np.concatenate(segments), np.concatenate(hashes)
            if not len(segments):
                continue
            text = np.concatenate(pieces)
            begins = np.cumsum(segments["windows"] + LENGTH - 1) - (segments["windows"] + LENGTH - 1)
            suffixes = _keys(text, np.repeat(begins, segments["windows"]) + _within(segments["windows"]))
            flags = matched(np.repeat(segments["doc"], segments["windows"]), suffixes)
            # what is known already passes through the shards
            out = [(key % shards, None, p, d, key) for d, key, p in _runs(segments, flags)]
            fresh = np.add.reduceat(~flags, np.cumsum(segments["windows"]) - segments["windows"]) > 0
            numbers = np.flatnonzero(fresh)
            for shard, chosen in _dealt(numbers, hashes[numbers] % np.uint64(shards)):
                out.append((shard, segments[chosen].tobytes(), b"".join(pieces[c].tobytes() for c in chosen), 0, 0))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["shard", "segments", "bytes", "doc", "key"])

    return run


def _found(pdf: pd.DataFrame) -> pd.DataFrame:
    """Covered runs of the documents of a shard."""
    known = pdf["segments"].isna()
    out = list(zip(pdf["doc"][known], pdf["key"][known], pdf["bytes"][known], strict=True))
    rest = pdf[~known]
    if len(rest):
        segments = np.concatenate([np.frombuffer(s, _SEGMENT) for s in rest["segments"]])
        text = np.frombuffer(b"".join(rest["bytes"]), np.uint8)
        sizes = segments["windows"] + LENGTH - 1
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(segments["doc"], kind="stable")
        segments, begins = segments[order], begins[order]
        starts = np.repeat(begins, segments["windows"]) + _within(segments["windows"])
        out += _runs(segments, matched(np.repeat(segments["doc"], segments["windows"]), _keys(text, starts)))
    return pd.DataFrame({"doc": [o[0] for o in out], "key": [o[1] for o in out], "runs": [o[2] for o in out]})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes covered runs: from rows (.., text, runs, whole) to (.., text, bytes, removed, spans)."""
    for batch in sliced(batches, 128):
        n = batch.num_columns - 3
        kept, sizes, removed, spans = [], [], [], []
        for text, runs, whole in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True):
            raw = _raw(text)
            sizes.append(len(raw))
            cover = np.zeros(len(raw) + 1, np.int32)
            if whole and len(raw) >= LENGTH:
                cover[0] = 1
            elif runs:
                pairs = np.concatenate([np.frombuffer(r, np.int64) for r in runs]).reshape(-1, 2)
                np.add.at(cover, pairs[:, 0], 1)
                np.add.at(cover, pairs[:, 1], -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0)
            kept.append(raw[~gone].tobytes() if removed[-1] else raw.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=[*batch.schema.names[:n], "suffix__kept", "suffix__bytes", "suffix__removed", "suffix__spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``suffix__kept`` (binary: what is left may cut through a character),
    ``suffix__bytes``, ``suffix__removed`` and ``suffix__spans``."""
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hashes = ["suffix__h", "suffix__g"]
    base = docs.select(ident.alias("doc"), text.alias("text")).where("doc is not null")
    marked = base.withColumns({"suffix__h": F.xxhash64("text"), "suffix__g": F.xxhash64(F.lit(1), F.col("text"))})
    # of equal texts the one with the least id stands for all
    copies = settle(marked.select("doc", *hashes, F.octet_length("text").alias("size")).groupBy(*hashes).agg(F.min("doc").alias("least"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")))
    total = copies.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    buckets, shards = max(12, -(-total // PER_BUCKET)), max(12, -(-total // PER_SHARD))
    own = marked.where(F.octet_length("text") >= LENGTH).select("doc", F.col("suffix__h").alias("key"), "text")
    shared = settle(own.mapInArrow(_posted(buckets), "bucket int, rows binary, known boolean").groupBy("bucket").applyInPandas(_shared, "doc long, key long, nth int"))
    places = shared.groupBy("doc", "key").agg(F.collect_list("nth").alias("nths"))
    firsts = copies.select(F.col("least").alias("doc"), F.col("suffix__h").alias("key"), F.col("suffix__g").alias("suffix__g_"))
    # one small table decides which texts take part, so the texts move once
    chosen = marked.withColumnRenamed("suffix__h", "key").join(places.join(firsts, ["doc", "key"]), ["doc", "key"]).where("suffix__g = suffix__g_").select("doc", "key", "nths", "text")
    sent = chosen.mapInArrow(_sent(shards), "shard int, segments binary, bytes binary, doc long, key long")
    found = settle(sent.groupBy("shard").applyInPandas(_found, "doc long, key long, runs binary"))
    runs = found.groupBy(F.col("doc").alias("suffix__doc"), F.col("key").alias("suffix__h")).agg(F.collect_list("runs").alias("suffix__runs"))
    # copies of an earlier document go whole; their ids, not their texts, meet the hashes
    ids = docs.select(ident.alias("suffix__of"), F.xxhash64(text).alias("suffix__h"), F.xxhash64(F.lit(1), text).alias("suffix__g")).where("suffix__of is not null")
    whole = ids.join(copies.where("n > 1").select(*hashes, "least"), hashes).where("suffix__of > least").select(F.col("suffix__of").alias("suffix__doc"), "suffix__h").distinct()
    facts = settle(whole.select("suffix__doc", "suffix__h", F.lit(True).alias("suffix__whole"), F.lit(None).cast("array<binary>").alias("suffix__runs")).union(runs.select("suffix__doc", "suffix__h", F.lit(False), "suffix__runs")))
    facts = facts.withColumnRenamed("suffix__h", "suffix__h_")
    rows = docs.withColumns({"suffix__id": ident, "suffix__h": F.xxhash64(text)})
    joined = rows.join(facts, (F.col("suffix__id") == F.col("suffix__doc")) & (F.col("suffix__h") == F.col("suffix__h_")), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    last = joined.select(*own, text.alias("suffix__text"), "suffix__runs", "suffix__whole")
    fields = [T.StructField("suffix__kept", T.BinaryType()), *(T.StructField(f"suffix__{c}", T.LongType()) for c in ("bytes", "removed", "spans"))]
    return last.mapInArrow(_cut, T.StructType([*docs.schema.fields, *fields]))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeats(docs)
    return done.select("doc_id", F.col("suffix__bytes").alias("n_bytes"), F.col("suffix__removed").alias("n_removed"), F.col("suffix__spans").alias("n_spans"), F.sha2("suffix__kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
h AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS p FROM w JOIN m ON w.k = m.k WHERE least < w.doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY 1, 2),
k AS (SELECT *, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM r),
t AS (SELECT d.doc_id, count(*) AS spans, sum(z - a) AS removed, max(z) AS z, string_agg(hex(b[y:a - 1]), '' ORDER BY a) AS head FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY 1)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(b[coalesce(z, 1):]))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
