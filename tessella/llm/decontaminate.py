"""Benchmark decontamination by pigeonhole edit matching.

A test item of n bytes may occur with up to k = n div 20 edits. It is split into k + 1 pieces;
an occurrence leaves at least one of them untouched, so all exact hits of all pieces (one
Aho-Corasick pass of each document) lead to every occurrence. Around the hits the item is
searched with Myers' bit-parallel edit distance. Items and documents are compared as lower-cased
words with single spaces. Documents are read once, whole, and nothing is shuffled; the test set
goes to the executors in blocks of bounded size, one pass for each block.

Results in odd cases: a null or blank item matches nothing, a null or blank document holds
nothing; items whose words are equal count as the one with the least id; an item found several
times in a document is reported once, where it is nearest (then first); rows that repeat a
doc_id are each searched; an item of fewer than 20 bytes must occur exactly and from word start
to word end; a null item id counts like any other; extra columns pass through; an empty test
set finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, settle, sliced, words

#: Bytes of an item for each edit allowed; bytes of test items in a block (some fifty times as much
#: as an automaton); rows that are searched at a time.
BYTES_PER_EDIT, BLOCK, ROWS = 20, 2 << 20, 128


def normal(text: str | None) -> str:
    """Lower-cased words with single spaces, a character for each byte."""
    return b" ".join(words(text)).decode("latin-1")


def myers(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """Edit distance of ``pattern`` to the nearest substring of ``text`` that ends at each
    place (to the prefix that ends there, if anchored), bit-parallel over the pattern."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    vp, vn, score, out = full, 0, m, []
    for c in text:
        x = masks.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hp, hn = vn | (full & ~(vp | d0)), vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 | anchored
        vp = full & (hn << 1 | ~(d0 | hp))
        vn = hp & d0 & full
        out.append(score)
    return out


class Searcher:
    """All pieces of a block of items in one automaton. ``items``: (id, normalised text)."""

    def __init__(self, items: list[tuple[int | None, str]], per_edit: int):
        import ahocorasick

        self.items, self.edits, pieces = items, [], {}
        for number, (_, text) in enumerate(items):
            k = len(text) // per_edit
            self.edits.append(k)
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((number, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def _regions(self, text: str) -> dict[int, list[list[int]]]:
        """Item to the stretches of the text where an occurrence may lie."""
        found: dict[int, list[list[int]]] = {}
        for end, places in self.automaton.iter(text):
            for number, offset in places:
                start, k = end + 1 - offset, self.edits[number]
                a, b = max(0, start - k), min(len(text), start + len(self.items[number][1]) + k)
                own = found.setdefault(number, [])
                if own and a <= own[-1][1]:  # hits come in order of their end; a longer offset may begin earlier
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        return found

    def search(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, edits, first byte, last byte + 1) of every item found, in order of items."""
        if not self.any or not text:
            return []
        out = []
        for number, regions in sorted(self._regions(text).items()):
            ident, item = self.items[number]
            k, best = self.edits[number], None
            if k == 0:  # short: whole words only
                at = f" {text} ".find(f" {item} ")
                if at >= 0:
                    out.append((ident, 0, at, at + len(item)))
                continue
            for a, b in regions:
                part = text[a:b]
                at = part.find(item)
                if at >= 0:
                    best = (0, a + at, a + at + len(item))
                    break
                scores = myers(item, part)
                least = min(scores)
                if least <= k and (best is None or least < best[0]):
                    end = scores.index(least) + 1
                    back = myers(item[::-1], part[:end][::-1], anchored=True)
                    best = (least, a + end - back.index(least) - 1, a + end)
            if best:
                out.append((ident, *best))
        return out


_ITEM = T.ArrayType(T.LongType())
_FOUND = ("decontaminate__items", "decontaminate__edits", "decontaminate__starts", "decontaminate__ends")


def find_items(docs: DataFrame, benchmark: DataFrame, per_edit: int = BYTES_PER_EDIT, block: int = BLOCK, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` plus four parallel arrays, empty for a clean row: the ids of the items found,
    their edits, and where they begin and end in the normalised text.

    A test set of one block is one pass without a shuffle. Of a larger one every block is a pass
    that returns only what it found, by the hashes of the texts, and ``docs`` meet that once."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block) or 1
    shipped = []
    for number in range(blocks):
        # about block bytes by the hash of the text, so equal items share a block
        rows = items.where(F.pmod(F.xxhash64(F.lower("text")), F.lit(blocks)) == number).collect()
        least: dict[str, int | None] = {}
        for ident, text in sorted(((r["id"], normal(r["text"])) for r in rows), key=lambda x: (x[0] is None, x[0] or 0)):
            if text:
                least.setdefault(text, ident)
        shipped.append(spark.sparkContext.broadcast(tuple((i, t) for t, i in least.items())))
    text = F.col(f"`{text_col}`").cast("string")
    if blocks == 1:
        return _search(docs, text, shipped[0], per_edit)
    keys = {"decontaminate__h": F.xxhash64(text), "decontaminate__g": F.xxhash64(F.lit(1), text)}
    texts = docs.where(F.length(text) > 0).select(text.alias("decontaminate__whole"))
    hits = [_search(texts, F.col("decontaminate__whole"), s, per_edit).where(F.size(_FOUND[0]) > 0) for s in shipped]
    parts = settle(reduce(DataFrame.union, [h.select(F.xxhash64("decontaminate__whole").alias("decontaminate__x"), F.xxhash64(F.lit(1), F.col("decontaminate__whole")).alias("decontaminate__y"), F.lit(k).alias("block"), *_FOUND) for k, h in enumerate(hits)]))
    once = parts.dropDuplicates(["decontaminate__x", "decontaminate__y", "block"])
    merged = once.groupBy("decontaminate__x", "decontaminate__y").agg(F.array_sort(F.collect_list(F.struct("block", *_FOUND))).alias("decontaminate__all"))
    joined = docs.withColumns(keys).join(merged, (F.col("decontaminate__h") == F.col("decontaminate__x")) & (F.col("decontaminate__g") == F.col("decontaminate__y")), "left")
    lists = [F.coalesce(F.flatten(F.col(f"decontaminate__all.{c}")), F.array().cast("array<bigint>")).alias(c) for c in _FOUND]
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *lists)


def _search(docs: DataFrame, text: Column, shipped, per_edit: int) -> DataFrame:
    frame = docs.select(*[F.col(f"`{c}`") for c in docs.columns], text.alias("decontaminate__text"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, _ITEM) for c in _FOUND)])
    key = ("items", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = only(key, lambda: Searcher(list(shipped.value), per_edit))
        for batch in sliced(batches, ROWS):
            found = [searcher.search(normal(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *_FOUND])

    return frame.mapInArrow(run, schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each test item found in a document: doc_id, item_id, edits, first_byte,
    end_byte (of the normalised text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    row = found.select("doc_id", F.explode(F.arrays_zip(*_FOUND)).alias("x"))
    return row.select("doc_id", F.col(f"x.{_FOUND[0]}").alias("item_id"), F.col(f"x.{_FOUND[1]}").alias("edits"), F.col(f"x.{_FOUND[2]}").alias("first_byte"), F.col(f"x.{_FOUND[3]}").alias("end_byte"))
