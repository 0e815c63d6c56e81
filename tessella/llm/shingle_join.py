"""N-gram Jaccard join with a count-vector R-tree.

A document's set are the hashes of its five-word shingles; two documents link at a similarity
of 0.75. Equal sets are one class. Linked sets share so many shingles that each must share one
of its rarest (prefix filter, below), so classes meet in blocks: the shingle's documents around
the least of them. In a block, shingles are hashed to groups, every class is the point of its
group counts, and the points are indexed in an R-tree. The overlap of two sets is at most the
sum of the lesser counts of each group, and for a node the sum of the lesser of a count and the
node's greatest count; what this bound leaves is verified on the sets themselves. A pair already
connected in its block is skipped, so a block of near copies costs links, not pairs.

Prefix filter. With sets ordered by one global order, sets of overlap o share l of their first
n - o + l elements. The first ``PREFIX`` part of a set by hash (shingles in more than a 2000th of
the documents last) is taken such that linked sets share l = about a tenth of it; of that part,
ordered by how many parts hold each shingle, all but the last l - 1 must then have one in
common. A document whose part is rare enough throughout stays alone. Shingles common in the
corpus are few by their definition (2000 times the mean set size at most), so the ``COMMON_MOST``
most frequent (eight bytes each) are broadcast; they, and passages that many documents share, fall
out of the part unless a document is made of them. Blocks of more than ``TILE`` classes are
compared tile by tile. No link is lost.

The result are components; links are not counted, as pairs of one component are not all verified.

Results in odd cases: a null text or one without words has an empty set and links with nothing;
fewer than five words are one shingle; rows that repeat an id are one node of the graph, with
the links of all its texts; a null id is no node: its component is null; ids must be whole numbers
(a text id that is none stops with a cast error); very long texts are read whole; an empty table
gives an empty table, and columns beyond id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import components, settle, sliced, words

WORDS, PERCENT = 5, 75
#: Part of a set by which linked documents must share more than one shingle.
SLACK = 0.10
COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 2000, 64, 2_000_000
#: Classes of a tile; shingles for each bucket; documents for each task group; points of a leaf.
TILE, PER_BUCKET, PER_GROUP, LEAF, FAN = 1024, 500_000, 256, 32, 8
STRETCH = 4 << 20
_POST = np.dtype([("hash", "<u8"), ("doc", "<i8")])
_DOC = np.dtype([("doc", "<i8"), ("plain", "<i4"), ("take", "<i4")])
_RARE = np.dtype([("doc", "<i8"), ("hash", "<u8"), ("parts", "<i4")])
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        found = self[word] = xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The ascending distinct shingle hashes of a text."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    width = min(WORDS, len(w))
    s = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        s = s * _A + w[k : len(w) - width + 1 + k]
    return np.unique(_mixed(s))


def _sums(s: np.ndarray) -> tuple[int, int, int]:
    """Size of a set and two sums that stand for it."""
    return len(s), int(s.sum().astype(np.int64)), int(_mixed(s ^ _A).sum().astype(np.int64))


def class_key(s: np.ndarray) -> int:
    """A number for a set: equal sets have the same."""
    n, one, two = (np.array([x], np.int64).astype(np.uint64) for x in _sums(s))
    return int(_mixed(two ^ _mixed(one ^ _mixed(n ^ _A))).astype(np.int64)[0])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of stretches of documents of about STRETCH characters."""
    ids, sets, held = [], [], 0
    for batch in sliced(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            sets.append(shingles(t))
            held += len(t or "")
            if held >= STRETCH:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n, two sums that stand for the set, its class key), and (hash, n) of shingles that are common
    in a stretch."""
    for ids, sets in _stretches(batches):
        n, one, two = zip(*map(_sums, sets), strict=True)
        cls = [class_key(s) for s in sets]
        hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= max(2, len(sets) / COMMON_SHARE)
        hashes, counts = hashes[often].astype(np.int64), counts[often].astype(np.int64)
        none, blank = pa.nulls(len(hashes), pa.int64()), pa.nulls(len(ids), pa.int64())
        columns = [pa.concat_arrays([pa.array(a, pa.int64()), b]) for a, b in ((ids, none), (n, none), (one, none), (two, none), (cls, none))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.concat_arrays([blank, pa.array(x)]) for x in (hashes, counts))], names=["doc", "n", "one", "two", "cls", "hash", "seen"])


def _lengths(n: int) -> tuple[int, int]:
    """Of a set of n: how many elements its part takes, and how many of these linked sets share
    at least."""
    least = -(-PERCENT * n // 100)
    share = int(SLACK * PERCENT * n / 100)  # no more than a tenth of any set that n can link with
    extra = -int(-SLACK * n // 1)
    return min(n, n - least + max(1, extra)), max(1, share)


def _posted(shipped, buckets: int):
    """Rows (bucket, kind, payload): postings (kind 0) of the plain shingles of each part, dealt
    by hash, and (kind 1) what is known of the set, dealt by class key; the common shingles of a
    part (kind 2). A class posts once in each stretch that holds it, whatever the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shipped.value
        for _, sets in _stretches(batches):
            posts, docs, rest, met = [], [], [], set()
            for s in sets:
                if not len(s) or (i := class_key(s)) in met:
                    continue
                met.add(i)
                often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                take, share = _lengths(len(s))
                plain, hot = s[~often][:take], s[often]
                hot = hot[: take - len(plain)]
                docs.append((i, len(plain), take - share + 1))
                posts.append(_rows(plain, i))
                rest.append(_rows(hot, i))
            if not docs:
                continue
            docs = np.array(docs, _DOC)
            out = [(b, 0, p) for b, p in _dealt(posts, "hash", buckets)] + [(b, 2, p) for b, p in _dealt(rest, "doc", buckets)] + [(b, 1, p) for b, p in _dealt([docs], "doc", buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "rows"])

    return run


def _rows(hashes: np.ndarray, doc: int) -> np.ndarray:
    rows = np.empty(len(hashes), _POST)
    rows["hash"], rows["doc"] = hashes, doc
    return rows


def _dealt(parts: list[np.ndarray], by: str, buckets: int) -> list[tuple[int, bytes]]:
    rows = np.concatenate(parts)
    to = (_mixed(rows[by].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    numbers, first = np.unique(to[order], return_index=True)
    return [(int(n), p.tobytes()) for n, p in zip(numbers, np.split(rows[order], first[1:]), strict=True)] if len(rows) else []


def _once(rows: np.ndarray) -> np.ndarray:
    """Each (doc, hash) once: a class that stands in several stretches has posted in all of them."""
    rows = rows[np.lexsort((rows["doc"], rows["hash"]))]
    return rows[np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["hash"][1:] != rows["hash"][:-1])])] if len(rows) else rows


def _of_kind(pdf: pd.DataFrame, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["rows"][pdf["kind"] == kind]), dtype)


def _counted(buckets: int):
    """Counts the parts that hold each shingle; those of one go no further. Kinds 1 and 2 pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        posts = _once(_of_kind(pdf, 0, _POST))
        _, place, n = np.unique(posts["hash"], return_inverse=True, return_counts=True)
        several = n[place] > 1 if len(posts) else np.empty(0, bool)
        rare = np.empty(int(several.sum()), _RARE)
        rare["doc"], rare["hash"], rare["parts"] = posts["doc"][several], posts["hash"][several], n[place][several] if len(posts) else []
        out = [(b, 3, p) for b, p in _dealt([rare], "doc", buckets)]
        out += [(b, k, r) for b, k, r in zip(pdf["bucket"], pdf["kind"], pdf["rows"], strict=True) if k]
        return pd.DataFrame(out, columns=["bucket", "kind", "rows"])

    return run


def _prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """(hash, doc) for the shingles by which a document can meet another one."""
    docs, rare, hot = _of_kind(pdf, 1, _DOC), _of_kind(pdf, 3, _RARE), _once(_of_kind(pdf, 2, _POST))
    docs = docs[np.argsort(docs["doc"], kind="stable")]
    docs = docs[np.concatenate([[True], docs["doc"][1:] != docs["doc"][:-1]])] if len(docs) else docs
    known = np.concatenate([rare["doc"], hot["doc"]])
    count = np.concatenate([rare["parts"].astype(np.int64), np.full(len(hot), np.iinfo(np.int64).max)])
    hashes = np.concatenate([rare["hash"], hot["hash"]])
    order = np.lexsort((hashes, count, known))
    known, hashes = known[order], hashes[order]
    at = np.searchsorted(docs["doc"], known)
    begin = np.searchsorted(known, docs["doc"])
    several = np.bincount(np.searchsorted(docs["doc"], rare["doc"]), minlength=len(docs))
    alone = np.maximum(docs["plain"] - several, 0)
    use = docs["take"] - alone
    keep = np.arange(len(known)) - begin[at] < use[at] if len(known) else np.empty(0, bool)
    return pd.DataFrame({"hash": hashes[keep].astype(np.int64), "doc": known[keep]})


class CountTree:
    """An R-tree over count vectors, loaded in bulk. Points are ordered by set size in slabs,
    then by their least shingle, so copies lie together; a node keeps the greatest count of
    each group and the range of set sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        groups = 1 << int(np.clip(np.ceil(np.log2(max(1, np.median(self.sizes)) / 3)), 4, 12))
        self.points = np.zeros((len(sets), groups), np.uint16 if self.sizes.max() < 1 << 16 else np.uint32)
        for row, s in zip(self.points, sets, strict=True):
            row[:] = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        rank = np.argsort(np.argsort(self.sizes, kind="stable"), kind="stable")
        self.order = np.lexsort(([int(s[0]) for s in sets], rank // max(LEAF * FAN, 1)))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low_n, high_n, fan = self.points[self.order], self.sizes[self.order], self.sizes[self.order], LEAF
        while len(high) > 1 and (len(high) > LEAF or not self.levels):
            cut = np.arange(0, len(high), fan)
            high, low_n, high_n, fan = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut), FAN
            self.levels.append((high, low_n, high_n))

    @staticmethod
    def _may(point: np.ndarray, size: int, high: np.ndarray, low_n: np.ndarray, high_n: np.ndarray) -> np.ndarray:
        fits = (100 * high_n >= PERCENT * size) & (PERCENT * low_n <= 100 * size)
        need = PERCENT * (size + np.maximum(low_n, -(-PERCENT * size // 100)))  # 100 o >= 75 (a + b - o)
        if fits.any():
            fits[fits] = (100 + PERCENT) * np.minimum(high[fits], point).sum(axis=1, dtype=np.int64) >= need[fits]
        return fits

    def candidates(self, k: int) -> np.ndarray:
        """Points whose overlap with point k may suffice."""
        point, size = self.points[k], int(self.sizes[k])
        nodes = None
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[depth]
            if nodes is None:
                nodes = np.arange(len(high))
            nodes = nodes[self._may(point, size, high[nodes], low_n[nodes], high_n[nodes])]
            fan = LEAF if depth == 0 else FAN
            below = len(self.points) if depth == 0 else len(self.levels[depth - 1][0])
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes = nodes[nodes < below]
        found = self.order[nodes] if nodes is not None else np.arange(len(self.points))
        return found[self._may(point, size, self.points[found], self.sizes[found], self.sizes[found])]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def forest(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all that links connect: no pair is verified whose ends already are."""
    tree, root = CountTree(sets), list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in range(len(sets)):
        for j in tree.candidates(k):
            if j > k and find(k) != find(j) and linked(sets[k], sets[j]):
                root[find(j)] = find(k)
                out.append((int(ids[k]), int(ids[j])))
    return out


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    out, memory = [], {}
    pdf = pdf.sort_values(["center", "left", "right", "doc"])
    rep = dict(zip(pdf["doc"], pdf["rep"], strict=True))
    for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
        if doc not in memory and class_key(found := shingles(text)) == doc:  # else another text of the same id
            memory[doc] = found
    for _, task in pdf.groupby(["center", "left", "right"], sort=False):
        ids = task["doc"].drop_duplicates().to_numpy()
        out += [(rep[a], rep[b]) for a, b in forest(ids, [memory[i] for i in ids])]
    return pd.DataFrame(out, columns=["u", "v"])


def link_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, component) for every row of ``docs``: its id, set size, and least reachable id."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    facts = settle(base.mapInArrow(_facts, "doc long, n long, one long, two long, cls long, hash long, seen long"))
    known = facts.where("n is not null").select("doc", "n", "one", "two", "cls")
    rows, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = facts.where("hash is not null").groupBy("hash").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(COMMON_LEAST, rows // COMMON_SHARE))
    # each of them takes a 2000th of the rows out of the sum of all set sizes. Where that allows for
    # very many, the most frequent are enough: which shingles come last loses no link
    common = common.orderBy(F.desc("seen"), "hash").limit(COMMON_MOST).select("hash").toPandas()["hash"]
    shipped = spark.sparkContext.broadcast(np.sort(common.to_numpy(np.int64).astype(np.uint64)))
    own = settle(_classes(known.where("n > 0 and doc is not null")))

    buckets = max(12, -(-total // PER_BUCKET))
    step = "bucket int, kind int, rows binary"
    posted = base.where("doc is not null").mapInArrow(_posted(shipped, buckets), step)
    counted = posted.groupBy("bucket").applyInPandas(_counted(buckets), step)
    prefixes = settle(counted.groupBy("bucket").applyInPandas(_prefixes, "hash long, doc long"))

    centers = settle(prefixes.groupBy("hash").agg(F.min("doc").alias("center"), F.max("doc").alias("most")).where("center < most").select("hash", "center"))
    around = settle(prefixes.join(centers, "hash").select("center", "doc").distinct())
    members = around.join(own.select(F.col("cls").alias("doc"), "rep").distinct(), "doc")
    sizes = settle(members.groupBy("center").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))  # written: a large block's join can be split
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    at = F.pmod(F.xxhash64("doc"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(F.least(at, j).alias("left"), F.greatest(at, j).alias("right")))
    tasks = settle(members.join(sizes, "center").select("doc", "rep", "center", F.explode(pairs).alias("t")).select("doc", "rep", "center", "t.left", "t.right"))
    groups = max(12, -(-tasks.count() // PER_GROUP))
    # tasks grow with the corpus: their join is never a broadcast, at no size
    texts = tasks.hint("merge").join(base.withColumnRenamed("doc", "rep"), "rep").withColumn("group", F.pmod(F.xxhash64("center", "left", "right"), F.lit(groups)))
    links = settle(texts.groupBy("group").applyInPandas(_blocks, "u long, v long"))

    # an id with several texts joins their classes; a class needs no links inside
    several = own.groupBy("doc").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("doc", "least")
    bridges = own.join(several, "doc").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    joined = components(links.union(bridges))
    of = own.groupBy("doc").agg(F.min("rep").alias("rep")).join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("doc", F.coalesce("component", "rep").alias("component"))
    return known.join(of, "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def _classes(known: DataFrame) -> DataFrame:
    """(doc, rep, cls): the least id with an equal set, and the set's class key. The least ids are
    written, so the join has both its exchanges to itself and those of a large class can be split."""
    same = ["n", "one", "two", "cls"]
    least = settle(known.groupBy(*same).agg(F.min("doc").alias("rep")))
    return known.join(least, same).select("doc", "rep", "cls").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not the least of its component."""
    gone = link_table(docs, id_col, text_col).where("component < doc").select(F.col("doc").alias("shingles__gone")).distinct()
    return docs.join(settle(gone), F.col(f"`{id_col}`").cast("long") == F.col("shingles__gone"), "left_anti")


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_table(docs).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s
  FROM split),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.y FROM reach r JOIN way w ON r.seen = w.x)
SELECT d.doc_id, coalesce(max(z.n), 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN size z ON z.doc_id = d.doc_id
GROUP BY d.doc_id
"""
