"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are one class. In each pass a class's key is a string of random
hyperplane bits; all classes are put in order of (label, key), numbered, and each is compared
with its neighbours up to ``window`` places on. Rows whose leading bits agree form a run, and a
run longer than the window is compared throughout, in tiles, so no group of near copies is cut
off by the window. Every comparison is a cosine in double precision.

A pair is found in a pass if its ranks there differ by at most the window or its leading bits
agree. As every row carries its ranks and leading bits of all passes, the task that meets a
pair can tell whether an earlier pass has met it, and counts it only the first time: what
leaves a task is a count for each row and a forest of links, never the pairs. Memory of a task
is bounded by two tiles. Leading bits grow with the log of the number of classes of a label, and
the number of passes with them: a pair at the threshold shares its leading bits in one of them
with a probability of at least ``RECALL`` (the windows come on top), whatever the table's size.

Results in odd cases: a vector that is null, zero or holds null or non-finite components, or
has no label or id, links with nothing and is its own component; vectors of different lengths
never link; rows equal in id, label and vector count as one vector; an id with several vectors
is one node of the graph, and each of them counts the vectors linked with it, whatever their ids;
equal vectors all link; an
empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, settle

THRESHOLD = 0.93
PASSES, WINDOW, BITS, TILE, AT_ONCE = 8, 64, 48, 1024, 4
RECALL, LEAD = 0.95, 8
_TASKS = "array<struct<near__kind:int,near__i:bigint,near__j:bigint,near__run:bigint,near__own:boolean>>"
_GROUP = ["near__label", "near__dim"]


def valid(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def leading_bits(classes: int, window: int) -> int:
    """Bits that cut so many classes into runs of about a window."""
    return min(BITS, max(LEAD, ceil(log2(max(1, classes / window)))))


def enough_passes(lead: int, threshold: float) -> int:
    """Passes after which a pair at the threshold has shared ``lead`` leading bits in one of them
    with probability ``RECALL``, ``PASSES`` at least."""
    same = (1 - acos(min(1.0, max(-1.0, threshold))) / pi) ** lead
    return max(PASSES, ceil(log(1 - RECALL) / log1p(-same))) if 0 < same < 1 else PASSES


def _keys(passes: int, bits: int):
    """Batches (id, vector) to (id, one key for each pass)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            keys = np.zeros((len(pdf), passes), np.int64)
            sizes = pdf["near__dim"].to_numpy()
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([7, int(dim)]).normal(size=(int(dim), passes * bits))
                at = np.flatnonzero(sizes == dim)
                side = np.stack(pdf["near__vector"].iloc[at].to_list()).astype(np.float64) @ planes[dim] > 0
                weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
                keys[at] = side.reshape(len(at), passes, bits) @ weights
            yield pd.DataFrame({"near__rep": pdf["near__rep"], "near__h": pdf["near__h"], "near__label": pdf["near__label"], "near__dim": sizes, "near__keys": list(keys)})

    return run


def _forest_of(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over links a-b between places of ``ids``: (ids, the least id that each reaches)."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root, u, v = np.arange(len(ids)), place[a], place[b]
    while len(u):
        ru, rv = root[u], root[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[order[moved]], ids[order[root[moved]]]


def _compare(threshold: float, window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, left, right = (int(pdf[c].iloc[0]) for c in ("near__kind", "near__i", "near__j"))
        pdf = pdf.sort_values("near__rank")
        rank, own = pdf["near__rank"].to_numpy(), pdf["near__own"].to_numpy()
        ids, cls, weight, nth = (pdf[f"near__{c}"].to_numpy() for c in ("rep", "cls", "copies", "pass"))
        label, dims = pdf["near__label"].to_numpy(), pdf["near__dim"].to_numpy()
        ranks, heads = np.stack(pdf["near__ranks"].to_list()), np.stack(pdf["near__heads"].to_list())
        counts, links = np.zeros(len(pdf), np.int64), []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.stack(pdf["near__vector"].iloc[at].to_list()).astype(np.float64)
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            i, j = at[i], at[j]
            gap = rank[j] - rank[i]
            fits = (label[i] == label[j]) & (nth[i] == nth[j])
            if kind == 0:
                fits &= own[i] & (gap <= window)
            else:
                fits &= gap > window
                if left != right:
                    fits &= own[i] != own[j]
            i, j = i[fits], j[fits]
            met = (np.abs(ranks[i] - ranks[j]) <= window) | (heads[i] == heads[j])
            first = ~(met & (np.arange(met.shape[1]) < nth[i][:, None])).any(axis=1)
            i, j = i[first], j[first]
            np.add.at(counts, i, weight[j])
            np.add.at(counts, j, weight[i])
            links.append((i, j))
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        u, v = _forest_of(ids, a, b)
        some = counts > 0
        return pd.DataFrame({"near__u": np.concatenate([u, ids[some]]), "near__v": np.concatenate([v, cls[some]]), "near__n": np.concatenate([np.zeros(len(u), np.int64), counts[some]])})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vectors`` plus ``near__links`` (other vectors linked directly) and ``near__component``
    (the least id reachable by links, itself included). ``passes``: as many as the size of the
    largest label asks for, if none are given."""
    tile = max(TILE, window)
    vector, ident = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    usable = valid(vector) & ident.isNotNull() & F.col(f"`{label_col}`").isNotNull()
    plain = F.transform(vector, lambda v: v.cast("double") + F.lit(0.0))  # -0.0 + 0.0 is 0.0
    marked = vectors.withColumns({"near__h": F.when(usable, F.xxhash64(plain)), "near__g": F.when(usable, F.xxhash64(F.lit(1), plain)), "near__dim": F.size(vector), "near__label": F.when(usable, F.xxhash64(F.col(f"`{label_col}`").cast("string")))})
    cls = [*_GROUP, "near__h", "near__g"]
    classes = marked.where("near__h is not null").groupBy(*cls, ident.alias("near__id")).agg(F.first(vector).alias("near__vector")).groupBy(*cls).agg(F.min("near__id").alias("near__rep"), F.count(F.lit(1)).alias("near__copies"), F.first("near__vector").alias("near__vector"))
    classes = settle(classes)
    # labels whose runs need more than LEAD bits: one for each window * 2^LEAD classes at most
    large = classes.groupBy(*_GROUP).count().where(F.col("count") > window << LEAD).collect()
    leads = [(r["near__label"], r["near__dim"], leading_bits(r["count"], window)) for r in large]
    passes = passes or enough_passes(max([LEAD, *(x[2] for x in leads)]), threshold)
    lead = F.broadcast(vectors.sparkSession.createDataFrame(leads, "near__label long, near__dim int, near__lead int"))

    # one order over all passes: rank = place in (pass, label, length, key, id)
    kinds = dict(classes.dtypes)
    keyed = classes.select("near__rep", "near__h", *_GROUP, "near__vector").mapInPandas(_keys(passes, BITS), f"near__rep {kinds['near__rep']}, near__h long, near__label long, near__dim int, near__keys array<bigint>")
    long = keyed.select("near__rep", "near__h", *_GROUP, F.posexplode("near__keys").alias("near__pass", "near__key"))
    order = ["near__pass", *_GROUP, "near__key", "near__rep", "near__h"]
    placed = settle(long.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("near__at")))
    sizes = {r["part"]: r["n"] for r in placed.groupBy(F.expr("near__at div 8589934592").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    starts = vectors.sparkSession.createDataFrame(offsets, "near__part long, near__start long")
    ranked = placed.withColumn("near__part", F.expr("near__at div 8589934592")).join(F.broadcast(starts), "near__part").join(lead, _GROUP, "left").select("near__rep", "near__h", *_GROUP, "near__pass", (F.col("near__start") + F.expr("near__at % 8589934592")).alias("near__rank"), F.expr(f"shiftright(near__key, {BITS} - coalesce(near__lead, {LEAD}))").alias("near__head"))
    run = ["near__pass", *_GROUP, "near__head"]
    runs = ranked.groupBy(*run).agg(F.min("near__rank").alias("near__first"), F.count(F.lit(1)).alias("near__size"))
    seen = ranked.join(runs, run).groupBy("near__rep", "near__h", *_GROUP).agg(F.sort_array(F.collect_list(F.struct("near__pass", "near__rank", "near__head", "near__first", "near__size"))).alias("near__seen"))
    rows = settle(classes.join(seen, ["near__rep", "near__h", *_GROUP]).select("near__rep", F.xxhash64(*cls).alias("near__cls"), *_GROUP, "near__copies", "near__vector", "near__seen"))

    found = []
    for start in range(0, passes, AT_ONCE):
        some = rows.select("near__rep", "near__cls", *_GROUP, "near__copies", "near__vector", F.col("near__seen.near__rank").alias("near__ranks"), F.col("near__seen.near__head").alias("near__heads"), F.explode(F.slice("near__seen", start + 1, min(AT_ONCE, passes - start))).alias("s"))
        rank, first, size = F.col("s.near__rank"), F.col("s.near__first"), F.col("s.near__size")
        chunk, at, tiles = F.floor(rank / tile), F.floor((rank - first) / tile).cast("int"), F.ceil(size / tile).cast("int")
        task = lambda kind, i, j, a, own: F.struct(F.lit(kind).alias("near__kind"), i.cast("long").alias("near__i"), j.cast("long").alias("near__j"), a.cast("long").alias("near__run"), own.alias("near__own"))
        own = F.array(task(0, chunk, F.lit(0), F.lit(0), F.lit(True)))
        halo = F.when(rank % tile < window, F.array(task(0, chunk - 1, F.lit(0), F.lit(0), F.lit(False)))).otherwise(F.array().cast(_TASKS))
        inside = F.when(size > window + 1, F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: task(1, F.least(at, j), F.greatest(at, j), first, at <= j))).otherwise(F.array().cast(_TASKS))
        tasks = some.select("near__rep", "near__cls", *_GROUP, "near__copies", "near__vector", "near__ranks", "near__heads", F.col("s.near__pass").alias("near__pass"), rank.alias("near__rank"), F.explode(F.concat(own, halo, inside)).alias("t")).select("*", "t.*").drop("t")
        found.append(settle(tasks.groupBy("near__kind", "near__run", "near__i", "near__j").applyInPandas(_compare(threshold, window), "near__u long, near__v long, near__n long")))
    every = reduce(DataFrame.union, found)
    joined = components(every.where("near__n = 0").select(F.col("near__u").alias("u"), F.col("near__v").alias("v")))
    # by class: an id with several vectors has a count for each
    counts = every.where("near__n > 0").groupBy(F.col("near__u").alias("near__rep"), F.col("near__v").alias("near__cls")).agg(F.sum("near__n").alias("near__n"))
    of = classes.select(*[F.col(c).alias(f"{c}_") for c in cls], "near__rep", F.xxhash64(*cls).alias("near__cls"), "near__copies").join(counts, ["near__rep", "near__cls"], "left").join(joined.withColumnRenamed("id", "near__rep"), "near__rep", "left")
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{c}_") for c in cls))
    out = marked.join(of, on, "left")
    own_cols = [F.col(f"`{c}`") for c in vectors.columns]
    links = F.coalesce(F.col("near__copies") - 1 + F.coalesce("near__n", F.lit(0)), F.lit(0)).cast("long")
    return out.select(*own_cols, links.alias("near__links"), F.coalesce("component", "near__rep", ident.cast("long")).alias("near__component"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    done = link_vectors(vectors)
    return done.select("vec_id", F.col("near__links").alias("n_links"), F.col("near__component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("near__component")).alias("kept"))


#: All pairs of a label, for tables on which that is feasible; the query finds nearly all of them.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
       WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM reach r JOIN link l ON r.seen = l.x),
n AS (SELECT x, count(*) AS links FROM link GROUP BY 1)
SELECT r.vec_id, coalesce(max(links), 0)::BIGINT AS n_links, min(seen) AS component_id, r.vec_id = min(seen) AS kept
FROM reach r LEFT JOIN n ON n.x = r.vec_id GROUP BY r.vec_id
"""
