"""Properties and small cases that the catalogue does not reach."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella import session
from tessella.functions import strings
from tessella.operators import arrays, calls, exchange, graph, membership, queues, reduce, scan
from tessella.operators.keyed import KeyedTable
from tessella.operators.matrix import Matrix
from tessella.plans import catalogue
from tessella.plans.layout import Blocking, Team, block_matmul, factor, same_layout, split_world
from tessella.sources import matrix_files
from tessella.streaming import live_queue


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_map_upsert_keeps_what_is_not_written(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "key string, value int, seq long")
    made = KeyedTable(old, ("key",), ("value",)).insert_or_assign(new, ["seq"])
    assert rows(made.scan(), "key") == [("a", 1), ("b", 6), ("c", 7)]
    first = KeyedTable(old, ("key",), ("value",)).insert_first(new, ["seq"])
    assert rows(first.scan(), "key") == [("a", 1), ("b", 2), ("c", 7)]
    assert first.local_scan().count() == 3


def test_map_array_values(spark):
    writes = spark.range(400).select((F.col("id") % 4).alias("key"), F.array_repeat(F.col("id"), 100).alias("value"), F.col("id").alias("seq"))
    got = KeyedTable.load(writes, ["key"], ["value"], ["seq"]).scan().collect()
    assert all(set(r["value"]) == {396 + r["key"]} for r in got)


def test_find_or_insert_returns_table(spark):
    old = KeyedTable(spark.createDataFrame([(1, 10)], "k long, v int"), ("k",), ("v",))
    seen, table = old.find_or_insert(spark.createDataFrame([(1, 0), (2, 1), (2, 2)], "k long, at int"), {"v": F.col("at") + 5}, ["at"])
    assert rows(seen, "at") == [(1, 0, 10, False), (2, 1, 6, True), (2, 2, 6, False)]
    assert rows(table.scan(), "k") == [(1, 10), (2, 6)]
    twice, _ = table.find_or_insert(spark.createDataFrame([(2, 9)], "k long, at int"), {"v": F.col("at")}, ["at"])
    assert rows(twice) == [(2, 9, 6, False)]


def test_bloom_sizes_and_rates(spark):
    assert membership.sizing(5000) == (3449, 7)
    inside = spark.range(2000).select(F.col("id").alias("x"))
    bloom = membership.BlockedBloom.build(inside, "x", 2000)
    assert bloom.test(inside, "x").where("not maybe").count() == 0
    outside = spark.range(10_000, 30_000).select(F.col("id").alias("x"))
    assert bloom.test(outside, "x").where("maybe").count() < 400
    more = bloom.insert(outside.limit(10), "x")
    assert more.test(outside.limit(10), "x").where("not maybe").count() == 0
    before, _ = bloom.insert_seen(outside, "x")
    assert before.where("maybe").count() < 400


def test_bloom_semijoin_without_a_small_filter(spark, monkeypatch):
    probes, build = spark.range(100).toDF("a"), spark.range(0, 300, 3).toDF("b")
    for limit in (membership.BROADCAST, 0):
        monkeypatch.setattr(membership, "BROADCAST", limit)
        assert membership.bloom_semijoin(probes, "a", build, "b", 100).count() == 34


def test_exchange_capacity(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("dest"), F.col("id").alias("seq"))
    ok, no = exchange.distribute_batches(df, "dest", 3, 10, ["seq"])
    assert (ok.count(), no.count()) == (30, 70)
    assert ok.withColumn("p", F.spark_partition_id()).where("p <> dest").count() == 0


def test_scan_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (3, 1), (-5, 9)], "x int, y int")
    got = rows(scan.ticket(df, ["x", "y"]), "ticket")
    assert got == [(None, 1, 0), (-5, 9, 1), (3, 1, 2), (3, 2, 3)]
    assert scan.ticket(df.limit(0), ["x", "y"]).count() == 0


@pytest.mark.parametrize("kind", ["skewed", "constant", "string", "date", "tied"])
@pytest.mark.parametrize("op", ["plus", "min", "xor", "swap"])
def test_scan_in_many_cells(spark, kind, op):
    """Groups cut into cells of forty rows, in orders that even widths would not cut."""
    x = {"skewed": "case when id = 0 then 1000000000 else id % 500 end", "constant": "1", "string": "concat('k', lpad(id * 7919 % 1000, 4, '0'))", "date": "date_add(date'2020-01-01', int(id * 31 % 700))", "tied": "id div 300"}[kind]
    df = spark.range(1000).selectExpr("id", "id % 2 as g", f"{x} as x", "id * 37 % 101 as v")
    got = {r["id"]: r["out"] for r in scan.exclusive_scan(df, F.col("v"), ["x", "id"], ["g"], "out", op, per_cell=40).collect()}
    step = {"plus": lambda a, b: a + b, "min": min, "xor": lambda a, b: a ^ b, "swap": lambda a, b: b}[op]
    held = {}
    for r in sorted(df.collect(), key=lambda r: (r["x"], r["id"])):
        assert got[r["id"]] == held.get(r["g"], 0 if op == "plus" else None)
        held[r["g"]] = r["v"] if r["g"] not in held else step(held[r["g"]], r["v"])
    cells = scan.with_cells(df, ["x", "id"], ["g"], 40, 100).groupBy("scan__cell").count().agg(F.max("count")).first()[0]
    assert cells <= (400 if kind == "constant" else 140)


def test_fetch_keeps_the_type(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "c int, at int")
    assert [r[2] for r in rows(reduce.fetch_and_add(df, ["c"], ["at"], F.lit(0.5)), "at")] == [0.0, 0.5, 1.0]
    assert [r[2] for r in rows(reduce.fetch_and("max", df, ["c"], ["at"], F.col("at"), F.lit(2)), "at")] == [2, 2, 2]
    with pytest.raises(ValueError):
        reduce.broadcast_from(df, "c", 1, ["at"], limit=2)


def test_queue_batches_and_whole_pop(spark):
    empty = spark.createDataFrame([], "host int, seq long, batch int, value int")
    pushes = spark.createDataFrame([(0, i, i // 4, i) for i in range(10)], "host int, seq long, batch int, value int")
    q, told = queues.RecordQueue(empty, "host", "seq", 9).push_batches(pushes, "batch")
    assert {r["batch"]: r["accepted"] for r in told.collect()} == {0: True, 1: True, 2: False}
    popped, rest = q.pop(3)
    assert [r[3] for r in rows(popped, "seq")] == [0, 1, 2]
    assert rest.pop(6, whole=True)[0].count() == 0
    assert rest.pop(5, whole=True)[0].count() == 5
    assert queues.RecordQueue(pushes, "host", "seq").push(pushes)[1].where("accepted").count() == 10


def test_queue_checksum_tells_laps(spark):
    q = queues.RecordQueue(spark.range(8).select(F.lit(0).alias("host"), F.col("id").alias("seq"), F.lit(5).alias("v")), "host", "seq")
    sums = [r["checksum"] for r in q.with_checksum("v", 4).orderBy("seq").collect()]
    assert len(set(sums)) == 2 and sums[0] == ~sums[4]


def test_reduce_atomics(spark):
    laps = spark.createDataFrame([(0, i, i, i + 1) for i in range(10)] + [(0, 99, 3, 50)], "cell int, seq int, expected long, desired long")
    assert rows(reduce.compare_and_swap(laps, ["cell"], "seq", "expected", "desired", F.lit(0))) == [(0, 10, 10)]


def test_arrays(spark):
    a = arrays.BlockedArray(spark.range(10).select(F.col("id").alias("idx"), F.col("id").alias("value")), 10, 3)
    assert a.local_size == 4
    assert [r[1] for r in rows(a.last(2).rows, "idx")] == [8, 9]
    assert [r[1] for r in rows(a.first(2).map(lambda v: v * 3).rows, "idx")] == [0, 3]
    assert rows(a.free(1).get(1)) == [(1, None)]
    assert a.fill(F.lit(7)).rows.where("value = 7").count() == 10
    with pytest.raises(IndexError):
        a.get(9, 2)
    with pytest.raises(PySparkException):
        a.put(spark.createDataFrame([(10, 1)], "idx long, value long")).rows.collect()


def test_layout():
    assert factor(12) == (4, 3) and factor(7) == (7, 1)
    assert Team.of([3, 1, 3]).members == (1, 3) and Team.of([3, 1]).resolve(3) == 1 and 2 not in Team.of([1])
    assert [len(t) for t in split_world(10, 3)] == [4, 4, 2]
    assert Blocking.fitted(1000, 10, 8).grid == (8, 1)
    # only columns are split: a hundred thousand rows over eight stay 12 500
    assert Blocking.fitted(100_000, 10, 8).tile == (12_500, 10)
    assert Blocking.fitted(100_000, 100_000, 4).tile == (50_000, 12_500) and Blocking.fitted(4000, 4000, 4).tile == (2000, 1334)
    assert Blocking.square(10).grid == (3, 3) and Blocking.rect(10).grid == (5, 2)
    a, b, c = block_matmul(100, 100, 100, 4)
    assert a.grid[1] == b.grid[0] and c.grid == (2, 2)
    assert Blocking((2, 3), (4, 4)).owner(3, 4) == 1 + 3
    assert same_layout(a, a, (4, 4), (4, 4))


def test_matrix_algebra(spark):
    a = Matrix.fill_range(spark, (13, 9), 7)
    b = Matrix.fill_range(spark, (9, 11), 5)
    to = lambda m: m.cells.toPandas().set_index(["i", "j"])["v"].unstack().to_numpy()
    want = to(a) @ to(b)
    assert np.allclose(to(a.dot(b)), want)
    assert np.allclose(to(a.dot_tiled(b, 4)), want)
    assert np.allclose(to(a.dot(b, salt=3)), want)
    assert np.allclose(to(b.T.dot(a.T)), want.T)
    assert np.allclose(to(a.gemm(b, Matrix.fill_range(spark, (13, 11), 3))), want + np.arange(143).reshape(13, 11) % 3)
    assert np.allclose(to((a + a) - a), to(a)) and np.allclose(to(a * a), to(a) ** 2)
    assert a.fill(2).sum().first()[0] == 234
    with pytest.raises(ValueError):
        a.dot(a)
    csr = Matrix.from_csr(a.to_csr(), a.shape)
    assert csr.allclose(a).first()[0] == 0
    assert np.allclose(to(a.dot(b, salt="auto")), want) and np.allclose(a.dot(b).to_numpy(), want)
    assert np.allclose(to(a.dot(b, F.max)), (to(a)[:, :, None] * to(b)[None]).max(1))
    with pytest.raises(ValueError):
        a.to_numpy(limit=10)
    assert [x.tolist() for x in Matrix(spark.createDataFrame([(2, 1, 5)], "i long, j long, v long"), (4, 3)).gather_csr()] == [[0, 0, 0, 1, 1], [1], [5]]
    assert a.put(spark.createDataFrame([(0, 0, 1.0, 1), (0, 0, 2.0, 2), (0, 0, 9.0, 0)], "i long, j long, v double, at int"), ["at"]).cells.where("i = 0 and j = 0").first()["v"] == 2.0
    assert a.show(1).startswith("13 by 9, 117 entries")
    random = Matrix.random(spark, (5, 4), 3)
    assert random.cells.where("v >= 0 and v < 1").count() == 20 and random.allclose(Matrix.random(spark, (5, 4), 3)).first()[0] == 0
    assert Matrix.zeros(spark, (2, 2)).dot(Matrix.zeros(spark, (2, 2))).cells.count() == 0
    sparse = Matrix(spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double"), (2, 2))
    other = Matrix(spark.createDataFrame([(1, 1, 2.0)], "i long, j long, v double"), (2, 2))
    assert rows((sparse + other).cells, "i") == [(0, 0, 1.0), (1, 1, 2.0)]


def test_gather_shared(spark, tmp_path, monkeypatch):
    """A matrix of any size is gathered without its rows in the driver."""
    cells = spark.range(2000).select((F.col("id") * 7 % 997).alias("i"), (F.col("id") % 13).alias("j"), F.col("id").alias("v"))
    m = Matrix(cells, (1000, 13))
    ptr, columns, values = m.gather_csr()
    pointers, entries = m.gather_shared(str(tmp_path / "csr"))
    assert [r["row_ptr"] for r in pointers.orderBy("i").collect()] == ptr.tolist()
    assert rows(entries, "i", "j") == rows(cells, "i", "j") and entries.count() == len(columns) == len(values)
    monkeypatch.setattr(Matrix, "gather_csr", None)
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    if (data := Path("/root/testdata/sf0.001")).exists():
        assert catalogue.queries()["sp_gather"](spark, str(data)).count() == 1501


def test_matrix_files(spark, tmp_path):
    mtx = tmp_path / "a.mtx"
    mtx.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 4\n1 1 2.5\n2 1 -1\n2 1 9\n3 3 4\n")
    m = matrix_files.read_matrix(spark, str(mtx))
    assert rows(m.cells, "i", "j") == [(0, 0, 2.5), (0, 1, -1.0), (1, 0, -1.0), (2, 2, 4.0)]
    assert matrix_files.matrix_info(spark, str(mtx)).nnz == 4
    out = str(tmp_path / "a.binary")
    matrix_files.write_binary(m, out)
    assert rows(matrix_files.read_matrix(spark, out).cells, "i", "j") == rows(m.cells, "i", "j")
    assert matrix_files.matrix_info(spark, out) == matrix_files.MatrixInfo((3, 3), 4)
    assert rows(matrix_files.read_binary(spark, out, rows=(1, 3)).cells, "i", "j") == [(0, 0, -1.0), (1, 2, 4.0)]
    small = str(tmp_path / "b.binary")
    matrix_files.write_binary(m, small, "<f4", "<i4")
    assert rows(matrix_files.read_binary(spark, small, "<f4", "<i4").cells, "i", "j") == rows(m.cells, "i", "j")
    parts = str(tmp_path / "parts.mtx")
    matrix_files.write_matrix_market(m, parts, parts=3)
    assert rows(matrix_files.read_matrix(spark, parts).cells, "i", "j") == rows(m.cells, "i", "j")
    text = str(tmp_path / "out.mtx")
    matrix_files.write_matrix_market(m, text)
    assert rows(matrix_files.read_matrix_market(spark, text).cells, "i", "j") == rows(m.cells, "i", "j")
    for bad in ("%%Other matrix coordinate real general\n1 1 0\n", "%%MatrixMarket matrix coordinate real skew-symmetric\n1 1 0\n", "%%MatrixMarket matrix coordinate real general\n1 1 1\n2 2 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 1\n2 2 1\n"):
        mtx.write_text(bad)
        with pytest.raises(ValueError):
            matrix_files.read_matrix(spark, str(mtx))
    mtx.write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n0 0\n1 1\n")
    assert rows(matrix_files.read_matrix_market(spark, str(mtx), one_indexed=False).cells, "i") == [(0, 0, 1.0), (1, 1, 1.0)]
    with pytest.raises(ValueError):
        matrix_files.file_type("a.csv")


def test_generators(spark):
    for alpha in (0.0, 1.2):
        g = matrix_files.generate_sparse(spark, (50, 40), 5, alpha)
        assert g.where("j < 0 or j >= 40 or v <> 1").count() == 0
        assert g.groupBy("i").count().count() == 50
    assert matrix_files.uniform_keys(spark, 100, 16).where("value < 0 or value >= 16").count() == 0


def test_strings(spark):
    df = spark.createDataFrame([("ACGTN",), ("TTTTA",)], "s string")
    got = df.select(strings.rcomplement(F.col("s")), strings.canonical(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("NACGT", "ACGTN"), ("TAAAA", "TAAAA")]
    k = spark.createDataFrame([("ACGTACGTACG",), ("TTG",)], "s string")
    back = k.select("s", strings.unpack_kmer(strings.pack_kmer(F.col("s")), F.length("s")).alias("t"))
    assert back.where("s <> t").count() == 0
    assert k.select(F.octet_length(strings.pack_kmer(F.col("s"))).alias("n")).orderBy("n").first()[0] == 1
    with pytest.raises(PySparkException):
        k.select(strings.bounded(F.col("s"), 3)).collect()


def test_contigs(spark, tmp_path):
    text, k = "ACGTTGCAACGGATCCTA", 5
    other = "GGGGGTCCC"
    lines = []
    for s in (text, other):
        for i in range(len(s) - k + 1):
            lines.append(f"{s[i:i + k]} {s[i - 1] if i else 'F'}{s[i + k] if i + k < len(s) else 'F'}")
    path = tmp_path / "kmers.txt"
    path.write_text("\n".join(lines) + "\n")
    kmers = matrix_files.read_kmers(spark, str(path), k)
    assert sorted(r["contig"] for r in graph.contigs(kmers).collect()) == sorted([text, other])
    matrix_files.write_contigs(graph.contigs(kmers), str(tmp_path / "out"), 10)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [text]
    cycle = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "n string, f string")
    assert rows(graph.walk(cycle, "n", "f")) == [("c", "c", 0)]


def test_calls(spark):
    c = spark.range(100).select(F.col("id").alias("call_id"), (F.col("id") % 4).alias("dest"), F.lit(7).alias("a"))
    done = calls.call_at(c, "dest", 4, lambda pdf: pdf.assign(r=pdf["a"] * pdf["a"])[["call_id", "r"]], "call_id long, r int")
    assert done.where("r = 49").count() == 100
    assert calls.launch(spark, 5, lambda i: i * i).agg(F.sum("value")).first()[0] == 30


def test_stream_equals_batch(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    rows_in = spark.range(50).select((F.col("id") % 3).alias("host"), F.col("id").alias("seq"))
    rows_in.union(rows_in).write.parquet(src)
    stream = live_queue.once(live_queue.listen(spark, src, rows_in.schema, 1), "host", "seq")
    live_queue.drain(stream, dst, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(dst).count() == 50
    got = []
    live_queue.deliver(live_queue.listen(spark, src, rows_in.schema), lambda df, _: got.append(df.count()), str(tmp_path / "cp2")).awaitTermination(60)
    assert sum(got) == 100


def test_tasks_grow_with_tables(spark):
    """A large table asks for more partitions of a shuffle, and short shares; what the session names stays."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    given = spark.sparkContext.__dict__.pop("_tessella_shares", {})
    try:
        for k in keys:
            spark.conf.unset(k)
        spark.conf.set(keys[1], "123456")
        session.share_out(spark, 100 << 20)
        assert [spark.conf.get(k) for k in keys] == [str(16 << 20), "123456", "400"]
        session.share_out(spark, 200 << 20)
        session.share_out(spark, 1 << 20)
        assert spark.conf.get(keys[2]) == "800"
        session.share_out(spark, 1 << 40)
        assert spark.conf.get(keys[2]) == "2048"
    finally:
        for k in keys:
            spark.conf.unset(k)
        for k, v in given.items():
            spark.conf.set(k, v)
        spark.sparkContext._tessella_shares = given


def test_chains_are_not_broadcast(spark):
    kmers = spark.createDataFrame([("AC", "F", "G"), ("CG", "A", "T"), ("GT", "C", "F")], "kmer string, bwd string, fwd string")
    found = graph.contigs(kmers)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == [("AC", "ACGT", 3)]


def test_single_files_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    """Neither does one task sort a whole matrix, nor do its rows pass through the driver's Python."""
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "coalesce", None)
    monkeypatch.setattr(frame, "toLocalIterator", None)
    cells = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("i"), (F.col("id") % 11).alias("j"), ((F.col("id") % 97) * -0.37).alias("v"))
    m = Matrix(cells, (300_000, 11))
    text, out = str(tmp_path / "one.mtx"), str(tmp_path / "one.binary")
    matrix_files.write_matrix_market(m, text)
    lines = [p.read_text().splitlines() for p in Path(text).glob("part-*")]
    assert len(lines) == 1 and lines[0][1] == "300000 11 300000"
    assert [int(x.split()[0]) for x in lines[0][2:]] == list(range(1, 300_001))
    assert matrix_files.read_matrix(spark, text).allclose(m, 0, 0).first()[0] == 0
    matrix_files.write_binary(m, out)
    assert Path(out).stat().st_size == 24 + 16 * 300_000 + 8 * 300_001
    assert matrix_files.read_matrix(spark, out).allclose(m, 0, 0).first()[0] == 0
