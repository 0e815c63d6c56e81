"""Line dedup, shingle join, suffix dedup, sharding and scoring against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import context_tree, line_dedup, registry, sharding, shingle_join, suffix_dedup
from tessella.llm.common import components as spark_components
from tessella.llm.common import words

from .helpers import SCHEMA, components, corpus, frame, saved


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (201, 202), (200, 202), (5, 5)]
    got = {r["id"]: r["component"] for r in spark_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert spark_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup_equals_sql_and_rule(spark, tmp_path):
    d = saved(spark, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    got = {r["doc_id"]: tuple(r) for r in registry.queries()["op5_line_dedup"](spark, d).collect()}
    want = {r[0]: r for r in con.sql(registry.oracle_sql()["op5_line_dedup"]).fetchall()}
    assert got == want
    assert sum(r[2] for r in got.values()) == 20
    rule = {}
    texts = {r[0]: r[1] or "" for r in corpus()}
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\f\r"))
    counts = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")})
    for i, t in texts.items():
        kept = [x for x in t.split("\n") if not key(x) or counts[key(x)] < 10]
        rule[i] = (i, t.count("\n") + 1, t.count("\n") + 1 - len(kept), sha("\n".join(kept)))
    assert got == rule


def test_line_dedup_odd_rows(spark):
    rows = [(1, "same\na"), (1, "b\nsame"), (None, "same"), (2, "same"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line_dedup__pos", F.lit(1))
    got = [(r["doc_id"], r["text"], r["line_dedup__dropped"]) for r in line_dedup.dedup_lines(df.drop("line_dedup__pos"), 3).collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 1), (1, "b", 1), (None, "", 1), (2, "", 1), (3, "", 0)], key=str)
    assert line_dedup.dedup_lines(df.limit(0).drop("line_dedup__pos")).count() == 0


def brute_links(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, links


def test_shingle_join_equals_brute_force(spark, tmp_path):
    rows = sorted(corpus(5, 120))
    d = saved(spark, tmp_path, rows)
    sets, links = brute_links([r[1] for r in rows])
    of = components(len(rows), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.queries()["op2_shingle_join"](spark, d).collect()}
    assert got == {r[0]: (len(s), rows[of[k]][0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))}
    assert len(links) > 30
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(registry.oracle_sql()["op2_shingle_join"]).fetchall()} == got


def test_shingle_join_tiles_and_tree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(150):  # one family, whose members differ in two words each
        own = list(base)
        for at in rng.integers(0, 60, 1):
            own[at] = f"x{k}"
        texts.append(" ".join(own))
    monkeypatch.setattr(shingle_join, "TILE", 32)
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    _, links = brute_links(texts)
    got = {r["doc"]: r["component"] for r in shingle_join.link_table(frame(spark, rows)).collect()}
    assert [got[k] for k in range(150)] == components(150, links)
    sets = [shingle_join.shingles(t) for t in texts]
    tree = shingle_join.CountTree(sets)
    for a, b in links:
        assert b in tree.candidates(a) and shingle_join.linked(sets[a], sets[b])


def test_shingle_join_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A B  C\nd e f"), (None, "a b c d e f"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in shingle_join.link_table(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, None), (7, 0, 7)], key=str)
    assert shingle_join.link_table(df.limit(0)).count() == 0
    kept = shingle_join.keep_one(df.withColumn("doc", F.lit(1))).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([5, 5, None, 7], key=str)


def brute_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if seen.setdefault(raw[k : k + 50], i) < i:
                gone[k : k + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out[i] = (i, len(raw), int(gone.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out


def test_suffix_dedup_equals_brute_force(spark, tmp_path):
    rows = corpus(9, 80) + [(10_000 + k, "ab" * 300 + "é" * k, None, None, 0) for k in range(4)]
    d = saved(spark, tmp_path, rows)
    got = {r["doc_id"]: tuple(r) for r in registry.queries()["op6_suffix_dedup"](spark, d).collect()}
    assert got == brute_repeats(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert {r[0]: r for r in con.sql(registry.oracle_sql()["op6_suffix_dedup"]).fetchall()} == got


def test_suffix_family_levels():
    rng = np.random.default_rng(0)
    docs = np.sort(rng.integers(0, 40, 3000))
    keys = np.array([f"{x:03d}" for x in rng.integers(0, 900, 3000)], "S3")
    least: dict = {}
    want = [least.setdefault(k, d) < d for d, k in zip(docs, keys, strict=True)]
    for batch in (50, 333, 5000):
        assert suffix_dedup.matched(docs, keys, batch).tolist() == want
    family = suffix_dedup.IndexFamily()
    for k in range(8):
        family.add(np.sort(np.unique(keys[k * 100 : k * 100 + 100])))
    sizes = [len(x) for x in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 4


def test_suffix_dedup_odd_rows(spark):
    t = "0123456789" * 5
    df = spark.createDataFrame([(1, t), (2, t), (None, t), (1, t), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["suffix__removed"], r["suffix__spans"]) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 50, 1), (None, 0, 0), (1, 0, 0), (3, 0, 0)], key=str)
    # texts under one id: each loses its own matches
    rng = random.Random(5)
    p, y = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (200, 300))
    rows = [(1, p), (2, p + " and more"), (2, y), (2, "x" + p[:120]), (3, y[100:])]
    got = {(r["doc_id"], r["suffix__bytes"]): r["suffix__removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 200): 0, (2, 209): 200, (2, 300): 0, (2, 121): 120, (3, 200): 200}
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def brute_shards(ids, shards):
    """One document at a time: home rows in ring order, then what overflowed, clockwise past full shards."""
    ring = sharding.ring(shards)
    place = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
    room = {s: len(ids) // shards + (s < len(ids) % shards) for s in range(shards)}
    arcs = [[] for _ in ring]
    for i in sorted(ids, key=place):
        arcs[next((k for k, (p, _) in enumerate(ring) if p >= place(i)), 0)].append(i)
    beyond = [i for i in arcs[0] if place(i) > ring[-1][0]]  # past the last point: the ring's end, which its first point owns
    order = [(s, [i for i in arc if i not in beyond] if k == 0 else arc) for k, ((_, s), arc) in enumerate(zip(ring, arcs, strict=True))] + [(ring[0][1], beyond)]
    out, left = {}, []
    for s, arc in order:
        fits = arc[: room[s]]
        room[s] -= len(fits)
        out |= dict.fromkeys(fits, s)
        left.append(arc[len(fits) :])
    home, queue = set(out), []
    for turn in range(2):
        for (s, _), own in zip(order, left, strict=True):
            while queue and room[s]:
                out[queue.pop(0)] = s
                room[s] -= 1
            queue += own if turn == 0 else []
    return out, home


def test_sharding_equals_one_row_at_a_time(spark):
    ids = [None, *range(997)]
    df = spark.createDataFrame([(i, "t" * ((i or 0) % 5)) for i in ids], "doc_id long, text string")
    got = [(r["doc_id"], r["ring__shard"], r["ring__slot"]) for r in sharding.assign_shards(df, 24).collect()]
    counts = Counter(s for _, s, _ in got)
    assert len(got) == 998 and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(x[2] for x in got if x[1] == s) == list(range(counts[s]))
    at = {i: s for i, s, _ in got}
    want, home = brute_shards(ids, 24)
    assert at == want and 0 < len(home) < len(ids)
    more = {r["doc_id"]: r["ring__shard"] for r in sharding.assign_shards(df, 25).collect()}
    assert more == brute_shards(ids, 25)[0]
    assert sum(at[i] != more[i] for i in at) < 0.15 * len(at)  # a plain modulus moves 96 in 100
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_sharding_of_repeated_rows(spark):
    df = spark.createDataFrame([(k % 3, "same" if k % 2 else f"t{k}") for k in range(240)], "doc_id long, text string")
    got = sharding.assign_shards(df, 24).groupBy("ring__shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ring__slot").alias("m")).collect()
    assert len(got) == 24 and all((r["n"], r["m"]) == (10, 10) for r in got)


def test_sharding_flow_conserves_rows():
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts, owners = rng.integers(0, 9, 30).tolist(), rng.integers(0, 4, 30).tolist()
        total = sum(counts)
        capacity = {s: total // 4 + (s < total % 4) for s in range(4)}
        pieces = sharding.flow(counts, owners, capacity)
        for n, cell in zip(counts, pieces, strict=True):
            assert sorted(x for a, b, _, _ in cell for x in range(a, b)) == list(range(n))
        for s, c in capacity.items():
            assert sorted(x for cell in pieces for a, b, t, first in cell if t == s for x in range(first, first + b - a)) == list(range(c))


def test_sharding_query(spark, tmp_path):
    rows = corpus()
    got = {r["doc_id"]: r for r in registry.queries()["op10_sharding"](spark, saved(spark, tmp_path, rows)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")


def test_context_tree_base(spark, tmp_path):
    rows = corpus(4, 24)
    got = {r["doc_id"]: r for r in registry.queries()["op9_context_tree"](spark, saved(spark, tmp_path, rows)).collect()}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    tokens = {r[0]: [*words(r[1]), b"\n"] for r in rows}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total = sum(counts.values())
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0


def direct_scores(train, score):
    depth = context_tree.DEPTH
    nodes: dict = {}

    def walk(ws):
        raw = b"\n" * depth + b" ".join(ws[:-1]) + b"\n"
        for at in range(depth, len(raw)):
            for k in range(8):
                yield raw[at - depth : at], (1 << k) | raw[at] >> (8 - k), raw[at] >> (7 - k) & 1

    for ws in train:
        for context, m, bit in walk(ws):
            for n in range(depth + 1):
                nodes.setdefault((context[depth - n :], m), [0, 0])[bit] += 1
    block = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(c[0] + c[1] + 1) - math.log(math.pi)
    children: dict = {}
    weight, total = {}, {}
    for n in range(depth, -1, -1):
        for (context, m), c in nodes.items():
            if len(context) != n:
                continue
            own = block(c)
            if n == depth:
                total[context, m], weight[context, m] = own, 1.0
            else:
                deeper = children[context, m]
                total[context, m] = max(own, deeper) + math.log1p(math.exp(-abs(own - deeper))) - math.log(2)
                weight[context, m] = math.exp(own - math.log(2) - total[context, m])
            if n:
                up = (context[1:], m)
                children[up] = children.get(up, 0) + total[context, m]
    out = []
    for ws in score:
        log = 0.0
        for context, m, bit in walk(ws):
            path = []
            for n in range(depth + 1):
                key = (context[depth - n :], m)
                if key not in nodes:
                    break
                path.append(((nodes[key][1] + 0.5) / (sum(nodes[key]) + 1), weight[key]))
            p = path[-1][0] if path else 0.5
            for one, w in reversed(path[:-1]):
                p = p + w * (one - p)
            log += math.log10(p if bit else 1 - p)
        out.append(log)
    return out


def test_context_tree_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_tree.score(df, F.lit(False)).collect()}
    assert got[1]["tree__base"] == 0 and math.isclose(got[1]["tree__score"], -24 * math.log10(2), rel_tol=1e-6)
    assert got[2]["tree__tokens"] == 1
    assert context_tree.score(df.limit(0), F.lit(True)).count() == 0


def test_empty_tables(spark, tmp_path):
    d = saved(spark, tmp_path, [], benchmark=spark.createDataFrame([], "item_id long, text string"), embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    for name, fn in registry.queries().items():
        assert fn(spark, d).count() == 0, name


def test_clashing_names(spark):
    df = frame(spark, [(1, "a b", "en", "s", 3), (2, "c", None, None, 1)])
    for c in ("n", "doc", "id", "u", "v", "rep", "component", "hash", "pos", "kind", "part", "word", "tag", "row", "label", "size", "gram", "bucket", "center", "group"):
        df = df.withColumn(c, F.lit(1))
    from tessella.llm import decontaminate, language, pieces, surrogates

    items = spark.createDataFrame([(1, "zz")], "item_id long, text string")
    made = [line_dedup.dedup_lines(df), shingle_join.keep_one(df), suffix_dedup.remove_repeats(df), sharding.assign_shards(df), context_tree.score(df, F.lit(True)), decontaminate.find_items(df, items), language.identify(df, None), pieces.encode_documents(df, pieces.model_bytes()), surrogates.replace_entities(df, "k")]
    for out in made:
        assert out.count() == 2 and set(df.columns) <= set(out.columns)
    assert SCHEMA


def test_context_tree_equals_direct_sums(spark, monkeypatch):
    """Scores as shipped are those of the whole tree, and as many slots as grams change nothing."""
    rows = [(r[0], r[1]) for r in corpus(4, 16) if len(r[1] or "") < 700]
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], "another text under an id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, at int").repartition(3).withColumn("learn", F.col("at") % 3 > 0)
    train = [[*words(t), b"\n"] for n, (_, t) in enumerate(rows) if n % 3 > 0]
    want = direct_scores(train, [[*words(t), b"\n"] for _, t in rows])
    for per_slot in (context_tree.PER_SLOT, 5):
        monkeypatch.setattr(context_tree, "PER_SLOT", per_slot)
        got = {r["at"]: r for r in context_tree.score(df, F.col("learn")).collect()}
        assert len(got) == len(rows) and np.allclose([got[n]["tree__score"] for n in range(len(rows))], want, rtol=1e-6)
        for n, (_, t) in enumerate(rows):
            size = len(b" ".join(words(t))) + 1
            assert got[n]["tree__bytes"] == size and math.isclose(got[n]["tree__bits"], -got[n]["tree__score"] / math.log10(2) / size, rel_tol=1e-9)


def test_context_tree_in_small_stretches(spark):
    df = frame(spark)
    one = {r["doc_id"]: r["tree__score"] for r in context_tree.score(df, F.lit(True)).collect()}
    many = {r["doc_id"]: r["tree__score"] for r in context_tree.score(df, F.lit(True), span=2000).collect()}
    assert one.keys() == many.keys() and np.allclose([one[i] for i in one], [many[i] for i in one], rtol=1e-6)


def test_shingle_join_of_repeated_ids(spark):
    """A row that stands in many stretches (here: partitions) keeps its near copy, and so does each
    of several texts under one id."""
    rng = random.Random(8)
    prose = [[f"w{rng.randrange(10**6)}" for _ in range(124)] for _ in range(3)]
    near = lambda ws: " ".join([*ws[:60], "changed", *ws[61:119], "end"])
    a, b, c = (" ".join(ws) for ws in prose)
    rows = [(1, a)] * 16 + [(2, near(prose[0])), (3, b), (3, c), (4, near(prose[1])), (5, near(prose[2]))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = {r["doc"]: r["component"] for r in shingle_join.link_table(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}


def test_context_tree_of_many_equal_decisions(spark):
    """A byte that a tree of hundreds of millions of others has never seen is rare, not impossible."""
    code = lambda b: int.from_bytes(b"\n" * 5 + b, "big")
    counts = spark.createDataFrame([(code(b"a"), 400_000_000), (code(b"_"), 0), (code(b"\xc3"), 0)], "gram long, n long")
    got = {r["gram"]: r["log"] for r in context_tree.gram_answers(counts).collect()}
    assert all(math.isfinite(x) for x in got.values())
    rare = lambda n: math.log10(0.5 / (n + 1))
    # of the eight decisions the first that differs is the rare one, and what follows it is unknown
    assert math.isclose(got[code(b"\xc3")], rare(4e8) + 7 * math.log10(0.5), abs_tol=1e-3)
    assert math.isclose(got[code(b"_")], rare(4e8) + 5 * math.log10(0.5), abs_tol=1e-3)
    assert abs(got[code(b"a")]) < 1e-6


def asked(texts, learned):
    """What a stretch asks, by plain loops."""
    ws, gs = Counter(), Counter()
    for t, learns in zip(texts, learned, strict=True):
        own = [*words(t), b""]
        raw = b"\n" * context_tree.DEPTH + b" ".join(own[:-1]) + b"\n"
        ws.update({w: 0 for w in own})
        gs.update({raw[k - context_tree.DEPTH : k + 1]: 0 for k in range(context_tree.DEPTH, len(raw))})
        if learns:
            ws.update(own)
            gs.update(raw[k - context_tree.DEPTH : k + 1] for k in range(context_tree.DEPTH, len(raw)))
    return dict(ws), {int.from_bytes(g, "big"): n for g, n in gs.items()}


def test_context_tree_asks_in_few_pieces(monkeypatch):
    """Texts that are learned from and those that are not take turns: their grams are still sorted
    together, where each turn was a sort of its own and most grams of a stretch were told many times."""
    rows = [(r[1], k % 3 > 0) for k, r in enumerate(corpus(6, 300))]
    rows += [("A\x1cB\x85c\u3000D e\x0bF \r\n", True), (None, True), ("", False), (" lead and trail ", False), (None, False)]
    want = asked(*zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * (len(rows) + 1), pa.int32()), pa.array([True] + [x for _, x in rows]), pa.array(["of another slice"] + [t for t, _ in rows])], names=["stretch", "learn", "text"]).slice(1)
    calls, summed = [], context_tree._sum_by
    monkeypatch.setattr(context_tree, "_sum_by", lambda keys, *values: calls.append(len(keys)) or summed(keys, *values))
    for stretch in (context_tree.STRETCH, 3000):
        monkeypatch.setattr(context_tree, "STRETCH", stretch)
        calls.clear()
        told = pa.Table.from_batches([*context_tree._ask_grams(iter([batch]))])
        assert set(told["stretch"].to_pylist()) == {7} and dict(zip(told["gram"].to_pylist(), told["n"].to_pylist(), strict=True)) == want[1]
        assert told.num_rows == len(want[1]) and (sum(calls) == len(want[1]) or stretch == 3000)
    told = pa.Table.from_batches([*context_tree._ask_words(iter([batch]))])
    assert told.num_rows == len(want[0]) and dict(zip(told["word"].to_pylist(), told["n"].to_pylist(), strict=True)) == want[0]


def test_context_tree_answers_equal_plain_loops(monkeypatch):
    """Sums of looked-up grams and words, whole or in pieces of a text; an answer may come twice."""
    rng, texts = random.Random(2), [r[1] for r in corpus(6, 60)] + [None, "", " a  b ", "unheard-of"]
    ws, gs = asked(texts, [k % 3 > 0 for k in range(len(texts))])
    logs = {g: float(np.float32(-rng.random())) for g in gs}
    known = {w: n for w, n in ws.items() if n}
    codes, told = [*logs, *[*logs][:50]], [*known, *[*known][:9]]
    answers = context_tree.Answers([np.array(codes, np.uint64).tobytes()], [np.array([logs[g] for g in codes], np.float32).tobytes()], [pa.array(told[:20], pa.binary()), pa.array(told[20:], pa.binary())], [np.array([known[w] for w in told], np.int64).tobytes()], 1e6)
    tokens = [context_tree.Tokens(pa.array(x, pa.string())) for x in (texts[:30], [], texts[30:])]
    for stretch in (context_tree.STRETCH, 3000):
        monkeypatch.setattr(context_tree, "STRETCH", stretch)
        score = np.concatenate([answers.scores(t) for t in tokens])
        n, n_known, base = (np.concatenate(x) for x in zip(*answers.bases(tokens), strict=True))
        for k, t in enumerate(texts):
            own = [*words(t), b""]
            assert math.isclose(score[k], sum(logs[g] * times for g, times in asked([t], [True])[1].items()), rel_tol=1e-12)
            assert (n[k], n_known[k]) == (len(own), sum(w in known for w in own))
            assert math.isclose(base[k], sum(math.log10((known.get(w, 0) + 1) / 1e6) for w in own), rel_tol=1e-12)
