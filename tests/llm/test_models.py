"""Language ID, pieces, surrogates, decontamination, near vectors and the pipeline."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontaminate, language, near_vectors, pieces, registry, shingle_join

from .helpers import components, corpus, frame, saved

MODEL = pieces.model_bytes()


# pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


ODD = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "梦", "😀", "\t", "\0", "x" * 60, "aaaaaaa", "<0x0A>", "<s>", " \n", "क", "​", "123", "ﬁ", "\r", "</s>", "<unk>", "ＡＢ", "①", "\xa0"]


def test_pieces_equal_the_library(library):
    rng, own = random.Random(1), pieces.Pieces(MODEL)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [t for _, t, *_ in corpus() if t]
    for text in texts:
        ids, ends = own.encode(text)
        assert ids.tolist() == library.encode(text)
        assert own.decode(ids) == library.decode(ids.tolist())
        assert ends.tolist() == [p.end for p in library.encode(text, return_type="proto").pieces]
    for _ in range(300):
        ids = [rng.randrange(32000 if rng.random() < 0.5 else 300) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalisation_and_alignment(rule):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own, rng = pieces.Pieces(theirs.serialized_model_proto()), random.Random(2)
    for _ in range(800):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(1, 10)))
        want, at = theirs.normalize(text, with_offsets=True)
        got, places = own.normalise(text)
        assert got == want
        if got:
            assert places == [len(text[:k].encode()) for k in at]


def test_pieces_query(spark, tmp_path, library):
    import hashlib

    rows = corpus()
    got = {r["doc_id"]: r for r in registry.queries()["op7_pieces"](spark, saved(spark, tmp_path, rows)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert got[i]["n_bytes_covered"] == len((t or "").encode())


# language


def languages(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["é", "aux", "qu", "oi"]}
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    return rows


def test_language_held_out_accuracy(spark, tmp_path):
    import zlib

    rows = languages(300, 3) + [(900, None, "aa", "s", 0), (901, "12 3.4 !?", "aa", "s", 0), (902, "", None, "s", 0), (903, "katomi " * 30_000, None, "s", 0)]
    got = {r["doc_id"]: r for r in registry.queries()["op3_language"](spark, saved(spark, tmp_path, rows)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for r in rows[:300] if got[r[0]]["held_out"]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)


def test_gradients():
    """Backpropagation through time against finite differences, for every kind of weight."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1])
    net = language._begin(["a", "b", "c"], 4, 0)
    _, grads = language.gradients(net, x, y)
    for name, places in {"table": [(0, 1, 98), (0, 6, 100), (1, 3, 97), (1, 11, 102)], "turn": [(0, 0, 0), (0, 5, 2), (1, 9, 3), (1, 11, 1)], "out": [(0, 0), (1, 5), (2, 7)], "bias": [(0,), (2,)]}.items():
        w = getattr(net, name)
        for at in places:
            kept = float(w[at])
            w[at] = kept + 1e-2
            up, _ = language.gradients(net, x, y)
            w[at] = kept - 1e-2
            down, _ = language.gradients(net, x, y)
            w[at] = kept
            assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-4, (name, at)


def test_prediction_equals_a_plain_loop(monkeypatch):
    """Every byte of every window, one at a time, pooled over the text."""
    monkeypatch.setattr(language, "READ", 16)
    monkeypatch.setattr(language, "SIDE", 3)
    net = language._begin(["a", "b", "c"], 4, 5)
    texts = ["short", "é" * 20, "a longer text of several windows, read in stretches " * 3, None, "12 3"]

    def states(window: bytes, of: int) -> list:
        k, h, out = 4, np.zeros(4), []
        for byte in window:
            seen, held = net.table[of][:, byte].astype(float), net.turn[of].astype(float) @ h
            z, r = (1 / (1 + np.exp(-(seen[a : a + k] + held[a : a + k]))) for a in (0, k))
            n = np.tanh(seen[2 * k :] + r * held[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    labels, scores = language.predict(net, texts)
    for t, label, score in zip(texts, labels, scores, strict=True):
        if not language.has_letter(t):
            assert (label, score) == ("und", 0.0)
            continue
        raw, total = t.encode(), np.zeros(3)
        for start in range(0, len(raw), 16):
            window = raw[start : start + 16]
            padded = window.ljust(16, b"\0")
            ahead, behind = states(padded, 0), states(padded[::-1], 1)[::-1]
            for a, b, _ in zip(ahead, behind, window):
                p = np.exp(net.out @ np.concatenate([a, b]) + net.bias)
                total += p / p.sum()
        assert label == net.labels[int(total.argmax())] and abs(score - total.max() / len(raw)) < 1e-4


def test_language_without_labels(spark):
    df = frame(spark, [(1, "abc", None, "s", 3)])
    assert language.fit(df, F.lit(True)) is None
    assert language.identify(df, None).first()["language__pred"] == "und"


# decontamination


def nearest(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    w = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(w() for _ in range(rng.randint(5, 25)))) for k in range(8)] + [(20, None), (21, "  "), (22, "short one")]
    rows = []
    for k in range(40):
        body = [w() for _ in range(30)]
        if k % 2:
            x = list(items[k % 8][1])
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], ["z"], [x[at], "y"]])
            body[10:10] = ["".join(x).upper() if k % 3 else "".join(x)]
        rows.append((k, "  ".join(body), None, None, 0))
    rows += [(100, None, None, None, 0), (101, "", None, None, 0), (102, "a Short\nOne b", None, None, 0), (103, "ashort oneb", None, None, 0)]
    table = spark.createDataFrame(items, "item_id long, text string")
    d = saved(spark, tmp_path, rows, benchmark=table)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in registry.queries()["op1_decontamination"](spark, d).collect()}
    want = {(102, 22): 0}
    for i, t, *_ in rows:
        for j, item in items[:8]:
            n = nearest(decontaminate.normal(item), decontaminate.normal(t))
            if n <= len(decontaminate.normal(item)) // 20:
                want[i, j] = n
    assert got == want and len(want) > 10
    blocks = decontaminate.find_items(frame(spark, rows), table, block=200)
    assert {(r["doc_id"], j) for r in blocks.collect() for j in r["decontaminate__items"]} == set(want)


# near vectors


def test_near_vectors_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    rows, k = [], 0
    for b, v in enumerate(base):
        for _ in range([1, 1, 2, 5, 90][b % 5]):
            x = v + rng.normal(size=16) * 0.05
            rows.append((k * 2, [float(c) for c in x], b % 3))
            k += 1
    rows += [(5001, rows[0][1], rows[0][2]), (5002, rows[0][1], 99), (5003, None, 1), (5004, [0.0] * 16, 1), (5005, [float("nan")] * 16, 1), (5006, [None] * 16, 1), (5007, rows[5][1], None), (5008, [1.0, 2.0], 0), (5009, [2.0, 4.0], 0), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in registry.queries()["op8_near_vectors"](spark, saved(spark, tmp_path, embeddings=df)).collect()}
    good = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and r[2] is not None and np.isfinite(r[1]).all() and np.any(r[1])]
    links = []
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            u, v = np.float32(good[a][1]).astype(float), np.float32(good[b][1]).astype(float)
            if good[a][2] == good[b][2] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                links.append((a, b))
    n = np.bincount(np.array(links).ravel(), minlength=len(good))
    of = components(len(good), links)
    recall = sum(got[g[0]]["n_links"] for g in good) / n.sum()
    assert len(links) > 3000 and 0.95 <= recall <= 1
    same = sum(got[g[0]]["component_id"] == min(good[k][0] for k in range(len(good)) if of[k] == of[j]) for j, g in enumerate(good))
    assert same >= 0.99 * len(good)
    for i in (5002, 5003, 5004, 5005, 5006, 5007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert near_vectors.link_vectors(df.limit(0)).count() == 0


def test_near_vectors_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["near__links"], r["near__component"]) for r in near_vectors.link_vectors(df.withColumn("near", F.lit(1))).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    # two vectors of an id that link with each other and with a third: each has two others
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [1.0, 0.05], 0), (1, [1.0, 0.0], 5), (4, [1.0, 0.0], 5)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["label"], r["vec_id"], r["near__links"]) for r in near_vectors.link_vectors(df).collect())
    assert got == [(0, 1, 2), (0, 1, 2), (0, 2, 2), (5, 1, 1), (5, 4, 1)]


def test_near_vectors_recall_does_not_fall_with_size(spark):
    """A table as large for its window as a label of 262 144 classes is for 64: twelve leading bits."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2048, 64))
    base /= np.sqrt((base * base).sum(axis=1))[:, None]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.sqrt((side * side).sum(axis=1))[:, None]
    near = 0.932 * base + np.sqrt(1 - 0.932**2) * side
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["near__links"] for r in near_vectors.link_vectors(df, window=1).collect()}
    assert set(got.values()) <= {0, 1} and np.mean([got[k] for k in range(2048)]) >= 0.92


# pipeline


def test_pipeline_stages(spark, tmp_path):
    rows = corpus(7, 60)
    leak = "this passage of the test set must not be learned by heart"
    rows += [(5000, f"some words before {leak} and after", "en", "s", 10), (5001, "2 3 4", "en", "s", 5)]
    d = saved(spark, tmp_path, rows, benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"))
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{tmp_path}/stage{number}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r for r in docs.collect()})
    letters = {r[0] for r in rows if language.has_letter(r[1])}
    assert set(kept[0]) == letters
    assert set(kept[1]) == letters and not any("stands in many" in r["text"] for r in kept[1].values())
    before = sorted((i, r["text"]) for i, r in kept[1].items())
    sets = [set(shingle_join.shingles(t).tolist()) for _, t in before]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = components(len(sets), links)
    assert set(kept[2]) == {i for k, (i, _) in enumerate(before) if of[k] == k}
    assert set(kept[2]) - set(kept[3]) == {5000}
    assert set(kept[4]) == set(kept[3])
    whole = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {i: r["ids"] for i, r in kept[4].items()}
    assert 3 <= len(corpus_pipeline.STAGES) <= 5


ODD_ROWS = [(1, None, "en", "s", 0), (1, "", None, "s", 0), (None, "a text without an id that has some words", "en", "s", 1), (2, "word " * 30_000, "en", None, 1), (3, "some plain words that stand here twice", "en", "s", 1), (3, "some plain words that stand here twice", "en", "s", 1), (3, "another text under the same id, quite different", "de", "s", None)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, name):
    """Null and repeated ids, nulls, repeated rows, a very long text, columns with clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    d = saved(spark, tmp_path, benchmark=spark.createDataFrame([(1, "nothing of this is there"), (None, None)], "item_id long, text string"))
    docs = frame(spark, ODD_ROWS)
    for c in ("n", "doc", "kind", "stretch", "ids", "ends", "hash", "label", "block"):
        docs = docs.withColumn(c, F.lit(1))
    got = stage(spark, docs, d)
    rows = [(r["doc_id"], r["text"]) if "text" in got.columns else r["doc_id"] for r in got.collect()]
    before = [r[:2] for r in ODD_ROWS]
    if name == "encoding":
        assert sorted(rows, key=str) == sorted((r[0] for r in ODD_ROWS), key=str)
    else:
        want = {"language_id": [r for r in before if r[1]], "line_dedup": [(i, t or "") for i, t in before]}.get(name, before)
        assert got.columns == docs.columns and sorted(rows, key=str) == sorted(want, key=str)
    assert stage(spark, docs.limit(0), d).count() == 0
    again = stage(spark, docs.drop("lang").withColumn("lang", F.lit(None).cast("string")).select(docs.columns), d)
    assert again.count() == len(rows) or name == "language_id" and again.count() == len(ODD_ROWS)  # nothing to learn from, nothing rejected


def test_memory_of_units_is_bounded(monkeypatch):
    own = pieces.Pieces(MODEL)
    long = "ab" * 100_000
    own.encode(long + " word")
    assert own.memory and max(map(len, own.memory)) <= pieces.UNIT
    monkeypatch.setattr(pieces, "MEMORY", 5000)
    for k in range(2000):
        own.encode(f"unit{k}")
        assert own.held <= 2500 + 2000 and len(own.older) + len(own.memory) <= 5000 / pieces.ENTRY + 10
    assert own.encode("unit1999")[0].tolist() == pieces.Pieces(MODEL).encode("unit1999")[0].tolist()


def test_decontamination_of_long_texts_and_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    long = "filler words " * 40_000
    rows = [(1, long + item.replace("lazy", "laxy") + " " + long), (1, "clean"), (None, item), (1, None), (2, item + " " + item), (2, item + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(0))
    items = spark.createDataFrame([(7, item), (8, item.upper()), (None, "another item that is not there at all")] + [(100 + k, f"item number {k} which no document holds") for k in range(50)], "item_id long, text string")
    want = sorted([((1, rows[0][1]), [(7, 1)]), ((1, "clean"), []), ((None, item), [(7, 0)]), ((1, None), []), ((2, rows[4][1]), [(7, 0)]), ((2, rows[4][1]), [(7, 0)])], key=str)
    for block in (decontaminate.BLOCK, 300):
        got = decontaminate.find_items(docs, items, block=block).collect()
        assert sorted((((r["doc_id"], r["text"]), list(zip(r["decontaminate__items"], r["decontaminate__edits"], strict=True))) for r in got), key=str) == want
