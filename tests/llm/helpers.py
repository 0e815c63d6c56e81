"""Fixtures: a small corpus with copies, near copies, shared passages, nulls and odd texts."""

import random

from pyspark.sql import DataFrame, SparkSession

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7)))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(seed)
    vocabulary = [word(rng) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = prose(60), "A line that stands in many documents."
    texts: list[str | None] = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not texts:
            texts.append(prose(rng.randint(1, 200)))
        elif kind == 1:
            texts.append(texts[-1])
        elif kind == 2:
            changed = (texts[-1] or prose(30)).split(" ")
            changed[rng.randrange(len(changed))] = "CHANGED"
            texts.append(" ".join(changed))
        elif kind == 3:
            texts.append(prose(20) + " " + passage + " " + prose(rng.randint(0, 40)))
        elif kind == 4:
            texts.append(prose(40) + "\n" + line + "\n\n  " + line.upper() + " \n" + prose(3))
        else:
            texts.append(prose(rng.randint(150, 400)))
    texts += [None, "", " \n\t ", "one", "two words", "Ünïcode 梦 ▁ ​ text\0with NUL", "x" * 3000, prose(20_000), "12 34 !!", "\n\n\n"]
    ids = list(range(3, 3 + 7 * len(texts), 7))
    rng.shuffle(ids)
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def saved(spark: SparkSession, tmp_path, rows: list[tuple] | None = None, **tables: DataFrame) -> str:
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]
