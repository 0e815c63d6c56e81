"""Line dedup: lines whose key is found in many documents go from every document.

Every text is split at \\n, each line reduced to a key, keys hashed, the distinct documents of
each hash counted, and the positions of lines over the threshold taken out of their document.
The texts themselves move once, in the join that brings each document its dropped positions;
counting moves two 64-bit hashes and an id for each distinct line of a document, and a line
that fills a third of the corpus is counted in partial sums.

Results in odd cases: a null or empty text is one empty line; an empty key (a blank line) never
counts as repeated; rows that repeat a doc_id count as one document and each keep their own
row; rows with a null doc_id count as one document; extra columns pass through; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, settle

MIN_DOCS, MIN_POINTS = 10, 1


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, the text column holding the kept lines, plus
    ``line_dedup__lines`` and ``line_dedup__dropped`` (lines before dropping, and dropped).

    A row is known by its id and the hash of its text, so rows that share an id stay apart.
    """
    of, pos, key = "line_dedup__id", "line_dedup__pos", F.col("line_dedup__key")
    row, hashes = [of, "line_dedup__text"], ["line_dedup__h", "line_dedup__g"]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(F.col(f"`{id_col}`").alias(of), F.xxhash64(text).alias(row[1]), F.posexplode(_lines(text)).alias(pos, "line_dedup__line"))
    keyed = lines.select(*row, pos, line_key(F.col("line_dedup__line")).alias("line_dedup__key")).where(F.length(key) >= max(min_points, 1))
    hashed = keyed.select(*row, pos, F.xxhash64(key).alias(hashes[0]), F.xxhash64(F.lit(1), key).alias(hashes[1]))
    # written, so the join below has both its exchanges to itself: those of a line in very many
    # documents can then be split
    common = settle(hashed.select(*hashes, of).distinct().groupBy(*hashes).agg(F.count(F.lit(1)).alias("line_dedup__docs")).where(F.col("line_dedup__docs") >= min_docs).select(*hashes))
    drops = hashed.join(common, hashes, "left_semi").groupBy(*row).agg(F.collect_set(pos).alias("line_dedup__drop"))
    drops = drops.select(F.col(of).alias("line_dedup__of"), F.col(row[1]).alias("line_dedup__as"), "line_dedup__drop")
    joined = docs.withColumns({row[1]: F.xxhash64(text)}).join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("line_dedup__of")) & (F.col(row[1]) == F.col("line_dedup__as")), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    split = joined.select(*own, _lines(text).alias("line_dedup__all"), "line_dedup__drop")
    every, drop = F.col("line_dedup__all"), F.col("line_dedup__drop")
    # every is read twice below, so it is computed once a row and looked up by position
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), drop), lambda p: F.get(every, p)), "\n")
    text_at = F.when(drop.isNull(), text).otherwise(kept)
    return split.select(*[text_at.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.size(every).cast("long").alias("line_dedup__lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("line_dedup__dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``dedup_lines`` over documents: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("line_dedup__lines").alias("n_lines"), F.col("line_dedup__dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents) u),
common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines LEFT JOIN common c ON lines.k = c.k
GROUP BY doc_id
"""
