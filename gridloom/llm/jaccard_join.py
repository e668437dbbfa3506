"""Operator 8: join of documents whose word n-gram sets have a Jaccard similarity of at least 0.75.

Two sets of at least that similarity share one of their first floor(n / 4) + 1
elements in any order that all sets agree on; hot shingles come last in it, the others
by hash.  So listing each set under these keys makes every link meet, exactly, and
the signature trees of ``near`` find the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, near, textnp

SIZE = 5


def _units(column: pa.Array) -> list[list[near.Unit]]:
    buf, offsets = common.utf8(column)
    return [[(0, 0, s)] for s in textnp.shingle_sets(buf, offsets, SIZE)]


def _prefixes(sets: list[np.ndarray], hot: near.Hot) -> list[np.ndarray]:
    out = []
    for s in sets:
        size = len(s) - (3 * len(s) + 3) // 4 + 1
        at, late = hot.find(s)
        if late.any():
            s = np.concatenate([s[~late], s[late][np.argsort(hot.rank[at[late]])]])
        out.append(s[:size])
    return out


SCHEME = near.Scheme(_units, lambda sets: sets, _prefixes)


def _classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, n, label (null without shingles) and the component's lowest key, of every row."""
    found = near.classes(near.normal(df, key, text), SCHEME)
    lowest = found.sets.groupBy("label").agg(F.min("lowest").alias("lowest"))
    sets = found.sets.drop("lowest").join(lowest, "label").select("sid", "check", "label", "lowest")
    return found.units.join(sets, ["sid", "check"], "left").select("key", "row", "n", "label", "lowest")


def join_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id of every row.

    component_id is the smallest key that is reachable by links, the row's own included.
    A row without words (null or empty text) has no shingles and no links, so its own
    key.  Rows of equal sets are linked, repeated rows among them.  A null key is no
    candidate for the smallest: where a component has no other, its id is null.  An
    empty table gives an empty one; other columns, whatever their names, are left out.
    """
    own = F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("lowest"))
    return _classes(df, key, text).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component, all columns: the one with the smallest key, of several the first by a hash of the text.

    A document is a row: different texts of one key are documents of their own, and
    repeated rows are copies, of which one stays (the smallest by the columns that can be
    ordered).  A null key comes after all others.  Rows without words all stay.  An empty
    table gives an empty one; the names of further columns don't matter.
    """
    rows = common.cut(_classes(df, key, text).where("label IS NOT NULL").select("key", "row", "label"))
    place = F.struct(F.col("key").isNull(), "key", "row")
    # Written, so that Spark can split a large component's rows in the join.
    several = common.cut(rows.groupBy("label").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    gone = rows.join(several, "label").where(~place.eqNullSafe(F.col("first"))).select("key", "row").distinct()
    repeated = common.cut(rows.groupBy("key", "row").count().where("count > 1").select("key", "row"))
    hashed, k, r = common.fresh(df.columns, "row", "gone_key", "gone_row")
    marked = df.withColumn(hashed, F.xxhash64(common.col(text)))

    def named(keys: DataFrame) -> DataFrame:
        return keys.select(F.col("key").alias(k), F.col("row").alias(r))

    same = common.col(key).eqNullSafe(F.col(k)) & (F.col(hashed) == F.col(r))
    out = marked.join(named(gone), same, "left_anti")
    if repeated.isEmpty():
        return out.drop(hashed)
    whole = F.struct(*[common.col(c) for c in df.columns])
    order = F.struct(*[common.col(f.name) for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])
    single = out.join(named(repeated), same, "left_anti").drop(hashed)
    several = out.join(named(repeated), same, "left_semi").groupBy(common.col(key), F.col(hashed)).agg(F.min_by(whole, order).alias(r))
    return single.union(several.select(*[F.col(r).getField(c).alias(c) for c in df.columns]))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common WHERE 100 * c >= 75 * (n + m - c)
), pairs AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT x, y FROM pairs UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON r.y = b.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id))::BIGINT AS component_id
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""
