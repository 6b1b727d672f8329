"""Mixing sources to target weights by exact cuts in a hash-random order.

Every document has a random key, a hash of its id. Within each source documents stand in key order;
a distributed prefix sum of sizes gives each the words before it, and the source's budget cuts the
order at an exact word: documents before the cut are taken once more than those behind it, whole
epochs repeat. Only DataFrame operations are used.

Prefix sums never gather a source: keys fall into buckets by their leading hex digits, about a
thousand documents in each; sums run within buckets, over the buckets of a group, and over groups.

Sources are ordered by code point, null last, and take ``weights`` in turn. A source's target is its
share of ``share`` times all sizes, but no more than ``cap`` times its own size; the excess goes to
the others by weight. Null ids hash like the empty text; rows of one id stand in order of size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.llm.storage import materialize
from tesselle.llm.words import word_count

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Documents of a bucket, about.
BUCKET_ROWS = 1000


def _before(part: list[str], order: list[str], value: str) -> Column:
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def _running(df: DataFrame, order: list[str], values: list[str], tag: str) -> DataFrame:
    """``df`` with <value>_before: sums over all rows that stand before in a total order, by a distributed prefix sum.

    Rows are range-sorted and written, so that their partitions stay; sums run within partitions, and a
    table with a row for each partition carries them on.
    """
    t = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), tag)
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy("__p").agg(*[F.sum(v).alias(v) for v in values])
    parts = parts.select("__p", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"__{v}") for v in values])
    own = t.select("*", *[_before(["__p"], order, v).alias(f"{v}_before") for v in values])
    got = own.join(F.broadcast(parts), "__p")  # no more rows than partitions
    return got.select(*df.columns, *[(F.col(f"{v}_before") + F.col(f"__{v}")).alias(f"{v}_before") for v in values])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(nosrc, src, source_size, target) from a table with a row for each source: (nosrc, src, source_size).

    The level at which weights are paid is found in closed form: sources sorted by the level at which
    they are full, the first one that the remaining budget cannot fill tells the level of the rest. Both
    orders, by name for the weights and by level, are distributed, so sources may be many.
    """
    placed = _running(sources.withColumn("one", F.lit(1).cast("long")), ["nosrc", "src"], ["one"], "sources")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("one_before", F.lit(len(weights))) + 1).cast("int"))
    s = placed.select("nosrc", "src", "source_size", w.cast("long").alias("w"), (F.col("source_size") * cap).alias("full"))
    s = s.withColumn("ratio", F.col("full").cast("double") / F.col("w"))
    every = s.agg((F.sum("source_size") * F.lit(share).cast("double")).alias("total"), F.sum("w").alias("every"))
    s = _running(s, ["ratio", "nosrc", "src"], ["full", "w"], "levels").crossJoin(F.broadcast(every))  # one row
    s = s.withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("every") - F.col("w_before")))
    first = s.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nosrc", "src", "level")))["level"].alias("paid"))
    target = F.least(F.col("full").cast("double"), F.coalesce("paid", F.lit(float("inf"))) * F.col("w"))
    return s.crossJoin(F.broadcast(first)).select("nosrc", "src", "source_size", target.alias("target"))


def plan(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Columns ``keep`` (default doc_id) with size, source_size, target and taken of every document.

    ``taken`` counts words: whole epochs of the document, plus the whole document or its first words
    where the cut of the last epoch lies behind or in it.
    """
    keep = keep or ["doc_id"]
    rows = docs.count()
    digits = min(12, max(2, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)) + 1))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(
        *keep,
        F.col("doc_id").alias("__id"),
        F.col("source").isNull().alias("nosrc"),
        F.coalesce("source", F.lit("")).alias("src"),
        word_count(F.col("text")).alias("size"),
        key.alias("__key"),
    ).withColumn("bucket", F.substring("__key", 1, digits))
    sums = materialize(sized.groupBy("nosrc", "src", "bucket").agg(F.sum("size").alias("words")), "buckets")
    group = F.substring("bucket", 1, digits // 2)
    groups = sums.groupBy("nosrc", "src", group.alias("grp")).agg(F.sum("words").alias("words"))
    groups = groups.withColumn("ahead", _before(["nosrc", "src"], ["grp"], "words"))
    sources = groups.groupBy("nosrc", "src").agg(F.sum("words").alias("source_size"))
    level = targets(sources, weights, share, cap)
    at = sums.withColumn("grp", group).withColumn("inside", _before(["nosrc", "src", "grp"], ["bucket"], "words"))
    at = at.join(groups.select("nosrc", "src", "grp", "ahead"), ["nosrc", "src", "grp"]).join(level, ["nosrc", "src"])
    at = at.select("nosrc", "src", "bucket", (F.col("inside") + F.col("ahead")).alias("base"), "source_size", "target")
    placed = sized.withColumn("own", _before(["nosrc", "src", "bucket"], ["__key", "__id", "size"], "size")).join(at, ["nosrc", "src", "bucket"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size") - F.col("own") - F.col("base")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select(*keep, "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_taken(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the document at a source's cut shortened to its taken words.

    Columns stay as they are; text, and n_chars where there is one, change in the shortened row only.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    p = plan(packed, ["__row"])
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.col("taken") - F.floor(F.col("taken") / F.greatest("size", F.lit(1))) * F.col("size")
    rows = p.withColumn("__part", part).withColumn("__n", copies).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    rows = rows.select("__row", F.when((F.col("__copy") == F.col("__n")) & (F.col("__part") > 0), F.col("__part")).alias("__cut"))
    pieces = F.regexp_extract_all("__row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("__cut").cast("int")), "")
    text = F.when(F.col("__cut").isNull(), F.col("__row.text")).otherwise(head)
    new = {"text": text}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("__cut").isNull(), F.col("__row.n_chars")).otherwise(F.length(text).cast("long"))
    return rows.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nosrc, coalesce(source, '') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    coalesce(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT), 0) AS size
  FROM documents),
s AS (SELECT nosrc, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY nosrc, src),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY nosrc, src) - 1) % 3] AS w FROM s),
r AS (SELECT *, 2 * source_size AS fl, CAST(2 * source_size AS DOUBLE) / w AS ratio FROM w),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
      - coalesce(sum(fl) OVER (ORDER BY ratio, nosrc, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, nosrc, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r),
t AS (SELECT nosrc, src, source_size, least(CAST(fl AS DOUBLE), (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, nosrc, src LIMIT 1) * w) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS b,
    coalesce(CAST(sum(d.size) OVER (PARTITION BY d.nosrc, d.src ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
  FROM d JOIN t USING (nosrc, src))
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE
    (b // source_size) * size + greatest(0, least(b % source_size - ahead, size)) END AS BIGINT) AS taken
FROM p
"""
