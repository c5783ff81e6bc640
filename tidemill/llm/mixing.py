"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document expects the same number of copies. Their prefix sums, shifted by one random offset of the
source, cross integers; a document is taken once for each integer that its interval crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE_CLASS, cut, fresh, row_hash

#: Weights by a source's rank, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size, so no document is taken more often.
MOST = 3
#: Hexadecimal digits of a document's hash that split the documents of a source with equal sizes.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """The number of maximal runs of other characters than ASCII white space; null has none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")
    trimmed = F.trim(inner)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.translate(trimmed, " ", "")) + 1).cast("bigint")


def _hex(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows (source, source_size) become (source, source_size, target).

    The sources by code point, null last, weigh `weights` in turn and share the sum of all sizes; a target stops at `most`
    times its source's size and the excess is shared again by weight. In order of size over weight, a source is at its
    limit if what is left for it and those after it, shared by weight, gives it more; so one pass settles all. The windows
    see one row for each source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint"))
    lcm = 1
    for w in weights:
        lcm *= w
    order = everything.orderBy(F.expr(f"source_size * {lcm} div w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = ranked.select(
        "*", F.sum("source_size").over(everything).alias("total"), (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).alias("given"), F.sum("w").over(after).alias("open")
    )
    full = left.withColumn("full", (F.col("total") - F.col("given")) * F.col("w") > F.col("source_size") * most * F.col("open"))
    rest = full.select(
        "*", F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * most)).over(everything), F.lit(0)).alias("taken"), F.sum(F.when(~F.col("full"), F.col("w"))).over(everything).alias("share")
    )
    share = (F.col("w") * (F.col("total") - F.col("taken"))).cast("double") / F.col("share").cast("double")
    return rest.select("source", "source_size", F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", keys: tuple[Column, ...] = ()) -> DataFrame:
    """One row for every row of docs: doc_id, size, source_size, target, copies, taken (and key0, key1, ... from `keys`).

    size counts words; a null text has none. Documents are ordered within their source by size, then by a hash of the id,
    then by the id; as sizes only rise along the order, a source's taken words miss its target by less than its largest
    document. Null ids hash as the empty text; rows that agree in source, size and id get the copies of their places, in
    any order. A source of no words takes nothing. The ranks come from counts of (source, size) and of (source, size,
    hash bucket), so no task ever holds a source. Texts may be of any length; other columns of docs, whatever their names,
    are not looked at. An empty table gives an empty result.
    """
    source = F.col(source_col).cast("string")
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("src"),
        word_count(F.col(text_col)).alias("size"), _hex(text_id, BUCKET_DIGITS).alias("bucket"), *(k.alias(f"key{i}") for i, k in enumerate(keys)),
    )
    rows = cut(rows)
    cells = cut(rows.groupBy("src", "size", "bucket").agg(F.count("*").alias("n")))
    by_size = cells.groupBy("src", "size").agg(F.sum("n").alias("n"))
    exclusive = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size_base = by_size.select("src", "size", exclusive(Window.partitionBy("src").orderBy("size")).alias("size_base"))
    cell_base = cells.select("src", "size", "bucket", exclusive(Window.partitionBy("src", "size").orderBy("bucket")).alias("cell_base"))
    per_source = cells.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(per_source.select(F.expr("if(src = 'n', null, substr(src, 2))").alias("source"), "source_size"))
    offset = (_hex(F.concat(F.lit(f"{seed}:"), "src"), 3) + 0.5) / 4096
    goal = goal.withColumn("src", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).select(
        "src", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size").cast("double"), F.lit(float(MOST)))).otherwise(0.0).alias("each"), offset.alias("offset")
    )
    base = cell_base.join(size_base, ["src", "size"]).join(goal, "src").select("*", (F.col("size_base") + F.col("cell_base")).alias("base")).drop("size_base", "cell_base")
    nth = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy(F.asc_nulls_last("doc_id")))
    placed = rows.withColumn("nth", nth).join(base, ["src", "size", "bucket"]).withColumn("place", (F.col("base") + F.col("nth")).cast("double"))
    crossed = F.floor(F.col("each") * F.col("place") + F.col("offset")) - F.floor(F.col("each") * (F.col("place") - 1) + F.col("offset"))
    return placed.withColumn("copies", crossed).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(f"key{i}" for i in range(len(keys))))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken; identical rows pool their copies.

    Rows are identical if two 64-bit hashes of all their columns are, maps by their JSON. Nulls, ties and sources as in
    mix(); columns may have any names and types; an empty table stays empty.
    """
    mix_id, mix_a, mix_b, copies, key_a, key_b, nth, copy = fresh(docs.columns, "mix_id", "mix_a", "mix_b", "copies", "key_a", "key_b", "nth", "copy")
    keys = (row_hash(docs), row_hash(docs, 1))
    pooled = mix(docs, id_col, text_col, source_col, seed, keys).groupBy("doc_id", "key0", "key1").agg(F.sum("copies").alias("copies")).where("copies > 0")
    pooled = pooled.select(F.col("doc_id").alias(mix_id), F.col("key0").alias(mix_a), F.col("key1").alias(mix_b), F.col("copies").cast("int").alias(copies))
    one = F.row_number().over(Window.partitionBy(key_a, key_b).orderBy(F.asc_nulls_last(id_col)))
    rows = docs.select(*docs.columns, keys[0].alias(key_a), keys[1].alias(key_b)).withColumn(nth, one).where(F.col(nth) == 1)
    joined = rows.join(pooled, (F.col(key_a) == F.col(mix_a)) & (F.col(key_b) == F.col(mix_b)) & F.col(id_col).eqNullSafe(F.col(mix_id)))
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(copy)).select(*docs.columns)


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS BIGINT) AS bucket
  FROM documents),
w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         3 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size * 10 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS given,
         CAST(sum(w) OVER (ORDER BY source_size * 10 // w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM w),
f AS (SELECT *, (total - given) * w > source_size * 3 * open AS capped FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * (total - coalesce(CAST(sum(source_size * 3) FILTER (WHERE capped) OVER () AS BIGINT), 0)) AS DOUBLE)
                   / CAST(sum(w) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target
  FROM f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / CAST(source_size AS DOUBLE), 3.0) ELSE 0.0 END AS expected,
         (CAST('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 3) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4096 AS DOUBLE) AS shift
  FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.expected, e.shift,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.bucket, d.doc_id NULLS LAST) AS DOUBLE) AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(expected * place + shift) - floor(expected * (place - 1) + shift) AS BIGINT) AS copies,
       CAST((floor(expected * place + shift) - floor(expected * (place - 1) + shift)) * size AS BIGINT) AS taken
FROM r
"""
