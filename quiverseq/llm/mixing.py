"""Mixing sources to target weights by systematic sampling, with built-in functions alone.

A document's expected number of copies is its source's target over its source's size. Along a fixed order within the
source the expected copies are prefix-summed, one offset in [0, 1) is added, and a copy is emitted for each integer
boundary that a document's interval crosses. Documents are ordered by size, so each run of similar sizes is sampled
evenly and the words taken stay close to the target.

Nulls: a null source is a source of its own, sorted last; null text has size 0. Empty tables give empty results.
Repeated rows each count and each are sampled. A source without words has target 0 and nothing taken. Extra columns pass
through; source_size, target and n_copies replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, word_count, written
from .sharding import stable_key


def source_targets(sizes: DataFrame, source: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """From rows (source, size): one row per source with source_size, target, copies (expected per document).

    Sources in code-point order, null last, take the weights in turn. The targets sum to share x all sizes and none
    exceeds ceiling x its source's size; what is cut off is shared out again by weight. That is water filling: sorted by
    ceiling over weight, a source is full if its ceiling lies below the level that the sources from it on would reach.
    The windows here see one row per source, never documents.
    """
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(ceiling)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col(source).asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    per = per.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
    per = per.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_weight"))
    #: Levels only fall once a source is not full, so the open sources share the largest of their levels.
    per = per.withColumn("_open", F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_open") * F.col("_weight"), F.col("_cap")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).withColumn("copies", copies).select(source, "source_size", "target", "copies")


def named(source: str) -> Column:
    """The source as a key that is never null and keeps null apart from every text."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))


def systematic_copies(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 7, lanes: int = 64) -> DataFrame:
    """Adds source_size, target and n_copies to rows with key, source and size; targets come from source_targets().

    A document's place in its source comes without a window over the whole source: size classes (sixteenths of a power
    of e) times hash lanes of the key are counted first, their counts prefix-summed per source, and rows numbered within
    (source, class, lane) only. A source or a size with a third of all rows thus spreads over its lanes. The order is by
    (class, lane, size, key); seed and source fix the offset, so reruns agree.
    """
    cells = docs.drop("source_size", "target", "n_copies", "copies").withColumns({"_s": named(source), "_class": F.floor(F.log(F.col("size") + F.lit(1.0)) * 16), "_lane": F.pmod(stable_key(key), F.lit(lanes))})
    counts = cells.groupBy("_s", "_class", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_class", "_lane").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rates = targets.select(named(source).alias("_s"), "source_size", "target", "copies").withColumn("_seeded", F.concat(F.lit(f"{seed}:"), F.col("_s")))
    rates = rates.withColumn("_offset", stable_key("_seeded").cast("double") / F.lit(float(1 << 60))).drop("_seeded")
    within = Window.partitionBy("_s", "_class", "_lane").orderBy("size", key)
    placed = cells.withColumn("_row", F.row_number().over(within)).join(firsts.join(rates, "_s"), ["_s", "_class", "_lane"])
    place = F.col("_before") + F.col("_row")
    crossed = lambda n: F.floor(F.col("copies") * n + F.col("_offset"))
    return placed.withColumn("n_copies", crossed(place) - crossed(place - 1)).drop("_s", "_class", "_lane", "_row", "_before", "_offset", "copies")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed: doc_id, size, source_size, target, taken = size x copies."""
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    mixed = systematic_copies(sizes, source_targets(sizes))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).cast("long").alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT s, any_value(source) AS source, sum(size)::DOUBLE AS ss,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY s),
lev AS (
  SELECT *, (1.5 * sum(ss) OVER () - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
tgt AS (
  SELECT *, CASE WHEN 2 * ss <= level * w THEN 2 * ss
                 ELSE least(2 * ss, w * max(CASE WHEN 2 * ss > level * w THEN level END) OVER ()) END AS target FROM lev),
rate AS (
  SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0 END AS r,
         ('0x' || substr(md5('7:' || s), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0 AS u FROM tgt),
placed AS (
  SELECT doc_id, s, size, row_number() OVER (PARTITION BY s ORDER BY floor(ln(size + 1.0) * 16),
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 64, size, doc_id) AS n FROM sized)
SELECT doc_id, size, ss::BIGINT AS source_size, target,
       (size * (floor(r * n + u) - floor(r * (n - 1) + u)))::BIGINT AS taken
FROM placed JOIN rate USING (s)
"""
