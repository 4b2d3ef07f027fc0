"""Cross-site line dedup: how many distinct sites carry a line, by HyperLogLog sketches per line hash.

Sketches of sites merge by aggregation, map-side first, so a line on a third of all documents costs one sketch per
task. Lines whose estimate lies near the threshold get exact distinct counts; the estimate alone decides the rest.
A line on enough sites is boilerplate: the document with the least doc_id keeps it, all others lose it.

Lines are split at "\\n" and known by 96 hash bits. Lines without a word are layout, never boilerplate. A null site is
a site of its own. Null text stays null and has no lines. A document that loses all its lines keeps an empty text.
Repeated rows carry the same lines: all rows with the least doc_id keep them, and a null doc_id counts as the greatest.
Extra columns pass through; n_lines and n_removed replace columns of these names.

The query takes a line from 8 sites on, whatever its length, as its SQL does. Long passages that fewer sites or one site
alone repeat are the matter of lost_passages, which the pipeline applies once near copies of whole documents are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, table, unboxed, written

#: A sketch of 2**12 registers has a relative standard error of about 1.6 %; three of them on either side are near.
LG_K, NEAR = 12, 0.05
#: A line of more words is a passage.
PASSAGE = 50


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _occurrences(docs: DataFrame, site: str) -> DataFrame:
    """(key, doc_id, site, pos, h, g) of each line that has a word."""
    own = docs.where("text is not null").select(_key().alias("key"), "doc_id", F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return own.where(F.regexp_like("line", F.lit(WORD))).select("key", "doc_id", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def boilerplate(lines: DataFrame, min_sites: int = 8) -> DataFrame:
    """(h, g, keeper) from (doc_id, site, h, g): lines on min_sites sites or more, and the least doc_id that has them."""
    spread = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), F.min("doc_id").alias("keeper")).where(F.col("n") >= min_sites)
    judged = written(spread.select("h", "g", "keeper", F.hll_sketch_estimate("sites").alias("sites")), "spread")
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    near = judged.where(F.col("sites").between(low, high))
    exact = lines.join(near.select("h", "g"), ["h", "g"]).select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("exact"))
    sure = judged.where(F.col("sites") > high).select("h", "g", "keeper")
    return sure.unionByName(near.join(exact, ["h", "g"]).where(F.col("exact") >= min_sites).select("h", "g", "keeper"))


def _without(text: Column, lost: Column) -> Column:
    """text less its lines at the lost places, in time linear in both; the lambda's variable holds the lines once split."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    joined = F.transform(F.array(F.struct(lines.alias("lines"), kept.alias("kept"))), lambda x: F.array_join(F.transform(x["kept"], lambda i: x["lines"][i]), "\n"))[0]
    return F.when(F.size(lost) > 0, joined).otherwise(text)


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 8) -> DataFrame:
    """All rows and columns of docs, with text less other documents' boilerplate, plus n_lines and n_removed."""
    lines = written(_occurrences(docs, site), "lines")
    bad = written(boilerplate(lines, min_sites), "boilerplate")
    lost = lines.join(bad, ["h", "g"]).where("doc_id > keeper or (doc_id is null and keeper is not null)")
    per = lost.select("key", "pos").distinct().groupBy("key").agg(F.collect_list("pos").alias("lost"))
    used = ["doc_id", "text"]
    joined = boxed(docs, used).withColumn("_key", _key()).join(per, F.col("_key") == F.col("key"), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    counted = joined.withColumns({"n_lines": n_lines, "n_removed": F.coalesce(F.size("lost"), F.lit(0)).cast("long")}).withColumn("text", _without(F.col("text"), F.col("lost")))
    return counted.select(*unboxed(counted, [c for c in docs.columns if c not in ("n_lines", "n_removed")], used), "n_lines", "n_removed")


def lost_passages(docs: DataFrame, kept: DataFrame, words: int = PASSAGE) -> DataFrame:
    """(doc_id, lost) of documents that repeat a line of over so many words of a document with a lesser doc_id.

    Any two documents count, of one site or of several; kept (_kept_id) names the documents that there are. lost maps the
    key of a text to the places of its lines that go. Keys and null values are those of dedup_lines.
    """
    own = docs.where("text is not null").select(_key().alias("key"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    long = own.where((F.length("line") > 2 * words) & (F.regexp_count("line", F.lit(WORD)) > words)).select("key", "doc_id", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    lines = written(long.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi"), "passages")
    spread = lines.groupBy("h", "g").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("blank"))
    bad = written(spread.where("keeper < last or (keeper is not null and blank > 0)").select("h", "g", "keeper"), "repeated")
    lost = lines.join(bad, ["h", "g"]).where("doc_id > keeper or doc_id is null")
    per = lost.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("places"))
    return per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "places"))).alias("lost"))


def without_passages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lost, ...) with text less its lost passages, and cut: whether it had any."""
    places = F.try_element_at("lost", _key())
    found = docs.withColumn("lost", places)
    cut = F.col("lost").isNotNull()
    return found.withColumn("shorter", _without(F.when(cut, F.col("text")), F.col("lost"))).withColumns({"text": F.when(cut, F.col("shorter")).otherwise(F.col("text")), "cut": cut})


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines, n_removed, n_chars and SHA-256 of the text that stays; a site is a source."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
b AS (SELECT line, min(doc_id) AS keeper FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT site) >= 8),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL AND doc_id > keeper) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL OR doc_id <= keeper), '') AS t
  FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(t)::BIGINT AS n_chars, sha256(t) AS text_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
