"""Queries over the driver's tables, and DuckDB SQL for those that SQL can express.

Documents, benchmark passages, part names and so on are read as residue sequences: protein keeps letters, nucleotide
keeps IUPAC letters. Every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverseq.functions import alphabets, stats
from quiverseq.functions.matrices import blosum62, cells
from quiverseq.operators.alignment import Scoring, align
from quiverseq.operators.kernels import end_point
from quiverseq.plans import report
from quiverseq.plans.search import Options, Search, bounds, chunk_plan, db_frames
from quiverseq.sources.fasta import split_queries, wrapped

NUCLEOTIDE = Options(program="blastn", match=1, mismatch=-3, gap_open=2, gap_extend=2, strands=1, expect=1e9)
PROTEIN = Options(program="blastp", expect=1e9)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sequences(spark, sf_dir, table: str, key: str, text: str, kind: str) -> DataFrame:
    return _table(spark, sf_dir, table).select(F.col(key).cast("long").alias("seqno"), alphabets.residues(F.col(text), kind).alias("residues"))


def _queries(spark, sf_dir, table: str, key: str, text: str, kind: str) -> DataFrame:
    rows = _table(spark, sf_dir, table)
    return rows.select(F.col(key).cast("int").alias("qno"), F.concat(F.lit(f"{table}_"), F.col(key).cast("string"), F.lit(" "), F.col(text)).alias("description"), alphabets.residues(F.col(text), kind).alias("residues"))


def _regions_by_parts(spark, sf_dir: str, options: Options) -> Search:
    """Five short queries against all part names."""
    return Search(_queries(spark, sf_dir, "region", "r_regionkey", "r_name", options.query_kind), _sequences(spark, sf_dir, "part", "p_partkey", "p_name", options.db_kind), options)


def _passages_by_documents(spark, sf_dir: str, **options) -> Search:
    """All benchmark passages against all documents, as protein."""
    o = Options(program="blastp", **options)
    return Search(_queries(spark, sf_dir, "benchmark", "item_id", "text", "protein"), _sequences(spark, sf_dir, "documents", "doc_id", "text", "protein"), o)


def residue_encode_aa(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", alphabets.residues(F.col("text"), "protein").alias("residues"))


def residue_encode_nt(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", alphabets.residues(F.col("text"), "nucleotide").alias("residues"))


def residue_codes(spark, sf_dir):
    codes = alphabets.codes(alphabets.residues(F.col("p_name"), "protein"), "protein")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"), alphabets.symbols(codes, "protein").alias("symbols"))


def reverse_complement(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", alphabets.reverse_complement(alphabets.residues(F.col("text"), "nucleotide")).alias("minus"))


def translate_six_frames(spark, sf_dir):
    rows = _sequences(spark, sf_dir, "documents", "doc_id", "text", "nucleotide")
    return db_frames(rows, Options(program="tblastn")).select("seqno", "dstrand", "dframe", F.col("residues").alias("acids"))


def db_info(spark, sf_dir):
    from quiverseq.plans.search import db_info as info

    return info(_sequences(spark, sf_dir, "documents", "doc_id", "text", "protein"))


def db_info_masked(spark, sf_dir):
    from quiverseq.plans.search import db_info as info

    rows = _sequences(spark, sf_dir, "documents", "doc_id", "text", "protein")
    mask = _table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("seqno"))
    return info(rows.join(mask, "seqno", "left_semi"))


def volume_seqno(spark, sf_dir):
    """Documents by source as volumes: ordinal within the volume plus the sizes of the volumes before it.

    Runs of 4,096 numbers are counted first and their counts summed up in order; only the rows of a run are sorted.
    """
    from pyspark.sql import Window

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.shiftright("doc_id", 12).alias("run"))
    runs = docs.groupBy("source", "run").agg(F.count("*").alias("n"))
    sizes = runs.groupBy("source").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = runs.select("source", "run", before(Window.partitionBy("source").orderBy("run")).alias("first"))
    starts = sizes.select("source", before(Window.orderBy("source")).alias("start"))  # one row per source
    placed = docs.withColumn("at", F.row_number().over(Window.partitionBy("source", "run").orderBy("doc_id")) - 1)
    oid = (F.col("first") + F.col("at")).cast("int")
    return placed.join(firsts, ["source", "run"]).join(starts, "source").select("doc_id", "source", oid.alias("oid"), (F.col("start") + F.col("first") + F.col("at")).alias("seqno"))


def _deflines(spark, sf_dir) -> DataFrame:
    """Documents with def-lines made of their labels: taxid by language, memberships 1 (quality) + 2 (toxic)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = _table(spark, sf_dir, "labels")
    taxid = F.when(F.col("lang") == "en", 9606).when(F.col("lang") == "de", 10090).otherwise(4932)
    line = F.struct(taxid.cast("long").alias("taxid"), (F.col("quality") + 2 * F.col("toxic")).cast("long").alias("memberships"))
    return docs.join(labels, "doc_id").groupBy("doc_id").agg(F.collect_list(line).alias("deflines"))


def taxid_filter(spark, sf_dir):
    """Sequences with a def-line of a listed taxid that passes the membership test of bit 1."""
    passes = lambda d: d["taxid"].isin(9606, 4932) & (d["memberships"].bitwiseAND(F.lit(1)) == 1)
    return _deflines(spark, sf_dir).where(F.exists("deflines", passes)).select("doc_id")


def membership_filter(spark, sf_dir):
    """Def-lines that pass the membership test of bit 2, as shown."""
    lines = F.filter("deflines", lambda d: d["memberships"].bitwiseAND(F.lit(2)) == 2)
    return _deflines(spark, sf_dir).select("doc_id", F.explode(lines).alias("d")).select("doc_id", "d.taxid", "d.memberships")


def mask_filter(spark, sf_dir):
    mask = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(mask, "doc_id", "left_semi")


def fasta_dump(spark, sf_dir):
    """Documents as FASTA records with lines of 80."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("seqno"), alphabets.residues(F.col("text"), "protein").alias("residues"), "lang", "source")
    title = F.concat(F.lit(">lcl|"), F.col("seqno").cast("string"), F.lit(" "), F.col("source"), F.lit(" "), F.col("lang"))
    return rows.select("seqno", F.concat(title, F.lit("\n"), wrapped(F.col("residues"))).alias("record"))


def fasta_queries(spark, sf_dir):
    """Conversations as query files of one record per turn, parsed."""
    turns = _table(spark, sf_dir, "conversations")
    line = F.concat(F.lit(">"), F.col("role"), F.lit("_"), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", r"[>\r]", ""))
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    return split_queries(files, "value", "protein").groupBy("description").agg(F.count("*").alias("records"), F.sum(F.length("residues")).alias("letters"))


def query_id(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", report.query_id(F.col("p_name")).alias("query_id"))


def defline_split(spark, sf_dir):
    line = F.concat(F.lit("gi|"), F.col("p_partkey").cast("string"), F.lit("|lcl|"), F.replace(F.col("p_brand"), F.lit(" "), F.lit("_")), F.lit(" "), F.col("p_name"))
    parts = _table(spark, sf_dir, "part").select("p_partkey", report.defline_split(line).alias("d"))
    return parts.select("p_partkey", "d.gi", "d.link", "d.rest")


def expect_format(spark, sf_dir):
    """The E-value ladder over values spread by part keys; powers are read as decimals, which any engine rounds alike."""
    value = F.concat(F.lit("1e"), (F.col("p_partkey") % 210 - 205).cast("string")).cast("double") * (F.col("p_size") + 1)
    return _table(spark, sf_dir, "part").select("p_partkey", report.expect_text(value).alias("expect"))




def _all(options: Options):
    """Options that keep every pair of a small search."""
    return Options(**{f: getattr(options, f) for f in options.__dataclass_fields__} | {"descriptions": 1 << 30})


def _score_query(options: Options):
    def query(spark, sf_dir):
        found = _regions_by_parts(spark, sf_dir, _all(options)).scored().where("score is not null")
        return found.select("qno", "seqno", "dstrand", "score")

    return query


def topk_hits(spark, sf_dir):
    """The ten best part names of each region, ties by descending seqno."""
    o = Options(program="blastp", expect=1e9, descriptions=10, alignments=10)
    return _regions_by_parts(spark, sf_dir, o).hits().select("qno", "seqno", "score", F.col("rn").cast("long").alias("rn"), F.round("bits", 6).alias("bits"), F.round("evalue", 6).alias("evalue"))


def total_and_obvious_hits(spark, sf_dir):
    o = Options(program="blastp", expect=1e9, min_score=12, max_score=16)
    return _regions_by_parts(spark, sf_dir, o).counts()


def length_adjustment(spark, sf_dir):
    """Length adjustment and E-value bounds of each benchmark passage against the documents."""
    lengths = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("qno"), F.length(alphabets.residues(F.col("text"), "protein")).alias("m")).collect()
    info = db_info(spark, sf_dir).first()
    limits = bounds([(r["qno"], r["m"]) for r in lengths], info["sequences"], info["residues"], Options(min_expect=1e-5))
    p = Options().statistics()
    rows = [(r["qno"], stats.length_adjustment(p, r["m"], info["residues"], info["sequences"]), limits[r["qno"]][0], limits[r["qno"]][1], round(limits[r["qno"]][2], 3)) for r in lengths]
    return spark.createDataFrame(rows, "qno int, adjustment int, lower int, upper int, space double")


def _pairs(spark, sf_dir):
    """Every region name with every nation name: 125 pairs, for end points of each."""
    q = _queries(spark, sf_dir, "region", "r_regionkey", "r_name", "protein").select("qno", F.col("residues").alias("q"))
    d = _sequences(spark, sf_dir, "nation", "n_nationkey", "n_name", "protein").select("seqno", F.col("residues").alias("d"))
    return q.crossJoin(d)  # 5 x 25 rows, the two fixed dimension tables


def _endpoints(hinted: bool):
    def query(spark, sf_dir):
        s = Scoring(blosum62(), 11, 1)

        @F.pandas_udf("struct<score:long,q_end:int,d_end:int>")
        def ends(qs, ds):
            import pandas as pd

            found = [end_point(alphabets.encode(q, "protein"), alphabets.encode(d, "protein"), s.scores, 11, 1, hinted) for q, d in zip(qs, ds)]
            return pd.DataFrame(found, columns=["score", "q_end", "d_end"])

        return _pairs(spark, sf_dir).withColumn("e", ends("q", "d")).where("e.score > 0").select("qno", "seqno", "e.score", "e.q_end", "e.d_end")

    return query


def alignment_rescore(spark, sf_dir):
    """The score that each shown edit script stands for; it equals the kernel's."""
    o = Options(program="blastp", expect=1e9, descriptions=10, alignments=10)
    return _regions_by_parts(spark, sf_dir, o).alignments().select("qno", "seqno", F.col("rescore").alias("score"))


def _titles(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seqno"), F.concat(F.lit("lcl|"), F.col("doc_id").cast("string"), F.lit(" "), F.col("source")).alias("subject_id"))


def tsv_report(spark, sf_dir):
    """The flagship: all benchmark passages against all documents, the five best alignments each."""
    return report.tsv(_passages_by_documents(spark, sf_dir, descriptions=5, alignments=5), _titles(spark, sf_dir))


def _part_titles(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("seqno"), F.col("p_name").alias("subject_id"))


def _nation_titles(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seqno"), F.col("n_name").alias("subject_id"))


def _reported(make, **options):
    def query(spark, sf_dir):
        o = Options(**{"program": "blastp", "expect": 1e9, "descriptions": 8, "alignments": 4} | options)
        return make(_regions_by_parts(spark, sf_dir, o), _part_titles(spark, sf_dir))

    return query


def _translated_search(program: str):
    def query(spark, sf_dir):
        o = Options(program=program, expect=1e9, descriptions=10, alignments=5)
        db = _sequences(spark, sf_dir, "part", "p_partkey", "p_name", o.db_kind)
        found = Search(_queries(spark, sf_dir, "benchmark", "item_id", "text", o.query_kind), db, o)
        return report.tsv(found, _part_titles(spark, sf_dir))

    return query


def sound_search(spark, sf_dir):
    """Region names against nation names as sounds."""
    o = Options(program="sound", descriptions=10, alignments=5)
    db = _sequences(spark, sf_dir, "nation", "n_nationkey", "n_name", "sound")
    return report.tsv(Search(_queries(spark, sf_dir, "region", "r_regionkey", "r_name", "sound"), db, o), _nation_titles(spark, sf_dir))


def nation_search(spark, sf_dir):
    """All nation names against all documents, BLOSUM62: the scoring scan and the ranking."""
    o = Options(program="blastp", expect=1e9, descriptions=20, alignments=0)
    s = Search(_queries(spark, sf_dir, "nation", "n_nationkey", "n_name", "protein"), _sequences(spark, sf_dir, "documents", "doc_id", "text", "protein"), o)
    return s.hits().select("qno", "seqno", "score", F.col("rn").cast("long").alias("rn"))


def chunks(spark, sf_dir):
    """The work chunks of documents by source as volumes, for four workers."""
    sizes = _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()  # one row per source
    plan = chunk_plan([r["n"] for r in sizes], 4)
    return spark.createDataFrame([(r["source"], r["n"], c) for r, c in zip(sizes, plan)], "source string, sequences long, chunks int")


def genetic_codes(spark, sf_dir):
    """All genetic codes, one row per code."""
    return spark.createDataFrame([(n, alphabets.genetic_code(n)) for n in alphabets.DIFFERENCES], "code int, acids string")


QUERIES = {
    "tsv_report": tsv_report,
    "nation_search": nation_search,
    "residue_encode_aa": residue_encode_aa,
    "residue_encode_nt": residue_encode_nt,
    "residue_codes": residue_codes,
    "reverse_complement": reverse_complement,
    "translate_six_frames": translate_six_frames,
    "db_info": db_info,
    "db_info_masked": db_info_masked,
    "volume_seqno": volume_seqno,
    "taxid_filter": taxid_filter,
    "membership_filter": membership_filter,
    "mask_filter": mask_filter,
    "fasta_dump": fasta_dump,
    "fasta_queries": fasta_queries,
    "query_id": query_id,
    "defline_split": defline_split,
    "expect_format": expect_format,
    "sw_score_nt": _score_query(NUCLEOTIDE),
    "sw_score_both_strands": _score_query(Options(program="blastn", match=1, mismatch=-3, gap_open=2, gap_extend=2, expect=1e9)),
    "sw_score_blosum62": _score_query(PROTEIN),
    "topk_hits": topk_hits,
    "total_and_obvious_hits": total_and_obvious_hits,
    "length_adjustment": length_adjustment,
    "alignment_endpoints_hinted": _endpoints(True),
    "alignment_endpoints_unhinted": _endpoints(False),
    "alignment_rescore": alignment_rescore,
    "tsv_lines": _reported(report.tsv_lines),
    "tsv_comment_lines": _reported(lambda s, t: report.tsv_lines(s, t, comments=True)),
    "xml_report": _reported(report.xml_hits),
    "summary_lines": _reported(report.summary_lines),
    "alignment_lines": _reported(report.alignment_lines),
    "blastx_search": _translated_search("blastx"),
    "tblastn_search": _translated_search("tblastn"),
    "tblastx_search": _translated_search("tblastx"),
    "sound_search": sound_search,
    "chunk_plan": chunks,
    "genetic_codes": genetic_codes,
}

# Fixed values of the SQL, stated apart from the functions under test: the genetic codes in the order T, C, A, G.
_CODES = """
1 FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
2 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG
3 FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG
4 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
5 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG
6 FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
9 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG
10 FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
11 FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
12 FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
13 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG
14 FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG
15 FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
16 FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
21 FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG
22 FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
23 FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
"""
_AA = "translate(regexp_replace({0}, '[^A-Za-z*\\-]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_NT = "translate(regexp_replace({0}, '[^ACGTURYMKSWBDHVNacgturymkswbdhvn\\-]', '', 'g'), 'acgturymkswbdhvnU', 'ACGTTRYMKSWBDHVNT')"
_MINUS = "translate(reverse({0}), 'ACGTRYMKSWBDHVN', 'TGCAYRKMSWVHDBN')"
_WRAP = "regexp_replace(regexp_replace({0}, '(.{{80}})', '\\1' || chr(10), 'g'), '([^\\n])$', '\\1' || chr(10))"


def _matrix_sql(scores, kind: str) -> str:
    return "(VALUES " + ", ".join(f"('{d}', '{q}', {s})" for d, q, s in cells(scores, kind)) + ") AS mx(dc, qc, s)"


def _dp_sql(queries: str, subjects: str, scores, kind: str, gap_open: int, gap_extend: int) -> str:
    """CTEs up to dp(qno, seqno, strand, i, j, h): all cells of all pairs, one recursion step per database position.

    queries gives (qno, strand, q) and subjects (seqno, d). Gaps along the query come from a running maximum, as in the
    kernels; rows carry h and e.
    """
    q, r = gap_open + gap_extend, gap_extend
    return f"""
WITH RECURSIVE qs AS ({queries}), ds AS ({subjects}),
mx AS (SELECT * FROM {_matrix_sql(scores, kind)}),
qp AS (SELECT qno, strand, unnest(range(1, length(q) + 1))::INT AS i, q FROM qs),
cell AS (SELECT qno, strand, i, substr(q, i, 1) AS qc FROM qp),
dp AS (
  SELECT c.qno, c.strand, s.seqno, 0 AS j, c.i, 0 AS h, 0 AS e, c.qc, s.d FROM cell c, ds s
  UNION ALL
  SELECT qno, strand, seqno, j, i, greatest(t, f) AS h, greatest(e - {r}, greatest(t, f) - {q}) AS e, qc, d FROM (
    SELECT *, coalesce(max(t + i * {r}) OVER (PARTITION BY qno, strand, seqno ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {gap_open} - i * {r}, -1000000) AS f FROM (
      SELECT p.qno, p.strand, p.seqno, p.j + 1 AS j, p.i, p.qc, p.d, p.e,
             greatest(0, p.e, coalesce(lag(p.h) OVER (PARTITION BY p.qno, p.strand, p.seqno ORDER BY p.i), 0) + mx.s) AS t
      FROM dp p JOIN mx ON mx.dc = substr(p.d, p.j + 1, 1) AND mx.qc = p.qc WHERE p.j < length(p.d))))
"""


_REGION_AA = f"SELECT r_regionkey::INT AS qno, 0 AS strand, {_AA.format('r_name')} AS q FROM region"
_REGION_NT = f"SELECT r_regionkey::INT AS qno, 0 AS strand, {_NT.format('r_name')} AS q FROM region"
_REGION_BOTH = f"SELECT qno, strand, CASE WHEN strand = 1 THEN {_MINUS.format('q')} ELSE q END AS q FROM ({_REGION_NT.replace('0 AS strand', 'unnest([0, 1]) AS strand')})"
_PART_AA = f"SELECT p_partkey::BIGINT AS seqno, {_AA.format('p_name')} AS d FROM part"
_PART_NT = f"SELECT p_partkey::BIGINT AS seqno, {_NT.format('p_name')} AS d FROM part"
_NATION_AA = f"SELECT n_nationkey::BIGINT AS seqno, {_AA.format('n_name')} AS d FROM nation"


def _sql() -> dict[str, str]:
    from quiverseq.functions.matrices import nucleotide_matrix

    p = stats.protein_parameters("BLOSUM62", 11, 1)
    dp_aa, dp_nt = (_dp_sql(a, b, s, k, *g) for a, b, s, k, g in ((_REGION_AA, _PART_AA, blosum62(), "protein", (11, 1)), (_REGION_NT, _PART_NT, nucleotide_matrix(1, -3), "nucleotide", (2, 2))))
    dp_both = _dp_sql(_REGION_BOTH, _PART_NT, nucleotide_matrix(1, -3), "nucleotide", 2, 2)
    dp_ends = _dp_sql(_REGION_AA, _NATION_AA, blosum62(), "protein", 11, 1)
    score = ", sc AS (SELECT qno, seqno, strand, max(h)::BIGINT AS score FROM dp GROUP BY ALL HAVING max(h) > 0) "
    top = score + ", tk AS (SELECT *, row_number() OVER (PARTITION BY qno ORDER BY score DESC, seqno DESC) AS rn FROM sc) "
    adjusted = f""",
tot AS (SELECT sum(length(d))::DOUBLE AS n, count(*)::DOUBLE AS cnt FROM ds),
m AS (SELECT qno, length(q)::DOUBLE AS m, n, cnt FROM qs, tot),
tried AS (SELECT qno, ell, {p.k} * (m - ell) * (n - cnt * ell) AS kmn, greatest(m, n) AS least FROM (SELECT *, unnest(range(0, m::BIGINT)) AS ell FROM m) WHERE n > cnt * ell),
adj AS (
  SELECT m.qno, m.m, m.n, m.cnt, coalesce(f.ell, 0) AS ell
  FROM m LEFT JOIN (SELECT qno, max(ell) AS ell FROM tried WHERE kmn >= least AND ell <= {p.alpha / p.lam!r} * ln(greatest(kmn, 1e-300)) + ({p.beta}) GROUP BY qno) f ON f.qno = m.qno)
"""
    bench = f"WITH RECURSIVE qs AS (SELECT item_id::INT AS qno, {_AA.format('text')} AS q FROM benchmark), ds AS (SELECT {_AA.format('text')} AS d FROM documents)"
    space = f"{p.k} * (adj.m - adj.ell) * (adj.n - adj.cnt * adj.ell)"
    codons = ", ".join(f"('{c}', '{a}')" for c, a in alphabets.codon_table(1).items() if a != "X")
    taxid = "CASE lang WHEN 'en' THEN 9606 WHEN 'de' THEN 10090 ELSE 4932 END"
    return {
        "residue_encode_aa": f"SELECT doc_id, {_AA.format('text')} AS residues FROM documents",
        "residue_encode_nt": f"SELECT doc_id, {_NT.format('text')} AS residues FROM documents",
        "residue_codes": f"""WITH s AS (SELECT p_partkey, {_AA.format('p_name')} AS symbols FROM part)
            SELECT p_partkey, symbols, coalesce(array_to_string(list_transform(string_split(symbols, ''), lambda c: (strpos('-ABCDEFGHIKLMNPQRSTVWXYZU*OJ', c) - 1)::VARCHAR), ','), '') AS codes FROM s""",
        "reverse_complement": f"SELECT doc_id, {_MINUS.format(_NT.format('text'))} AS minus FROM documents",
        "translate_six_frames": f"""WITH codon(c, a) AS (VALUES {codons}), book AS (SELECT map_from_entries(list((c, a))) AS b FROM codon),
            s AS (SELECT doc_id AS seqno, {_NT.format('text')} AS r FROM documents),
            f AS (SELECT seqno, dstrand, dframe, CASE WHEN dstrand = 1 THEN {_MINUS.format('r')} ELSE r END AS r FROM s, (VALUES (0), (1)) x(dstrand), (VALUES (0), (1), (2)) y(dframe))
            SELECT seqno, dstrand, dframe, coalesce(array_to_string(list_transform(range(0, greatest(0, (length(r) - dframe) // 3)), lambda i: coalesce(b[substr(r, (3 * i + dframe + 1)::BIGINT, 3)], 'X')), ''), '') AS acids FROM f, book""",
        "db_info": f"SELECT count(*) AS sequences, coalesce(sum(length({_AA.format('text')})), 0)::BIGINT AS residues, coalesce(max(length({_AA.format('text')})), 0)::INT AS longest FROM documents",
        "db_info_masked": f"SELECT count(*) AS sequences, coalesce(sum(length({_AA.format('text')})), 0)::BIGINT AS residues, coalesce(max(length({_AA.format('text')})), 0)::INT AS longest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "volume_seqno": "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS oid, (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS seqno FROM documents",
        "taxid_filter": f"SELECT DISTINCT doc_id FROM documents JOIN labels USING (doc_id) WHERE {taxid} IN (9606, 4932) AND ((quality + 2 * toxic) & 1) = 1",
        "membership_filter": f"SELECT doc_id, ({taxid})::BIGINT AS taxid, (quality + 2 * toxic)::BIGINT AS memberships FROM documents JOIN labels USING (doc_id) WHERE ((quality + 2 * toxic) & 2) = 2",
        "mask_filter": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
        "fasta_dump": f"SELECT doc_id AS seqno, '>lcl|' || doc_id || ' ' || source || ' ' || lang || chr(10) || {_WRAP.format(_AA.format('text'))} AS record FROM documents",
        "fasta_queries": f"SELECT role || '_' || turn AS description, count(*) AS records, sum(length({_AA.format('text')}))::BIGINT AS letters FROM conversations GROUP BY 1",
        "query_id": "SELECT p_partkey, split_part(p_name, ' ', 1) AS query_id FROM part",
        "defline_split": "SELECT p_partkey, p_partkey::VARCHAR AS gi, 'lcl|' || replace(p_brand, ' ', '_') AS link, p_name AS rest FROM part",
        "sw_score_nt": dp_nt + score + "SELECT qno, seqno, 0 AS dstrand, score FROM sc",
        "sw_score_both_strands": dp_both + score + "SELECT qno, seqno, strand AS dstrand, score FROM sc",
        "sw_score_blosum62": dp_aa + score + "SELECT qno, seqno, 0 AS dstrand, score FROM sc",
        "topk_hits": dp_aa + adjusted + top + f"SELECT tk.qno, seqno, score, rn, round(({p.lam} * score - ln({p.k})) / ln(2), 6) AS bits, round({space} * exp(-{p.lam} * score), 6) AS evalue FROM tk JOIN adj USING (qno) WHERE rn <= 10",
        "total_and_obvious_hits": dp_aa + score + "SELECT qno, count(*) FILTER (score >= 12) AS total_hits, count(*) FILTER (score > 16) AS obvious_hits FROM sc GROUP BY qno",
        "length_adjustment": bench + adjusted + f"SELECT qno, ell::INT AS adjustment, greatest(1, ceil(-ln(10.0 / ({space})) / {p.lam}))::INT AS lower, floor(-ln(1e-5 / ({space})) / {p.lam})::INT AS upper, round({space}, 3) AS space FROM adj",
        "alignment_endpoints_hinted": dp_ends + ", b AS (SELECT *, max(h) OVER (PARTITION BY qno, seqno) AS top FROM dp), r AS (SELECT *, row_number() OVER (PARTITION BY qno, seqno ORDER BY j, i) AS k FROM b WHERE h = top AND h > 0) SELECT qno, seqno, h::BIGINT AS score, (i - 1)::INT AS q_end, (j - 1)::INT AS d_end FROM r WHERE k = 1",
        "alignment_endpoints_unhinted": dp_ends + ", b AS (SELECT *, max(h) OVER (PARTITION BY qno, seqno) AS top FROM dp), r AS (SELECT *, row_number() OVER (PARTITION BY qno, seqno ORDER BY i, j) AS k FROM b WHERE h = top AND h > 0) SELECT qno, seqno, h::BIGINT AS score, (i - 1)::INT AS q_end, (j - 1)::INT AS d_end FROM r WHERE k = 1",
        "alignment_rescore": dp_aa + top + "SELECT qno, seqno, score FROM tk WHERE rn <= 10",
        "expect_format": """WITH v AS (SELECT p_partkey, ('1e' || (p_partkey % 210 - 205))::DOUBLE * (p_size + 1) AS e FROM part)
            SELECT p_partkey, CASE WHEN e < 1e-180 THEN '0.0  ' WHEN e < 9.5e-100 THEN rpad(substr(printf('%.0e', e), 2), 5, ' ') WHEN e < 0.00095 THEN rpad(printf('%.0e', e), 5, ' ')
              WHEN e < 0.0995 THEN rpad(printf('%.3f', e), 5, ' ') WHEN e < 0.95 THEN rpad(printf('%.2f', e), 5, ' ') WHEN e < 9.5 THEN rpad(printf('%.1f', e), 5, ' ') ELSE printf('%5.0f', e) END AS expect FROM v""",
        # With as many volumes as workers, splitting the widest until none exceeds the limit gives each its own quotient.
        "chunk_plan": """WITH v AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM v)
            SELECT source, n AS sequences, ceil(n / (16 * CASE WHEN total >= 256 THEN floor(sqrt(total // 64)) ELSE 1 END))::INT AS chunks FROM v, t""",
        "genetic_codes": "SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(*line.split()) for line in _CODES.split("\n") if line) + ") t(code, acids)",
    }


ORACLE = _sql()
