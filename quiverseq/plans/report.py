"""Reports of a search, as DataFrames of columns or of lines: tabular, tabular with comments, XML, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import Search

FIELDS = ["Query id", "Subject id", "% identity", "alignment length", "mismatches", "gap openings", "q. start", "q. end", "s. start", "s. end"]


def query_id(description: Column) -> Column:
    """The description up to its first blank."""
    return F.substring_index(description, " ", 1)


def defline_split(description: Column) -> Column:
    """A struct of gi, link (the identifier) and rest of a def-line such as gi|1|gb|A.1|N title."""
    gi = F.regexp_extract(description, r"^gi\|(\d+)", 1)
    after = F.regexp_replace(description, r"^gi\|\d+\|?", "")
    return F.struct(gi.alias("gi"), F.regexp_extract(after, r"^(\S*)", 1).alias("link"), F.regexp_extract(after, r"^\S*\s?(.*)$", 1).alias("rest"))


def fitted(text: Column, width: int) -> Column:
    """Cut to the width, with three dots if something is lost, and padded to it."""
    return F.rpad(F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text), width, " ")


def printed(form: str, number: Column) -> Column:
    """The number as C's printf writes it: the binary value is rounded, ties to even, which the JVM's formatter doesn't do."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(numbers):
        return numbers.map(lambda x: None if x != x or x is None else form % x)

    return text(number.cast("double"))


def expect_text(e: Column) -> Column:
    """An E-value in five characters or so: fewer decimals as it grows, exponents as it shrinks."""
    short = lambda digits: F.rpad(printed(f"%.{digits}f", e), 5, " ")
    power = printed("%.0e", e)
    # The bounds between the forms.
    return (
        F.when(e < 1e-180, F.lit("0.0  ")).when(e < 9.5e-100, F.rpad(F.substring(power, 2, 9), 5, " ")).when(e < 0.00095, F.rpad(power, 5, " "))
        .when(e < 0.0995, short(3)).when(e < 0.95, short(2)).when(e < 9.5, short(1)).otherwise(printed("%5.0f", e))
    )


def two_digits(e: Column) -> Column:
    """%.2g: two significant digits, plain between 1e-4 and 100, else with an exponent; trailing zeros dropped."""
    return printed("%.2g", e)


def strand_label(strand: Column, frame: Column | None = None) -> Column:
    sign = F.when(strand == 1, "-").otherwise("+")
    return sign if frame is None else F.concat(sign, (frame + 1).cast("string"))


def tsv(search: Search, titles: DataFrame) -> DataFrame:
    """One row per alignment with the columns of the tabular report; titles has seqno and subject_id."""
    rows = search.alignments().join(titles.select("seqno", "subject_id"), "seqno")
    return rows.select(
        "qno", "rn", query_id(F.col("description")).alias("query_id"), "subject_id", printed("%.2f", F.lit(100.0) * F.col("identities") / F.col("aligned")).cast("double").alias("pct_identity"),
        "aligned", (F.col("aligned") - F.col("identities") - F.col("indels")).alias("mismatches"), F.col("gaps").alias("gap_openings"), F.col("q_first").alias("q_start"), F.col("q_last").alias("q_end"), F.col("d_first").alias("s_start"), F.col("d_last").alias("s_end"),
        "score", "evalue", "bits",
    )


def tsv_lines(search: Search, titles: DataFrame, comments: bool = False, database: str = "database") -> DataFrame:
    """(qno, line_no, line) of the tabular report, with comment lines if asked for."""
    rows = tsv(search, titles)
    plain = ["aligned", "mismatches", "gap_openings", "q_start", "q_end", "s_start", "s_end"]
    last = [two_digits(F.col("evalue")), printed("%.1f", F.col("bits"))] if search.options.statistics() else [F.col("score").cast("string")]
    line = F.concat_ws("\t", "query_id", "subject_id", printed("%.2f", F.col("pct_identity")), *[F.col(c).cast("string") for c in plain], *last)
    body = rows.select("qno", F.col("rn").cast("int").alias("line_no"), line.alias("line"))
    if not comments:
        return body
    fields = FIELDS + (["e-value", "bit score"] if search.options.statistics() else ["score"])
    heads = F.array(F.lit("# quiverseq search"), F.concat(F.lit("# Query: "), F.col("description")), F.lit(f"# Database: {database}"), F.lit("# Fields: " + ", ".join(fields)))
    first = search.queries.select("qno", F.posexplode(heads).alias("at", "line")).select("qno", (F.col("at") - 4).alias("line_no"), "line")
    return first.unionByName(body)


def _escaped(text: Column) -> Column:
    for symbol, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        text = F.replace(text, F.lit(symbol), F.lit(f"&{name};"))
    return text


def xml_hits(search: Search, titles: DataFrame) -> DataFrame:
    """(qno, rn, xml): one hit element per row; hits beyond the alignment limit lack the alignment."""
    o = search.options
    found = search.hits().where(F.col("rn") <= max(o.descriptions, o.alignments))
    extra = search.alignments().select("qno", "rn", "ops", "q_first", "q_last", "d_first", "d_last", "q_line", "a_line", "d_line")
    lengths = search.db.select("seqno", F.length("residues").alias("d_length"))
    rows = found.join(extra, ["qno", "rn"], "left").join(lengths, "seqno").join(titles.select("seqno", "subject_id"), "seqno").join(F.broadcast(search.queries.select("qno", "description")), "qno")
    element = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    pair = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    shown = F.concat(element("alignment", F.col("ops")), element("qpos", pair("q_first", "q_last")), element("dpos", pair("d_first", "d_last")), element("qseq", F.col("q_line")), element("aseq", F.col("a_line")), element("dseq", F.col("d_line")))
    hit = F.concat(element("hitno", F.col("rn")), element("track", F.col("seqno")), element("query", _escaped(query_id(F.col("description")))), element("name", _escaped(F.col("subject_id"))), element("len", F.col("d_length")), element("score", F.col("score")), F.coalesce(shown, F.lit("")))
    return rows.select("qno", "rn", F.concat(F.lit("<hit>"), hit, F.lit("</hit>")).alias("xml"))


def summary_lines(search: Search, titles: DataFrame) -> DataFrame:
    """(qno, rn, line): the summary table of the plain report."""
    o = search.options
    width = {"blastn": 65, "blastx": 64, "tblastn": 64, "tblastx": 61}.get(o.program, 67)
    rows = search.hits().where(F.col("rn") <= o.descriptions).join(titles.select("seqno", "subject_id"), "seqno")
    parts = [fitted(F.col("subject_id"), width)]
    if o.program == "blastn":
        parts.append(F.concat(F.lit(" "), strand_label(F.col("dstrand"))))
    labels = {"blastx": ["q"], "tblastn": ["d"], "tblastx": ["q", "d"]}.get(o.program, [])
    if labels:
        parts.append(F.concat(F.lit(" "), F.concat_ws("/", *[strand_label(F.col(f"{x}strand"), F.col(f"{x}frame")) for x in labels])))
    if o.statistics():
        parts += [F.concat(F.lit(" "), F.lpad(F.floor(F.col("bits") + 0.5).cast("string"), 5, " ")), F.concat(F.lit(" "), expect_text(F.col("evalue")))]
    else:
        parts.append(F.concat(F.lit(" "), F.lpad(F.col("score").cast("string"), 5, " ")))
    return rows.select("qno", "rn", F.concat(*parts).alias("line"))


def alignment_lines(search: Search, titles: DataFrame, width: int = 60) -> DataFrame:
    """(qno, rn, line_no, line): each shown alignment in blocks of 60 columns, after its title and figures."""
    o = search.options
    rows = search.alignments().join(titles.select("seqno", "subject_id"), "seqno")
    share = lambda name: F.concat(F.col(name).cast("string"), F.lit("/"), F.col("aligned").cast("string"), F.lit(" ("), F.floor(F.col(name) * 100 / F.col("aligned")).cast("string"), F.lit("%)"))
    score = F.concat(F.lit(" Score = "), printed("%.1f", F.col("bits")), F.lit(" bits ("), F.col("score").cast("string"), F.lit("), Expect = "), expect_text(F.col("evalue"))) if o.statistics() else F.concat(F.lit(" Score = "), F.col("score").cast("string"))
    counts = [F.concat(F.lit(" Identities = "), share("identities"))]
    if o.program != "blastn":
        counts.append(F.concat(F.lit(", Positives = "), share("positives")))
    counts.append(F.when(F.col("indels") > 0, F.concat(F.lit(", Gaps = "), share("indels"))).otherwise(F.lit("")))
    a_line = F.col("a_line")
    if o.program == "blastn":
        a_line = F.translate(a_line, "+", " ")
    cut = lambda line, i: F.substring(line, i * width + 1, F.lit(width))
    letters = lambda line, n: F.length(F.replace(F.substring(line, F.lit(1), n), F.lit("-"), F.lit("")))

    def place(side: str, i):
        """Position of a block's first residue on the sequence as given."""
        at = F.col(f"{side}_start") + letters(F.col(f"{side}_line"), i * width)
        minus, whole, frame = F.col(f"{side}strand") == 1, F.col(f"{side}_nt"), F.col(f"{side}frame")
        if o.program in (("blastx", "tblastx") if side == "q" else ("tblastn", "tblastx")):
            return F.when(minus, whole - 3 * at - frame).otherwise(3 * at + frame + 1)
        return F.when(minus, whole - at).otherwise(at + 1) if side == "d" and o.program == "blastn" else at + 1

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("aligned") - 1) / width).cast("int")),
        lambda i: F.array(F.concat(F.lit("Query: "), F.rpad(place("q", i).cast("string"), 8, " "), cut(F.col("q_line"), i)), F.concat(F.lit(" " * 15), cut(a_line, i)), F.concat(F.lit("Sbjct: "), F.rpad(place("d", i).cast("string"), 8, " "), cut(F.col("d_line"), i)), F.lit("")),
    )
    lines = F.concat(F.array(F.concat(F.lit(">"), F.col("subject_id")), score, F.concat(*counts), F.lit("")), F.flatten(blocks))
    return rows.select("qno", "rn", F.posexplode(lines).alias("line_no", "line"))
