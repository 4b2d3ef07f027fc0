from quiverseq.plans.search import Options, Search
from quiverseq.streaming.search import search_stream


def test_streamed_queries_find_what_one_search_finds(spark, tmp_path):
    db = spark.createDataFrame([(0, "MKWYHMKWYH"), (1, "ACDEFGHIKL"), (2, "WWWWYHMK")], "seqno long, residues string")
    queries = spark.createDataFrame([(i, f"q{i}", s) for i, s in enumerate(["MKWYH", "DEFGH", "WWYHM"])], "qno int, description string, residues string")
    for i in range(3):
        queries.where(f"qno = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = []
    options = Options(program="blastp", expect=1e9)
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = search_stream(stream, db, options, lambda hits, n: found.extend(map(tuple, hits.select("qno", "seqno", "score", "rn").collect())), str(tmp_path / "checkpoint"))
    run.processAllAvailable()
    run.stop()
    assert sorted(found) == sorted(map(tuple, Search(queries, db, options).hits().select("qno", "seqno", "score", "rn").collect()))
