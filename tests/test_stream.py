from lexweave.sources import text
from lexweave.streaming.static_join import join_stream


def test_stream_of_records(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate([[(0, "a b"), (1, "q")], [(2, "a")]]):
        text.with_tokens(spark.createDataFrame(part, "id long, raw string")).coalesce(1).write.parquet(f"{src}/{n}")
    right = text.with_tokens(spark.createDataFrame([(7, "c"), (8, "x")], "id long, raw string"))
    stream = spark.readStream.schema("id long, raw string, toks array<string>").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(src))
    q = join_stream(stream, right, text.rules_of(spark, [("a b", "c"), ("a", "x")]), sink=sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id1, r.id2) for r in spark.read.parquet(sink).collect()} == {(0, 7), (2, 8)}
