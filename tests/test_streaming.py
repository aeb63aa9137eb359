"""The event-time aggregates give a stream the rows they give the table."""

from lodestra.streaming import events


def test_stream_equals_table(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{n} {k}" for n, k in table.dtypes)
    for name, run in {"tumbling": events.tumbling, "sliding": events.sliding}.items():
        q = run(events.read_stream(spark, f"{tmp_path}/in", schema)).writeStream.outputMode("complete").format("memory").queryName(f"s_{name}").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(f"s_{name}").collect())) == sorted(map(tuple, run(table).collect()))
