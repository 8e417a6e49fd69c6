import json

from graphloom.streaming import traces as st


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"caller": "a", "callee": "b" if i % 2 else "z", "source": "tracer", "timestamp": 1.7e9 + 60 * i}) for i in range(10)))
    symbols = spark.createDataFrame([("a",), ("b",)], "qname string")
    edges = spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, relation string")
    events = st.trace_stream(spark, str(tmp_path / "in"), 1)
    st.accumulate(events, symbols, edges, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "state" / "v1")).collect()] == [("a", "b", "confirmed", 10)]
    q = st.limit_rate(events.selectExpr("caller AS key", "ts"), 120, 1).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count_if(allowed) FROM limited").first()[0] == 5
