"""Work that is long for its bytes is dealt to tasks by its number of rows; rows meet classes, not each other."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F


def test_customers_meet_classes_of_suppliers(spark, duck, monkeypatch):
    from graphloom.plans import all as plans
    from graphloom.plans import scalar_queries

    order = lambda rows: sorted(tuple(map(float, r)) for r in rows)
    wanted = order(duck.execute(plans.SQL["score_candidate"]).fetchall())
    for alike in (2, 50_000):
        monkeypatch.setattr(scalar_queries, "ALIKE", alike)
        found = plans.QUERIES["score_candidate"](spark, DATA)
        assert order(found.collect()) == wanted
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate explode(keys") < text.index("BroadcastHashJoin")  # pairs are made after both joins


@pytest.mark.parametrize("partitions", (4, 3))
def test_files_are_parsed_in_tasks_by_their_number(spark, monkeypatch, partitions):
    from graphloom import storage
    from graphloom.sources import python_source

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        monkeypatch.setattr(storage, "tasks_for", lambda rows, each=0: 3 if rows == 40 else 1)
        files = spark.range(40).coalesce(1).select(F.format_string("m%d.py", "id").alias("path"), F.format_string("m%d", "id").alias("module"), F.when(F.col("id") > 0, F.format_string("def f(a: int = %d): pass\n", "id")).alias("content"))
        parsed = python_source.parse_files(files)
        assert parsed.rdd.getNumPartitions() == 3 and python_source.captures(files, "definitions").rdd.getNumPartitions() == 3
        rows = {r.path: r for r in parsed.collect()}
        assert len(rows) == 40 and rows["m0.py"].symbols == [] and rows["m0.py"].exports is None and rows["m0.py"].error is None
        one = rows["m7.py"].symbols[0]
        assert (one.qname, one.start, one.is_async, [tuple(p) for p in one.params], one.bases) == ("m7.f", 1, False, [("a", "int", "7")], [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_texts_are_compressed_in_tasks_by_their_number(spark, monkeypatch):
    from graphloom.operators import compress

    monkeypatch.setattr(compress, "tasks_for", lambda rows, each=0: 4 if rows == 80 else 1)  # as many as a join's exchange has
    files = spark.range(40).select(F.format_string("%d.py", "id").alias("path"), F.lit("python").alias("language"), F.lit("def f(): pass\ndef g(): pass\n").alias("source"))
    each = lambda name, line: files.select(F.concat(F.lit(name), "path").alias("qname"), "path", F.lit(name).alias("name"), F.lit(line).alias("start"), F.lit(line).alias("end"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("calls"))
    found = compress.compress(files, each("f", 1).unionByName(each("g", 2)))
    assert found.rdd.getNumPartitions() == 4
    assert {(r.qname[0], r.l0, r.l3) for r in found.collect()} == {("f", "def f(): pass", "def f(): ..."), ("g", "def g(): pass", "def g(): ...")}
