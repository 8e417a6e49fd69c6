"""Queries are sent to the documents; only the best of a batch are shuffled."""

from pyspark.sql import functions as F


def test_queries_are_sent_to_documents(spark, monkeypatch):
    from graphloom.operators import metrics

    texts = [(i, f"w{i % 7} w{i % 11} w{i % 5} common" + " w3" * (i % 4)) for i in range(900)] + [(901, ""), (902, None), (903, "common common zz")]
    documents = spark.createDataFrame(texts, "doc long, text string").select("doc", F.filter(F.split("text", " "), lambda x: x != "").alias("terms")).repartition(3)
    queries = spark.createDataFrame([(q, [f"w{q}", "w3", "common", f"w{q}", "none"]) for q in range(8)] + [(90, ["none"]), (91, []), (92, None)], "query long, terms array<string>")
    sent = metrics.bm25(documents, queries, top=10)
    monkeypatch.setattr(metrics, "ASKED_SENT", 0)
    joined = metrics.bm25(documents, queries, top=10)
    rows = lambda df: sorted((r.query, r["rank"], r.doc, round(r.score, 9)) for r in df.collect())
    assert rows(sent) == rows(joined) and len(rows(sent)) == 80
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan(sent) and "SortMergeJoin" not in plan(sent) and "MapInArrow" not in plan(joined)
    monkeypatch.undo()
    twice = documents.unionByName(documents.where("doc = 5"))
    assert "MapInArrow" not in plan(metrics.bm25(twice, queries, top=10))
