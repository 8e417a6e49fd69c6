"""Aggregates, rankings and sequence measures over selections, texts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import FEATURE_BITS


def tag_histogram(symbols: DataFrame) -> DataFrame:
    """(tag, n) by falling count, then name; symbols: tags array."""
    return symbols.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def strongest_pairs(pairs: DataFrame) -> DataFrame:
    """(src, dst, confidence): the largest confidence of each pair, from all languages."""
    return pairs.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def causal_edges(edges: DataFrame, data_flow: DataFrame, guards: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, weight, synthetic): structural edges with their indicators, and indicated pairs that aren't edges but join known nodes.

    edges: src, dst, relation; data_flow, guards: src, dst, confidence; nodes: node.
    """
    from ..functions.scores import causal_edge_weight

    df, gd = strongest_pairs(data_flow).withColumnRenamed("confidence", "i_df"), strongest_pairs(guards).withColumnRenamed("confidence", "i_g")
    structural = edges.join(df, ["src", "dst"], "left").join(gd, ["src", "dst"], "left").withColumn("synthetic", F.lit(False))
    own = edges.select("src", "dst").distinct()
    known = nodes.select("node").distinct()
    extra = df.join(gd, ["src", "dst"], "full").join(own, ["src", "dst"], "left_anti").join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    extra = extra.withColumns({"relation": F.lit("CALLS"), "synthetic": F.lit(True)})
    both = structural.unionByName(extra)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("src", "dst", "relation", causal_edge_weight(F.col("relation"), zero("i_df"), zero("i_g")).alias("weight"), "synthetic")


def bit_frequencies(masks: DataFrame) -> DataFrame:
    """(feature, df, idf): symbols that have each bit, and ln(N / (1 + df)); masks: mask."""
    # one pass: a count for each known bit, then as rows
    sums = masks.agg(F.count("*").alias("n"), *(F.count_if(F.col("mask").bitwiseAND(F.lit(1 << b)) != 0).alias(n) for n, b in FEATURE_BITS.items()))
    rows = sums.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("df")) for f in FEATURE_BITS))).alias("r")).select("n", "r.*")
    return rows.where("df > 0").select("feature", "df", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))


def coverage(candidates: DataFrame) -> DataFrame:
    """(query, reachable_mask, packed_mask, gap_mask, n_reachable, n_packed); candidates: query, mask, packed boolean."""
    out = candidates.groupBy("query").agg(F.bit_or("mask").alias("reachable_mask"), F.bit_or(F.when(F.col("packed"), F.col("mask")).otherwise(F.lit(0).cast("long"))).alias("packed_mask"), F.count("*").alias("n_reachable"), F.count_if("packed").alias("n_packed"))
    return out.withColumn("gap_mask", F.col("reachable_mask").bitwiseAND(F.bitwise_not("packed_mask")))


def covered_idf(packages: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(query, fcc): summed idf of the features a package covers, per 1,000 tokens; null without features; packages: query, mask, tokens."""
    masks = packages.groupBy("query").agg(F.bit_or("mask").alias("mask"), F.sum("tokens").alias("tokens"))
    known = F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(1 << b).cast("long").alias("bit")) for n, b in FEATURE_BITS.items()))
    held = masks.select("query", "tokens", F.explode_outer(F.filter(known, lambda b: b["bit"].bitwiseAND(F.col("mask")) != 0)).alias("f")).select("query", "tokens", "f.feature")
    joined = held.join(F.broadcast(frequencies), "feature", "left")  # a row for each known bit
    return joined.groupBy("query").agg((F.sum("idf") * 1000 / F.max("tokens")).alias("fcc"))


def recall(selected: Column, truth: Column) -> Column:
    """Share of truth selected; 1 if there is none."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.size(F.array_intersect(selected, truth)) / F.size(truth))


def strict_recall(selected: Column, truth: Column) -> Column:
    return F.when(F.size(F.array_except(truth, selected)) == 0, 1.0).otherwise(0.0)


def false_share(selected: Column, truth: Column) -> Column:
    return F.when(F.size(selected) == 0, 0.0).otherwise(F.size(F.array_except(selected, truth)) / F.size(selected))


def precision_recall_f1(predicted: Column, truth: Column) -> list[Column]:
    """precision, recall and f1 of two sets; two empty sets have 1, one empty set 0."""
    hit, p, r = F.size(F.array_intersect(predicted, truth)), F.size(predicted), F.size(truth)
    both_empty, any_empty = (p == 0) & (r == 0), (p == 0) | (r == 0)
    rule = lambda x: F.when(both_empty, 1.0).when(any_empty, 0.0).otherwise(x)
    return [rule(hit / p).alias("precision"), rule(hit / r).alias("recall"), rule(2 * hit / (p + r)).alias("f1")]


def dice(a: Column, b: Column) -> Column:
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def redundant(nodes: DataFrame) -> DataFrame:
    """(query, node): nodes all of whose bits some other node of the query has too; nodes: query, node, mask."""
    bits = F.array(*(F.lit(1 << b).cast("long") for b in FEATURE_BITS.values()))
    each = nodes.select("query", "node", F.explode(F.filter(bits, lambda b: b.bitwiseAND(F.col("mask")) != 0)).alias("bit"))
    often = each.groupBy("query", "bit").agg(F.count("*").alias("n"))
    return each.join(often, ["query", "bit"]).groupBy("query", "node").agg(F.min("n").alias("least")).where("least >= 2").select("query", "node")


def agreement(kappa: Column, adjudicated: Column) -> Column:
    """Gate of a task: accepted from 0.8 on, from 0.6 on if it was adjudicated, else rejected."""
    return F.when(kappa >= 0.8, "accept").when((kappa >= 0.6) & adjudicated, "accept").when(kappa >= 0.6, "needs_adjudication").otherwise("reject")


def mode_by_group(rows: DataFrame, group: str, text: str, order: str, most: int = 20) -> DataFrame:
    """(group, text, n): the commonest text of a group's first rows by order, most of them; ties to the first seen."""
    w = Window.partitionBy(group).orderBy(order)
    first = rows.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= most)  # a rank filter, so Spark keeps most rows a group before the shuffle
    counted = first.groupBy(group, text).agg(F.count("*").alias("n"), F.min("k_").alias("k"))
    return counted.groupBy(group).agg(F.max_by(F.struct(text, "n"), F.struct(F.col("n"), -F.col("k"))).alias("b")).select(group, f"b.{text}", "b.n")


#: Groups whose sums of all resamples a task of the bootstrap holds at a time.
GROUPS_AT_ONCE = 64


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """keys, mean, low, high: Poisson bootstrap; rows without a value count nowhere.

    Equal rows draw their weights together, as a sum of Poisson(1) is a Poisson of their number, so draws grow
    with distinct values. They are seeded by keys and value, and sums of each task are added up.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("n_"))
    group = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    text = F.to_json(group, {"ignoreNullFields": "false"})
    seeded = counted.select(text.alias("g_"), "v_", "n_", F.xxhash64(text, "v_").alias("seed_"))

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}

        def out():
            for g, (s, n) in sums.items():
                yield pa.RecordBatch.from_pydict({"g_": pa.array([g] * resamples, pa.string()), "b_": pa.array(range(resamples), pa.int32()), "s": pa.array(s), "n": pa.array(n)})
            sums.clear()

        for batch in batches:
            for g, v, n, seed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g not in sums:
                    if len(sums) >= GROUPS_AT_ONCE:
                        yield from out()
                    sums[g] = (np.zeros(resamples), np.zeros(resamples, np.int64))
                w = np.random.Generator(np.random.SFC64(seed & (1 << 64) - 1)).poisson(n, resamples)
                sums[g][0][:] += w * v
                sums[g][1][:] += w
        yield from out()

    drawn = seeded.repartition("g_", F.pmod("seed_", F.lit(64))).mapInArrow(draw, "g_ string, b_ int, s double, n long")
    sums = drawn.groupBy("g_", "b_").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    tail = (1 - confidence) / 2
    ends = sums.groupBy("g_").agg(F.percentile(F.col("s") / F.col("n"), F.lit(tail)).alias("low"), F.percentile(F.col("s") / F.col("n"), F.lit(1 - tail)).alias("high"))
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean")).withColumn("g_", text)
    return means.join(ends, "g_", "left").select(*keys, "mean", "low", "high")


def paired_deltas(baseline: DataFrame, treatment: DataFrame, keys: list[str], field: str) -> DataFrame:
    """keys and delta: treatment minus baseline of the cells that both have."""
    return baseline.select(*keys, F.col(field).alias("a_")).join(treatment.select(*keys, F.col(field).alias("b_")), keys).select(*keys, (F.col("b_") - F.col("a_")).alias("delta"))


def latest_by_key(reports: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The newest row of each key."""
    return reports.groupBy(*keys).agg(F.max_by(F.struct(*reports.columns), F.col(recency)).alias("r")).select("r.*")


def phantom_mentions(texts: DataFrame, known: DataFrame, pattern: str = r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)") -> DataFrame:
    """(id, mentions, phantom, ratio): dotted names in a text whose root is known but which are not; texts: id, text; known: name."""
    named = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("name"))
    roots = known.select(F.substring_index("name", ".", 1).alias("root"), F.lit(True).alias("root_known")).distinct()
    joined = named.withColumn("root", F.substring_index("name", ".", 1)).join(roots, "root", "left").join(known.select("name", F.lit(True).alias("known")).distinct(), "name", "left")
    ghost = F.col("root_known") & F.col("known").isNull()
    counts = joined.groupBy("id").agg(F.count("*").alias("mentions"), F.count_if(ghost).alias("phantom"))
    return counts.withColumn("ratio", F.round(F.col("phantom") / F.col("mentions"), 6))


def words(text: Column) -> Column:
    """Words between spaces, tabs, line and form feeds and carriage returns."""
    return F.filter(F.split(text, r"[\t\n\f\r ]+"), lambda x: x != "")


def token_windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """array<struct<first, tokens>>: windows of size tokens with overlap; no window of overlap alone."""
    tokens = words(text)
    n, stride = F.size(tokens), size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda i: (n > 0) & ((i == 0) | (i + overlap < n)))
    return F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice(tokens, i + 1, size).alias("tokens")))


#: Pairs of query and term that may be sent to the documents.
ASKED_SENT = 200_000
#: Documents whose scores are worked out together.
DOCUMENTS_AT_ONCE = 1000


def _postings(terms, vocabulary):
    """Of an Arrow array of lists of terms: (row, term, tf), rows and places in the vocabulary (an Arrow array) as numpy arrays, sorted."""
    import numpy as np
    import pyarrow.compute as pc

    row, place = pc.list_parent_indices(terms), pc.index_in(pc.list_flatten(terms), vocabulary)
    known = pc.is_valid(place)
    key = pc.filter(row, known).to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(vocabulary)) + pc.filter(place, known).to_numpy(zero_copy_only=False)
    key, tf = np.unique(key, return_counts=True)
    return *np.divmod(key, max(1, len(vocabulary))), tf


def _bm25_sent(documents: DataFrame, asked: DataFrame, top: int, k1: float, b: float) -> DataFrame:
    """bm25 for asked (query, term) that fit every task and documents that have a doc each: two passes over the documents, of which only sums by term and the best of each batch are shuffled."""
    spark = documents.sparkSession
    asked = asked.select(F.dense_rank().over(Window.orderBy("query")).alias("q"), "query", "term")  # ASKED_SENT rows at most
    pairs = asked.select("q", "term").toPandas()  # ASKED_SENT rows at most
    words_ = sorted(set(pairs["term"]))
    place = {w: i for i, w in enumerate(words_)}
    by_term: list[list[int]] = [[] for _ in words_]
    for q, w in zip(pairs["q"], pairs["term"], strict=True):
        by_term[place[w]].append(int(q))
    sent = spark.sparkContext.broadcast((words_, by_term))
    n, mean_length = documents.agg(F.count("*"), F.avg(F.size("terms"))).first()

    def frequencies(batches):
        import numpy as np
        import pyarrow as pa

        vocabulary, total = pa.array(sent.value[0], pa.string()), np.zeros(len(sent.value[0]), np.int64)
        for batch in batches:
            total += np.bincount(_postings(batch.column(0), vocabulary)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int64)), pa.array(total[total > 0])], ["t", "df"])

    found = documents.select("terms").mapInArrow(frequencies, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    idf = found.select("t", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).collect()  # one row an asked term
    mean = sum(r.idf for r in sorted(idf)) / max(1, len(idf))
    weight = {r.t: 0.25 * mean if r.idf < 0 else r.idf for r in idf}
    weighed = spark.sparkContext.broadcast([weight.get(i, 0.0) for i in range(len(words_))])
    doc_type = documents.schema["doc"].dataType.simpleString()

    def best(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        vocabulary, by = pa.array(sent.value[0], pa.string()), sent.value[1]
        idf_of, many, start = np.array(weighed.value), np.array([len(x) for x in by], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in by])]).astype(np.int64)
        all_queries = np.array([q for x in by for q in x], np.int64)
        width = int(all_queries.max(initial=0)) + 1
        for whole in batches:
            for k in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(k, DOCUMENTS_AT_ONCE)
                row, term, tf = _postings(batch.column(1), vocabulary)
                length = np.bincount(pa.compute.list_parent_indices(batch.column(1)).to_numpy(zero_copy_only=False), minlength=batch.num_rows)
                part = idf_of[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean_length)) if len(row) else np.zeros(0)
                times = many[term]
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                key = np.repeat(row, times) * width + all_queries[np.repeat(start[term], times) + at]
                size = batch.num_rows * width
                score, hit = np.bincount(key, np.repeat(part, times), size), np.bincount(key, minlength=size) > 0
                d, q = np.divmod(np.flatnonzero(hit), width)
                score = score[hit]
                by_doc = np.empty(batch.num_rows, np.int64)
                by_doc[pa.compute.array_sort_indices(batch.column(0)).to_numpy()] = np.arange(batch.num_rows)
                order = np.lexsort((by_doc[d], -score, q))
                d, q, score = d[order], q[order], score[order]
                # the first top of a query, and what rounding may bring before the last of them; of equal scores the first top by doc
                last = np.minimum(np.searchsorted(q, q) + top - 1, np.searchsorted(q, q, "right") - 1)
                other = np.concatenate([[True], (q[1:] != q[:-1]) | (score[1:] != score[:-1])])[: len(q)]
                place_in_run = np.arange(len(q)) - np.maximum.accumulate(np.where(other, np.arange(len(q)), 0))
                keep = (score >= score[last] - 1e-8) & (place_in_run < top)
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), batch.column(0).take(pa.array(d[keep])), pa.array(score[keep])], ["q", "doc", "score"])

    scored = documents.select("doc", "terms").mapInArrow(best, f"q long, doc {doc_type}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "doc"))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(asked.select("q", "query").distinct()), "q").select("query", "doc", "score", "rank")


def bm25(documents: DataFrame, queries: DataFrame, top: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank): Okapi ranks of documents (doc, terms array) for queries (query, terms array).

    Only postings of asked terms are joined. Document frequencies come from all documents; a term in over half
    of them weighs a quarter of the mean idf of asked terms. Where the queries are few enough to be sent to the
    documents, only the first top of each query in each batch are shuffled; docs must be whole numbers or texts, each once.
    """
    if top:
        asked = queries.select("query", F.explode(F.array_distinct("terms")).alias("term")).where("term IS NOT NULL")
        if documents.schema["doc"].dataType.simpleString() in ("int", "bigint", "string") and asked.count() <= ASKED_SENT:
            docs = documents.agg(F.count("*").alias("n"), F.count_distinct("doc").alias("own")).first()
            if docs.n == docs.own:
                return _bm25_sent(documents, asked, top, k1, b)
    lengths = documents.select("doc", F.size("terms").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    asked = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    postings = documents.select("doc", F.size("terms").alias("len"), F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))  # one row
    idf = df.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg(F.avg("idf").alias("mean"))
    idf = idf.join(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("mean")).otherwise(F.col("idf"))).select("term", "idf", "avg")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = postings.join(idf, "term").join(asked, "term").groupBy("query", "doc").agg(F.sum(part).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def islands(rows: DataFrame, key: str, position: str, flag: Column) -> DataFrame:
    """(key, first, last, n): maximal runs of rows where flag holds, by position."""
    w = Window.partitionBy(key).orderBy(position)
    marked = rows.select(key, F.col(position).alias("pos"), flag.alias("flag"), F.row_number().over(w).alias("i"))
    run = marked.where("flag").withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    return run.groupBy(key, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("run")


def chain_score(text: Column, pipeline: Column) -> Column:
    """1 if the names of pipeline first occur in text in strictly rising places, else 0."""
    places = F.transform(pipeline, lambda p: F.instr(text, p))
    rising = F.aggregate(places, F.lit(0), lambda last, p: F.when((last >= 0) & (p > last), p).otherwise(-1))
    return F.when(rising >= 0, 1.0).otherwise(0.0)


def ordered_coverage(pipeline: Column, found: Column) -> Column:
    """Longest common subsequence of two arrays over the first's length; a dynamic programme in expressions."""
    n = F.size(pipeline)
    zero = F.array_repeat(F.lit(0), n + 1)

    def row(previous, x):
        # current[i + 1] = previous[i] + 1 at a match, else the larger neighbour
        return F.aggregate(
            F.sequence(F.lit(1), n), F.array(F.lit(0)),
            lambda current, i: F.concat(current, F.array(F.when(F.element_at(pipeline, i) == x, F.element_at(previous, i) + 1).otherwise(F.greatest(F.element_at(previous, i + 1), F.element_at(current, -1))))),
        )

    last = F.aggregate(found, zero, row)
    return F.when(n == 0, 1.0).otherwise(F.element_at(last, -1) / n)


def guard_pairs(calls: DataFrame) -> DataFrame:
    """(def, src, dst, confidence) from calls (def, pos, callee, block, kind): condition and body of a predicate at 1.0, consecutive calls of a try at 0.9, an early return's call and the next at 0.9."""
    c = calls.where("kind = 'condition'").select("def", "block", F.col("callee").alias("src"))
    predicate = c.join(calls.where("kind = 'body'").select("def", "block", F.col("callee").alias("dst")), ["def", "block"]).select("def", "src", "dst", F.lit(1.0).alias("confidence"))
    tried = Window.partitionBy("def", "block").orderBy("pos")
    consecutive = calls.where("kind = 'try'").select("def", F.col("callee").alias("src"), F.lead("callee").over(tried).alias("dst"), F.lit(0.9).alias("confidence")).where("dst IS NOT NULL")
    whole = Window.partitionBy("def").orderBy("pos")
    early = calls.select("def", "kind", F.col("callee").alias("src"), F.lead("callee").over(whole).alias("dst")).where("kind = 'early' AND dst IS NOT NULL").select("def", "src", "dst", F.lit(0.9).alias("confidence"))
    return predicate.unionByName(consecutive).unionByName(early)


def fractional_bound(candidates: DataFrame, budget: str, cost: int = 15) -> DataFrame:
    """(query, bound): value of the best fractional fill at cost each; candidates: query, value, and budget of the query."""
    w = Window.partitionBy("query").orderBy(F.desc("value"))
    ranked = candidates.withColumn("k", F.row_number().over(w))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(budget) - cost * (F.col("k") - 1)) / cost))
    return ranked.groupBy("query").agg(F.sum(F.col("value") * share).alias("bound"))


def rate_limited(hits: DataFrame, key: str, ts: str, seconds: int = 60, most: int = 60) -> DataFrame:
    """hits with in_window (earlier hits of the key in the last seconds, the far end left out) and allowed."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    counted = hits.withColumn("in_window", F.count("*").over(w) - 1)
    return counted.withColumn("allowed", F.col("in_window") < most)
