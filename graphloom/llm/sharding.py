"""Sharding by extendible hashing.

A directory is indexed by the leading bits of each row's hash. Only a bucket over
the byte limit splits, on the next bit, until every bucket fits. Sizes are summed
by hash prefix, so buckets split over a table of prefixes and not over rows. Rows
whose hashes agree in all bits, and so can't be parted, overflow into pages: each
takes its place in the bucket's running total of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import free_name, sized, table, written

#: Bits of a hash in use, and bits that one round looks at.
HASH_BITS, ROUND_BITS = 60, 10
SHARD_BYTES = 16 << 20
#: Of a query that splits buckets to several depths on small tables too.
SMALL_BYTES = 64 << 10


def directory(rows: DataFrame, limit: int, start_bits: int) -> DataFrame:
    """(prefix, bits, shard_bytes, rows): the buckets; rows: h long of HASH_BITS bits, n_bytes long.

    Buckets over limit are returned as they are if they hold one row or have HASH_BITS bits.
    """
    leaves, waiting, done = None, rows.select("h", "n_bytes"), 0
    while True:
        upto = min(HASH_BITS, done + (max(ROUND_BITS, start_bits) if not done else ROUND_BITS))
        fine = written(waiting.groupBy(F.shiftright("h", HASH_BITS - upto).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n")))
        depths = F.explode(F.sequence(F.lit(done), F.lit(upto))).alias("bits")
        sizes = fine.select(depths, "prefix", "n_bytes", "n").groupBy("bits", F.expr(f"shiftright(prefix, {upto} - bits)").alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("rows"))
        sizes = written(sizes)
        over = sizes.where((F.col("shard_bytes") > limit) & (F.col("rows") > 1)).select((F.col("bits") + 1).alias("bits"), F.col("prefix").alias("parent"))
        child = sizes.where(F.col("bits") > done).withColumn("parent", F.shiftright("prefix", 1)).join(over, ["bits", "parent"], "left_semi").select("prefix", "bits", "shard_bytes", "rows")
        first = sizes.where(F.col("bits") == done).select("prefix", "bits", "shard_bytes", "rows")
        level = child.unionByName(first) if not done else child
        fits = (F.col("shard_bytes") <= limit) | (F.col("rows") == 1) | (F.col("bits") == HASH_BITS)
        found = level.where(fits)
        leaves = found if leaves is None else leaves.unionByName(found)
        left = written(level.where(~fits & (F.col("bits") == upto)).select("prefix"))
        n = left.count()
        if not n:
            return written(leaves)
        done = upto
        waiting = waiting.withColumn("p", F.shiftright("h", HASH_BITS - upto)).join(sized(left.withColumnRenamed("prefix", "p"), n, 16), "p", "left_semi").select("h", "n_bytes")


def placed(docs: DataFrame, limit: int, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """id, n_bytes, shard, shard_bytes of each row of docs, and with carry its columns as the struct q_row."""
    digits = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.md5(digits), 1, HASH_BITS // 4), 16, 10).cast("long")
    kept = [F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("q_row")] if carry else []
    more = ["q_row"] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), h.alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *kept)
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    start_bits = min(HASH_BITS, max(1, int(total) // max(1, limit)).bit_length() + 3)
    buckets = directory(rows, limit, start_bits)
    kinds = buckets.groupBy("bits").agg(F.count("*").alias("n"), F.max(F.when(F.col("rows") > 1, F.col("shard_bytes"))).alias("most")).collect()  # HASH_BITS rows at most
    n = sum(r.n for r in kinds)
    if not kinds:
        return rows.select("id", "n_bytes", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), *more).where(F.lit(False))
    # a row tries the depths in use; exactly one prefix of it is a bucket
    tries = F.array(*(F.struct(F.lit(r.bits).alias("bits"), F.shiftright("h", HASH_BITS - r.bits).alias("prefix")) for r in sorted(kinds, key=lambda r: r.bits)))
    found = rows.withColumn("t", F.explode(tries)).select("id", "n_bytes", "t.bits", "t.prefix", *more).join(sized(buckets, n, 32), ["bits", "prefix"])
    name = F.when(F.col("bits") == 0, "").otherwise(F.expr("right(concat(repeat('0', 64), bin(prefix)), bits)"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("rows") == 1)
    fit = found.where(fits).select("id", "n_bytes", F.concat(name, F.lit(".0")).alias("shard"), "shard_bytes", *more)
    if any((r.most or 0) > limit for r in kinds):
        fit = fit.unionByName(pages(found.where(~fits).select("id", "n_bytes", name.alias("bucket"), *more), limit))
    return fit


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, shard (its bits as '01...', then '.' and a page), shard_bytes.

    n_bytes is the text's length in UTF-8, 0 for null. A shard has at most limit bytes, or one row that
    alone has more. The hash is of the id's decimal digits (null: empty), so rows with one id go to
    one bucket, and overflow into pages of it if they don't fit. An empty table has no shards. Other
    columns are ignored.
    """
    return placed(docs, limit, id_col, text_col).withColumnRenamed("id", id_col)


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of rows (id, n_bytes, bucket and others) that no bit can part: each page of limit bytes at most, or one row.

    Rows of one size are alike here, so their number decides: size classes (powers of two) are packed
    apart, limit // class of them to a page, by their running number within salted groups.
    """
    top = F.greatest(F.col("n_bytes"), F.lit(1))
    cls = F.when(top >= limit, F.lit(63)).otherwise(F.length(F.bin(top)))
    per_page = F.expr(f"greatest(1L, {limit}L div shiftleft(1L, least(cls, 62)))")
    salted = written(rows.withColumns({"cls": cls, "salt": F.spark_partition_id()}).withColumn("per_page", per_page))
    w = Window.partitionBy("bucket", "cls", "salt").orderBy("id")
    numbered = salted.withColumn("page", F.floor((F.row_number().over(w) - 1) / F.col("per_page")))
    named = written(numbered.withColumn("shard", F.concat_ws(".", F.col("bucket"), F.concat(F.lit("p"), F.concat_ws("-", "cls", "salt", "page")))))
    sizes = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return named.join(sizes, "shard").select("id", "n_bytes", "shard", "shard_bytes", *(c for c in rows.columns if c not in ("id", "n_bytes", "bucket")))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs under path, one folder per shard, with all columns; returns shard, n_docs and shard_bytes of each folder.

    Rows carry their shard, so each row of docs is written once: also those with a null id, a null
    text or an id or row that repeats. The folders are named by the column shard, or q_shard (and so
    on) if docs has one of that name. Shards look like numbers: read with
    spark.sql.sources.partitionColumnTypeInference.enabled false to get their names back. An empty
    table writes no folder.
    """
    name = free_name("shard", docs.columns)
    rows = placed(docs, limit, id_col, text_col, carry=True)
    named = rows.select(*(F.col(f"q_row.c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("shard").alias(name))
    named.repartition(name).write.partitionBy(name).parquet(path)
    return rows.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("shard_bytes"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), SMALL_BYTES)


_SQL = """
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
e AS (SELECT doc_id, n_bytes, bits, h >> (60 - bits) AS prefix FROM r, (SELECT unnest(range(0, 41)) AS bits)),
s AS (SELECT bits, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n FROM e GROUP BY bits, prefix),
leaf AS (SELECT c.bits, c.prefix, c.shard_bytes FROM s c LEFT JOIN s p ON p.bits = c.bits - 1 AND p.prefix = c.prefix >> 1
    WHERE (c.shard_bytes <= {limit} OR c.n = 1) AND (c.bits = 0 OR p.shard_bytes > {limit} AND p.n > 1))
SELECT e.doc_id, e.n_bytes, CASE WHEN e.bits = 0 THEN '' ELSE right(repeat('0', 64) || bin(e.prefix), e.bits::INT) END || '.0' AS shard, leaf.shard_bytes
FROM e JOIN leaf ON e.bits = leaf.bits AND e.prefix = leaf.prefix
"""

QUERIES = {"op7_sharding": op7_sharding, "sharding_small": sharding_small}
SQL = {"op7_sharding": _SQL.format(limit=SHARD_BYTES), "sharding_small": _SQL.format(limit=SMALL_BYTES)}
