"""Scans and sinks: source trees, traces, snapshots and keyed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

TRACE = "caller string, callee string, source string, timestamp double, sink_tag string, detail string, callee_file string, callee_line int"
EXPORT = "manifest struct<git_commit_sha:string,environment:string,timestamp:string,file_fingerprints:map<string,string>>, edges array<struct<caller:string,callee:string,count:bigint,errors:bigint>>"
ATTRIBUTE = "struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:string,doubleValue:string>>"
OTLP = f"resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<spanId:string,parentSpanId:string,kind:string,attributes:array<{ATTRIBUTE}>>>>>>>"
FINGERPRINT = "struct<scope:string,kind:string,structural_hash:string>"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")


def discover_files(spark: SparkSession, root: str, tier: str | None = None) -> DataFrame:
    """(path, language, tier, modified, size) of known source files below root, without skipped folders, by path; contents aren't read.

    The driver lists the tree itself: Spark's readers leave out names that begin with an underscore,
    and packages have __init__.py.
    """
    from pyarrow import fs

    store, base = _store(root)
    listed = [(i.path[len(base.rstrip("/")) + 1 :], i.mtime, i.size) for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file]
    df = spark.createDataFrame(listed, "path string, modified timestamp, size long")
    df = df.withColumn("language", text.language_for_path(F.col("path"))).where("language IS NOT NULL").where(~text.ignored_path(F.col("path"))).withColumn("tier", text.precision_tier(F.col("language")))
    return (df.where(F.col("tier") == tier) if tier else df).orderBy("path")


def read_sources(spark: SparkSession, root: str, tier: str | None = None) -> DataFrame:
    """(path, module, language, content, sha) of the discovered files, read by the executors."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")
        for batch in batches:
            for path, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([language]), pa.array([content], pa.binary())], ["path", "language", "raw"])

    raw = discover_files(spark, root, tier).select("path", "language").mapInArrow(read, "path string, language string, raw binary")
    return raw.select("path", text.path_to_module(F.col("path")).alias("module"), "language", F.expr("try_validate_utf8(cast(raw AS string))").alias("content"), F.sha2("raw", 256).alias("sha"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace events of JSON lines; blank lines are nothing, what can't be read is null."""
    return spark.read.schema(TRACE).json(path).where("caller IS NOT NULL OR callee IS NOT NULL OR sink_tag IS NOT NULL")


def write_traces(events: DataFrame, path: str) -> None:
    events.select(*(c.split()[0] for c in TRACE.split(", "))).write.mode("append").json(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """(trace, span_id, parent_id, kind, attributes map) of OTLP JSON files."""
    df = spark.read.schema(OTLP).option("multiLine", "true").json(path).select(F.input_file_name().alias("trace"), F.explode("resourceSpans").alias("r"))
    df = df.select("trace", F.explode("r.scopeSpans").alias("s")).select("trace", F.explode("s.spans").alias("x"))
    value = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"], a["value"]["doubleValue"])
    named = F.filter(F.coalesce("x.attributes", F.array().cast(f"array<{ATTRIBUTE}>")), lambda a: a["key"].isNotNull())
    # of a key that comes twice the last counts
    last = F.filter(named, lambda a, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda b: b["key"] == a["key"]))
    attributes = F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], value(a))))
    return df.select("trace", F.col("x.spanId").alias("span_id"), F.nullif("x.parentSpanId", F.lit("")).alias("parent_id"), F.col("x.kind").alias("kind"), attributes.alias("attributes"))


def read_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Manifests (trace, commit, env, files) and edges (trace, env, caller, callee, count, errors) of native exports."""
    df = spark.read.schema(EXPORT).option("multiLine", "true").json(path).select(F.input_file_name().alias("trace"), "manifest", "edges").where("manifest IS NOT NULL")
    manifests = df.select("trace", F.col("manifest.git_commit_sha").alias("commit"), F.col("manifest.environment").alias("env"), F.col("manifest.file_fingerprints").alias("files"))
    edges = df.select("trace", F.col("manifest.environment").alias("env"), F.explode("edges").alias("e")).where("e.caller IS NOT NULL AND e.callee IS NOT NULL")
    return manifests, edges.select("trace", "env", "e.caller", "e.callee", F.coalesce("e.count", F.lit(0)).alias("count"), F.coalesce("e.errors", F.lit(0)).alias("errors"))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(qname, scope, kind, structural_hash) of a JSON object by name; nothing if it can't be read."""
    df = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.trim("value"), r"\n(?=\{)")).alias("value")).select(F.from_json("value", f"map<string,{FINGERPRINT}>").alias("m"))
    return df.select(F.explode("m").alias("qname", "f")).select("qname", "f.scope", "f.kind", "f.structural_hash")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(path, basis) of a JSON file with an object 'sinks'."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", "sinks map<string,string>").alias("m"))
    return df.select(F.explode("m.sinks").alias("path", "basis"))


def read_jsonc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file with comments, by schema."""
    return spark.read.schema(schema).option("multiLine", "true").option("allowComments", "true").json(path)


def path_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, target) of the path mappings of a tsconfig.json or jsconfig.json: each pattern that ends in *, and its first target below baseUrl."""
    options = read_jsonc(spark, path, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>").select("compilerOptions.*")
    rows = options.select(F.regexp_replace(F.coalesce("baseUrl", F.lit(".")), r"^\./?|/$", "").alias("base"), F.explode("paths").alias("pattern", "targets"))
    bare = lambda c: F.regexp_replace(c, r"\*$", "")
    below = F.regexp_replace(bare(F.get("targets", F.lit(0))), r"^\./", "")
    return rows.where("pattern LIKE '%*' AND size(targets) > 0").select(bare(F.col("pattern")).alias("prefix"), F.concat(F.when(F.col("base") != "", F.concat("base", F.lit("/"))).otherwise(""), below).alias("target"))


def by_file_cached(files: DataFrame, compute, path: str) -> DataFrame:
    """What compute gives for files (path, sha and others), row by row with path: kept at path for files whose hash is unchanged, computed for the others, and kept anew.

    compute takes the files to work on and returns rows with their path. Files that are gone leave the cache.
    """
    from pyspark.errors import AnalysisException

    from ..storage import written

    spark = files.sparkSession
    try:
        kept = written(spark.read.parquet(path).join(files.select("path", "sha"), ["path", "sha"], "left_semi"))
        todo = files.join(spark.read.parquet(f"{path}-files"), ["path", "sha"], "left_anti")
    except AnalysisException:  # nothing kept
        kept, todo = None, files
    fresh = compute(todo).join(files.select("path", "sha"), "path")
    rows = written(fresh if kept is None else kept.unionByName(fresh))
    rows.write.mode("overwrite").parquet(path)
    files.select("path", "sha").distinct().write.mode("overwrite").parquet(f"{path}-files")  # also files without rows
    return rows.drop("sha")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def invalidate(old: DataFrame, keys: DataFrame) -> DataFrame:
    """old without the rows of keys."""
    return old.join(keys, keys.columns, "left_anti")


def save_keyed(df: DataFrame, path: str, signature: str) -> None:
    """Writes what was computed for the files of a signature (contracts, flow results), in place of what was kept for it."""
    df.write.mode("overwrite").parquet(f"{path}/signature={signature}")


def load_keyed(spark: SparkSession, path: str, signature: str) -> DataFrame | None:
    """What save_keyed kept for a signature, or None."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/signature={signature}")
    except AnalysisException:  # nothing kept
        return None


def write_fingerprints(fingerprints: DataFrame, path: str) -> None:
    """(qname, scope, kind, structural_hash) as lines of JSON objects by name, as read_fingerprints reads them."""
    value = F.to_json(F.create_map("qname", F.struct("scope", "kind", "structural_hash")))
    fingerprints.select(value.alias("value")).write.mode("overwrite").text(path)


def clear_cache(spark: SparkSession, path: str) -> None:
    """An empty cache with the schema of the one at path."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def save_snapshot(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Writes each table and then, last, the row that makes the snapshot valid."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version int").write.mode("overwrite").parquet(f"{path}/_valid")


def load_snapshot(spark: SparkSession, path: str, version: int, current: DataFrame) -> dict[str, DataFrame] | None:
    """The tables of a snapshot if its version and its files (path, sha) are those of current, else None: all or nothing."""
    from pyspark.errors import AnalysisException

    from ..operators.joins import snapshot_matches

    try:
        if spark.read.parquet(f"{path}/_valid").first().version != version:
            return None
        if not snapshot_matches(spark.read.parquet(f"{path}/files").select("path", "sha"), current.select("path", "sha")).first().valid:
            return None
        return {n: spark.read.parquet(f"{path}/{n}") for n in ("files", "symbols", "edges")}
    except AnalysisException:  # no snapshot
        return None
