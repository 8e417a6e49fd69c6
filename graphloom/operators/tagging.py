"""Tags of symbols: what they call, are decorated with, raise and change, and where they stand in the call graph.

A symbol's facts are a row of arrays; rules are literal lists held against them by expressions in
the JVM. Sinks are looked up by an equal join on the prefixes of a call's dotted name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bit
from ..storage import sized

# Tag rules. Calls: tag, method names, and the imports one of which must be there.
CALL_RULES = (
    ("#db_write", ("commit", "execute", "save", "insert", "update", "delete", "persist"), ("sqlalchemy", "prisma", "psycopg2", "sql")),
    ("#db_read", ("find_one", "filter", "query", "select", "all", "first"), ("sqlalchemy", "prisma", "pymongo")),
    ("#external_io", ("get", "post", "put", "send", "request", "fetch"), ("requests", "httpx", "aiohttp", "fetch")),
    ("#event_producer", ("emit", "publish", "send_message"), ("celery", "kafka", "pika", "redis")),
)
# Tag and the parts of a decorator's text that give it.
DECORATOR_RULES = (
    ("#route_handler", ("app.get", "app.post", "app.put", "app.delete", "app.route", "router.", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "Route", "ApiController")),
    ("#event_consumer", ("subscribe", "consumer", "app.task")),
    ("#auth_guard", ("PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed", "Authorize", "RequireScope")),
    ("#state_mutation", ("Transactional", "Modifying", "UnitOfWork")),
    ("#db_write", ("Transactional", "Modifying")),
    ("#property", ("property", "cached_property")),
)
# Names of guards, of files and folders of entry points, and of texts that reach outside.
AUTH_CALLS, AUTH_ERRORS = ("verify", "authenticate"), ("Auth", "Permission", "Forbidden")
ENTRY_FILES, ENTRY_FOLDERS = ("main.go", "app.py", "main.py", "index.ts", "index.js", "index.tsx"), ("routes", "api")
IO_TEXTS, GO_ERROR_CHECK = ("requests.", "http.", "os.", "sql.", "net/http", "net.Dial", "fmt.Fprint"), "err != nil"
# Effects by the lower-cased method name and a part of its receiver, and names of calls that assert.
EFFECT_RULES = (
    ("NETWORK_HTTP", ("fetch", "get", "post", "put", "delete", "patch", "request", "send"), ("fetch", "axios", "http", "https", "requests", "httpx", "aiohttp", "urllib", "$http")),
    ("DISK_IO", ("open", "read", "write", "readfile", "writefile", "readfilesync", "writefilesync", "mkdir", "unlink", "exists"), ("fs", "os", "path", "pathlib", "io")),
    ("DOM_MUTATION", ("click", "fill", "check", "uncheck", "type", "press", "settext", "setattribute", "appendchild", "removechild", "remove", "insertadjacenthtml", "focus", "blur", "selectoption", "dragto", "hover", "tap", "scrollintoview", "setitem", "clear"), ("page", "locator", "element", "document", "localstorage", "sessionstorage")),
    ("DOM_READ", ("textcontent", "innertext", "innerhtml", "getattribute", "queryselector", "queryselectorall", "getbytestid", "getbyrole", "getbytext", "getbylabel", "locator", "isvisible", "isenabled", "ischecked", "getitem", "count"), ("page", "locator", "element", "document", "localstorage", "sessionstorage")),
)
ASSERT_CALLS = ("expect", "assert_", "assertequal", "asserttrue", "assertfalse")
#: A category's bit.
SINK_BITS = {"network_io": "SINK_NETWORK_IO", "database_io": "SINK_DATABASE_IO", "filesystem_io": "SINK_FILESYSTEM_IO", "process_io": "SINK_PROCESS_IO", "time_io": "SINK_TIME_IO", "randomness": "SINK_RANDOMNESS"}
# Packages of the default registry by language and category; a call into one of them, at any depth, is a sink.
SINK_PACKAGES = {
    ("python", "network_io"): "requests httpx urllib urllib3 http.client aiohttp socket websockets smtplib ftplib grpc", ("python", "database_io"): "sqlite3 psycopg2 sqlalchemy pymongo redis mysql asyncpg motor",
    ("python", "filesystem_io"): "open pathlib.Path shutil tempfile os.remove os.rename os.mkdir os.makedirs os.listdir os.walk glob", ("python", "process_io"): "subprocess os.system os.popen os.fork os.kill multiprocessing sys.exit signal",
    ("python", "time_io"): "time datetime.datetime.now datetime.date.today", ("python", "randomness"): "random secrets uuid.uuid4 os.urandom",
    ("javascript", "network_io"): "fetch axios http https net XMLHttpRequest WebSocket", ("javascript", "database_io"): "pg mysql mongoose prisma knex redis", ("javascript", "filesystem_io"): "fs", ("javascript", "process_io"): "child_process process",
    ("javascript", "time_io"): "Date setTimeout setInterval performance.now", ("javascript", "randomness"): "Math.random crypto.randomBytes crypto.randomUUID",
    ("go", "network_io"): "net net.http", ("go", "database_io"): "database.sql github.com.jackc.pgx", ("go", "filesystem_io"): "os.Open os.Create os.ReadFile os.WriteFile io.ioutil", ("go", "process_io"): "os.exec os.Exit syscall", ("go", "time_io"): "time", ("go", "randomness"): "math.rand crypto.rand",
}


def _any(texts: Column, parts: tuple[str, ...]) -> Column:
    """Whether any text holds any of the parts."""
    return F.exists(texts, lambda t: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(t, p)))


def _gathered(rules: list[tuple[str, Column]]) -> Column:
    """Sorted distinct tags whose condition holds."""
    held = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(tag)) for tag, c in rules))
    return F.array_sort(F.array_distinct(F.array_compact(held)))


def tag_symbols(symbols: DataFrame) -> DataFrame:
    """(qname, tags) of symbols: qname, decorators, roots (imported packages), calls (dotted), raises: arrays of strings; writes_self, dynamic_attribute, hazard: booleans."""
    leaf = F.transform("calls", lambda c: F.substring_index(c, ".", -1))
    named = lambda names: F.arrays_overlap(leaf, F.array(*map(F.lit, names)))
    roots = F.transform("roots", lambda r: F.lower(r))
    rules = [(tag, named(methods) & F.arrays_overlap(roots, F.array(*map(F.lit, needs)))) for tag, methods, needs in CALL_RULES]
    rules += [(tag, _any(F.col("decorators"), parts)) for tag, parts in DECORATOR_RULES]
    rules += [("#auth_guard", named(AUTH_CALLS) | _any(F.col("raises"), AUTH_ERRORS)), ("#state_mutation", F.col("writes_self")), ("#dynamic_attribute", F.col("dynamic_attribute")), ("#dynamic_hazard", F.col("hazard"))]
    return symbols.select("qname", _gathered(rules).alias("tags"))


def topological_tags(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(qname, tags) by degree and text; symbols: qname, file, language, body, returns_value, has_try, has_raise; edges: src, dst."""
    each = edges.select("src", "dst").distinct()
    out = each.groupBy(F.col("src").alias("qname")).agg(F.count("*").alias("n_out"))
    into = each.groupBy(F.col("dst").alias("qname")).agg(F.count("*").alias("n_in"))
    df = symbols.join(out, "qname", "left").join(into, "qname", "left").where("n_out IS NOT NULL OR n_in IS NOT NULL").fillna(0, ["n_in", "n_out"])
    parts = F.split(F.translate("file", "\\", "/"), "/")
    entry = F.element_at(parts, -1).isin(*ENTRY_FILES) | F.arrays_overlap(parts, F.array(*map(F.lit, ENTRY_FOLDERS)))
    handles = (F.col("has_try") | ((F.col("language") == "go") & F.contains("body", F.lit(GO_ERROR_CHECK)))) & (F.col("returns_value") | F.col("has_raise"))
    rules = [("#entrypoint", (F.col("n_in") == 0) & (F.col("n_out") > 0) & entry), ("#pure_transform", (F.col("n_in") > 0) & (F.col("n_out") == 0) & F.col("returns_value")), ("#io_sink", _any(F.array("body"), IO_TEXTS)), ("#error_handler", handles)]
    return df.select("qname", _gathered(rules).alias("tags"))


def sentinel_tags(sentinels: DataFrame, tags: DataFrame) -> DataFrame:
    """(qname, tags) of sentinels (qname, candidates array, dynamic boolean): the tags of all candidates, or the hazard of a dynamic one."""
    each = sentinels.where("NOT dynamic").select("qname", F.explode_outer("candidates").alias("c"))
    joined = each.join(tags.select(F.col("qname").alias("c"), F.explode("tags").alias("tag")), "c", "left")
    union = joined.groupBy("qname").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return union.unionByName(sentinels.where("dynamic").select("qname", F.array(F.lit("#dynamic_hazard")).alias("tags")))


def tag_graph(symbols: DataFrame, edges: DataFrame, sentinels: DataFrame | None = None) -> DataFrame:
    """(qname, tags) of all symbols that have any, with the columns of tag_symbols and topological_tags; sentinels after them."""
    found = tag_symbols(symbols).unionByName(topological_tags(symbols, edges)).select("qname", F.explode("tags").alias("tag"))
    tags = found.groupBy("qname").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return tags if sentinels is None else tags.unionByName(sentinel_tags(sentinels, tags))


def default_registry(spark) -> DataFrame:
    """(language, entry, category) of SINK_PACKAGES; TypeScript has JavaScript's."""
    rows = [(lang, entry, category) for (language, category), entries in SINK_PACKAGES.items() for entry in entries.split() for lang in ([language, "typescript"] if language == "javascript" else [language])]
    return spark.createDataFrame(rows, "language string, entry string, category string")


def sink_bits(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """(caller, mask): bits of the sinks that each caller's calls (caller, language, chain, target) reach directly.

    A call is a sink if an entry is its dotted name, as written or as imported, or begins it at a dot.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda n: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), n), "."))
    asked = calls.select("caller", "language", F.explode(F.array_distinct(F.concat(prefixes(F.col("chain")), F.coalesce(prefixes(F.col("target")), F.array().cast("array<string>"))))).alias("entry")).distinct()
    value = F.lit(0).cast("long")
    for category, name in SINK_BITS.items():
        value = F.when(F.col("category") == category, F.lit(bit(name)).cast("long")).otherwise(value)
    known = registry.select("language", "entry", value.alias("mask"))
    return asked.join(sized(known, known.count(), 80), ["language", "entry"]).groupBy("caller").agg(F.bit_or("mask").alias("mask"))


def substance(direct: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(qname, mask): a symbol's own sinks and those of callees with three statements or fewer; pure computing if there are none and it changes nothing.

    direct: caller, mask; edges: src, dst; symbols: qname, n_statements, mutates boolean.
    """
    own = direct.select(F.col("caller").alias("qname"), "mask")
    small = symbols.where("n_statements <= 3").select("qname").join(own, "qname").select(F.col("qname").alias("dst"), F.col("mask").alias("lent"))
    lent = edges.select("src", "dst").distinct().join(small, "dst").groupBy(F.col("src").alias("qname")).agg(F.bit_or("lent").alias("lent"))
    zero = F.lit(0).cast("long")
    mask = F.coalesce("mask", zero).bitwiseOR(F.coalesce("lent", zero))
    joined = symbols.join(own, "qname", "left").join(lent, "qname", "left")
    return joined.select("qname", F.when(mask != 0, mask).when(~F.col("mutates"), F.lit(bit("SINK_PURE_COMPUTE")).cast("long")).otherwise(zero).alias("mask"))


def effects(symbols: DataFrame) -> DataFrame:
    """(qname, effects, thrown): sorted effects and exceptions of symbols.

    symbols: qname, calls (dotted names), raises: arrays of strings; awaits, asserts: booleans. A call's
    effect goes by its method and a part of its receiver.
    """
    calls = F.transform("calls", lambda c: F.struct(F.lower(F.regexp_replace(c, r"\.?[^.]*$", "")).alias("on"), F.lower(F.substring_index(c, ".", -1)).alias("method")))
    hit = lambda methods, parts: F.exists(calls, lambda r: r["method"].isin(*methods) & ~r["method"].isin(*ASSERT_CALLS) & F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(r["on"], x)))
    asserts = F.col("asserts") | F.exists(calls, lambda r: r["method"].isin(*ASSERT_CALLS))
    rules = [(effect, hit(methods, parts)) for effect, methods, parts in EFFECT_RULES]
    thrown = F.concat("raises", F.when(F.col("asserts"), F.array(F.lit("AssertionError"))).otherwise(F.array().cast("array<string>")))
    return symbols.select("qname", _gathered([*rules, ("ASSERTS", asserts), ("ASYNC_WAIT", F.col("awaits"))]).alias("effects"), F.array_sort(F.array_distinct(thrown)).alias("thrown"))
