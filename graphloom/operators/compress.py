"""Source text of definitions at four resolutions: whole, pruned, skeleton with contract, and stub.

A file's text is parsed once for all its definitions, in an Arrow function: trees don't leave it.
Python goes through the standard parser; other languages, and what can't be parsed, by lines.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import tasks_for
from .groups import each_group

# Parts of the names of calls that only report, and of lines of other languages that do.
REPORTING = ("log", "print", "metric")
REPORTING_LINES = ("console.log", "logger.", "log.", "fmt.Println", "System.out")
#: Deeper nesting than this isn't walked; the whole text is given.
DEEPEST = 150
TEXTS = "qname string, l0 string, l1 string, l2 string, l3 string"


def _call(value, whole: bool):
    """A call with its arguments, or with '...' for them; other values as they are."""
    if whole or not isinstance(value, ast.Call) or not (value.args or value.keywords):
        return value
    return ast.Call(value.func, [ast.Constant(...)], [])


def pruned(body: list, whole: bool, empty: bool = False) -> list:
    """Statements that decide what happens and what is called: no documentation, reporting calls or values worked out without a call.

    whole: calls keep their arguments. A block that lost everything passes, unless it may be empty.
    """
    out = []
    for s in body:
        if isinstance(s, ast.Expr):
            if not isinstance(s.value, ast.Call) or any(x in ast.unparse(s.value.func).lower() for x in REPORTING):
                continue
            s = ast.Expr(_call(s.value, whole))
        elif isinstance(s, ast.Assign):
            if not isinstance(s.value, ast.Call):
                continue
            s = ast.Assign(s.targets, _call(s.value, whole))
        elif isinstance(s, ast.Return):
            s = ast.Return(_call(s.value, whole))
        elif isinstance(s, ast.Raise):
            s = ast.Raise(_call(s.exc, whole), s.cause)
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            s = skeleton(s, whole)
        else:
            blocks = {f: pruned(getattr(s, f), whole, f != "body") for f in ("body", "orelse", "finalbody") if isinstance(getattr(s, f, None), list)}
            blocks |= {f: [type(h)(**{k: getattr(h, k, None) for k in h._fields} | {"body": pruned(h.body, whole)}) for h in getattr(s, f)] for f in ("handlers", "cases") if getattr(s, f, None)}
            if blocks:
                s = type(s)(**{k: getattr(s, k, None) for k in s._fields} | blocks)
        out.append(s)
    return out or ([] if empty else [ast.Pass()])


def skeleton(node, whole: bool):
    fields = {k: getattr(node, k, None) for k in node._fields} | {"body": pruned(node.body, whole), "decorator_list": []}
    return type(node)(**fields)


def contract_lines(tags: list[str], mutates: list[str], raises: list[str], calls: list[str], compact: bool = False) -> str:
    """The comment that says of a skeleton what its text no longer shows."""
    if compact:
        named = [("tags", sorted(tags)), ("mutates", mutates), ("raises", raises), ("calls", calls)]
        return "# " + " ".join(f"{k}=[{', '.join(v)}]" for k, v in named if v or k == "tags")
    lines = [f"# Tags: [{', '.join(sorted(tags))}]"]
    lines += [f"# {k}: {', '.join(v)}" for k, v in (("Mutates", mutates), ("Raises", raises), ("Calls", calls)) if v]
    return "\n".join(lines)


def _raised(node) -> list[str]:
    exceptions = (r.exc for r in ast.walk(node) if isinstance(r, ast.Raise) and r.exc is not None)
    return list(dict.fromkeys(ast.unparse(e.func if isinstance(e, ast.Call) else e) for e in exceptions))


def _own_writes(node) -> list[str]:
    targets = (t for a in ast.walk(node) if isinstance(a, ast.Assign) for t in a.targets)
    return list(dict.fromkeys(f"self.{t.attr}" for t in targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"))


def _depth(node) -> int:
    most, level = 0, [node]
    while level:
        most, level = most + 1, [c for n in level for c in ast.iter_child_nodes(n)]
    return most


def sliced_lines(source: str, start: int, end: int) -> str:
    return "\n".join(source.split("\n")[start - 1 : end])


def python_levels(node, text: str, tags: list[str], calls: list[str], compact: bool = False) -> tuple[str, str, str, str]:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(map(ast.unparse, node.bases))
        header = f"class {node.name}({bases}): ..." if bases else f"class {node.name}: ..."
        told = f"{header}\n{contract_lines(tags, [], [], calls, compact)}"
        return text, told, told, header
    stub = {k: getattr(node, k, None) for k in node._fields} | {"body": [ast.Pass()], "decorator_list": []}
    header = ast.unparse(ast.fix_missing_locations(type(node)(**stub))).split("\n")[0] + " ..."
    if _depth(node) > DEEPEST:
        return text, text, text, header
    l1, l2 = (ast.unparse(ast.fix_missing_locations(skeleton(node, whole))) for whole in (True, False))
    told = contract_lines(tags, _own_writes(node) if "#state_mutation" in tags else [], _raised(node), calls, compact)
    return text, l1, f"{l2}\n{told}", header


def plain_levels(text: str, tags: list[str], calls: list[str]) -> tuple[str, str, str, str]:
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return (text,) * 4
    header = lines[0].rstrip("{ ").rstrip(":") + " ..."
    kept = [x for x in lines if not any(t in x for t in REPORTING_LINES)]
    return text, "\n".join(kept) or text, f"{header}\n{contract_lines(tags, [], [], calls)}", header


def compress(files: DataFrame, definitions: DataFrame, compact: bool = False) -> DataFrame:
    """(qname, l0, l1, l2, l3) of definitions (qname, path, name, start, end, tags, calls) in files (path, language, source).

    l0: its lines; l1: without documentation, reporting and plain values; l2: also without arguments, and
    with what it is tagged, changes, raises and calls; l3: its header. What can't be parsed or found
    keeps its lines at all levels but those of other languages.
    """
    none = F.array().cast("array<string>")
    row = F.struct("qname", "name", "start", "end", F.coalesce("tags", none).alias("tags"), F.coalesce("calls", none).alias("calls"))
    grouped = definitions.groupBy("path").agg(F.collect_list(row).alias("defs"))  # of one file

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for language, source, defs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = {}
                if language == "python":
                    try:
                        for n in ast.walk(ast.parse(source or "")):
                            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                                found.setdefault(n.name, []).append(n)
                    except (SyntaxError, ValueError, RecursionError, MemoryError):
                        found = None
                for d in defs:
                    text = sliced_lines(source or "", d["start"], d["end"])
                    node = next((n for n in (found or {}).get(d["name"], ()) if d["start"] <= n.lineno <= d["end"]), None)
                    if language != "python":
                        levels = plain_levels(text, d["tags"], d["calls"])
                    elif node is None:
                        levels = (text,) * 4
                    else:
                        levels = python_levels(node, text, d["tags"], d["calls"], compact)
                    out.append((d["qname"], *levels))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["qname", "l0", "l1", "l2", "l3"])

    # dealt to tasks by number, as reading a file takes long for its few bytes; not by the key of the join, whose exchange would do for both and be joined again
    tasks = tasks_for(definitions.count(), 5_000)
    joined = files.select("path", "language", "source").join(grouped, "path").repartition(tasks, F.xxhash64("path"))
    return joined.select("language", "source", "defs").mapInArrow(run, TEXTS)


def with_costs(texts: DataFrame) -> DataFrame:
    """texts with c0 to c3, the estimated tokens of each level, at least 1: what distance packing chooses by."""
    from ..functions.text import fallback_token_count

    return texts.withColumns({f"c{k}": F.greatest(fallback_token_count(F.col(f"l{k}")), F.lit(1)) for k in range(4)})


def referenced_constants(names: Column, constants: Column, bound: Column) -> Column:
    """Sorted constants of the module that a body names and doesn't bind itself: arrays of strings."""
    return F.array_sort(F.array_except(F.array_intersect(names, constants), bound))


def compact_mode(reachable: DataFrame) -> DataFrame:
    """(query, compact): few nodes in reach, or little text in all; reachable: query, tokens."""
    return reachable.groupBy("query").agg(((F.count("*") <= 3) | (F.sum("tokens") < 1200)).alias("compact"))


def bundle_constants(picked: DataFrame, references: DataFrame) -> DataFrame:
    """(query, qname, constants): constants that each picked symbol brings along, first come under the budget left, each once.

    picked: query, qname, ord, left (tokens that the package has left; null: no limit); references: qname,
    constant, cost. A constant that is picked itself, or came along before, isn't brought again; one that
    doesn't fit is passed over, and later ones are still tried.
    """
    listed = picked.join(references, "qname", "left")

    def choose(rows):
        own, left, out, seen = {r[1] for r in rows}, rows[0][3], {}, set()
        for query, qname, _, _, constant, cost in rows:
            if constant is None or constant in own or constant in seen or (left is not None and cost is not None and cost > left):
                continue
            seen.add(constant)
            out.setdefault((query, qname), []).append(constant)
            left = left - cost if left is not None and cost is not None else None
        return [(query, qname, constants) for (query, qname), constants in out.items()]

    kind = picked.schema["query"].dataType.simpleString()
    return each_group(listed.select("query", "qname", "ord", "left", "constant", "cost"), "query", choose, f"query {kind}, qname string, constants array<string>", [F.asc_nulls_last("ord"), F.col("constant")])


def enforce_budget(packages: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """packages (query, id, role, distance, budget, full_cost, stub_cost) with stub: whether the node is given as its stub.

    The farthest transitive nodes become stubs, ties by the later name, one at a time, until a package is within
    its budget and the tolerance or has none left; a seed, its callers and callees never do. Running sums
    over a query's nodes say which.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("free"), F.desc("distance"), F.desc("id"))  # one package
    total = F.sum("full_cost").over(Window.partitionBy("query"))
    df = packages.withColumn("free", (F.col("role") == "transitive") & (F.col("stub_cost") < F.col("full_cost"))).withColumn("total", total)
    saved = F.coalesce(F.sum(F.when(F.col("free"), F.col("full_cost") - F.col("stub_cost")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("stub", F.col("free") & (F.col("total") - saved > F.col("budget") * (1 + tolerance))).drop("free", "total")


def signature_stub(text: Column, most: int = 10) -> Column:
    """A definition's lines up to the first that ends in ':' and '...'; null if none of the first most lines does."""
    lines = F.slice(F.split(text, "\n"), 1, most)
    ends = F.array_position(F.transform(lines, lambda x: F.rtrim(x).endswith(":")), F.lit(True)).cast("int")
    return F.when(ends > 0, F.concat(F.array_join(F.slice(lines, F.lit(1), ends), "\n"), F.lit(" ...")))


def constant_stub(name: Column, text: Column, entries: Column, tokens: Column, most: int = 64) -> Column:
    """A constant's text, or of one over most tokens its name, bracket and number of entries; null if it is no display of any."""
    bracket = F.regexp_extract(text, r"=\s*([\[{(])", 1)
    close = F.translate(bracket, "[{(", "]})")
    return F.when(tokens <= most, text).when(bracket != "", F.concat(name, F.lit(" = "), bracket, F.lit("..."), close, F.lit("  # "), entries.cast("string"), F.lit(" entries")))


#: Tags that say that a symbol reaches outside.
IO_TAGS = ("#db_read", "#db_write", "#external_io", "#event_producer", "#io_sink")


def infallible(purity: Column, complexity: Column, throws: Column, effects: Column, tags: Column) -> Column:
    """Whether nothing can go wrong in a symbol: pure, of two paths at most, nothing thrown, no effects and no tag that reaches outside."""
    return (purity == "pure") & (complexity <= 2) & (F.size(throws) == 0) & (F.size(effects) == 0) & ~F.arrays_overlap(tags, F.array(*map(F.lit, IO_TAGS)))
