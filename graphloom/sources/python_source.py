"""Python source files to rows: symbols with contracts, imports and call sites, through the standard parser.

Only Python has a parser in the standard library; other languages are discovered and
hashed, and give no symbols.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bit
from ..operators.groups import values_of
from ..storage import dealt, written

SYMBOL = """struct<qname:string,kind:string,name:string,enclosing_class:string,start:int,end:int,is_async:boolean,params:array<struct<name:string,type:string,default:string>>,return_type:string,
docstring:string,complexity:int,raises:array<string>,decorators:array<string>,mutations:array<string>,bases:array<string>,n_statements:int,structural_hash:string,form:bigint,output:bigint>"""
IMPORT = "struct<local:string,target:string,is_wildcard:boolean,ord:int>"
CALL = "struct<caller:string,chain:string,line:int,n_args:int,awaited:boolean,in_loop:boolean,in_try:boolean,bound_to:string,return_bound:boolean,role:string,hazard:string>"
FILE = f"path string, module string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, calls array<{CALL}>, exports array<string>, error string".replace("\n", "")

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Files whose rows are handed back together.
FILES_AT_ONCE = 1000
MUTATING = ("append", "add", "update", "extend", "insert", "pop", "remove", "clear", "setdefault", "discard")


def own_nodes(root):
    """Nodes below root, in order, without those of nested definitions; depth first, without recursion."""
    stack = list(ast.iter_child_nodes(root))[::-1]
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, SCOPES):
            stack.extend(list(ast.iter_child_nodes(node))[::-1])


def chain_of(node) -> str | None:
    """Dotted text of a name or attribute chain, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *parts[::-1]])


def relative_module(module: str, is_package: bool, level: int, name: str | None) -> str:
    """The module that 'from ...name import' names."""
    if not level:
        return name or ""
    parts = module.split(".")
    base = parts[: len(parts) - level + (1 if is_package else 0)]
    return ".".join([*base, name] if name else base)


def _text(node) -> str | None:
    return ast.unparse(node) if node is not None else None


def parameters(args) -> list[dict]:
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    found = [(a, d) for a, d in zip(plain, defaults, strict=True) if a.arg not in ("self", "cls")]
    found += list(zip(args.kwonlyargs, args.kw_defaults, strict=True))
    return [{"name": a.arg, "type": _text(a.annotation), "default": _text(d)} for a, d in found]


def structural_hash(node) -> str:
    """16 digits of parameter types, result type and the kinds of all nodes but names."""
    import hashlib

    kinds = [type(n).__name__ for n in ast.walk(node) if not isinstance(n, (ast.Name, ast.arg, ast.Load, ast.Store))]
    types = ",".join(p["type"] or "?" for p in parameters(node.args)) if hasattr(node, "args") else ""
    return hashlib.sha256("|".join([types, _text(getattr(node, "returns", None)) or "?", ",".join(kinds)]).encode()).hexdigest()[:16]


def mutations(node) -> list[str]:
    """State that a function changes: attributes of self, declared globals, items, mutating calls on attributes; sorted."""
    found = set()
    for n in own_nodes(node):
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AugAssign, ast.AnnAssign)) else []
        for target in targets:
            holder = target.value if isinstance(target, ast.Subscript) else target
            if isinstance(holder, ast.Attribute) and (chain := chain_of(holder)):
                found.add(chain)
        if isinstance(n, (ast.Global, ast.Nonlocal)):
            found.update(n.names)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in MUTATING and isinstance(n.func.value, ast.Attribute) and (chain := chain_of(n.func.value)):
            found.add(chain)
    return sorted(found)


def form_bits(node, name: str) -> int:
    """Shape of a function: one of retry, dispatch, guard, pipeline or linear, and what it has besides."""
    own = list(own_nodes(node))
    loops = [n for n in own if isinstance(n, (ast.For, ast.AsyncFor, ast.While))]
    tries = [n for n in own if isinstance(n, ast.Try)]
    ifs = [n for n in own if isinstance(n, ast.If)]
    body = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    ends = lambda block: bool(block) and isinstance(block[-1], (ast.Return, ast.Raise))
    retry = any(isinstance(n, ast.Try) for loop in loops for n in own_nodes(loop))
    dispatch = any(isinstance(n, ast.Match) for n in own) or any(len(i.orelse) == 1 and isinstance(i.orelse[0], ast.If) and i.orelse[0].orelse for i in ifs)
    guard = bool(body) and isinstance(body[0], ast.If) and ends(body[0].body) and not body[0].orelse
    steps = [s for s in body if isinstance(s, ast.Assign) and isinstance(s.value, (ast.Call, ast.Await))]
    shape = "FORM_RETRY_LOOP" if retry else "FORM_BRANCH_DISPATCH" if dispatch else "FORM_GUARD_EARLY_EXIT" if guard else "FORM_PIPELINE" if len(steps) >= 3 and not ifs and not loops else "FORM_LINEAR"
    mask = bit(shape)
    calls = [chain_of(n.func) for n in own if isinstance(n, ast.Call)]
    if ifs and all(ends(i.body) and isinstance(i.body[-1], ast.Raise) for i in ifs):
        mask |= bit("FORM_VALIDATOR")
    if loops and not retry:
        mask |= bit("FORM_BATCH_LOOP")
    if tries:
        mask |= bit("FORM_WRAPPED_TRY")
    if any(c and c.rsplit(".", 1)[-1] == name for c in calls):
        mask |= bit("FORM_RECURSIVE")
    if any(c in ("asyncio.gather", "asyncio.create_task", "asyncio.wait") for c in calls):
        mask |= bit("FORM_ASYNC_CONCURRENT")
    return mask


def output_bits(node) -> int:
    """What a function returns, by its first return that tells."""
    returns = [n.value for n in own_nodes(node) if isinstance(n, ast.Return)]
    names = {a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]}
    mask = bit("OUTPUT_ASYNC_DEFERRED") if isinstance(node, ast.AsyncFunctionDef) else 0
    values = [v for v in returns if v is not None and not (isinstance(v, ast.Constant) and v.value is None)]
    if not values:
        only_raises = bool(node.body) and isinstance(node.body[-1], ast.Raise)
        return mask | bit("OUTPUT_GUARD" if only_raises else "OUTPUT_COMMAND")
    v = values[0]
    if isinstance(v, (ast.Compare, ast.BoolOp)) or isinstance(v, ast.Constant) and isinstance(v.value, bool) or isinstance(v, ast.UnaryOp) and isinstance(v.op, ast.Not):
        kind = "OUTPUT_PREDICATE"
    elif isinstance(v, ast.Name) and v.id == "self":
        kind = "OUTPUT_FLUENT"
    elif isinstance(v, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp, ast.Tuple)):
        kind = "OUTPUT_AGGREGATOR"
    elif isinstance(v, ast.Call) and (c := chain_of(v.func)) and c.rsplit(".", 1)[-1][:1].isupper():
        kind = "OUTPUT_FACTORY"
    elif any(isinstance(n, ast.Name) and n.id in names - {"self", "cls"} for n in ast.walk(v)):
        kind = "OUTPUT_TRANSFORMER"
    else:
        kind = "OUTPUT_QUERY"
    return mask | bit(kind)


def call_sites(node, caller: str, path: str) -> list[dict]:
    """Calls of one definition with their contexts, in order."""
    rows = []
    returned = {n.id for r in own_nodes(node) if isinstance(r, ast.Return) and r.value is not None for n in ast.walk(r.value) if isinstance(n, ast.Name)}

    def visit(n, loop, tried, awaited, bound, returning, asserted):
        if isinstance(n, SCOPES) and n is not node:
            return
        if isinstance(n, ast.Call):
            chain = chain_of(n.func)
            hazard = "EVAL" if chain in ("eval", "exec") else "REFLECTION" if chain in ("getattr", "setattr", "__import__") else "SUBSCRIPT_DISPATCH" if isinstance(n.func, ast.Subscript) else None
            rows.append({
                "caller": caller, "chain": chain, "line": n.lineno, "n_args": len(n.args) + len(n.keywords), "awaited": awaited, "in_loop": loop, "in_try": tried,
                "bound_to": bound, "return_bound": returning or bound in returned, "role": "assertion_subject" if asserted else "plain", "hazard": hazard,
            })
        if isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            name = chain_of(targets[0]) if len(targets) == 1 else None
            visit(n.value, loop, tried, False, name, returning, asserted)
            return
        for child in ast.iter_child_nodes(n):
            direct = child if isinstance(n, ast.Await) else None
            visit(child, loop or isinstance(n, (ast.For, ast.AsyncFor, ast.While)), tried or isinstance(n, ast.Try), direct is not None, bound if isinstance(n, ast.Await) else None, returning or isinstance(n, ast.Return), asserted or isinstance(n, ast.Assert))

    for statement in node.body:
        visit(statement, False, False, False, None, False, False)
    return rows


def parse_module(path: str, module: str, source: str) -> dict:
    """Rows of one file; a file that can't be parsed has its error and nothing else."""
    empty = {"path": path, "module": module, "symbols": [], "imports": [], "calls": [], "exports": None, "error": None}
    try:
        tree = ast.parse(source)
        imports, symbols, calls, exports = [], [], [], None
        package = path.endswith("__init__.py")
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    imports.append((a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], False, n.lineno))
            elif isinstance(n, ast.ImportFrom):
                base = relative_module(module, package, n.level, n.module)
                for a in n.names:
                    imports.append((None if a.name == "*" else a.asname or a.name, base if a.name == "*" else f"{base}.{a.name}" if base else a.name, a.name == "*", n.lineno))
        for n in tree.body:
            if isinstance(n, ast.Assign) and any(isinstance(x, ast.Name) and x.id == "__all__" for x in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
                exports = [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        stack = [(n, module, None) for n in tree.body[::-1]]
        while stack:
            n, prefix, owner = stack.pop()
            if isinstance(n, (*FUNCTIONS, ast.ClassDef)):
                qname, is_class = f"{prefix}.{n.name}", isinstance(n, ast.ClassDef)
                own = list(own_nodes(n))
                symbols.append({
                    "qname": qname, "kind": "class" if is_class else "method" if owner else "function", "name": n.name, "enclosing_class": owner, "start": n.lineno, "end": n.end_lineno,
                    "is_async": isinstance(n, ast.AsyncFunctionDef), "params": [] if is_class else parameters(n.args), "return_type": None if is_class else _text(n.returns), "docstring": ast.get_docstring(n),
                    "complexity": 1 + sum(isinstance(x, BRANCHES) for x in own), "raises": sorted({c for x in own if isinstance(x, ast.Raise) and x.exc is not None and (c := chain_of(x.exc.func if isinstance(x.exc, ast.Call) else x.exc))}),
                    "decorators": [c for d in n.decorator_list if (c := chain_of(d.func if isinstance(d, ast.Call) else d))], "mutations": [] if is_class else mutations(n), "bases": [c for b in getattr(n, "bases", []) if (c := chain_of(b))],
                    "n_statements": sum(isinstance(x, ast.stmt) for x in own), "structural_hash": structural_hash(n), "form": 0 if is_class else form_bits(n, n.name), "output": 0 if is_class else output_bits(n),
                })
                if not is_class:
                    calls += call_sites(n, qname, path)
                stack.extend((c, qname, qname if is_class else None) for c in n.body[::-1])
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                stack.extend((c, prefix, owner) for c in list(ast.iter_child_nodes(n))[::-1] if isinstance(c, ast.stmt))
        named = [{"local": a, "target": b, "is_wildcard": w, "ord": i} for i, (a, b, w, _) in enumerate(sorted(imports, key=lambda x: x[3]))]
        return empty | {"symbols": symbols, "imports": named, "calls": calls, "exports": exports}
    except SyntaxError as e:
        return empty | {"error": f"SyntaxError on line {e.lineno}"}
    except (RecursionError, ValueError) as e:
        return empty | {"error": type(e).__name__}


def parse_files(files: DataFrame) -> DataFrame:
    """FILE rows of files (path, module, content string), dealt to tasks by their number: parsing takes long for the few bytes of a file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(FILE))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, FILES_AT_ONCE):
                rows = zip(*map(values_of, batch.slice(k, FILES_AT_ONCE).columns), strict=True)
                yield pa.RecordBatch.from_pylist([parse_module(p, m, s or "") for p, m, s in rows], schema=fields)

    return dealt(files.select("path", "module", "content"), "path").mapInArrow(run, FILE)


#: Named patterns of a syntax tree: what captures gives for each.
PATTERNS = {
    "definitions": ((*FUNCTIONS, ast.ClassDef), lambda n: n.name),
    "imports": ((ast.Import, ast.ImportFrom), ast.unparse),
    "calls": ((ast.Call,), lambda n: chain_of(n.func)),
    "decorators": ((*FUNCTIONS, ast.ClassDef), lambda n: [ast.unparse(d) for d in n.decorator_list]),
}


def captures(files: DataFrame, pattern: str) -> DataFrame:
    """(path, pattern, text, line) of what a named pattern finds in Python files (path, content), in order of lines; files that can't be parsed have none."""
    kinds, text_of = PATTERNS[pattern]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, source in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    nodes = [n for n in ast.walk(ast.parse(source or "")) if isinstance(n, kinds)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for n in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
                    found = text_of(n)
                    rows += [(path, pattern, t, n.lineno) for t in (found if isinstance(found, list) else [found]) if t]
            yield pd.DataFrame(rows, columns=["path", "pattern", "text", "line"])

    return dealt(files.select("path", "content"), "path").mapInPandas(run, "path string, pattern string, text string, line int")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """One row per definition; a name that comes again is numbered name#2 and so on, in order of file and line."""
    from pyspark.sql import Window

    rows = parsed.select("path", "module", F.explode("symbols").alias("s")).select("path", "module", "s.*")
    again = F.row_number().over(Window.partitionBy("qname").orderBy("path", "start"))
    return rows.withColumn("n_", again).withColumn("qname", F.when(F.col("n_") == 1, F.col("qname")).otherwise(F.concat("qname", F.lit("#"), F.col("n_").cast("string")))).drop("n_")


def edges_of(parsed: DataFrame) -> DataFrame:
    """(src, dst, relation, and the call's context): CALLS and INSTANTIATES, EXTENDS, OVERRIDES.

    A call is resolved by self, the file's imports or its module; then by the class that its receiver was
    bound to in the same function, or as an attribute in the same class, if that is one class only;
    then by the nearest ancestor that defines the method. Calls that no definition answers keep
    their dotted path as an external name.
    """
    from ..operators.graph import ancestors
    from ..operators.joins import override_links

    symbols = written(symbols_of(parsed).select("path", "module", "qname", "kind", "name", "enclosing_class", "bases", "start"))
    known = symbols.select(F.col("qname").alias("dst"), F.col("kind").alias("dst_kind"))
    imports = parsed.select("path", F.explode("imports").alias("i")).where("NOT i.is_wildcard").groupBy("path", F.col("i.local").alias("root")).agg(F.max_by("i.target", "i.ord").alias("target"))
    owner = symbols.where("enclosing_class IS NOT NULL").select(F.col("qname").alias("caller"), F.col("enclosing_class").alias("owner"))
    calls = parsed.select("path", "module", F.explode("calls").alias("c")).select("path", "module", "c.*").where("chain IS NOT NULL")
    root, rest = F.substring_index("chain", ".", 1), F.expr("substring(chain, instr(concat(chain, '.'), '.'))")
    named = calls.withColumns({"root": root, "rest": rest}).join(imports, ["path", "root"], "left").join(owner, "caller", "left")
    via_self = F.when(F.col("root").isin("self", "cls") & F.col("owner").isNotNull(), F.concat("owner", "rest"))
    via_import = F.when(F.col("target").isNotNull(), F.concat("target", "rest"))
    local = F.concat_ws(".", "module", "chain")
    tried = written(named.withColumn("dst", F.coalesce(via_self, via_import, local)).withColumn("outside", via_self.isNull() & via_import.isNull()).join(known, "dst", "left"))
    # receivers bound to one class
    bound = tried.where("dst_kind = 'class' AND bound_to IS NOT NULL").select(F.when(F.col("bound_to").startswith("self."), F.col("owner")).otherwise(F.col("caller")).alias("scope"), F.col("bound_to").alias("receiver"), F.col("dst").alias("class"))
    one = bound.groupBy("scope", "receiver").agg(F.min("class").alias("class"), F.max("class").alias("other")).where("class = other").drop("other")
    receiver = F.expr("left(chain, length(chain) - length(substring_index(chain, '.', -1)) - 1)")
    method = F.substring_index("chain", ".", -1)
    open_ = tried.where("dst_kind IS NULL").withColumns({"receiver": receiver, "method": method, "scope": F.when(F.col("chain").startswith("self."), F.col("owner")).otherwise(F.col("caller"))})
    open_ = open_.join(one, ["scope", "receiver"], "left").withColumn("class", F.coalesce("class", F.when(F.col("receiver").isin("self", "cls"), F.col("owner"))))
    # bases, and the ancestors they give
    classes = symbols.where("kind = 'class'")
    bases = classes.select("path", "module", F.col("qname").alias("src"), F.posexplode("bases").alias("pos", "chain")).withColumns({"root": root, "rest": rest}).join(imports, ["path", "root"], "left")
    extends = written(bases.withColumn("dst", F.coalesce(F.concat("target", "rest"), local)).join(known, "dst", "left_semi").select("src", "dst", "pos"))
    up = written(ancestors(extends, F.col("pos")).select("node", "ancestor", "rank"))
    methods = symbols.where("enclosing_class IS NOT NULL").select(F.col("enclosing_class").alias("class"), F.col("name").alias("method"))
    line = classes.select(F.col("qname").alias("class"), F.col("qname").alias("holder"), F.lit(0).alias("rank")).unionByName(up.select(F.col("node").alias("class"), F.col("ancestor").alias("holder"), "rank"))
    held = line.join(methods.withColumnRenamed("class", "holder"), "holder").groupBy("class", "method").agg(F.min_by("holder", "rank").alias("holder"))
    found = open_.join(held, ["class", "method"], "left").withColumn("by_class", F.when(F.col("holder").isNotNull(), F.concat_ws(".", "holder", "method")))
    context = ["line", "n_args", "awaited", "in_loop", "in_try", "bound_to", "return_bound", "role", "hazard"]
    relation = F.when(F.col("dst_kind") == "class", "INSTANTIATES").otherwise("CALLS")
    called = tried.where("dst_kind IS NOT NULL").select(F.col("caller").alias("src"), "dst", relation.alias("relation"), *context)
    rest_of = found.select(F.col("caller").alias("src"), F.coalesce("by_class", F.when(F.col("outside"), F.col("chain")).otherwise(F.col("dst"))).alias("dst"), F.lit("CALLS").alias("relation"), *context)
    blank = [F.lit(None).cast(called.schema[c].dataType).alias(c) for c in context]
    overrides = override_links(methods, up).select(F.concat_ws(".", "class", "method").alias("src"), F.concat_ws(".", "base", "method").alias("dst"), F.lit("OVERRIDES").alias("relation"), *blank)
    return called.unionByName(rest_of).unionByName(extends.select("src", "dst", F.lit("EXTENDS").alias("relation"), *blank)).unionByName(overrides)
