"""Imports, exports, heritage and definitions of JavaScript, TypeScript, Go, Java and C# sources, as columns.

Without a parser for them these are scanners: comments are blanked, statements are found by
their form, and each is taken apart by expressions that run in the JVM, row by row. What
is computed, templated or nested in a string is not guessed. Specifiers are resolved by joins
with the set of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File endings that a JavaScript specifier may leave out, in the order they are tried.
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx")
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def without_comments(source: Column) -> Column:
    """source with // and /* */ comments blanked; // inside a word, as in a URL, stays."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"(^|[\s;{}(),])//[^\n]*", "$1")


def _all(source: Column, pattern: str) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(0))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _bind(local: Column, target: Column, member: Column, wildcard: bool = False) -> Column:
    return F.struct(local.alias("local"), target.alias("specifier"), member.alias("member"), F.lit(wildcard).alias("is_wildcard"))


def _named(clause: Column, specifier: Column, separator: str) -> Column:
    """Bindings of 'a, b as c' (or 'a, b: c'), by local name."""
    items = F.filter(F.transform(F.split(clause, ","), lambda x: F.trim(F.regexp_replace(x, r"^\s*type\s+|\s+", " "))), lambda x: x.rlike(rf"^{NAME}( ?{separator} ?{NAME})?$"))
    return F.transform(items, lambda x: _bind(_part(x, rf"({NAME})$"), specifier, _part(x, rf"^({NAME})")))


def js_imports(source: Column) -> Column:
    """array<struct<local, specifier, member, is_wildcard>> of ES imports and CommonJS requires of a constant string.

    member is '' for a whole module, 'default' for a default import; an import for its effect binds nothing.
    """
    text = without_comments(source)
    statements = _all(text, r"""(?s)\bimport\s+(type\s+)?[A-Za-z0-9_$\s{},*]+?\s*from\s*['"][^'"]+['"]""")

    def clauses(s: Column) -> Column:
        head, specifier = _part(s, r"(?s)^import\s+(?:type\s+)?(.*?)\s*from\s*['\"]", 1), _part(s, r"['\"]([^'\"]+)['\"]$")
        default, space = _part(head, rf"^({NAME})\s*(?:,|$)"), _part(head, rf"\*\s*as\s+({NAME})")
        found = lambda x: F.filter(F.array(x), lambda y: y["local"] != "")
        return F.concat(found(_bind(default, specifier, F.lit("default"))), found(_bind(space, specifier, F.lit(""))), _named(_part(head, r"(?s)\{(.*?)\}"), specifier, "as"))

    required = _all(text, rf"""(?m)(?:\b(?:const|let|var)\s+|,\s*)({NAME}|\{{[^}}]*\}})\s*=\s*require\(\s*['"][^'"]+['"]\s*\)(\.{NAME})?\s*(?=;|,|$)""")

    def bound(s: Column) -> Column:
        target, specifier, member = _part(s, r"(?s)(?:const|let|var|,)\s*(.*?)\s*=\s*require\("), _part(s, r"require\(\s*['\"]([^'\"]+)['\"]"), _part(s, rf"\)\.({NAME})")
        whole = F.filter(F.array(_bind(_part(target, rf"^({NAME})$"), specifier, member)), lambda y: y["local"] != "")
        return F.when(target.startswith("{") & (member != ""), F.slice(whole, 1, 0)).when(target.startswith("{"), _named(_part(target, r"(?s)\{(.*)\}"), specifier, ":")).otherwise(whole)

    return F.concat(F.flatten(F.transform(statements, clauses)), F.flatten(F.transform(required, bound)))


def js_reexports(source: Column) -> Column:
    """array<struct<local, specifier, member, is_wildcard>>: what a module exports from others by name, or all of it."""
    text = without_comments(source)
    named = _all(text, r"""(?s)\bexport\s+(?:type\s+)?\{[^}]*\}\s*from\s*['"][^'"]+['"]""")
    stars = _all(text, r"""\bexport\s*\*\s*from\s*['"][^'"]+['"]""")
    specifier = lambda s: _part(s, r"['\"]([^'\"]+)['\"]$")
    by_name = F.flatten(F.transform(named, lambda s: _named(_part(s, r"(?s)\{(.*?)\}"), specifier(s), "as")))
    return F.concat(by_name, F.transform(stars, lambda s: _bind(F.lit(""), specifier(s), F.lit(""), True)))


def go_imports(source: Column) -> Column:
    """Bindings of Go imports: alias or last segment of the path; the target is the path with dots."""
    text = without_comments(source)
    single = _all(text, r'(?m)^[ \t]*import[ \t]+(?:[A-Za-z0-9_.]+[ \t]+)?"[^"\n]+"')
    blocks = F.array_join(_all(text, r"(?s)\bimport\s*\([^)]*\)"), "\n")
    specs = F.concat(single, _all(F.regexp_replace(blocks, r"\bimport\s*\(|\)", "\n"), r'(?m)^[ \t]*(?:[A-Za-z0-9_.]+[ \t]+)?"[^"\n]+"'))

    def bound(s: Column) -> Column:
        path, alias = _part(s, r'"([^"\n]+)"'), _part(s, r'(?:^|\s)([A-Za-z0-9_.]+)[ \t]+"')
        alias = F.when(alias == "import", "").otherwise(alias)
        return _bind(F.when(alias != "", alias).otherwise(F.substring_index(path, "/", -1)), F.translate(path, "/", "."), F.lit(""))

    return F.transform(specs, bound)


def java_imports(source: Column) -> Column:
    """Bindings of Java imports: a class by its simple name, a package with .* as a wildcard; static imports bind no class."""
    found = _all(without_comments(source), r"(?m)^[ \t]*import\s+[A-Za-z0-9_.]+(\.\*)?\s*;")
    name = lambda s: _part(s, r"import\s+([A-Za-z0-9_.]*[A-Za-z0-9_])")
    star = lambda s: s.rlike(r"\*\s*;$")
    return F.transform(found, lambda s: F.struct(F.when(star(s), "").otherwise(F.substring_index(name(s), ".", -1)).alias("local"), name(s).alias("specifier"), F.lit("").alias("member"), star(s).alias("is_wildcard")))


def csharp_imports(source: Column) -> Column:
    """Wildcards of C# using directives; aliases and static ones bind no class."""
    found = _all(without_comments(source), r"(?m)^[ \t]*(?:global\s+)?using\s+[A-Za-z0-9_.]+\s*;")
    return F.transform(found, lambda s: _bind(F.lit(""), _part(s, r"using\s+([A-Za-z0-9_.]+)\s*;$"), F.lit(""), True))


def imports(language: Column, source: Column) -> Column:
    """Bindings of a source by its language; none for others."""
    none = F.array().cast("array<struct<local:string,specifier:string,member:string,is_wildcard:boolean>>")
    js = js_imports(source)
    return (
        F.when(language.isin("javascript", "typescript", "tsx"), js)
        .when(language == "go", go_imports(source))
        .when(language == "java", java_imports(source))
        .when(language == "c_sharp", csharp_imports(source))
        .otherwise(none)
    )


def without_generics(header: Column) -> Column:
    """A header without its type arguments, three levels deep."""
    for _ in range(3):
        header = F.regexp_replace(header, r"<[^<>]*>", "")
    return header


def ts_heritage(source: Column) -> Column:
    """array<struct<name, base, relation>>: what classes extend and implement and interfaces extend, without type arguments."""
    headers = F.transform(_all(without_comments(source), r"(?s)\b(?:class|interface)\s+[A-Za-z_$][^{;]*\{"), without_generics)

    def bases(h: Column) -> Column:
        name = _part(h, rf"(?:class|interface)\s+({NAME})")
        listed = lambda text, relation: F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(F.translate(x, "\n\t", "  "))), lambda x: x.rlike(r"^[A-Za-z_$][A-Za-z0-9_$.]*$")), lambda x: F.struct(name.alias("name"), x.alias("base"), F.lit(relation).alias("relation")))
        return F.concat(listed(_part(h, r"(?s)\bextends\s+(.*?)\s*(?:\bimplements\b|\{)"), "EXTENDS"), listed(_part(h, r"(?s)\bimplements\s+(.*?)\s*\{"), "IMPLEMENTS"))

    return F.flatten(F.transform(headers, bases))


def go_embeds(source: Column) -> Column:
    """array<struct<name, embedded>>: struct fields without a name, of the same package, pointers included."""
    structs = _all(without_comments(source), r"(?s)\btype\s+[A-Za-z_]\w*(?:\[[^\]]*\])?\s+struct\s*\{[^{}]*\}")

    def fields(s: Column) -> Column:
        name, lines = _part(s, r"type\s+([A-Za-z_]\w*)"), F.split(_part(s, r"(?s)\{(.*)\}"), r"[\n;]")
        kept = F.filter(lines, lambda x: x.rlike(r"^\s*\*?[A-Za-z_]\w*\s*(`[^`]*`)?\s*$"))
        return F.transform(kept, lambda x: F.struct(name.alias("name"), _part(x, r"^\s*\*?([A-Za-z_]\w*)").alias("embedded")))

    return F.flatten(F.transform(structs, fields))


#: Language -> (kind, form of a line that begins a definition, whose first group is its name and second, if any, its holder).
DEFINITIONS = {
    "go": (("method", r"^func\s*\(\s*\w*\s*\*?()\w*[^)]*\)\s*\w+"), ("function", r"^func\s+(\w+)\s*[\[(]"), ("class", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b")),
    "javascript": (("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({NAME})"), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{NAME}\s*=>)"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({NAME})"), ("interface", rf"^\s*(?:export\s+)?interface\s+({NAME})")),
    "java": (("class", r"^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|record|enum)\s+(\w+)"), ("interface", r"^\s*(?:(?:public|protected|private|static|sealed)\s+)*interface\s+(\w+)"), ("method", r"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized|default|override|virtual|async)\s+)+[\w<>\[\],.? ]+?\s(\w+)\s*\([^;]*$")),
}
DEFINITIONS["typescript"] = DEFINITIONS["tsx"] = DEFINITIONS["javascript"]
DEFINITIONS["c_sharp"] = DEFINITIONS["java"]


def definitions(files: DataFrame) -> DataFrame:
    """(path, language, kind, name, holder, line) of the definitions that files (path, language, source) begin; holder: a Go method's type.

    Line by line: what a line looks like decides, so definitions inside strings count and headers over several lines may not.
    """
    lines = files.select("path", "language", F.posexplode(F.split(without_comments(F.col("source")), "\n")).alias("at", "text"))
    go_method = r"^func\s*\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)"
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, forms in DEFINITIONS.items():
        for what, form in reversed(forms):
            here = (F.col("language") == language) & F.col("text").rlike(form)
            kind = F.when(here, what).otherwise(kind)
            name = F.when(here, _part(F.col("text"), go_method, 2) if language == "go" and what == "method" else _part(F.col("text"), form)).otherwise(name)
    holder = F.when((F.col("language") == "go") & (F.col("kind") == "method"), _part(F.col("text"), go_method, 1))
    found = lines.withColumns({"kind": kind, "name": name}).where("kind IS NOT NULL")
    return found.select("path", "language", "kind", "name", holder.alias("holder"), (F.col("at") + 1).alias("line"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, module, qname, kind, name, enclosing_class, start, end) of the definitions in files (path, module, language, source); one ends before the next begins."""
    from pyspark.sql import Window

    found = definitions(files).join(files.select("path", "module", F.size(F.split("source", "\n")).alias("lines")), "path")
    w = Window.partitionBy("path").orderBy("line", "name")  # one file
    owner = F.when(F.col("holder").isNotNull(), F.concat_ws(".", "module", "holder"))
    rows = found.select("path", "module", F.concat_ws(".", "module", "holder", "name").alias("qname"), "kind", "name", owner.alias("enclosing_class"), F.col("line").alias("start"), F.coalesce(F.lead("line").over(w) - 1, F.col("lines")).alias("end"))
    again = F.row_number().over(Window.partitionBy("qname").orderBy("path", "start"))  # definitions of one name
    return rows.withColumn("n_", again).withColumn("qname", F.when(F.col("n_") == 1, F.col("qname")).otherwise(F.concat("qname", F.lit("#"), F.col("n_").cast("string")))).drop("n_")


def type_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, relation) between types: heritage of JavaScript and TypeScript, embedding of Go; files as in symbols."""
    from ..operators.linking import embed_edges, heritage_edges

    scripts = files.where(F.col("language").isin("javascript", "typescript", "tsx"))
    clauses = scripts.select(F.col("path").alias("file"), "module", F.explode(ts_heritage(F.col("source"))).alias("c")).select("file", "module", F.concat_ws(".", "module", "c.name").alias("qname"), "c.base", "c.relation")
    bound = scripts.select("path", F.explode(js_imports(F.col("source"))).alias("b")).select("path", "b.local", "b.specifier", "b.member")
    named = resolve_specifiers(bound, files.select("path")).select(F.col("path").alias("file"), "local", F.concat_ws(".", "module", F.nullif(F.col("member"), F.lit(""))).alias("target")).dropDuplicates(["file", "local"])
    none = files.select(F.col("path").alias("file"), "module", F.lit(0).alias("ord")).where(F.lit(False))
    up = heritage_edges(clauses, named, symbols.select("qname", "module", "name", "kind"), none)
    embeds = files.where("language = 'go'").select(module_folder(F.col("path")).alias("module"), F.explode(go_embeds(F.col("source"))).alias("e")).select("module", "e.name", "e.embedded")
    types = symbols.where("path LIKE '%.go' AND kind IN ('class', 'interface')").select(module_folder(F.col("path")).alias("module"), "name", "qname")
    return up.unionByName(embed_edges(embeds, types))


def module_folder(path: Column) -> Column:
    """A Go package is its folder."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined_path(folder: Column, specifier: Column) -> Column:
    """folder/specifier with . and .. worked out; a path that leads above the top keeps what is left."""
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda x: (x != "") & (x != "."))
    up = F.struct(F.array().cast("array<string>").alias("p"))
    done = F.aggregate(parts, up, lambda a, x: F.struct(F.when(x == "..", F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0)))).otherwise(F.concat(a["p"], F.array(x))).alias("p")))
    return F.array_join(done["p"], "/")


def resolve_specifiers(bindings: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """bindings (path, specifier and others) with module: relative ones by the file they name, aliased ones by the longest prefix, others with dots for slashes.

    files: path. A relative specifier names the first of itself with each ending, then an index file in it,
    that exists, or itself. aliases: prefix, target ('@/' for 'src/').
    """
    from ..functions.text import path_to_module
    from ..operators.joins import longest_prefix

    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    relative = F.col("specifier").startswith(".")
    asked = bindings.select("path", "specifier").distinct()
    base = asked.where(relative).withColumn("base", joined_path(folder, F.col("specifier")))
    tries = ["", *JS_ENDINGS, *(f"/index{e}" for e in JS_ENDINGS)]
    each = base.withColumn("t", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.concat("base", F.lit(e)).alias("file")) for k, e in enumerate(tries)))))
    known = each.join(files.select(F.col("path").alias("file_")).distinct(), F.col("t.file") == F.col("file_"), "left_semi")
    first = known.groupBy("path", "specifier").agg(F.min("t").alias("t"))
    near = base.join(first, ["path", "specifier"], "left").select("path", "specifier", path_to_module(F.coalesce("t.file", "base")).alias("module"))
    rest = asked.where(~relative)
    dotted = F.translate("specifier", "/", ".")
    if aliases is None:
        far = rest.select("path", "specifier", dotted.alias("module"))
    else:
        named = rest.select("specifier").distinct()
        hit = longest_prefix(named, aliases, "specifier", "prefix").join(aliases.select("prefix", "target"), "prefix")
        to = hit.select("specifier", path_to_module(F.concat("target", F.expr("substring(specifier, length(prefix) + 1)"))).alias("aliased"))
        far = rest.join(to, "specifier", "left").select("path", "specifier", F.coalesce("aliased", dotted).alias("module"))
    return bindings.join(near.unionByName(far), ["path", "specifier"])


def export_rows(modules: DataFrame) -> DataFrame:
    """(module, name, origin, origin_name): export registry of modules (module, bindings of js_reexports with module resolved as origin)."""
    return modules.select("module", F.when(F.col("is_wildcard"), "*").otherwise(F.col("local")).alias("name"), "origin", F.when(F.col("is_wildcard"), "*").otherwise(F.col("member")).alias("origin_name"))
