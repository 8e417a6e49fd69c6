"""Names, paths, source text and markup as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, languages and their precision tiers.
EXTENSIONS = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".cs": "c_sharp"}
# Folders that aren't read.
IGNORED_DIRS = (".git", "__pycache__", "node_modules", "vendor", "dist", "build", "venv", ".venv", "site-packages")
# Paths of tests.
TEST_PATTERNS = (
    r"(^|/)tests?/", r"(^|/)__tests__/", r"(^|/)testing/", r"(^|/)tests?\.py$", r"(^|/)conftest\.py$",
    r"(^|/)test_[^/]+\.py$", r"(^|/)[^/]+_test\.py$", r"(^|/)[^/]+_test\.go$", r"\.(test|spec)\.(ts|tsx|js|jsx)$",
)


def language_for_path(path: Column) -> Column:
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for e, language in EXTENSIONS.items():
        out = out.when(ext == e, F.lit(language))
    return out


def ignored_path(path: Column) -> Column:
    """Whether a folder on the path is skipped: by name, or because it begins with a dot."""
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: x.isin(*IGNORED_DIRS) | x.startswith("."))


def path_to_module(path: Column) -> Column:
    """Dotted module: no extension, no trailing __init__ of Python or index of scripts."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    bare = F.when(path.endswith(".py"), F.regexp_replace(bare, r"/__init__$", "")).when(path.rlike(r"\.(ts|tsx|js|jsx)$"), F.regexp_replace(bare, r"/index$", "")).otherwise(bare)
    return F.translate(bare, "/", ".")


def module_parts(path: Column) -> Column:
    """Segments of a path of either separator; one that leaves its root is an error."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    return F.when(F.array_contains(parts, ".."), F.raise_error(F.lit("path leaves the root"))).otherwise(parts)


def module_of(path: Column) -> Column:
    """The folder of a path, '.' at the top."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def prefix3(module: Column) -> Column:
    return F.substring_index(module, ".", 3)


def shares_package(a: Column, b: Column) -> Column:
    return F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)


def relative_module(module: Column, is_package: Column, level: Column, name: Column) -> Column:
    """The module that 'from <level dots>name import' names: level - 1 steps up from the module's package, level 0 the name itself."""
    parts = F.split(module, r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level + F.when(is_package, 1).otherwise(0), F.lit(0)))
    tail = F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(name))
    return F.when(level == 0, F.coalesce(name, F.lit(""))).otherwise(F.array_join(F.concat(base, tail), "."))


def chain_segments(chain: Column) -> Column:
    """Segments of a plain dotted reference, null for anything else."""
    return F.when(chain.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$"), F.split(chain, r"\."))


def import_roots(imports: Column) -> Column:
    """Top-level names of import specifiers, lower-cased, sorted."""
    roots = F.transform(imports, lambda x: F.lower(F.substring_index(F.substring_index(x, ".", 1), "/", 1)))
    return F.array_sort(F.array_distinct(F.filter(roots, lambda x: x != "")))


def is_test_file(path: Column) -> Column:
    clean = F.regexp_replace(F.translate(F.lower(path), "\\", "/"), r"^[./]+", "")
    out = F.lit(False)
    for pattern in TEST_PATTERNS:
        out = out | clean.rlike(pattern)
    return out


def is_public_symbol(name: Column, path: Column, language: Column, exported: Column) -> Column:
    hidden = F.exists(F.split(path, "/"), lambda x: x.startswith("_") & ~x.startswith("__"))
    index = F.element_at(F.split(path, "/"), -1).isin("index.ts", "index.tsx", "index.js", "index.jsx")
    rule = F.when(language == "python", ~name.startswith("_") & ~hidden).when(language == "go", name.rlike(r"^\p{Lu}")).when(language.isin("typescript", "javascript"), index | exported).otherwise(False)
    return ~is_test_file(path) & rule


def is_entrypoint(public: Column, language: Column, role: Column, package_export: Column) -> Column:
    rule = F.when(language == "python", role.isin("entrypoint", "facade") | package_export).when(language == "go", role == "entrypoint").when(language.isin("typescript", "javascript"), role.isin("entrypoint", "facade")).otherwise(False)
    return public & F.coalesce(rule, F.lit(False))


def precision_tier(language: Column) -> Column:
    return F.when(language == "python", "tier1").when(language.isin("javascript", "typescript", "tsx", "java", "c_sharp"), "tier2").when(language == "go", "tier3")


def visibility(name: Column, language: Column, exported: Column) -> Column:
    dunder = name.rlike(r"^__.*__$")
    return F.when(language == "python", F.when(name.startswith("_") & ~dunder, "private").otherwise("public")).when(language == "go", F.when(name.rlike(r"^\p{Lu}"), "exported").otherwise("private")).otherwise(F.when(exported, "exported").when(name.rlike("^[_#]"), "private").otherwise("public"))


def doc_summary(text: Column, most: int = 120) -> Column:
    """First sentence, with an ellipsis beyond most characters; null for nothing."""
    first = F.trim(F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"^(.*?[.!?])(?:\s|$)", 1))
    first = F.when(first == "", F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(first)
    return F.when(first == "", F.lit(None)).when(F.length(first) > most, F.concat(F.rtrim(F.substring(first, 1, most - 3)), F.lit("..."))).otherwise(first)


def is_deprecated(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)@deprecated\b|\bdeprecated\b")


def sanitized(text: Column) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def escaped_attribute(text: Column) -> Column:
    out = sanitized(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(sanitized(text), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def first_lines(text: Column, count: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, count), "\n")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, both counted from 1 and kept."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")


def first_line(text: Column, most: int = 90) -> Column:
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def normalized_content(text: Column) -> Column:
    """LF line ends, no blanks at line ends, runs of empty lines as one, one LF at the end."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+(?=\n|$)", "")
    out = F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "^\n+|\n+$", "")
    return F.concat(out, F.lit("\n"))


def parameter_text(name: Column, kind: Column, default: Column) -> Column:
    """name: type = default, as far as they are known."""
    return F.concat(name, F.coalesce(F.concat(F.lit(": "), kind), F.lit("")), F.coalesce(F.concat(F.lit(" = "), default), F.lit("")))


# Operators that count as one token, quoted literals, and where a name's parts begin.
COMPOUND_OPERATORS = ("...", "->", "=>", "::", ":=", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "**")
LITERALS = r'''("""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`)'''
NAME_PARTS = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def _thirds(n: Column) -> Column:
    return F.floor((n + 2) / 3).cast("long")


#: What counts as one token of ordinary text, each counted by itself: parts of words that aren't numbers, where such a part
#: is divided, up to three digits of a number, and each underscore of a word of nothing else.
PART, DIGITS, UNDERSCORE = r"\d*[A-Za-z][A-Za-z0-9]*", r"(?:\G(?<=\d)|(?<![A-Za-z0-9]))\d{1,3}(?=\d*(?![A-Za-z0-9]))", r"(?:\G(?<=_)|(?<!\w))_(?=_*(?!\w))"


def ordinary_count(text: Column) -> Column:
    """Tokens of text without literals: words by their parts between underscores and by capitals, digits by threes, operators and other characters one each."""
    operators = "|".join("".join("\\" + c for c in op) for op in COMPOUND_OPERATORS)
    kinds = (PART, NAME_PARTS, DIGITS, UNDERSCORE, operators + r"|[^\w\s]")
    return sum((F.regexp_count(text, F.lit(kind)).cast("long") for kind in kinds[1:]), F.regexp_count(text, F.lit(kinds[0])).cast("long"))


def subword_count(word: Column) -> Column:
    """Tokens of one word."""
    return ordinary_count(word)


def literal_size(literal: Column) -> Column:
    """Characters of a quoted literal within its quotes."""
    return F.length(literal) - F.when(F.substring(literal, 1, 3).isin('"""', "'''"), 6).otherwise(2)


def literal_count(literal: Column, dense: int = 32) -> Column:
    """Tokens of a quoted literal: by its length if that is over dense, else as ordinary text."""
    return F.when(literal_size(literal) <= dense, ordinary_count(literal)).otherwise(_thirds(literal_size(literal)) + 2)


def fallback_token_count(text: Column, gain: float = 1.08, dense: int = 32) -> Column:
    """Estimated tokens of source text, rounded up with a margin; literals as in literal_count."""
    literals = F.regexp_extract_all(text, F.lit(LITERALS), F.lit(1))
    short = F.array_join(F.filter(literals, lambda x: literal_size(x) <= dense), " ")
    long = F.aggregate(F.filter(literals, lambda x: literal_size(x) > dense), F.lit(0).cast("long"), lambda n, x: n + _thirds(literal_size(x)) + 2)
    total = ordinary_count(F.concat_ws(" ", F.regexp_replace(text, LITERALS, " "), short)) + long
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.ceil(total * F.lit(gain))).cast("long")
