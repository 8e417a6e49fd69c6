"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Four signals of a text are compared with cutoffs. The cutoffs come from labelled
documents: for each stratum and signal the strictest cutoff is taken whose false
rejections among good documents an exact binomial tail certifies. The allowed
false rejection rate is split over the signals, so that it holds for the rules
together; the error probability is split over all strata and signals
(Bonferroni). Along a signal's cutoffs, tested from the loosest on until the
first failure, no further correction is due. A signal has no rule in a stratum
whose own labels certify no cutoff: what holds over all strata together need not
hold in that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, sized, table, written

SYMBOLS = "#*$%&|<>"
#: Signal -> (counted column, column that it is a share of), as whole thousandths.
SIGNALS = {"symbols": ("n_symbols", "n_words"), "bangs": ("n_bangs", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
#: Cutoffs in thousandths are multiples of STEP up to STEP * STEPS.
STEP, STEPS = 25, 40
#: Windows' hashes and positions share 64 bits; longer texts take the exact path.
POSITION_BITS = 20
#: False rejections allowed in op2, and in a query whose cutoffs fewer labels certify.
ALPHA, LOOSE_ALPHA = 0.02, 0.2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_KEYS = f"sort_array(transform(slice(q_words, 1, greatest(size(q_words) - 2, 0)), (w, i) -> (xxhash64(w, get(q_words, i + 1), get(q_words, i + 2)) & {-1 << POSITION_BITS}L) | i))"
_TWINS = "filter(q_keys, (k, i) -> shiftright(k ^ get(q_keys, i - 1), {b}) = 0 OR shiftright(k ^ get(q_keys, i + 1), {b}) = 0)".format(b=POSITION_BITS)
_AT = f"CAST({{}} & {(1 << POSITION_BITS) - 1}L AS INT)"
_OTHER = " OR ".join(f"get(q_words, {_AT.format('k')} + {j}) <> get(q_words, {_AT.format('get(q_twins, i - 1)')} + {j})" for j in range(3))
_CLASH = f"size(filter(q_twins, (k, i) -> shiftright(k ^ get(q_twins, i - 1), {POSITION_BITS}) = 0 AND ({_OTHER}))) > 0"
_COVERED = "size(array_distinct(flatten(transform({}, k -> array({p}, {p} + 1, {p} + 2)))))"
_FAST = _COVERED.format("q_twins", p=_AT.format("k"))
_ROWS = "array_sort(transform(slice(q_words, 1, greatest(size(q_words) - 2, 0)), (w, i) -> struct(w, get(q_words, i + 1) AS x, get(q_words, i + 2) AS y, i AS p)))"
_SAME = "(r.w = get({a}, {n}).w AND r.x = get({a}, {n}).x AND r.y = get({a}, {n}).y)"
_EXACT = "aggregate(array({rows}), 0, (z, a) -> {covered})".format(
    rows=_ROWS, covered=_COVERED.format(f"filter(a, (r, i) -> {_SAME.format(a='a', n='i - 1')} OR {_SAME.format(a='a', n='i + 1')})", p="k.p")
)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and the columns of COUNTS, n_lines and n_bangs (long), for whole texts; null texts have zeros.

    n_repeat_words is exact: windows are sorted by hash with their positions, and a text in which
    two different windows share a hash, or of over 2**20 words, is counted by the words themselves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    df = docs.withColumn("q_words", F.array_remove(F.split(F.translate(text, SPACE[1:], " " * 5), " "), "")).withColumn("q_lines", lines)
    df = df.withColumn("q_keys", F.expr(f"CASE WHEN size(q_words) <= {1 << POSITION_BITS} THEN {_KEYS} ELSE array() END")).withColumn("q_twins", F.expr(_TWINS))
    counts = {
        "n_words": F.size("q_words"),
        "word_chars": F.length(F.translate(text, SPACE, "")),
        "n_symbols": less(SYMBOLS),
        "n_dup_lines": F.size("q_lines") - F.size(F.array_distinct("q_lines")),
        "n_repeat_words": F.expr(f"CASE WHEN size(q_words) > {1 << POSITION_BITS} OR {_CLASH} THEN {_EXACT} ELSE {_FAST} END"),
        "n_lines": F.size("q_lines"),
        "n_bangs": less("!"),
    }
    return df.select(*docs.columns, *(c.cast("long").alias(n) for n, c in counts.items()))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def thousandths(signal: str) -> Column:
    part, whole = SIGNALS[signal]
    return F.expr(f"CASE WHEN {whole} > 0 THEN {part} * 1000 div {whole} ELSE 0 END")


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, good to 12 digits for x >= 1."""
    y, shift = x + 8, F.lit(0.0)
    for j in range(8):
        shift = shift + F.log(x + j)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n * p, else 1 (never certified)."""
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p)))
    series = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda a, j: F.struct((a.term * (kd - j + 1) / (nd - kd + j) * ((1 - p) / p)).alias("term"), (a.total + a.term * (kd - j + 1) / (nd - kd + j) * ((1 - p) / p)).alias("total")),
        lambda a: a.total,
    )
    return F.when(kd < nd * p, top * series).otherwise(1.0)


def cutoffs(labelled: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """One row per stratum: stratum, and for each signal its cutoff in thousandths (null: no rule).

    labelled: a row for each good labelled document, with stratum (not null) and the signals' thousandths.
    """
    bins = F.array(*(F.struct(F.lit(s).alias("signal"), F.least(F.floor(F.col(s) / STEP), F.lit(STEPS)).cast("long").alias("bin")) for s in SIGNALS))
    per_bin = labelled.select(F.col(stratum).alias("stratum"), F.explode(bins).alias("b")).groupBy("stratum", "b.signal", "b.bin").agg(F.count("*").alias("n"))
    packed = per_bin.groupBy("stratum", "signal").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bin", "n")).alias("bins"))  # at most STEPS + 1 bins
    steps = packed.select("stratum", "signal", "total", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"), "bins")
    rejected = steps.withColumn("k", F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b.bin >= F.col("step"), b.n).otherwise(0)))
    families = F.broadcast(packed.agg(F.count("*").alias("families")))  # one row
    tested = rejected.join(families).withColumn("certified", binomial_tail(F.col("k"), F.col("total"), alpha / len(SIGNALS)) * F.col("families") <= delta)
    best = tested.groupBy("stratum", "signal").agg(F.min(F.when(F.col("certified"), F.col("step") * STEP)).alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"cut_{s}") for s in SIGNALS))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns of COUNTS, base_failed, kept, and the columns named in carry.

    docs: doc_id, text and stratum_col; labels: doc_id, quality (1: good). At most alpha of a
    stratum's good documents are rejected by the signals, with probability 1 - delta for all strata
    at once; a signal rejects nothing in a stratum whose own labels certify no cutoff. Null or empty
    texts have no words and fail the base rule. A null stratum counts as the stratum ''; a null id has
    no label. Labels that contradict each other are left out; with no labels nothing but the base rule
    rejects. Repeated rows are judged each (one of them, the worst, is counted for the cutoffs). An empty
    table gives no rows. Other columns of either table are ignored.
    """
    keep = [F.col(c).alias(f"c_{c}") for c in carry]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), *keep)
    rows = written(with_counts(rows).drop("text"))
    rows = rows.withColumns({s: thousandths(s) for s in SIGNALS})
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    good = told.where("lo = 1 AND hi = 1").select("doc_id")
    seen = rows.where("NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)").select("doc_id", "stratum", *SIGNALS)
    labelled = seen.join(good, "doc_id").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), *(F.max(s).alias(s) for s in SIGNALS))
    own = written(cutoffs(labelled, "stratum", alpha, delta))
    judged = rows.join(sized(own, own.count(), 64), "stratum", "left")
    reject = F.lit(False)
    for s in SIGNALS:
        reject = reject | F.coalesce(F.col(s) >= F.col(f"cut_{s}"), F.lit(False))
    judged = judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~reject)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", *(F.col(f"c_{c}").alias(c if c not in {"doc_id", *COUNTS, "base_failed", "kept"} else f"c_{c}") for c in carry))


def quality_filter(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names; odd rows as in quality_rules.

    A null or empty text fails the base rule and goes; a null id or a repeated row stays or goes by its text.
    """
    names = docs.columns
    whole = docs.select("doc_id", "text", settings.get("stratum_col", "lang"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("q_row"))
    return quality_rules(whole, labels, carry=("q_row",), **settings).where("kept").select(*(F.col(f"q_row.c{i}").alias(c) for i, c in enumerate(names)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_rules_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), alpha=LOOSE_ALPHA)


_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g2),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g3, (SELECT unnest([0, 1, 2]) AS o) WHERE c >= 2 GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
    CASE WHEN n_words > 0 THEN n_bangs * 1000 // n_words ELSE 0 END AS bangs,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines FROM f),
good AS (SELECT v.* FROM v JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1) l ON v.doc_id = l.doc_id WHERE NOT base_failed),
long AS (SELECT stratum, 'symbols' AS signal, symbols AS x FROM good UNION ALL SELECT stratum, 'bangs', bangs FROM good
    UNION ALL SELECT stratum, 'repeats', repeats FROM good UNION ALL SELECT stratum, 'dup_lines', dup_lines FROM good),
fam AS (SELECT count(*) AS families FROM (SELECT DISTINCT stratum, signal FROM long)),
st AS (SELECT stratum, signal, step, count(*) AS n, sum(CASE WHEN x >= step * 25 THEN 1 ELSE 0 END)::BIGINT AS k FROM long, (SELECT unnest(range(1, 41)) AS step) GROUP BY stratum, signal, step),
js AS (SELECT st.stratum, st.signal, st.step, st.n, st.k, unnest(range(0, st.k + 1)) AS j FROM st WHERE st.k < st.n * RISK),
tail AS (SELECT stratum, signal, step, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(RISK) + (n - j) * ln(1 - RISK))) AS p FROM js GROUP BY stratum, signal, step),
best AS (SELECT stratum, signal, min(step * 25) AS cutoff FROM tail, fam WHERE p * families <= 0.05 GROUP BY stratum, signal),
strata AS (SELECT DISTINCT stratum AS s FROM v), sig AS (SELECT unnest(['symbols', 'bangs', 'repeats', 'dup_lines']) AS g),
cut AS (SELECT s, g, cutoff FROM strata CROSS JOIN sig LEFT JOIN best b ON b.stratum = s AND b.signal = g),
wide AS (SELECT s, max(CASE WHEN g = 'symbols' THEN cutoff END) AS c1, max(CASE WHEN g = 'bangs' THEN cutoff END) AS c2,
    max(CASE WHEN g = 'repeats' THEN cutoff END) AS c3, max(CASE WHEN g = 'dup_lines' THEN cutoff END) AS c4 FROM cut GROUP BY s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (coalesce(symbols >= c1, false) OR coalesce(bangs >= c2, false) OR coalesce(repeats >= c3, false) OR coalesce(dup_lines >= c4, false)) AS kept
FROM v JOIN wide ON v.stratum = wide.s
"""

QUERIES = {"op2_quality_rules": op2_quality_rules, "quality_rules_loose": quality_rules_loose}
SQL = {name: _SQL.replace("RISK", str(alpha / len(SIGNALS))) for name, alpha in (("op2_quality_rules", ALPHA), ("quality_rules_loose", LOOSE_ALPHA))}
