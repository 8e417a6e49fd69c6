"""Small tests of the training-data operators: results by brute force, and odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, canonical
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, chat_formatting, decontamination, line_dedup, near_dedup, quality_classifier, quality_rules, registry, sharding, token_counts, token_files
from graphloom.llm._common import vocabulary

WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
CLASHES = ("id", "key", "keys", "n_words", "n_lines", "n_dropped", "kept", "cluster", "q_words", "q_text", "h", "bits", "prefix", "stratum", "features", "label", "component_id", "shard")


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, a very long text, white space alone, and columns with clashing names."""
    line = "A line that many documents share, word for word."
    rows = [(1, prose(1)), (2, None), (3, ""), (None, prose(4)), (5, prose(5)), (5, prose(5)), (6, " \t\n\x0b "), (7, "x"), (8, prose(8) + " ###$$$"), (9, "É " * 3 + "long " * 60_000)]
    rows += [(10 + i, f"{prose(20 + i, 20)}\n{line if i % 2 else '  ' + line.upper() + ' '}\n{prose(40 + i, 5)}") for i in range(6)]
    df = spark.createDataFrame([(*r, None if i == 0 else "en", "s", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)), rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (5, 1), (8, 0), (None, 1), (10, 0), (11, 1), (11, 0), (12, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))


def empty(df):
    return df.where(F.lit(False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, wanted = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns) and canonical(got) == canonical(wanted)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# token counts


def greedy(word, starts, goes_on):
    n, at = 0, 0
    while at < len(word):
        pieces = goes_on if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1 + token_counts.UNKNOWN
        n, at = n + 1, end
    return n


def test_automaton_is_greedy():
    rng = random.Random(0)
    for _ in range(40):
        make = lambda k: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(k)}
        starts, goes_on = make(12), make(12)
        automaton = token_counts.Automaton(starts, goes_on)
        for _ in range(200):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, starts, goes_on), (word, starts, goes_on)


def test_token_counts(spark, odd):
    df, rows = odd
    starts, goes_on = map(set, token_counts.load_pieces(open(vocabulary("piece_bpe_32k.model"), "rb").read()))
    got = collections.Counter(tuple(r) for r in token_counts.token_counts(df).collect())
    wanted = collections.Counter()
    for i, text in rows:
        counts = collections.Counter(words(text))
        totals = [(greedy(w.decode(), starts, goes_on), c) for w, c in counts.items()]
        wanted[i, sum(counts.values()), sum((n & token_counts.UNKNOWN - 1) * c for n, c in totals), sum((n >> 40) * c for n, c in totals)] += 1
    assert got == wanted
    assert token_counts.token_counts(empty(df)).count() == 0


# quality rules


def brute_counts(text):
    text = text or ""
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + o for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd, labels):
    df, rows = odd
    got = sorted((tuple(r) for r in quality_rules.quality_rules(df, labels).select("doc_id", *quality_rules.COUNTS, "base_failed").collect()), key=str)
    wanted = []
    for i, text in rows:
        c = brute_counts(text)
        wanted.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(wanted, key=str)
    assert quality_rules.quality_filter(df, labels).columns == df.columns
    assert quality_rules.quality_rules(empty(df), labels).count() == 0
    none = quality_rules.quality_rules(df, empty(labels))
    assert none.where("kept <> (NOT base_failed)").count() == 0


def test_exact_path_counts_the_same(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 2, 3, 4, 9, 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    exact = F.expr(quality_rules._EXACT)
    with_words = df.withColumn("q_words", F.array_remove(F.split("text", " "), ""))
    assert [r.n for r in with_words.select("doc_id", exact.alias("n")).orderBy("doc_id").collect()] == [brute_counts(t)[4] for t in texts]


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.05), (3, 2300, 0.005), (50, 20_000, 0.005), (90, 20_000, 0.005), (5, 10, 0.1), (0, 1, 0.5)])
def test_binomial_tail(spark, k, n, p):
    from math import comb, log1p, exp, log, lgamma

    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
    exact = sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p)) for j in range(k + 1))
    assert got == pytest.approx(exact if k < n * p else 1.0, rel=1e-8) and comb(4, 2) == 6


def test_cutoffs_keep_their_promise(spark):
    rng = np.random.default_rng(0)
    rows = [("a" if i % 2 else "b", int(rng.random() < 0.02) * 600, 0, 0, 0) for i in range(8000)]
    good = spark.createDataFrame(rows, "stratum string, symbols long, bangs long, repeats long, dup_lines long")
    cut = {r.stratum: r for r in quality_rules.cutoffs(good, "stratum", 0.02, 0.05).collect()}
    # 2 % of good documents have 600: a cutoff there would reject more than 0.5 %
    assert all(r.cut_symbols == 625 and r.cut_bangs == 25 for r in cut.values()) and set(cut) == {"a", "b"}


def test_no_rule_where_a_stratum_certifies_none(spark):
    plain, rich = prose(1, 60), prose(2, 60) + " #" * 40
    docs = spark.range(4200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, plain).otherwise(rich).alias("text"), F.when(F.col("id") < 4000, "big").otherwise("small").alias("lang"))
    good = docs.where("doc_id < 4000 OR doc_id % 50 = 0").select("doc_id", F.lit(1).alias("quality"))
    got = quality_rules.quality_rules(docs, good, carry=("lang",))
    # 4 of 4,004 good documents have many symbols: certified over both strata, disproved in the small one
    assert got.where("lang = 'small' AND NOT kept").count() == 0 and got.where("kept").count() == 4200
    junk = docs.withColumn("text", F.when(F.col("doc_id") == 7, rich).otherwise(F.col("text")))
    assert [r.doc_id for r in quality_rules.quality_rules(junk, good.where("doc_id <> 7")).where("NOT kept").collect()] == [7]


# byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}


def test_byte_bpe(odd, ranks):
    import tiktoken

    df, rows = odd
    own = tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    wanted = collections.Counter()
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        wanted[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in byte_bpe.byte_bpe(df).collect()) == wanted
    assert byte_bpe.byte_bpe(empty(df)).count() == 0


def test_rank_queue_long_pretokens(ranks):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    bpe, rng = byte_bpe.ByteBPE(ranks), random.Random(2)
    for word in ["a" * 5000, "ab" * 4000, "".join(rng.choice("etaoin") for _ in range(6000)), "é" * 1000, "<|endoftext|>"]:
        ids = [i for piece in __import__("regex").findall(byte_bpe.split_pattern(), word) for i in bpe.encode(piece.encode())]
        assert ids == own.encode_ordinary(word) and bpe.decode(ids) == word.encode()


# near-duplicates


def brute_components(rows, width, up, down):
    sets = []
    for i, text in rows:
        w = [x.lower() for x in words(text)]
        k = min(width, len(w))
        sets.append((i, frozenset(b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and len(a & b) * down >= len(a | b) * up:
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return collections.Counter((i, len(s), root(i), i == root(i)) for i, s in sets)


@pytest.mark.parametrize("tile", [1024, 4])
def test_near_dedup(spark, tile):
    rng = random.Random(7)
    rows, base = [], prose(100, 120).split()
    for i in range(60):  # near copies of one text, at all distances
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, prose(i)) for i in range(20)] + [(50 + i, prose(3).upper()) for i in range(5)] + [(70, "a b"), (71, "A  b"), (72, "a"), (73, None), (74, ""), (75, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter(tuple(r) for r in near_dedup.near_dedup(df, width=3, similarity=(85, 100), tile_rows=tile).collect())
    assert got == brute_components(rows, 3, 85, 100)
    kept = near_dedup.near_dedup_filter(df.withColumn("id", F.lit("clash")), width=3, similarity=(85, 100))
    assert kept.columns == ["doc_id", "text", "id"] and {r.doc_id for r in kept.collect()} == {i for i, _, c, k in got if k}


def test_near_dedup_odd_rows(odd):
    df, rows = odd
    got = near_dedup.near_dedup(df).collect()
    assert len(got) == len(rows) and [r.component_id for r in got if r.doc_id == 5] == [5, 5] and all(r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_dedup(empty(df)).count() == 0
    assert near_dedup.blocks_for(0.85) == 16 and near_dedup.blocks_for(0.8) == 21


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = prose(1), prose(2)
    df = spark.createDataFrame([(1, a), (9, a), (9, b), (4, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_dedup(df).collect()} == {(1, 1), (9, 1), (4, 1)}


# decontamination


def test_decontamination(spark, odd):
    df, rows = odd
    rng = random.Random(1)
    items = [(i, prose(200 + i, n)) for i, n in enumerate([3, 7, 20, 33, 50, 64])] + [(90, None), (91, ""), (None, "x y z"), (92, prose(200, 3))]
    held = [(500 + k, prose(900 + k, rng.randrange(400)) + " " + text.upper() + " " + prose(950 + k, 30)) for k, (_, text) in enumerate(items[:6])]
    near = " ".join("zz" if j == 25 else w for j, w in enumerate(items[4][1].split()))
    held.append((600, prose(1) + " " + near))
    docs = spark.createDataFrame([*held, *rows], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))

    def grams(text):
        w = [x.lower() for x in words(text)]
        k = min(5, len(w))
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()

    wanted = {(d, i, len(g), len(g & grams(t))) for d, t in [*held, *rows] for i, x in items if (g := grams(x)) and d is not None and i is not None and 100 * len(g & grams(t)) >= 80 * len(g)}
    assert {tuple(r) for r in decontamination.contained(docs, bench).collect()} == wanted and len(wanted) == 6
    assert {tuple(r) for r in decontamination.contained(docs, bench, at_once=200).collect()} == wanted
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, _ in [*held, *rows]} - {w[0] for w in wanted}
    assert decontamination.contained(docs, empty(bench)).count() == 0 and decontamination.contained(empty(docs), bench).count() == 0


# quality classifier


def test_quality_classifier(spark, odd, labels):
    good, bad = [(i, prose(i)) for i in range(300)], [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i).split())) for i in range(100)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    told = spark.createDataFrame([(i, int(i < 1000)) for i, _ in [*good, *bad]], "doc_id long, quality int")
    rows = quality_classifier.score_quality(docs, told).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in rows if r.held_out]) > 0.97
    again = {r.doc_id: r.score for r in quality_classifier.score_quality(docs.repartition(7), told).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)
    df, all_rows = odd
    assert quality_classifier.score_quality(df, labels).count() == len(all_rows)
    assert {r.score for r in quality_classifier.score_quality(df, empty(labels)).collect()} == {0.5}
    assert quality_classifier.score_quality(empty(df), labels).count() == 0


# sharding


@pytest.mark.parametrize("limit", [50, 1000, 10**9])
def test_sharding(odd, limit):
    df, rows = odd
    got = sharding.assign_shards(df, limit).toPandas()
    assert sorted(got["n_bytes"]) == sorted(len((t or "").encode()) for _, t in rows)
    for shard, g in got.groupby("shard"):
        assert g["n_bytes"].sum() == g["shard_bytes"].iat[0] and (g["n_bytes"].sum() <= limit or len(g) == 1)
        prefix = shard.split(".")[0]
        for i in g["doc_id"].dropna():
            assert bin(int(hashlib.md5(str(int(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60).startswith(prefix)
    assert sharding.assign_shards(empty(df), limit).count() == 0


@pytest.mark.parametrize("limit", [60, 10**6])
def test_write_shards(spark, odd, tmp_path, limit):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, "d"), (2, "d"), (3, None), (4, ""), *((i, "x" * 10) for i in range(10, 50)), (60, "y" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("shard"), F.struct(F.lit(1).alias("a b")).alias("n_bytes"), F.lit(0).alias("q.row"))
    shards = {r.shard: (r.n_docs, r.shard_bytes) for r in sharding.write_shards(df, str(tmp_path / "out"), limit).collect()}
    found = spark.read.schema("doc_id long, text string, shard string, n_bytes struct<`a b`:int>, `q.row` int, q_shard string").parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(rows, key=str) and all(r.shard == "clash" and r.n_bytes["a b"] == 1 for r in found)
    sizes = collections.defaultdict(lambda: [0, 0])
    for r in found:
        sizes[r.q_shard][0] += 1
        sizes[r.q_shard][1] += len((r.text or "").encode())
    assert {k: tuple(v) for k, v in sizes.items()} == shards and (len(shards) > 8 if limit == 60 else len(shards) == 1)
    assert sharding.write_shards(empty(df), str(tmp_path / "none"), limit).count() == 0
    assert sharding.write_shards(odd[0], str(tmp_path / "odd"), limit).agg(F.sum("n_docs")).first()[0] == len(odd[1])


# chat formatting


def test_chat_formatting(spark, duck):
    rows = [
        (1, 0, "user", "Hello there my friend\nHow are you today?\n\nSecond paragraph is here."), (1, 1, "assistant", "Bob wrote:\n> Hello there my friend\n> How are you today?\n\nFine thanks to you"),
        (1, 2, "user", ">> hello THERE my   friend\n>> How are you today?\n> Fine thanks to you\nGood to hear\n\n"), (1, 3, "user", "unrelated text with no quote"), (1, 4, None, "> > Second paragraph is here.\n> nothing like this here\nok"),
        (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "u", "> Hello there my friend\n"), (None, 1, "u", "> a b c"), (1, None, "u", "x y z"),
        (3, 0, "u", "same line here now"), (3, 1, "u", "same line here now"), (3, 2, "u", "> same line here now\nyes it is true"), (3, 2, "u", "> same line here now\nyes it is true"), (3, 3, "u", "> yes it is true\nq"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quoted_lines, r.text) for r in chat_formatting.link_quotations(df).collect()}
    assert got[1, 1] == (0, 0, 1, 2, "Fine thanks to you") and got[1, 2] == (1, 0, 2, 3, "Good to hear") and got[1, 3] == (None, 3, 0, 0, "unrelated text with no quote")
    assert got[1, 4] == (0, 0, 1, 2, "ok") and got[2, 2] == (None, 2, 0, 1, "") and got[3, 2][:3] == (0, 0, 1) and got[3, 3] == (2, 0, 2, 1, "q") and got[None, 1][0] is None
    order = [(r.conv_id, r.turn) for r in chat_formatting.chat_segments(df).collect() if r.conv_id == 3]
    assert order == [(3, 0), (3, 2), (3, 2), (3, 3), (3, 1)]
    assert chat_formatting.link_quotations(empty(df)).count() == 0


def test_short_passages_link(spark):
    rows = [
        (1, 0, "u", "Shall we go?\n\nSounds good"), (1, 1, "a", "Yes"), (1, 2, "u", "> yes\nGreat"), (1, 3, "a", "> Sounds good\n42"), (1, 4, "u", "> 42\nsure"), (1, 5, "a", "> Nobody said\nok then"),
        (2, 0, "u", "no"), (2, 1, "a", "a longer line here"), (2, 2, "u", "> a longer line here\n\n> no\nq"), (2, 3, "a", "> a longer line\n> no\nx"), (2, 4, "a", "> \n>\ny"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in chat_formatting.link_quotations(df).collect()}
    assert got[1, 2] == (1, 1, 1) and got[1, 3] == (0, 0, 1) and got[1, 4] == (3, 0, 2) and got[1, 5] == (None, 5, 0)
    # the longer of two passages of a level comes first; a few words inside a longer passage aren't one
    assert got[2, 2] == (1, 1, 1) and got[2, 3] == (None, 3, 0) and got[2, 4] == (None, 4, 0)


# token files


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    df, rows = odd
    more = [(100, "end of <|endoftext|> text"), (101, "<|ENDOFTEXT|>, TÜRKÇE DİLİ. İ! don't"), (102, "a<|startoftext|>b<|endoftext|>")]
    df, rows = df.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")), [*rows, *more]
    uri = f"file://{tmp_path}/shards"
    shards = token_files.token_files(df, uri, length=64)
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = sorted(((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted((tuple(r) for r in token_files.read_digests(spark, uri, shards).collect()), key=lambda x: x[1])
    at, wanted = 0, []
    for i, x in ids:
        wanted.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == wanted
    flat = []
    for name, _, n in shards:
        shard = token_files.Shard(uri, name)
        for k in range(len(shard)):
            seq, mask = shard.sequence(k)
            assert len(seq) == 64 and not seq.flags.owndata and not mask.flags.owndata
            flat += seq[mask].tolist()
        assert -(-n // 64) == len(shard)
    assert flat == [t for _, x in ids for t in x]
    assert token_files.read_digests(spark, uri + "e", token_files.token_files(empty(df), uri + "e")).count() == 0


def test_words_alone_equal_whole_texts():
    from tokenizers import Tokenizer

    path, rng = vocabulary("word_bpe_49k.json"), random.Random(5)
    whole, own = Tokenizer.from_file(path), token_files.Encoder(open(path).read(), 1 << 12, 2)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "İ", "ß", "é", "e\u0301", "\u0301", "\u0307", "\u00a0", "\u2003", "\u0085", "\u001c", "Σ", " ", "\n", "B", "word", "don't", "'S", "1", "½", "!", "...", "中文", "ﬁ", "\U0001F600", "\u200d", "K", "가", "ᄀ", "ᅡ", "-", "x" * 70]
    for k in range(20_000):
        chars = lambda: chr(rng.choice([rng.randrange(32, 65), rng.randrange(160, 0x370), rng.randrange(0x370, 0x2100)]))
        text = "".join(rng.choice(pool) if k % 2 else chars() for _ in range(rng.randint(0, 13)))
        assert np.frombuffer(own.encode(text.encode()), own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_that_reach_beyond_words():
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(vocabulary("word_bpe_49k.json")))
    spec["added_tokens"].append({"id": 49408, "content": "new york", "single_word": False, "lstrip": True, "rstrip": False, "normalized": True, "special": False})
    text = json.dumps(spec)
    ids = np.frombuffer(token_files.Encoder(text, 100, 2).encode(b"in  New York now <|endoftext|>"), np.uint16).tolist()
    assert ids == Tokenizer.from_str(text).encode("in  New York now <|endoftext|>", add_special_tokens=False).ids and 49408 in ids


# line dedup


def brute_lines(rows, least=40, copies=5):
    held = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, text in rows:
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                held[key(x)].add(i)
    out = collections.Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < copies or i == max(held[key(x)])]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("bits", [27, 13])
def test_line_dedup(odd, bits):
    df, rows = odd
    out = line_dedup.line_dedup(df, most_bits=bits)
    assert out.columns == [*df.columns, "q_n_lines", "q_n_dropped"]
    assert collections.Counter(tuple(r) for r in out.select("doc_id", "q_n_lines", "q_n_dropped", "text").collect()) == brute_lines(rows)
    assert line_dedup.line_dedup(empty(df)).count() == 0


def test_line_dedup_many(spark):
    rng = random.Random(4)
    pool = [f"Shared line number {k} with more than forty characters, é." for k in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng.random(), 9) for _ in range(rng.randrange(8)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter(tuple(r) for r in line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == brute_lines(rows)


def test_line_dedup_other_columns(spark):
    df = spark.createDataFrame([(1, "a\nb"), (None, None)], "doc_id long, text string").select("*", F.struct(F.lit(1).alias("a b")).alias("s t"), F.lit(0).alias("n_lines"), F.lit(0).alias("q_n_lines"), F.lit(0).alias("x.y"))
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "q_q_n_lines", "n_dropped"] and sorted(out.select("q_q_n_lines").collect()) == [(1,), (2,)]


# the classifier's parts by brute force


def test_context_sums_by_brute_force(spark):
    import xxhash

    texts = [prose(i, 30) for i in range(6)] + ["one", "", None, "two words", "a a a b a"]
    df = spark.createDataFrame([(t.encode() if t is not None else None,) for t in texts], "text binary").repartition(3)
    got, index = quality_classifier.context_vectors(df), quality_classifier.index_vectors()
    wanted = np.zeros_like(got)
    for t in texts:
        slots = [xxhash.xxh3_64_intdigest(w) % quality_classifier.SLOTS for w in words(t)]
        for i, a in enumerate(slots):
            for j in range(max(0, i - quality_classifier.WINDOW), min(len(slots), i + quality_classifier.WINDOW + 1)):
                if i != j:
                    wanted[a] += index[slots[j]]
    assert (got == wanted).all() and (np.abs(index).sum(1) == quality_classifier.ENTRIES).all()
    vectors = quality_classifier.word_vectors(got)
    norm = np.linalg.norm(got, axis=1, keepdims=True)
    assert np.allclose(vectors[:, : quality_classifier.DIMS] * np.maximum(norm, 1), got, atol=1e-4) and np.allclose(vectors[:, quality_classifier.DIMS :] * 2, index)
    pooled = quality_classifier.pooled([t.encode() if t is not None else None for t in texts], vectors)
    for row, t in zip(pooled, texts, strict=True):
        mine = [vectors[xxhash.xxh3_64_intdigest(w) % quality_classifier.SLOTS] for w in words(t)] or [np.zeros(vectors.shape[1])]
        assert np.allclose(row, [*np.mean(mine, 0), *np.sqrt(np.mean(np.square(mine), 0)), np.log1p(len(words(t)))], atol=1e-5)
    assert quality_classifier.pooled([], vectors).shape == (0, 2 * vectors.shape[1] + 1)


def test_network_and_temperature():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=1200) > 0).astype(float)
    model = quality_classifier.Network().fit(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.85
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    a = np.tanh(z @ model.weights[0] + model.weights[1]) @ model.weights[2] + model.weights[3]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(a / model.temperature, -40, 40))))
    # the temperature is the best of its grid on the rows kept from learning
    held = np.random.default_rng(model.seed).random(1200) < 0.25
    loss = lambda t: np.mean(np.logaddexp(0, a[held] / t) - y[held] * a[held] / t)
    assert loss(model.temperature) <= min(map(loss, np.exp(np.linspace(np.log(0.25), np.log(16), 200)))) + 1e-12


def test_learns_from_a_bounded_number(spark):
    rows = spark.createDataFrame([(i, b"t") for i in range(3000)] + [(5, b"u"), (None, b"v")], "doc_id long, text binary")
    told = spark.createDataFrame([(i, i % 2) for i in range(0, 4000, 2)] + [(4, 1), (None, 1), (7, None), (9, 2)], "doc_id long, quality int")
    all_ = quality_classifier.learned_rows(rows, told, 10**6)
    wanted = {i for i in range(0, 3000, 2) if i != 4 and zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r.doc_id for r in all_.collect()} == wanted
    few = {r.doc_id for r in quality_classifier.learned_rows(rows, told, 100).collect()}
    order = sorted(wanted, key=dict(spark.range(3000).select("id", quality_classifier.id_hash(F.col("id"))).collect()).__getitem__)
    assert few == set(order[: len(few)]) and 100 <= len(few) < 400


# pipeline


def brute_quality(rows, labels, alpha=0.02, delta=0.05):
    """Ids that the rules keep, by plain arithmetic; rows: (doc_id, text, lang)."""
    from math import comb

    facts, good = [], {i for i, q in labels if q == 1} - {i for i, q in labels if q != 1}
    for i, text, lang in rows:
        n, _, symbols, dups, repeats = brute_counts(text)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n"))
        share = lambda part, whole: part * 1000 // whole if whole else 0
        facts.append((i, lang or "", n < 50 or 100 * repeats > 50 * n, (share(symbols, n), share((text or "").count("!"), n), share(repeats, n), share(dups, lines))))
    told = collections.defaultdict(list)
    for i, lang, failed, signals in facts:
        if i in good and not failed:
            for s, x in enumerate(signals):
                told[lang, s].append(x)
    cut = {}
    for (lang, s), seen in told.items():
        n, p = len(seen), alpha / 4
        for step in range(1, 41):
            k = sum(x >= step * 25 for x in seen)
            if k < n * p and sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) * len(told) <= delta:
                cut[lang, s] = step * 25
                break
    return {i for i, lang, failed, signals in facts if not failed and not any(x >= cut.get((lang, s), 10**9) for s, x in enumerate(signals))}


def brute_items(rows, items):
    def grams(text):
        w = [x.lower() for x in words(text)]
        k = min(5, len(w))
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()

    wanted = [g for _, t in items if (g := grams(t))]
    return {i for i, t in rows if any(100 * len(g & have) >= 80 * len(g) for have in [grams(t)] for g in wanted)}


def test_pipeline_stages(spark, ranks):
    import corpus_pipeline
    import tiktoken

    from graphloom.llm._common import written

    own = tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    docs = read("documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        langs = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()] if name == "quality rules" else []
        docs = written(stage(spark, docs, DATA))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality rules":
            assert kept == brute_quality(langs, [tuple(r) for r in read("labels").select("doc_id", "quality").collect()])
        if name == "decontamination":
            assert kept == {i for i, _ in rows} - brute_items(rows, [tuple(r) for r in read("benchmark").select("item_id", "text").collect()])
        if name == "byte-level BPE":
            wanted = {(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, t in rows for x in [own.encode_ordinary(t)]}
            assert {tuple(r) for r in docs.select("doc_id", "n_tokens", "ids_sha256").collect()} == wanted
        if name == "near dedup":
            assert kept == {i for i, _, c, k in brute_components(rows, 5, 80, 100) if k}
        if name == "line dedup":
            wanted = brute_lines(rows)
            assert {(r.doc_id, r.text) for r in docs.collect()} == {(i, t) for i, _, _, t in wanted}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert 0 < len(kept) < before
    assert {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()} == {tuple(r) for r in docs.collect()}


def test_quality_stage_with_cutoffs(spark):
    from graphloom.llm._common import written

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    told = [tuple(r) for r in labels.select("doc_id", "quality").collect()]
    kept = {r.doc_id for r in written(quality_rules.quality_filter(docs, labels, alpha=quality_rules.LOOSE_ALPHA)).collect()}
    wanted = brute_quality(rows, told, quality_rules.LOOSE_ALPHA)
    assert kept == wanted and len(wanted) < sum(not f for f in (n < 50 or 100 * r > 50 * n for n, _, _, _, r in (brute_counts(t) for _, t, _ in rows)))


def test_pipeline_stages_on_odd_rows(spark, odd, labels, tmp_path):
    import corpus_pipeline

    df, rows = odd
    bench = spark.createDataFrame([(1, prose(5)), (2, None), (None, "x"), (3, "")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for name, frame in {"labels": labels, "benchmark": bench}.items():
        frame.write.parquet(f"{tmp_path}/full/{name}.parquet")
        empty(frame).write.parquet(f"{tmp_path}/none/{name}.parquet")
    more = df.select("*", F.lit("clash").alias("q_row"), F.lit(0).alias("q_hit"), F.lit(0).alias("hit"), F.lit(0).alias("lost"), F.lit(0).alias("n_lines.x"))
    for kind in ("full", "none"):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, more, f"{tmp_path}/{kind}")
            assert stage(spark, empty(more), f"{tmp_path}/{kind}").count() == 0
            got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
            if name != "byte-level BPE":
                assert out.columns == more.columns
            if name == "quality rules":  # only texts of 50 words that don't repeat themselves
                assert got == collections.Counter(i for i, t in rows if len(words(t)) >= 50 and i != 9)
            if name in ("line dedup", "byte-level BPE"):
                assert got == collections.Counter(i for i, _ in rows)
            if name == "near dedup":  # rows with one id stay together, no words and no id stay
                assert got == collections.Counter(i for i, _ in rows)
            if name == "decontamination":
                assert got == collections.Counter(i for i, _ in rows if kind == "none" or i != 5)
