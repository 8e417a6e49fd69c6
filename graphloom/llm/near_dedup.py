"""Near-duplicates by MinHash with tensored banding.

A document's shingle set has b small collections of ROWS minhashes. A table key is
a pair of collections, so b * (b - 1) / 2 tables come from b * ROWS minhashes: about
the square root of what separate bands would compute. Equal sets are one set from the
start. The sets of a key gather round its smallest id, the key's pivot; a pivot's star
holds every set that shares one of its keys with it, so any two sets that share a key
share a star. Candidates are verified on full sets, in tiles of bounded size.

First each set goes to the star of its smallest pivot only, a large star being dealt
into tiles in two ways at random: the links found there join nearly all of what
belongs together. Then the stars whose sets are still in more than one component, and
weren't compared in full, are worked off: tiles of a star are pairs of parts, where
sets of one large component have parts of their own, and parts of one component aren't
compared with each other. So every pair of different components that shares a key is
compared, and no group is expanded into its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batch_words, free_name, mixed, shingles, sized, sliced, table, written
from .components import components

ROWS = 3
#: Probability that a pair right at the limit shares no key, at most.
MOST_MISSED = 1e-5
#: Sets in a tile's side at most, and their bytes.
TILE_ROWS, TILE_BYTES = 512, 8 << 20


def miss_probability(similarity: float, blocks: int, rows: int = ROWS) -> float:
    """Probability that a pair of that similarity shares no key: fewer than two of its collections agree."""
    p = similarity**rows
    return (1 - p) ** blocks + blocks * p * (1 - p) ** (blocks - 1)


def blocks_for(similarity: float, rows: int = ROWS) -> int:
    """Collections that keep miss_probability within MOST_MISSED: 16 for 0.85, 21 for 0.8."""
    blocks = 2
    while miss_probability(similarity, blocks, rows) > MOST_MISSED:
        blocks += 1
    return blocks


def _multipliers(count: int):
    import numpy as np

    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def block_values(found, multipliers, rows: int):
    """The collections' values (uint64) of a set of shingle hashes, not empty."""
    import numpy as np

    least = np.array([((found * m) ^ (found * m >> np.uint64(29))).min() for m in multipliers], np.uint64)
    out = np.arange(len(multipliers) // rows, dtype=np.uint64)
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[j::rows])
    return out


def signatures(docs: DataFrame, width: int, blocks: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set), blocks array<long>; both null for an empty set."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        multipliers = _multipliers(blocks * rows)
        for batch in sliced(batches, 1):
            words, starts = batch_words(t.as_py() for t in batch.column(1))
            sizes, keys, values = [], [], []
            for i in range(batch.num_rows):
                found = np.unique(shingles(words[starts[i] : starts[i + 1]], width))
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                values.append(block_values(found, multipliers, rows).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "blocks"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, blocks array<long>")


def shared_keys(sets: DataFrame, blocks: int) -> DataFrame:
    """(key, id): the table keys of each set, from those collections of it that some other set shares.

    A collection that no other set shares can't be half of a shared key.
    """
    single = sets.select("id", F.posexplode("blocks").alias("block", "value"))
    often = single.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1").select("block", "value")
    alive = single.join(often, ["block", "value"]).groupBy("id").agg(F.collect_list(F.struct("block", "value")).alias("alive"))  # as many as blocks at most

    def pairs(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, keys = [], []
            for doc_id, alive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                alive.sort(key=lambda x: x["block"])
                block = np.array([x["block"] for x in alive], np.uint64)
                value = np.array([x["value"] for x in alive], np.int64).view(np.uint64)
                i, j = np.triu_indices(len(alive), 1)
                key = mixed(mixed(value[i] + block[i] * np.uint64(blocks) + block[j]) + value[j])
                keys.append(key.view(np.int64))
                ids.append(np.full(len(key), doc_id, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])

    return alive.where(F.size("alive") > 1).mapInArrow(pairs, "key long, id long")


def tile_links(tiles: DataFrame, by: list[str], similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join what is similar within each tile: a group of rows with the same columns by.

    tiles: by, part int (a tile of two parts compares rows of different parts only), label long (rows
    with one label are joined already), id, blocks array<long>, hashes binary (sorted uint64).
    similarity: (85, 100) for 0.85.
    """
    up, down = similarity

    def compare(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id", ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        values = np.array(pdf["blocks"].tolist(), np.int64)
        part, ids = pdf["part"].to_numpy(), pdf["id"].to_numpy()
        across = len(np.unique(part)) > 1
        label = pdf["label"].to_numpy().copy()
        links: list[tuple[int, int]] = []
        for i in range(1, len(ids)):
            near = ((values[:i] == values[i]).sum(1) >= 2) & (label[:i] != label[i])
            if across:
                near &= part[:i] != part[i]
            waiting = np.flatnonzero(near)
            while len(waiting):
                j, waiting = waiting[0], waiting[1:]
                low, high = sorted((len(sets[i]), len(sets[j])))
                if low * down < high * up:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * down >= (low + high - both) * up:
                    links.append((ids[j], ids[i]))
                    label[label == label[i]] = label[j]
                    waiting = waiting[label[waiting] != label[i]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return tiles.select(*by, "part", "label", "id", "blocks", "hashes").groupBy(*by).applyInPandas(compare, "a long, b long")


def parts_of(sets: str, size: str, tile_rows: int, tile_bytes: int):
    """Parts of at most about tile_rows sets and tile_bytes bytes."""
    return F.greatest(F.ceil(F.col(sets) / tile_rows), F.ceil(F.col(size) / tile_bytes)).cast("int")


def home_tiles(stars: DataFrame, sizes: DataFrame, tile_rows: int, tile_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(pivot, way, part, id): each set in the tile of its smallest pivot, and that pivot itself; and (pivot, parts) of the tiles.

    A pivot with more than one tile deals its sets in two ways, and is in every tile of them.
    """
    home = stars.groupBy("id").agg(F.min("pivot").alias("pivot")).join(sizes, "id").select("pivot", "id", "bytes")
    dealt = home.groupBy("pivot").agg(F.count("*").alias("sets"), F.sum("bytes").alias("bytes")).select("pivot", parts_of("sets", "bytes", tile_rows, tile_bytes).alias("parts"))
    ways = F.explode(F.sequence(F.lit(0), F.when(F.col("parts") > 1, 1).otherwise(0))).alias("way")
    own = home.join(dealt, "pivot").select("pivot", "id", "parts", ways).withColumn("part", F.pmod(F.xxhash64("id", "way"), "parts").cast("int"))
    itself = dealt.select("pivot", F.col("pivot").alias("id"), "parts", ways).select("pivot", "id", "way", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return own.select("pivot", "way", "part", "id").unionByName(itself.select("pivot", "way", "part", "id")), dealt


def open_tiles(stars: DataFrame, dealt: DataFrame, labels: DataFrame, sizes: DataFrame, tile_rows: int, tile_bytes: int) -> DataFrame:
    """(pivot, lo, hi, part, label, id): tiles of the stars that hold pairs of different labels which no tile of home_tiles compared.

    Parts of a star: sets whose label fills half a tile have parts of that label alone, the others
    share parts. Two parts of one label are no tile.
    """
    away = F.col("id") != F.col("pivot")
    members = written(
        stars.unionByName(stars.select("pivot", F.col("pivot").alias("id")).distinct())
        .join(sizes, "id")
        .join(stars.groupBy("id").agg(F.min("pivot").alias("home")), "id", "left")
        .join(labels, "id", "left")
        .select("pivot", "id", F.coalesce("label", "id").alias("label"), "bytes", (away & (F.col("home") != F.col("pivot"))).alias("guest"))
    )
    # of each star's labels; rows of a star meet what is known of it in one join, on star and label
    fill = members.groupBy("pivot", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("guest").alias("guests"))
    state = fill.groupBy("pivot").agg(F.count("*").alias("labels"), F.max("guests").alias("guests")).join(dealt, "pivot", "left")
    waiting = state.where("labels > 1 AND (guests OR coalesce(parts, 1) > 1)").select("pivot")
    fill = fill.join(waiting, "pivot", "left_semi").withColumn("parts", parts_of("n", "bytes", tile_rows, tile_bytes))
    heavy = (F.col("n") * 2 > tile_rows) | (F.col("bytes") * 2 > tile_bytes)
    light = fill.where(~heavy).groupBy("pivot").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("pivot", parts_of("n", "bytes", tile_rows, tile_bytes).alias("mixed"))
    ordered = Window.partitionBy("pivot").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # a star has at most two heavy labels for each tile's worth of sets
    alone = fill.where(heavy).select("pivot", "label", F.col("parts").alias("own"), F.coalesce(F.sum("parts").over(ordered), F.lit(0)).cast("int").alias("before"))
    total = fill.where(heavy).groupBy("pivot").agg(F.sum("parts").cast("int").alias("pure"))
    known = fill.select("pivot", "label").join(alone, ["pivot", "label"], "left").join(light, "pivot", "left").join(total, "pivot", "left")
    known = written(known.withColumns({"mixed": F.coalesce("mixed", F.lit(0)), "pure": F.coalesce("pure", F.lit(0))}))
    dealt_left = members.join(known, ["pivot", "label"])
    first = F.col("mixed") + F.col("before")
    part = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("id"), F.greatest("mixed", F.lit(1)))).otherwise(first + F.pmod(F.xxhash64("id"), "own")).cast("int")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    zero, end = F.lit(0), F.col("mixed") + F.col("pure")
    others = F.when(F.col("own").isNull(), span(zero, end)).otherwise(F.concat(span(zero, first), span(first + F.col("own"), end)))
    tiles = dealt_left.select("pivot", "id", "label", part.alias("part"), F.explode(others).alias("other"))
    return tiles.select("pivot", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "label", "id")


def full_sets(docs: DataFrame, width: int, blocks: int, rows: int) -> DataFrame:
    """id, blocks and hashes (its sorted shingle hashes as binary) of each row with doc_id and text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        multipliers = _multipliers(blocks * rows)
        for batch in sliced(batches, 1):
            words, starts = batch_words(t.as_py() for t in batch.column(1))
            sets = [np.unique(shingles(words[starts[i] : starts[i + 1]], width)) for i in range(batch.num_rows)]
            values = [block_values(x, multipliers, rows).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "blocks", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, blocks array<long>, hashes binary").where(F.octet_length("hashes") > 0)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100), blocks: int | None = None, rows: int = ROWS, tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (long), kept boolean.

    A set is the distinct width-word shingles of the whole text, A-Z lower-cased, words being runs of
    characters other than \\x20 and \\x09-\\x0D; of a shorter text its whole sequence; of none, empty
    and linked with nothing. Sets are linked at similarity[1] * intersection >= similarity[0] *
    union, on full sets of 64-bit hashes. component_id is the smallest id reachable over links,
    kept whether it is the row's own. Rows with one id are one document: its sets, if several,
    are linked. A row with a null id has no component and is kept. Other columns are ignored.
    blocks: by default as many as keep the probability that a pair right at the limit shares no key
    within MOST_MISSED; such a pair may still be joined through others.
    """
    blocks = blocks or blocks_for(similarity[0] / similarity[1], rows)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = written(signatures(slim, width, blocks, rows))
    named = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    per_set = written(named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("blocks").alias("blocks")))
    keys = written(shared_keys(per_set.select("id", "blocks"), blocks))
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    pivots = written(pivots)  # so that the join's two sides are plain shuffles, which can be split
    stars = written(keys.join(pivots, "key").where("id <> pivot").select("pivot", "id").distinct())
    sizes = per_set.groupBy("id").agg((F.max("n_shingles") * 8).alias("bytes"))
    again = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("n > 1")
    repeated = again.limit(1).count() > 0
    wanted = stars.select(F.explode(F.array("pivot", "id")).alias("id")).distinct()
    near = sized(wanted, wanted.count(), 16)
    sets = full_sets(slim.join(near, F.col("doc_id") == F.col("id"), "left_semi"), width, blocks, rows)
    if repeated:
        sets = sets.groupBy("id", "hashes").agg(F.first("blocks").alias("blocks"))
    homes, dealt = home_tiles(stars, sizes, tile_rows, tile_bytes)
    homes = homes.withColumns({"label": F.col("id"), "tile": F.col("part"), "part": F.lit(0)})
    found = written(tile_links(sets.join(homes, "id"), ["pivot", "way", "tile"], similarity))
    joined = components(found)
    tiles = written(open_tiles(stars, dealt, joined, sizes, tile_rows, tile_bytes))
    if tiles.limit(1).count():
        ids = tiles.select(F.col("id").alias("open")).distinct()
        rest = full_sets(slim.join(sized(ids, ids.count(), 16), F.col("doc_id") == F.col("open"), "left_semi"), width, blocks, rows)
        if repeated:
            rest = rest.groupBy("id", "hashes").agg(F.first("blocks").alias("blocks"))
        found = found.unionByName(written(tile_links(rest.join(tiles, "id"), ["pivot", "lo", "hi"], similarity)))
    if repeated:  # an id's sets are one document
        own = named.join(again.where("lo <> hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_key").join(per_set.select("set_key", "id"), "set_key")
        found = found.unionByName(own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    labels = components(found)
    by_set = per_set.join(labels, "id", "left").select("set_key", F.coalesce("label", "id").alias("component_id"))
    out = signed.join(by_set, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def near_dedup_filter(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that near_dedup keeps, one document of each group, with all their columns, whatever their names.

    Rows with one id are one document and stay or go together; rows with a null id, and those whose
    text has no words, stay. An empty table gives no rows.
    """
    id_col, name = settings.get("id_col", "doc_id"), free_name("lost", docs.columns)
    lost = written(near_dedup(docs, **settings).where("NOT kept").select(F.col(id_col).alias(name)).distinct())
    return docs.join(sized(lost, lost.count(), 16), F.col(id_col) == F.col(name), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, similarity=(85, 100))


QUERIES = {"op4_near_dedup": op4_near_dedup}
SQL: dict[str, str] = {}
