"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item has a tiny similarity with a long document, whatever it holds of the
item. So sets are partitioned by size: items by the power of two, u, that bounds
their number of shingles, and each document is read in windows of 2 * u shingles at
every u-th one, so that sizes within a partition differ by a known factor and any
passage of an item's length lies in one window. With containment 0.8 an item and such
a window have similarity of 0.19 or more, which HASHES minhashes of one row miss
with probability below 2e-6. Candidates are verified on all shingles of the item
and of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_shingles, batch_words, free_name, mixed, shingles, sized, sliced, table, written

HASHES = 64
#: Bits of a minhash that are looked up before the whole.
SEEN_BITS = 15
SEEN_MASK = (1 << SEEN_BITS) - 1
#: Bytes of item texts searched for at once; more of them are searched for in turns.
ITEMS_AT_ONCE = 4 << 20


class ItemIndex:
    """Shingle sets and minhashes of some items, by size partition."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        import numpy as np

        words, starts = batch_words(text for _, text in items)
        self.width = width
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(shingles(words[starts[k] : starts[k + 1]], width)) for k in range(len(items))]
        self.multipliers = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        by_size: dict[int, list[int]] = {}
        for k, found in enumerate(self.sets):
            if len(found):
                by_size.setdefault(1 << max(0, int(len(found)) - 1).bit_length(), []).append(k)
        self.parts = {}
        for bound, ks in sorted(by_size.items()):
            least = np.array([[(self.folded(self.sets[k]) * m).min() for m in self.multipliers] for k in ks], np.uint32)
            order = least.argsort(0, kind="stable")
            seen = np.zeros((HASHES, 1 << SEEN_BITS), bool)  # low bits of the items' minhashes
            for h in range(HASHES):
                seen[h, least[:, h] & SEEN_MASK] = True
            self.parts[bound] = (np.array(ks), order, np.take_along_axis(least, order, 0), seen)

    @staticmethod
    def folded(found):
        import numpy as np

        return (found >> np.uint64(32)).astype(np.uint32)

    def candidates(self, found, begins) -> set[tuple[int, int]]:
        """(text, item), both by place, where a window of the text shares a minhash with the item.

        found, begins: shingle hashes of several texts, in text order.
        """
        import numpy as np

        hits: set[tuple[int, int]] = set()
        if not len(found) or not self.parts:
            return hits
        base = min(self.parts)
        folded, sizes = self.folded(found), np.diff(begins)
        layout = []  # of each partition: blocks' starts in the finer blocks, first blocks of windows, texts
        step, counts = base, -(-sizes // base)
        text = np.repeat(np.arange(len(sizes)), counts)
        offset = np.concatenate([[0], np.cumsum(counts)])
        first_starts = begins[text] + (np.arange(len(text)) - offset[text]) * base
        for bound in self.parts:
            folds = []
            while step < bound:
                place = np.arange(len(text)) - offset[text]
                starts = np.flatnonzero(place % 2 == 0)
                folds.append(starts)
                text, counts, step = text[starts], -(-counts // 2), step * 2
                offset = np.concatenate([[0], np.cumsum(counts)])
            after = np.minimum(np.arange(len(text)) + 1, len(text) - 1)
            alone = counts[text] == 1
            begin = np.flatnonzero((text[after] == text) & (after > np.arange(len(text))) | alone)
            layout.append((bound, folds, begin, np.where(alone[begin], begin, after[begin]), text[begin]))
        for h, m in enumerate(self.multipliers):
            blocks = np.minimum.reduceat(folded * m, first_starts)
            for bound, folds, begin, then, text in layout:
                for starts in folds:
                    blocks = np.minimum.reduceat(blocks, starts)
                ks, order, least, seen = self.parts[bound]
                windows = np.minimum(blocks[begin], blocks[then])
                some = np.flatnonzero(seen[h, windows & SEEN_MASK])
                if not len(some):
                    continue
                lo = np.searchsorted(least[:, h], windows[some])
                hi = np.searchsorted(least[:, h], windows[some], "right")
                real = np.flatnonzero(lo < hi)
                for w, a, b in zip(text[some[real]].tolist(), lo[real].tolist(), hi[real].tolist(), strict=True):
                    for i in range(a, b):
                        hits.add((w, int(ks[order[i, h]])))
        return hits


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, share: tuple[int, int] = (80, 100), at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """One row per document and item it contains: id_col, item_col, n_item_shingles, n_shared (long).

    Shingles: distinct width-word shingles, A-Z lower-cased, words being runs of characters other than
    \\x20 and \\x09-\\x0D; of a shorter text its whole sequence. An item is contained if share[1] * shared
    >= share[0] * its shingles. Null and empty texts, and null ids, match nothing; rows with one id are
    found each, and a pair is returned once. Other columns are ignored. Items of over at_once bytes are
    searched for in several passes over docs.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("t")).where("item IS NOT NULL AND t IS NOT NULL")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-int(total) // at_once))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id IS NOT NULL")
    up, down = share

    def found_with(block: list[tuple[int, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # about at_once bytes

        def run(batches):
            import numpy as np
            import pyarrow as pa

            index = ItemIndex(sent.value, width)
            for batch in sliced(batches, 1):
                words, starts = batch_words(t.as_py() for t in batch.column(1))
                found, begins = batch_shingles(words, starts, width)
                ids, out, last, own = batch.column(0).to_pylist(), [], -1, None
                for i, k in sorted(index.candidates(found, begins)):
                    if i != last:
                        last, own = i, np.unique(found[begins[i] : begins[i + 1]])
                    item = index.sets[k]
                    at = np.searchsorted(own, item)
                    at[at == len(own)] = 0
                    shared = int((own[at] == item).sum())
                    if shared * down >= len(item) * up:
                        out.append((ids[i], index.ids[k], len(item), shared))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_item_shingles", "n_shared"])

        return rows.mapInArrow(run, "doc_id long, item_id long, n_item_shingles long, n_shared long")

    result = None
    for p in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("item", "t"), F.lit(passes)) == p) if passes > 1 else wanted
        found = found_with([(r.item, bytes(r.t)) for r in block.collect()])
        result = found if result is None else result.unionByName(found)
    # one row per pair, also where documents or items repeat
    return result.groupBy(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col)).agg(F.max("n_item_shingles").alias("n_item_shingles"), F.max("n_shared").alias("n_shared"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs that contain no item, with all their columns, whatever their names.

    Rows with one id are one document: all go if one of them contains an item. Rows with a null id,
    or a null or empty text of their own, stay. Without items all rows stay; an empty table gives no rows.
    """
    name = free_name("hit", docs.columns)
    hit = written(contained(docs, items, id_col=id_col, **settings).select(F.col(id_col).alias(name)).distinct())
    return docs.join(sized(hit, hit.count(), 16), F.col(id_col) == F.col(name), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+')"
_SHINGLES = "SELECT DISTINCT id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM {} WHERE len(ws) > 0)"
_SQL = f"""
WITH d AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id AS id, {_WORDS} AS ws FROM benchmark),
ds AS ({_SHINGLES.format("d")}), bs AS ({_SHINGLES.format("b")}), n AS (SELECT id, count(*)::BIGINT AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, max(n.n) AS n_item_shingles, count(*)::BIGINT AS n_shared
FROM ds JOIN bs ON ds.s = bs.s JOIN n ON n.id = bs.id GROUP BY ds.id, bs.id HAVING count(*) * 100 >= 80 * max(n.n)
"""

QUERIES = {"op5_decontamination": op5_decontamination}
SQL = {"op5_decontamination": _SQL}
