"""Line dedup with two Bloom filters.

A first pass sets bits for the hashes of lines seen once, and in a second filter
for those seen again. A second pass looks each line up in the second filter; only
suspected repeats are shuffled, counted exactly by document and given the one
document that keeps them. The filters grow with the number of lines up to a fixed
size; past it more lines are suspected and shuffled, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ._common import free_name, merged, sized, sliced, table, written

#: Bytes of text for each bit of a filter (about 8 bits a line), log2 of its bits at most (29: 64 MB), bytes that travel together.
BYTES_PER_BIT, MOST_BITS, CHUNK = 32, 29, 1 << 16


def line_keys(text: bytes | None, least: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has at least least code points."""
    found = []
    for i, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= least:
            key = line.strip().lower()
            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                found.append((i, key))
    return found


def _distinct_hashes(text: bytes | None, least: int) -> set[bytes]:
    import xxhash

    return {xxhash.xxh3_128_digest(key) for _, key in line_keys(text, least)}


def _bits(hashes: list[bytes], log_bits: int):
    """Two bit numbers for each 128-bit hash."""
    import numpy as np

    pair = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return (pair >> np.uint64(64 - log_bits)).astype(np.int64)


def _seen_twice(docs: DataFrame, least: int, log_bits: int):
    """The filter of lines that two documents or more may share, packed, as bytes."""

    def partial(batches):
        import zlib

        import numpy as np
        from pyspark import TaskContext

        once, twice = (np.zeros((1 << log_bits) // 8, np.uint8) for _ in range(2))
        for batch in sliced(batches, 0):
            hashes: list[bytes] = []
            for text in batch.column(0):
                hashes.extend(_distinct_hashes(text.as_py(), least))
            if hashes:
                counts: dict[bytes, int] = {}
                for h in hashes:
                    counts[h] = counts.get(h, 0) + 1
                bits = _bits(list(counts), log_bits)
                place, bit = bits >> 3, (128 >> (bits & 7)).astype(np.uint8)
                again = ((once[place] & bit) > 0).all(1) | (np.fromiter(counts.values(), np.int64) > 1)
                np.bitwise_or.at(twice, place[again], bit[again])
                np.bitwise_or.at(once, place, bit)
        part = TaskContext.get().partitionId()
        for chunk, at in enumerate(range(0, len(once), CHUNK)):
            parts = [x[at : at + CHUNK] for x in (once, twice)]
            if parts[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in parts)], ["chunk", "part", "once", "twice"])

    def merge(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        once = twice = None
        for batch in batches:
            for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                once, twice = (a, b) if once is None else (once | a, twice | b | once & a)
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in keys), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice))], ["chunk", "part", "once", "twice"])

    schema = "chunk int, part int, once binary, twice binary"
    import zlib

    filters = merged(docs.select("q_text").mapInArrow(partial, schema), merge, schema)

    out = bytearray(max(1, (1 << log_bits) // 8))
    for row in filters.select("chunk", "twice").collect():  # MOST_BITS bits together at most
        chunk = zlib.decompress(row.twice)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(chunk)] = chunk
    return bytes(out)


def repeated_lines(docs: DataFrame, least: int = 40, copies: int = 5, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, keys array<binary>): hashes of the lines that the document loses, for documents that lose any.

    docs: doc_id long, q_text binary.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("q_text")), F.lit(0)).alias("n")).first().n
    log_bits = max(13, min(most_bits, (int(size) // BYTES_PER_BIT).bit_length()))
    twice = docs.sparkSession.sparkContext.broadcast(_seen_twice(docs, least, log_bits))

    def suspects(batches):
        import numpy as np

        packed = np.frombuffer(twice.value, np.uint8)
        for batch in sliced(batches, 1):
            ids, hashes = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _distinct_hashes(text.as_py(), least)
                ids.extend([doc_id] * len(own))
                hashes.extend(own)
            if hashes:
                bits = _bits(hashes, log_bits)
                hit = (packed[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8) & 1).all(1)
                where = np.flatnonzero(hit).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in where], pa.int64()), pa.array([hashes[i] for i in where], pa.binary())], ["doc_id", "key"])

    found = written(docs.select("doc_id", "q_text").mapInArrow(suspects, "doc_id long, key binary").where("doc_id IS NOT NULL"))
    confirmed = found.groupBy("key", "doc_id").agg(F.lit(1).alias("x")).groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= copies)
    confirmed = written(confirmed.select("key", "keeper"))  # so that the join's two sides are plain shuffles, which can be split
    lost = found.join(sized(confirmed, confirmed.count(), 48), "key").where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # as many as the document has lines at most


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, copies: int = 5, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with the lines that at least copies documents share taken out of text_col, and n_lines, n_dropped (long; q_ is put before a name that docs has, until it has none such).

    A line's key is the line without \\x20 and \\x09-\\x0D at its ends, A-Z lower-cased; keys of at
    least least code points count. Such a line stays only in the largest id that has it, there each
    time. A null or empty text is one empty line and comes out empty. Rows with a null id lose
    nothing and aren't counted; rows with equal ids are one document. All columns of docs stay.
    """
    count_names = [free_name(n, docs.columns) for n in ("n_lines", "n_dropped")]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("q_text"))
    lost = written(repeated_lines(slim, least, copies, most_bits))
    size = lost.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("keys")).first()
    rows = docs.select(F.col(id_col).cast("long").alias("q_id"), F.col(text_col).cast("binary").alias("q_text"), *(F.col(f"`{c}`").alias(f"q{i}_") for i, c in enumerate(docs.columns) if c != text_col))
    rows = rows.join(sized(lost.select(F.col("doc_id").alias("q_id"), "keys"), 1, 64 * size.rows + 32 * size["keys"]), "q_id", "left")
    others = [(f"q{i}_", c) for i, c in enumerate(docs.columns) if c != text_col]

    def drop(batches):
        import xxhash

        for batch in sliced(batches, 0):
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column("q_text"), batch.column("keys"), strict=True):
                text = text.as_py() or b""
                gone = set(keys.as_py() or ())
                total, dropped = text.count(b"\n") + 1, 0
                if gone:
                    out = {i for i, key in line_keys(text, least) if xxhash.xxh3_128_digest(key) in gone}
                    dropped = len(out)
                    text = b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in out)
                texts.append(text)
                n_lines.append(total)
                n_dropped.append(dropped)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *(batch.column(a) for a, _ in others)], ["q_text", "q_lines", "q_dropped", *(a for a, _ in others)])

    types = {f.name: f.dataType for f in docs.schema}
    schema = StructType([StructField("q_text", BinaryType()), StructField("q_lines", LongType()), StructField("q_dropped", LongType()), *(StructField(a, types[c]) for a, c in others)])
    out = rows.select("q_text", "keys", *(a for a, _ in others)).mapInArrow(drop, schema)
    back = {c: F.col(a).alias(c) for a, c in others} | {text_col: F.col("q_text").cast("string").alias(text_col)}
    return out.select(*(back[c] for c in docs.columns), F.col("q_lines").alias(count_names[0]), F.col("q_dropped").alias(count_names[1]))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL = {"op10_line_dedup": _SQL}
