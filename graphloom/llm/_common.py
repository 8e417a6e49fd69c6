"""Shared pieces of the training-data operators: shared-folder tables, text
splitting, word hashing and size-checked broadcasts."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of ASCII white space, as bytes.split() and bytes.strip() take them: \x20 and \x09-\x0D.
SPACE = "\x20\t\n\x0b\x0c\r"

#: Largest estimated size of anything sent to every executor.
BROADCAST_LIMIT = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A query's table."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared folder of the cluster (spark.checkpoint.dir).

    Where that setting is absent, a folder of this machine serves on a local master, as in tests; on any other it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _stash("scratch").setdefault("dir", None) or tempfile.mkdtemp(prefix="graphloom-")
        _stash("scratch")["dir"] = base
        base = f"file://{base}"
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df marked for broadcast if rows * row_bytes is within limit; beyond it df itself, and the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def _stash(name: str) -> dict:
    """A dict that outlives a task in its Python worker (functions are shipped by value, so module globals don't)."""
    return sys.__dict__.setdefault("_graphloom_stash", {}).setdefault(name, {})


#: Longer keys aren't remembered: they seldom come again, and a memo's bytes follow its number of entries.
LONGEST_KEY = 64


class Memo(dict):
    """Results of fn by argument (text or bytes of up to LONGEST_KEY), never None, for the arguments met most: of cap entries, those asked for since half as many came are kept."""

    def __init__(self, fn, cap: int = 1 << 20):
        super().__init__()
        self.fn, self.half, self.old = fn, cap // 2, {}

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.fn(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.fn(key)
        self.put(key, value)
        return value


def remembered(name: str, key, make):
    """make() once per Python worker and key. A worker keeps one value at all, so that it doesn't hold what an earlier operator remembered."""
    slot = _stash("remembered")
    if slot.get("key") != (name, key):
        slot.clear()
        slot["value"], slot["key"] = make(), (name, key)
    return slot["value"]


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """spark, which from now on hands Python workers rows rows at a time, if it had Spark's default: texts are long and memory is short.

    For queries and pipelines, which own their session. Operators leave it as it is and cut batches by bytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
    return spark


def free_name(wanted: str, taken) -> str:
    """wanted, with as many q_ before it as keep it apart from the names taken (Spark's names are blind to case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"q_{wanted}"
    return wanted


#: Partial results of a table that one merging task reads, for as many tasks as its cube; beyond that more.
MERGED_AT_ONCE = 64


def merged(parts: DataFrame, merge, schema: str) -> DataFrame:
    """parts (chunk int, part int: the task that made it, and others) merged by merge to one row per chunk, in rounds of groups."""
    for group in (F.col("part") / MERGED_AT_ONCE, F.col("part") / MERGED_AT_ONCE, F.lit(0)):
        parts = parts.withColumn("part", F.floor(group).cast("int")).groupBy("chunk", "part").applyInArrow(merge, schema)
    return parts


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def vocabulary(name: str) -> str:
    """Default place of a public tokenizer's file; every operator takes another path as a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def word_hashes():
    """Memo of the 64-bit hash of a word's bytes."""
    import xxhash

    return remembered("word_hash", 1, lambda: Memo(xxhash.xxh3_64_intdigest, 1 << 18))


def batch_words(texts):
    """Word hashes of all texts, one after the other, and where each text begins.

    texts: bytes or None. Words are runs of non-space bytes, A-Z lower-cased.
    """
    import numpy as np

    memo, flat, counts = word_hashes(), [], []
    get = memo.__getitem__
    for text in texts:
        words = text.lower().split() if text else ()
        flat.extend(map(get, words))
        counts.append(len(words))
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return np.array(flat, np.uint64), starts


def sliced(batches, column: int, most: int = 2 << 20):
    """The batches cut so that a slice's texts have about most bytes, or it is one row."""
    for batch in batches:
        begin = size = 0
        for i, text in enumerate(batch.column(column)):
            n = text.as_buffer().size if text.is_valid else 0
            if size and size + n > most:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if batch.num_rows > begin:
            yield batch.slice(begin)


def mixed(x):
    """64-bit finaliser (splitmix64) over a numpy array."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words, width: int):
    """Hashes of all width-word shingles of one text's word hashes, in text order; of a shorter text, the whole as one."""
    import numpy as np

    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    return out


def batch_shingles(words, starts, width: int):
    """Shingle hashes of all texts, one after the other, and where each text begins; as shingles() gives for each text."""
    import numpy as np

    n = np.diff(starts)
    if not (n >= width).any():
        parts = [shingles(words[a:b], width) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        sizes = [len(p) for p in parts]
        return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    sizes = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begins = np.zeros(len(n) + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    text = np.repeat(np.arange(len(n)), sizes)
    place = np.arange(begins[-1]) - begins[text] + starts[text]  # of a shingle's first word
    out = np.full(len(place), width, np.uint64)
    for j in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(place + j, len(words) - 1)])
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        out[begins[i]] = shingles(words[starts[i] : starts[i + 1]], width)[0]
    return out, begins
