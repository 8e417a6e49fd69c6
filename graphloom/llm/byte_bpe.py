"""Byte-level BPE encoding and decoding with a rank queue.

Each match of the split pattern is encoded by itself. The queue holds, for each
merge rank, the linked-list positions whose pair has that rank; a hierarchical
bitmap over the ranks finds the lowest occupied one by find-first-set at each
level. Merges leave stale entries behind, which are skipped as they come up. A
pre-token of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, read_file, remembered, sliced, table, vocabulary

#: Bits of a bitmap word, as a power of two.
WORD = 6  # as in the shifts and masks of encode


class ByteBPE:
    """Ranks of byte strings, and encoding and decoding by them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values(), default=0) + 1
        self.bytes_of = [b""] * top
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        # the queue's bitmap: a bit for each rank, each word of those, each word of those words
        self.low, self.mid = [0] * ((top >> WORD) + 1), [0] * ((top >> 2 * WORD) + 1)

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, low, mid, high = ranks.get, self.low, self.mid, 0
        buckets: dict[int, list[int]] = {}
        n = len(piece)
        after, before, current = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        fresh = [(i, i + 2) for i in range(n - 1)]
        while True:
            for i, end in fresh:  # pairs that have come up, by where they begin and end
                r = rank_of(piece[i:end])
                if r is None:
                    current[i] = -1
                    continue
                current[i] = r
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [i]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (r >> 6 & 63)
                    high |= 1 << (r >> 12)
                else:
                    heappush(bucket, i)
            while high:
                a = (high & -high).bit_length() - 1
                word = mid[a]
                b = a << 6 | (word & -word).bit_length() - 1
                word = low[b]
                r = b << 6 | (word & -word).bit_length() - 1
                bucket = buckets[r]
                i = heappop(bucket)
                if not bucket:
                    del buckets[r]
                    low[b] = word = word & word - 1
                    if not word:
                        mid[a] = word = mid[a] & mid[a] - 1
                        if not word:
                            high &= high - 1
                if current[i] == r:  # else stale
                    break
            else:
                break
            j = after[i]
            k = after[i] = after[j]
            current[j] = current[i] = -1
            p = before[i]
            fresh = [(p, k)] if p >= 0 else []
            if k < n:
                before[k] = i
                fresh.append((i, after[k]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank on each line."""
    import base64

    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def split_pattern() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except ImportError:  # the same, as published with this vocabulary
        return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False, limit: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id_col, n_tokens long, ids_sha256, decoded_sha256, and with with_ids also ids array<int>.

    Whole texts are encoded without special tokens; a null or empty text has no ids. The ids are
    decoded again, and decoded_sha256 is of those bytes. Null ids stay null, repeated rows are
    encoded each, other columns of docs are ignored. limit: pre-tokens, of up to 64
    characters, whose ids a Python worker remembers.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_file(ranks_path or vocabulary("byte_bpe_50k.tiktoken")))
    pattern = pattern or split_pattern()

    def run(batches):
        import array
        import hashlib

        import pyarrow as pa
        import regex

        def make():
            bpe = ByteBPE(load_ranks(ranks.value))
            ids = Memo(lambda piece: array.array("I", bpe.encode(piece.encode())).tobytes(), limit)
            return bpe, ids, [str(i) for i in range(len(bpe.bytes_of))]

        bpe, memo, names = remembered("byte_bpe", (hashlib.md5(ranks.value).digest(), limit), make)
        pieces, ids_of, name = regex.compile(pattern).findall, memo.__getitem__, names.__getitem__
        for batch in sliced(batches, 1):
            counts, encoded, decoded, lists = [], [], [], []
            for text in batch.column(1):
                ids = array.array("I", b"".join(map(ids_of, pieces(text.as_py() or "")))).tolist()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)]
            names_ = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names_.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names_)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
SQL: dict[str, str] = {}
