"""Token ids in Arrow files of equal-length sequences.

Each shard is an Arrow file whose batches hold two fixed-size lists per row: the
ids of one sequence and the mask (a byte each) of those that are not padding. Masks
are alike but for the last, so their lists are dictionary values. All rows have the
same size, so a sequence's place follows from its number, and a memory-mapped file
is read without copying. A second file per shard lists its documents: id, place of
its first token in the shard, number of tokens. Shards follow each other in
ascending order of document ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, read_file, remembered, shared_dir, sliced, table, vocabulary

LENGTH, BATCH_ROWS = 2048, 64


def open_store(uri: str):
    """(file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _renamed(store, made: str, to: str) -> None:
    store.move(made, to)  # a task that runs twice leaves the same file


def id_type(vocabulary_size: int):
    import numpy as np

    return np.uint16 if vocabulary_size <= 1 << 16 else np.uint32


def write_shard(uri: str, name: str, docs, dtype, length: int = LENGTH, batch_rows: int = BATCH_ROWS) -> tuple[int, int]:
    """Writes name.arrow and name.docs.arrow from (doc_id, ids as a numpy array); (documents, ids) written.

    Holds one batch of sequences and the list of documents at a time.
    """
    import uuid

    import numpy as np
    import pyarrow as pa

    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}-{uuid.uuid4().hex}"
    mask = pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length))
    schema = pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), pa.field("mask", mask)], {"length": str(length)})
    full, ids, starts, sizes, held, total = length * batch_rows, [], [], [], [], 0
    waiting = 0

    def batch(flat):
        pad = -len(flat) % length
        rows = (len(flat) + pad) // length
        which, masks = np.zeros(rows, np.int8), np.ones(2 * length if pad else length, np.uint8)
        if pad:
            flat = np.concatenate([flat, np.zeros(pad, dtype)])
            masks[-pad:] = 0
            which[-1] = 1
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (flat, masks)]
        return pa.record_batch([lists[0], pa.DictionaryArray.from_arrays(pa.array(which), lists[1])], schema=schema)

    deltas = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)
    with store.open_output_stream(own) as out, pa.ipc.new_file(out, schema, options=deltas) as writer:
        for doc_id, tokens in docs:
            ids.append(doc_id)
            starts.append(total)
            sizes.append(len(tokens))
            total += len(tokens)
            held.append(tokens)
            waiting += len(tokens)
            if waiting >= full:
                flat = np.concatenate(held)
                for at in range(0, len(flat) - full + 1, full):
                    writer.write_batch(batch(flat[at : at + full]))
                held = [flat[len(flat) // full * full :]]
                waiting = len(held[0])
        if waiting:
            writer.write_batch(batch(np.concatenate(held)))
    listed = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
    with store.open_output_stream(f"{own}.docs") as out, pa.ipc.new_file(out, listed.schema) as writer:
        writer.write_table(listed)
    _renamed(store, f"{own}.docs", f"{path}/{name}.docs.arrow")
    _renamed(store, own, f"{path}/{name}.arrow")
    return len(ids), total


class Shard:
    """Random access to a written shard."""

    def __init__(self, uri: str, name: str):
        import pyarrow as pa
        from pyarrow import fs

        store, path = open_store(uri)
        opened = lambda p: pa.memory_map(p) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(p)
        self.file = pa.ipc.open_file(opened(f"{path}/{name}.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{path}/{name}.docs.arrow")).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.last = -1, None

    def __len__(self) -> int:
        k = self.file.num_record_batches
        return 0 if not k else (k - 1) * self.rows + self.file.get_batch(k - 1).num_rows

    def _ids(self, batch: int):
        if self.last[0] != batch:  # documents of one batch are read one after the other
            self.last = batch, self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.last[1]

    def sequence(self, i: int):
        """ids and mask (booleans) of the i-th sequence, both views of the file."""
        at = i % self.rows
        masks = self.file.get_batch(i // self.rows).column(1)
        mask = masks.dictionary.flatten().to_numpy(zero_copy_only=True).view(bool)
        which = masks.indices[at].as_py() * self.length
        return self._ids(i // self.rows)[at * self.length : (at + 1) * self.length], mask[which : which + self.length]

    def tokens(self, start: int, count: int):
        """The ids from the start-th on, as views one after the other."""
        full = self.rows * self.length
        while count > 0:
            part = self._ids(start // full)[start % full : start % full + count]
            yield part
            start += len(part)
            count -= len(part)


#: ASCII punctuation that may end a word, without the apostrophe that begins contractions.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Ids of a text's white-space separated words, as the tokenizer gives them for the whole text.

    The tokenizer drops white space, so words are encoded alone and remembered. It parts a letter or digit from
    punctuation after it, so a Latin letter or digit and the closing punctuation of its word are too
    (after others, as the dotted capital I, its normal form may end in a mark that goes with the punctuation); and it lower-cases, so an
    ASCII word has the ids of its lower-case form. Special tokens are cut out of the text as the tokenizer
    cuts them, before all else. Added tokens of other kinds reach beyond words: such a tokenizer gets whole texts.
    """

    def __init__(self, tokenizer_json: str, limit: int, end_id: int = 0):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(tokenizer_json)
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.plain = Tokenizer.from_str(tokenizer_json)  # for what is left between special tokens
        self.plain.encode_special_tokens = True
        added = parsed["added_tokens"]
        self.dtype = id_type(1 + max([end_id, *parsed["model"]["vocab"].values(), *(t["id"] for t in added)]))
        self.by_words = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
        self.special = {t["content"].encode(): self._packed([t["id"]]) for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")").split if added else lambda text: [text]
        self.memo = Memo(self._word, limit)

    def _packed(self, ids) -> bytes:
        import numpy as np

        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: bytes) -> bytes:
        if b"'" not in word:
            body = word.rstrip(TAIL)
            if body and len(body) < len(word) and (last := body.decode("utf-8", "replace")[-1]).isalnum() and last < "\u0250" and last != "\u0130":
                return self.memo[body] + self.memo[word[len(body) :]]
            low = word.lower() if word.isascii() else word
            if low != word:
                return self.memo[low]
        return self._packed(self.plain.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        """The ids of text, as bytes of dtype."""
        if not self.by_words:
            return self._packed(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        get = self.memo.__getitem__
        if not any(token in text for token in self.special):
            return b"".join(map(get, text.split()))
        parts = self.cut(text)
        return b"".join(self.special[part] if k % 2 else b"".join(map(get, part.split())) for k, part in enumerate(parts))


def token_files(docs: DataFrame, uri: str, tokenizer_path: str | None = None, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", limit: int = 3 << 19) -> list[tuple[str, int, int]]:
    """Encodes docs and writes their ids in ascending order of id_col under uri; (shard, documents, ids) of each shard, in order.

    Each document ends with end_id; a null or empty text has that id only. Rows with equal ids come
    in the order of their texts' hashes; a null id comes first and is kept. Every shard starts a new
    sequence, its last one is padded. Other columns are ignored. limit: words, of up to 64 bytes, whose
    ids a Python worker remembers. The tokenizer must lower-case, drop white space and part
    letters from punctuation (checked against whole texts in tests).
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path or vocabulary("word_bpe_49k.json")))

    def write(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = remembered("token_files", (hashlib.md5(spec.value).digest(), limit, end_id), lambda: Encoder(spec.value.decode(), limit, end_id))
        dtype = encoder.dtype
        end = np.array([end_id], dtype).tobytes()

        def encoded():
            for batch in sliced(batches, 1):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc_id, np.frombuffer(encoder.encode(text.as_py() or b"") + end, dtype)

        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}"
        counts = write_shard(uri, name, encoded(), dtype, length)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, *counts)], ["shard", "docs", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    made = rows.mapInArrow(write, "shard string, docs long, ids long").collect()  # a row for each partition
    return sorted((r.shard, r.docs, r.ids) for r in made)


def read_digests(spark: SparkSession, uri: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document."""
    placed, before = [], 0
    for name, _, ids in shards:
        placed.append((name, before))
        before += ids

    def read(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(uri, name)
                for listed in shard.docs.to_batches(max_chunksize=10_000):
                    crcs = []
                    for start, n in zip(listed.column(1).to_pylist(), listed.column(2).to_pylist(), strict=True):
                        crc = 0
                        for part in shard.tokens(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array(listed.column(1).to_numpy() + np.int64(base))
                    yield pa.RecordBatch.from_arrays([listed.column(0), starts, listed.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(placed or [("", 0)], "shard string, base long").where("shard <> ''")
    return rows.repartition(max(1, len(placed))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark)
    return read_digests(spark, uri, token_files(table(spark, sf_dir, "documents"), uri))


QUERIES = {"op9_token_files": op9_token_files}
SQL: dict[str, str] = {}
