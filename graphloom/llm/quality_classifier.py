"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Each word slot has a sparse random index vector. A first pass over all documents
adds to each slot's context vector the index vectors of its neighbours, in
integers, so sums don't depend on their order. A second pass pools the context
vectors of a document's words, next to their own index vectors. A two-layer network
in numpy learns from labelled documents that aren't held out; a temperature fitted
on a part of these that it did not learn from calibrates its probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, merged, remembered, sized, sliced, table, written

#: Word slots (words share them by hash; the sums of all of them are sent), dimensions, neighbours on each side, index vectors' entries.
SLOTS, DIMS, WINDOW, ENTRIES = 1 << 16, 32, 2, 4
#: Slots whose partial sums travel together.
CHUNK = 1 << 12
#: Labelled documents to learn from at most: those with the smallest hashes of their ids.
MOST_LABELLED = 40_000
#: A label's document id has a hash of so many values.
HASHES = 1 << 30


def index_vectors():
    """The slots' index vectors: ENTRIES entries of +1 or -1 each (int64)."""
    import numpy as np

    rng = np.random.default_rng(20_240_229)
    at = rng.permuted(np.tile(np.arange(DIMS), (SLOTS, 1)), axis=1)[:, :ENTRIES]
    out = np.zeros((SLOTS, DIMS), np.int64)
    np.put_along_axis(out, at, rng.choice([-1, 1], (SLOTS, ENTRIES)), 1)
    return out


def _slot_of():
    import xxhash

    return remembered("word_slot", SLOTS, lambda: Memo(lambda w: xxhash.xxh3_64_intdigest(w) % SLOTS, 1 << 17)).__getitem__


def context_vectors(texts: DataFrame):
    """Summed neighbours' index vectors of each slot over all rows of texts (text binary), as an int64 array."""

    def partial(batches):
        import numpy as np
        from pyspark import TaskContext

        slot_of = _slot_of()
        index, total = index_vectors(), np.zeros((SLOTS, DIMS), np.int64)
        where = np.array([np.flatnonzero(v) for v in index])
        signs = np.take_along_axis(index, where, 1)
        for batch in sliced(batches, 0, 8 << 20):
            flat, ends = [], []
            for text in batch.column(0):
                flat.extend(map(slot_of, (text.as_py() or b"").split()))
                ends.append(len(flat))
            if not flat:
                continue
            used, slots = np.unique(np.array(flat, np.int64), return_inverse=True)
            found, at, sign = np.zeros(len(used) * DIMS), where[used], signs[used]
            text_of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
            for d in range(1, WINDOW + 1):
                same = text_of[d:] == text_of[:-d]
                left, right = slots[:-d][same], slots[d:][same]
                for word, near in ((left, right), (right, left)):
                    for e in range(ENTRIES):
                        found += np.bincount(word * DIMS + at[near, e], weights=sign[near, e], minlength=len(found))
            total[used] += found.astype(np.int64).reshape(-1, DIMS)
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        for chunk in range(0, SLOTS, CHUNK):
            if total[chunk : chunk + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), part, pa.array([zlib.compress(total[chunk : chunk + CHUNK].tobytes(), 1)], pa.binary())], ["chunk", "part", "sums"])

    def merge(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(CHUNK * DIMS, np.int64)
        for batch in batches:
            for sums in batch.column("sums"):
                total += np.frombuffer(zlib.decompress(sums.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in keys] + [pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "part", "sums"])

    import numpy as np

    schema = "chunk int, part int, sums binary"
    total = np.zeros((SLOTS, DIMS), np.int64)
    for row in merged(texts.mapInArrow(partial, schema), merge, schema).collect():  # SLOTS * DIMS integers together
        total[row.chunk : row.chunk + CHUNK] = np.frombuffer(zlib.decompress(row.sums), np.int64).reshape(CHUNK, DIMS)
    return total


def word_vectors(contexts):
    """Unit context vectors, a word's index vector beside them (float32)."""
    import numpy as np

    norm = np.sqrt((contexts.astype(np.float64) ** 2).sum(1, keepdims=True))
    own = index_vectors() / np.sqrt(ENTRIES)
    return np.hstack([contexts / np.maximum(norm, 1.0), own]).astype(np.float32)


def pooled(texts, vectors):
    """A row of features (float32) of each text (bytes or None): mean of its words' vectors, root mean square of each dimension, log of 1 + words."""
    import numpy as np

    slot_of, out = _slot_of(), []
    for text in texts:
        slots = list(map(slot_of, (text or b"").split()))
        used, counts = np.unique(np.array(slots, np.int64), return_counts=True)
        found = vectors[used]
        weights = counts.astype(np.float32) / max(1, len(slots))
        out.append(np.concatenate([weights @ found, np.sqrt(weights @ (found * found)), [np.float32(np.log1p(len(slots)))]]))
    return np.array(out, np.float32).reshape(-1, 2 * vectors.shape[1] + 1)


def learned_rows(rows: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """doc_id, text, quality of the labelled rows to learn from: all, or hardly more than the most_labelled with the smallest hashes.

    Held-out rows and contradictory labels are left out; rows with one id come each.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("told"), "quality").where("told IS NOT NULL AND quality IN (0, 1)")
    told = told.groupBy("told").agg(F.min("quality").alias("quality"), F.max("quality").alias("hi")).where("quality = hi").where(~held_out(F.col("told"))).select("told", "quality")
    told = written(told.join(rows.select(F.col("doc_id").alias("told")), "told", "left_semi"))
    n = told.count()
    if n > most_labelled:
        share = (most_labelled + 10 * most_labelled**0.5 + 10) / n
        told = told.where(id_hash(F.col("told")) < int(share * HASHES))
        n = int(share * n)
    return rows.join(sized(told, n, 24), F.col("doc_id") == F.col("told")).select("doc_id", "text", "quality")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def id_hash(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(HASHES))


class Network:
    """A hidden layer of tanh units and a logistic output, over standardised features."""

    def __init__(self, hidden: int = 24, rounds: int = 300, seed: int = 7):
        self.hidden, self.rounds, self.seed, self.temperature = hidden, rounds, seed, 1.0

    def fit(self, x, y):
        """Learns by full-batch Adam on three quarters of the rows; the temperature is fitted on the rest."""
        import numpy as np

        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        held = rng.random(len(y)) < 0.25
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            held[:] = False
        fit_x, fit_y = x[~held], y[~held]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for t in range(1, self.rounds + 1):
            a = np.tanh(fit_x @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -40, 40))) - fit_y) / len(fit_y)
            back = np.outer(error, w[2]) * (1 - a * a)
            grads = [fit_x.T @ back + 1e-4 * w[0], back.sum(0), a.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
            for p, g, mm, vv in zip(w, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= 0.02 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        if held.any():
            z, target = self._logits(x[held]), y[held]
            loss = lambda s: np.mean(np.logaddexp(0, z / s) - target * z / s)
            self.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(16), 200)), key=loss))
        return self

    def _logits(self, x):
        import numpy as np

        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def score(self, x):
        import numpy as np

        z = self._logits(np.clip((x - self.mean) / self.scale, -8, 8)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Constant:
    """Stands in where the labels to learn from are of one kind or none."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x):
        import numpy as np

        return np.full(len(x), self.value)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row per row of docs: id_col, held_out boolean, score double, predicted int (score >= 0.5).

    labels: doc_id, quality (1: good, 0: not). Rows with crc32(id as text) mod 3 = 1 are held out and
    never learned from; contradictory labels aren't either. Scores come from the text alone. A null or
    empty text has the score of a document without words; a null id counts as not held out and isn't
    learned from; without labels of both kinds the score is the mean label, or 0.5. Repeated rows are
    scored each; of rows with one id that is labelled, one is learned from. An empty table gives no rows.
    Other columns are ignored. Texts are read three times: for the sums, the labelled ones, the scores.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(context_vectors(rows.select("text"))))  # SLOTS * 2 * DIMS floats

    def featured(batches):
        for batch in sliced(batches, 1):
            x = pooled((t.as_py() for t in batch.column(1)), vectors.value)
            lists = pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], ["doc_id", "features", "quality"])

    known = learned_rows(rows, labels, most_labelled).select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    known = known.mapInArrow(featured, "doc_id long, features array<float>, quality int")
    known = known.groupBy("doc_id").agg(F.min("features").alias("features"), F.first("quality").alias("quality"))
    sample = known.orderBy(id_hash(F.col("doc_id")), "doc_id").limit(most_labelled).select("quality", "features").toArrow()
    import numpy as np

    y = sample["quality"].to_numpy().astype(np.float64)
    if len(set(y)) == 2:
        x = sample["features"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        model = Network().fit(x.astype(np.float64), y)
    else:
        model = Constant(float(y.mean()) if len(y) else 0.5)

    def score(batches):
        for batch in sliced(batches, 1):
            s = model.score(pooled((t.as_py() for t in batch.column(1)), vectors.value).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    out = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("doc_id", id_col)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
