"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word and pieces
that go on with one. Where a match can't go on, a node's failure link leads to
the node of what is left after popping the longest pieces, and the number of
pieces popped is stored with it, so a word is read once, character by
character, and no piece is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, read_file, remembered, sliced, table, vocabulary

#: Added to a word's count if the word can't be spelt in the vocabulary.
UNKNOWN = 1 << 40


class Automaton:
    """Greedy word-piece counts. starts: pieces at a word's beginning; goes_on: pieces after it (without a mark)."""

    def __init__(self, starts, goes_on):
        self.goto: dict[int, int] = {}
        depth, chars, parents, self.final = [0, 0], [0, 0], [-1, -1], [False, False]
        for root, pieces in ((0, starts), (1, goes_on)):
            for piece in pieces:
                node = root
                for c in map(ord, piece):
                    key = node << 21 | c
                    nxt = self.goto.get(key)
                    if nxt is None:
                        nxt = self.goto[key] = len(depth)
                        depth.append(depth[node] + 1)
                        chars.append(c)
                        parents.append(node)
                        self.final.append(False)
                    node = nxt
                if node > 1:
                    self.final[node] = True
        self.fail, self.pops = [-1] * len(depth), [0] * len(depth)
        for v in sorted(range(2, len(depth)), key=depth.__getitem__):
            if self.final[v]:
                self.fail[v], self.pops[v] = 1, 1
                continue
            z, popped = self.fail[parents[v]], self.pops[parents[v]]
            while z >= 0 and (z << 21 | chars[v]) not in self.goto:
                popped += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.goto[z << 21 | chars[v]], popped

    def count(self, word: str) -> int:
        """Pieces of a word; 1 + UNKNOWN if it can't be spelt."""
        goto, fail, pops, u, n = self.goto, self.fail, self.pops, 0, 0
        for c in map(ord, word):
            while (v := goto.get(u << 21 | c)) is None:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return 1 + UNKNOWN
            u = v
        while u != 1:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return 1 + UNKNOWN
        return n


def load_pieces(model: bytes) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece model: those with its word mark begin words, the others go on with them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in ids]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 1 << 18) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_tokens, n_unknown (long).

    Words are runs of characters other than \\x20 and \\x09-\\x0D. A word that
    the vocabulary can't spell counts as one token and in n_unknown. Null or
    empty texts have zeros; a null id stays null; repeated rows are counted
    each; other columns of docs are ignored. limit: words, of up to 64 bytes, whose
    counts a Python worker remembers.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_file(model_path or vocabulary("piece_bpe_32k.model")))

    def run(batches):
        import hashlib

        import pyarrow as pa

        def make():
            automaton = Automaton(*load_pieces(model.value))
            return Memo(lambda w: automaton.count(w.decode("utf-8", "replace")), limit)

        memo = remembered("token_counts", hashlib.md5(model.value).digest(), make)
        get = memo.__getitem__
        for batch in sliced(batches, 1):
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                total = sum(map(get, words))
                n_words.append(len(words))
                n_tokens.append(total & UNKNOWN - 1)
                n_unknown.append(total >> 40)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], ["id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
