"""Chat formatting by quotation linking.

Messages quote earlier ones with '>' marks, nested by their number. Each message is
parsed into its own text and its quoted passages; normalised passages are hashed and
joined to the first message of the conversation that wrote them. A message replies to
the one it quotes at the lowest level. Following replies to their roots, by pointer
jumping, gives threads; ordered by conversation, root and turn, every reply comes
after what it answers, and no quoted line is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import sliced, table, written

#: Passages of fewer words link as a whole only, and after longer ones of their level.
LEAST_WORDS = 3


def parse_quotes(text: str) -> tuple[str, list[tuple[int, list[str]]], int]:
    """A message's own text, its quoted passages (level, lines) in order, and its quoted lines' number.

    A line that introduces a quotation ('... wrote:') goes with it. Own text loses blank lines at its
    ends if anything was taken out, and is otherwise as it was.
    """
    import re

    mark = re.compile(r"[ \t]*(>(?:[ \t]*>)*) ?")
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    quoted, last = 0, 0
    for line in text.split("\n"):
        m = mark.match(line)
        if not m:
            own.append(line)
            last = 0
            continue
        level = m[1].count(">")
        if not last and own and re.search(r"\bwrote:[ \t\r]*$", own[-1]):
            own.pop()
        if level != last:
            passages.append((level, []))
        passages[-1][1].append(line[m.end() :])
        quoted, last = quoted + 1, level
    if not quoted:
        return text, [], 0
    while own and not own[0].strip():
        own.pop(0)
    while own and not own[-1].strip():
        own.pop()
    return "\n".join(own), passages, quoted


def passage_key(text: str, least: int = 1) -> bytes | None:
    """Hash of a passage, blind to case (A-Z) and white space; None if it has fewer than least words."""
    import hashlib

    words = text.encode().lower().split()
    return hashlib.md5(b" ".join(words)).digest() if len(words) >= least else None


def own_keys(text: str) -> set[bytes]:
    """Keys under which a message can be quoted: the whole, each paragraph, each line."""
    import re

    parts = [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")]
    return {k for k in map(passage_key, parts) if k}


def quoted_keys(passages: list[tuple[int, list[str]]]) -> set[tuple[int, int, bytes]]:
    """(level, 0 for a whole passage, 1 for a line of it or 2 for a whole passage of few words, key).

    A line of few words inside a longer passage is no passage of its own and has no key.
    """
    found = set()
    for level, lines in passages:
        whole = "\n".join(lines)
        for kind, part in [(0, whole), *((1, x) for x in lines)]:
            if key := passage_key(part, LEAST_WORDS):
                found.add((level, kind, key))
        if not passage_key(whole, LEAST_WORDS) and (key := passage_key(whole)):
            found.add((level, 2, key))
    return found


def _parsed(messages: DataFrame, what: str) -> DataFrame:
    """messages (conv, turn, text): 'own' or 'quoted' keys as rows, or 'text' with each row's own text."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, 2):
            conv, turn, out = [], [], []
            for c, t, text in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True):
                own, passages, _ = parse_quotes(text or "")
                keys = own_keys(own) if what == "own" else quoted_keys(passages)
                conv.extend([c] * len(keys))
                turn.extend([t] * len(keys))
                out.extend(keys)
            if what == "own":
                columns, names = [pa.array(out, pa.binary())], ["key"]
            else:
                level, kind, key = zip(*out, strict=True) if out else ((), (), ())
                columns, names = [pa.array(level, pa.int32()), pa.array(kind, pa.int32()), pa.array(key, pa.binary())], ["level", "kind", "key"]
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), *columns], ["conv", "turn", *names])

    return messages.select("conv", "turn", "text").mapInArrow(run, "conv long, turn long, " + ("key binary" if what == "own" else "level int, kind int, key binary"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): the turn that each quoting message answers; messages: conv, turn long, text."""
    known = messages.where("conv IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    quoted = written(_parsed(known.where(F.contains("text", F.lit(">"))), "quoted"))
    asked = quoted.select("conv", "key").distinct()
    first = _parsed(known, "own").join(asked, ["conv", "key"], "left_semi").groupBy("conv", "key").agg(F.min("turn").alias("parent"))
    found = quoted.join(first, ["conv", "key"]).where("parent < turn")
    best = found.groupBy("conv", "turn").agg(F.min(F.struct("level", "kind", (-F.col("parent")).alias("back"))).alias("b"))
    return best.select("conv", "turn", (-F.col("b.back")).alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) of each message that replies: pointers double until all are at a root."""
    now = written(links.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        new = now.join(above, ["conv", "root"], "left")
        new = written(new.select("conv", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        now = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return now


def link_quotations(conversations: DataFrame) -> DataFrame:
    """One row per row of conversations: conv_id, turn, role, text without quotes, n_quoted_lines, parent_turn, root_turn, depth.

    parent_turn is null where nothing earlier in the conversation is quoted; root_turn is then the turn
    itself and depth 0. A passage belongs to the earliest turn that wrote it. Null texts become ''; a row
    with a null conversation or turn links nothing. Rows with one conversation and turn are one message
    for the links and stay apart in the result. Other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def clean(batches):
        import pyarrow as pa

        for batch in sliced(batches, 3):
            done = [parse_quotes(text or "") for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([d[0] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], ["conv", "turn", "role", "text", "n_quoted_lines"])

    own = rows.mapInArrow(clean, "conv long, turn long, role string, text string, n_quoted_lines long")
    linked = own.join(threads(reply_links(rows)), ["conv", "turn"], "left")
    return linked.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", "n_quoted_lines", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")
    )


def chat_segments(conversations: DataFrame) -> DataFrame:
    """link_quotations in reply order, each message with its segment of chat text.

    Rows are sorted over the whole table by conversation, root and turn; concatenated, the segments of a
    root are a conversation. No conversation is gathered into one task.
    """
    linked = link_quotations(conversations)
    segment = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    return linked.withColumn("segment", segment).orderBy("conv_id", "root_turn", "turn")


def _digests(conversations: DataFrame) -> DataFrame:
    rows = chat_segments(conversations)
    rows = rows.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1).cast("long")))
    return rows.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "n_quoted_lines", F.sha2("text", 256).alias("text_sha256"), F.sha2("segment", 256).alias("segment_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(table(spark, sf_dir, "conversations"))


def chat_formatting_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with every message quoting the two before it, one inside the other, where no message of the table quotes."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    for level in (1, 2):
        mark = "> " * level
        said = rows.select("conv_id", (F.col("turn") + level).alias("turn"), F.concat(F.lit(mark), F.replace("text", F.lit("\n"), F.lit("\n" + mark))).alias(f"said{level}"))
        rows = rows.join(said, ["conv_id", "turn"], "left")
    return _digests(rows.select("conv_id", "turn", "role", F.concat_ws("\n", "said2", "said1", "text").alias("text")))


_MARK = r"^[ \t]*>(?:[ \t]*>)* ?"
_WORDS = r"regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+')"
_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM MESSAGES),
l0 AS (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM m),
l1 AS (SELECT *, CASE WHEN regexp_matches(line, '{_MARK}') THEN length(regexp_replace(regexp_extract(line, '{_MARK}'), '[^>]', '', 'g')) ELSE 0 END AS level FROM l0),
l2 AS (SELECT *, level = 0 AND coalesce(lead(level) OVER w, 0) > 0 AND regexp_matches(line, '\bwrote:[ \t\r]*$') AS intro,
    i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS island FROM l1 WINDOW w AS (PARTITION BY r ORDER BY i)),
body AS (SELECT *, regexp_replace(line, '{_MARK}', '') AS said FROM l2 WHERE level > 0),
edge AS (SELECT r, min(i) FILTER (regexp_matches(line, '[^\s]')) AS lo, max(i) FILTER (regexp_matches(line, '[^\s]')) AS hi FROM l2 WHERE level = 0 AND NOT intro GROUP BY r),
q AS (SELECT r, count(*)::BIGINT AS n FROM body GROUP BY r),
own AS (SELECT l2.r, string_agg(line, chr(10) ORDER BY i) AS text FROM l2 JOIN edge USING (r) JOIN q USING (r) WHERE level = 0 AND NOT intro AND i BETWEEN lo AND hi GROUP BY l2.r),
c AS (SELECT m.r, conv_id, turn, role, CASE WHEN q.n IS NULL THEN m.text ELSE coalesce(own.text, '') END AS text, coalesce(q.n, 0)::BIGINT AS n_quoted_lines FROM m LEFT JOIN q USING (r) LEFT JOIN own USING (r)),
parts AS (SELECT conv_id, turn, text AS part FROM c UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM c UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM c),
first_ AS (SELECT conv_id, ws, min(turn) AS parent FROM (SELECT conv_id, turn, {_WORDS} AS ws FROM parts) WHERE len(ws) > 0 GROUP BY conv_id, ws),
said AS (SELECT conv_id, turn, level, 0 AS kind, string_agg(said, chr(10) ORDER BY i) AS part FROM body GROUP BY r, conv_id, turn, level, island UNION ALL SELECT conv_id, turn, level, 1, said FROM body),
found AS (SELECT s.conv_id, s.turn, s.level, CASE WHEN len(s.ws) >= {LEAST_WORDS} THEN s.kind ELSE 2 END AS kind, f.parent
    FROM (SELECT *, {_WORDS} AS ws FROM said) s JOIN first_ f ON s.conv_id = f.conv_id AND s.ws = f.ws WHERE f.parent < s.turn AND (len(s.ws) >= {LEAST_WORDS} OR s.kind = 0)),
link AS (SELECT conv_id, turn, parent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, kind, parent DESC) AS k FROM found) WHERE k = 1),
up AS (SELECT conv_id, turn, parent, parent AS root, 1 AS depth FROM link UNION ALL SELECT up.conv_id, up.turn, up.parent, link.parent, up.depth + 1 FROM up JOIN link ON link.conv_id = up.conv_id AND link.turn = up.root),
top AS (SELECT conv_id, turn, max(parent) AS parent, min(root) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, coalesce(top.parent, -1)::BIGINT AS parent_turn, coalesce(top.root, c.turn) AS root_turn, coalesce(top.depth, 0)::BIGINT AS depth, n_quoted_lines,
    sha256(c.text) AS text_sha256, sha256('<|' || coalesce(role, 'user') || '|>' || chr(10) || c.text || chr(10) || '<|end|>' || chr(10)) AS segment_sha256
FROM c LEFT JOIN top ON c.conv_id = top.conv_id AND c.turn = top.turn
"""

_QUOTED = """(SELECT c.conv_id, c.turn, c.role, concat_ws(chr(10), '> > ' || replace(b.text, chr(10), chr(10) || '> > '), '> ' || replace(a.text, chr(10), chr(10) || '> '), c.text) AS text
    FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2)"""

QUERIES = {"op8_chat_formatting": op8_chat_formatting, "chat_formatting_quoted": chat_formatting_quoted}
SQL = {"op8_chat_formatting": _SQL.replace("MESSAGES", "conversations"), "chat_formatting_quoted": _SQL.replace("MESSAGES", _QUOTED)}
