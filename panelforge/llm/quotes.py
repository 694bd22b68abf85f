"""Reply threads from quotations: nested quotes are parsed, quoted passages linked to the messages that wrote them, quotes dropped.

A line's level is the number of leading `>` (spaces between are allowed). A passage is a run of non-blank lines of one level;
normalised, it has single spaces and no case. Each message offers its own passages and lines (level 0) and its whole own text. A
quoted passage, or a line of one, is linked, within its conversation, to the nearest earlier message that offers it. The reply goes
to the message of the quote with the least level; there a whole passage goes before a line, and the latest message before others.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import materialize, ship

QUOTE = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
WROTE = re.compile(r"\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.IGNORECASE)


def level_of(line: str) -> tuple[int, str]:
    """(quote level, the line without its marks)."""
    m = QUOTE.match(line)
    return (m[1].count(">"), line[m.end() :]) if m else (0, line)


def normal(text: str) -> str:
    return " ".join(text.split()).casefold()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, passages as (level, text)); a line that introduces a quote ("... wrote:") is not own text."""
    lines = [level_of(x) for x in re.split(r"\r\n|\r|\n", text or "")]
    own, passages, run, at = [], [], [], 0
    for i, (level, line) in enumerate(lines):
        if level == 0:
            follows = next((lines[j][0] for j in range(i + 1, min(i + 3, len(lines))) if lines[j][0] or lines[j][1].strip()), 0)
            if follows and WROTE.search(line):
                line = ""
            own.append(line)
        if level != at or not line.strip():
            if run:
                passages.append((at, "\n".join(run)))
            run, at = [], level
        if line.strip():
            run.append(line)
    if run:
        passages.append((at, "\n".join(run)))
    return "\n".join(own).strip(), passages


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def messages(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, own_text, n_quotes, and passages (level, whether a whole one, digest)."""

    def read(batches):
        for batch in batches:
            own, quotes, found = [], [], []
            for text in batch.column("text").to_pylist():
                body, passages = parse(text)
                own.append(body)
                quotes.append(sum(n > 0 for n, _ in passages))
                keys = {(n, part is p, digest(normal(part))) for n, p in passages for part in (p, *(p.split("\n") if "\n" in p else ()))}
                if body:
                    keys.add((0, True, digest(normal(body))))
                found.append([{"level": n, "whole": w, "key": k} for n, w, k in sorted(keys)])
            kind = pa.list_(pa.struct([("level", pa.int32()), ("whole", pa.bool_()), ("key", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(own, pa.string()), pa.array(quotes, pa.int64()), pa.array(found, kind)], names=["conv_id", "turn", "role", "own_text", "n_quotes", "passages"])

    named = {"conv_id": (conv_col, "long"), "turn": (turn_col, "long"), "role": (role_col, "string"), "text": (text_col, "string")}
    source = conversations.select(*(F.col(c).cast(t).alias(n) for n, (c, t) in named.items()))
    return source.mapInArrow(read, "conv_id long, turn long, role string, own_text string, n_quotes long, passages array<struct<level:int,whole:boolean,key:binary>>")


def nearest(asked: DataFrame, offered: DataFrame, span: int = 4096) -> DataFrame:
    """asked (conv_id, key, turn, ...) with origin: the last turn before it at which the key is offered, or null.

    Both sides are dealt by blocks of `span` turns, so a key that very many messages of one conversation share is not one
    task's; what earlier blocks offer comes from one row a block.
    """
    deal = lambda df: df.withColumn("block", F.shiftright("turn", span.bit_length() - 1))
    both = deal(asked).withColumn("offer", F.lit(None).cast("long")).unionByName(deal(offered).withColumn("offer", F.col("turn")), allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("inner", F.max("offer").over(earlier)).where("offer is null")
    last = deal(offered).groupBy("conv_id", "key", "block").agg(F.max("turn").alias("outer"))
    blocks = deal(asked).select("conv_id", "key", "block").unionByName(last.select("conv_id", "key", "block")).distinct().join(last, ["conv_id", "key", "block"], "left")
    before = Window.partitionBy("conv_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("outer", F.max("outer").over(before))
    return within.join(blocks, ["conv_id", "key", "block"]).withColumn("origin", F.coalesce("inner", "outer")).drop("block", "offer", "inner", "outer")


def replies(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): links by passage. Only passages that someone quotes are looked up."""
    flat = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.whole", "p.key")
    quoted = flat.where("level > 0").distinct()
    offered = flat.where("level = 0").select("conv_id", "key", "turn").distinct().join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    met = nearest(quoted, offered).where("origin is not null")
    return met.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "whole", "origin")).alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, root_turn, depth) by pointer doubling: rounds grow with the logarithm of the deepest thread."""
    state = materialize(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        if not state.join(up, ["conv_id", "root_turn"], "left_semi").limit(1).count():
            return state
        state = state.join(up, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", "reply_to", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        state = materialize(state, "threads")


def conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, reply_to, root_turn, depth, n_quotes and own_text of each row, to be read in order of (conv_id, root_turn, turn).

    Replies follow the root of their thread, and no message comes before the one it answers. A message without a linked quote
    starts a thread (reply_to null, root_turn its turn, depth 0). Rows without a conversation or turn link with nothing. Null
    texts are empty. Rows that repeat a (conversation, turn) share its links. Extra columns are ignored. An empty table gives
    an empty result.
    """
    ship(table.sparkSession)
    parsed = materialize(messages(table, conv_col, turn_col, role_col, text_col), "messages")
    linked = threads(replies(parsed))
    out = parsed.join(linked, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", "own_text")
