"""Conversations rebuilt from event logs, then rendered with a loss mask.

An event log has, per message, streamed deltas (text to append), edits (text
that replaces all so far) and regenerations (start afresh). Events are sorted
by sequence inside their message and folded: what counts is the text from the
last edit or regeneration on. Messages are rendered as marked turns in which
control strings of the texts are escaped reversibly.

Each message is folded on its own key. The rendered conversation is one text
and its digest one sequential fold, so all turns of one conversation meet in
one task; they are sorted by Spark (spilling) and streamed through in bounded
memory, whatever their number.

Defined results: null text is empty, null role the empty role; turns that tie
are ordered by role, text and then arrival; rows that repeat are turns of
their own; an empty log gives no rows; a conversation without id is one
conversation; events of unknown kind change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import let, read, text_of
from newsquant.session import ship_package

#: Marks around the text of a role; any other role uses [TURN name] ... [/TURN].
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[BOT] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
_CONTROL = "/?s>|/?INST\\]|/?SYS\\]|/?BOT\\]|/?TURN(?: [^\\]]*)?\\]"
_TURN = re.compile(
    r"\[(?:(?P<mark>INST|BOT|SYS)|TURN (?P<role>[^\]]*))\] (?P<text>.*?) (?:\[/(?:INST|SYS|TURN)\]|</s>)\n", re.S)
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_ROLE = {m[0][1:-2]: r for r, m in MARKS.items()}

CHUNK = 160
SUMMARY = ("conv_id {}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, message) from events (conv_id, turn, message, role, seq, kind, text)."""
    kept = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "turn", "message").agg(
        F.max("role").alias("role"), F.sort_array(F.collect_list(kept)).alias("log"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset"))
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"].isin("delta", "edit"), e["text"]).otherwise("")), "")
    return folded.select("conv_id", "turn", "role", text.alias("text"), "message")


def escape(text: Column) -> Column:
    """One backslash more after the first sign of every control string, so none is left as it is."""
    return F.regexp_replace(text, f"([<\\[])(\\\\*)(?={_CONTROL})", "$1\\\\$2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role_name(role: Column) -> Column:
    """Role names outside the template, safe inside the mark: % ] and line ends written as %25 %5D %0A."""
    for a, b in (("%", "%25"), ("]", "%5D"), ("\n", "%0A")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def render(messages: DataFrame) -> DataFrame:
    """Adds `segment`, the marked turn, and `mask_start`, `mask_chars`: the part under the loss mask (code points)."""
    role = F.coalesce("role", F.lit(""))
    begin = F.concat(F.lit("[TURN "), _role_name(role), F.lit("] "))
    end = F.lit(" [/TURN]")
    for r, (a, b) in MARKS.items():
        begin = F.when(role == r, F.lit(a)).otherwise(begin)
        end = F.when(role == r, F.lit(b)).otherwise(end)
    parts = F.struct(begin.alias("a"), escape(text_of("text")).alias("t"), end.alias("b"))
    return messages.withColumn("__p", parts).withColumns({
        "segment": F.concat("__p.a", "__p.t", "__p.b", F.lit("\n")),
        "mask_start": F.length("__p.a"),
        "mask_chars": F.when(role == "assistant", F.length("__p.t")).otherwise(F.lit(0)),
    }).drop("__p")


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted text; start and end of the escaped text in it."""
    for m in _TURN.finditer(formatted):
        role = _ROLE.get(m["mark"])
        if role is None:
            role = m["role"].replace("%0A", "\n").replace("%5D", "]").replace("%25", "%")
        yield role, unescape(m["text"]), m.start("text"), m.end("text")


class _Summary:
    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, chars: int) -> None:
        self.chars += len(segment)
        for role, text, _, _ in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if chars:
            text = unescape(segment[start:start + chars])
            self.loss += len(text)
            self.masked.update(text.encode())

    def row(self):
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, kind = None, None
    for b in batches:
        done, kind = [], b.schema.field(0).type
        for conv, segment, start, chars in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Summary(conv)
            now.add(segment, start, chars)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else None) for i, c in enumerate(zip(*done, strict=True))], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], kind if i == 0 else None) for i, c in enumerate(now.row())], names)


def summarise(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered turns."""
    ship_package(rendered.sparkSession)
    order = ["conv_id", "turn", "role", "text", "message"]
    rows = rendered.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segment", "mask_start", "mask_chars")
    return rows.mapInArrow(_summaries, SUMMARY.format(rendered.schema["conv_id"].dataType.simpleString()))


def event_log(turns: DataFrame) -> DataFrame:
    """A log that streams every turn in chunks; two thirds of the turns are first drafted wrong and then edited or regenerated."""
    text = text_of("text")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(CHUNK))
    chunks = F.transform(starts, lambda s: F.substring(text, s, F.lit(CHUNK)))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))

    def event(kind, chunk) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), chunk.alias("text"))

    def log(c: Column) -> Column:
        draft = F.array(event("delta", F.reverse(F.get(c, F.lit(0)))))
        plain = F.transform(c, lambda x: event("delta", x))
        edited = F.transform(c, lambda x, i: event(F.when(i == 0, "edit").otherwise("delta"), x))
        again = F.array(event("regenerate", F.lit("")))
        return F.when(way == 0, plain).when(way == 1, F.concat(draft, edited)).otherwise(F.concat(draft, again, plain))

    tagged = turns.withColumn("message", F.monotonically_increasing_id())
    rows = tagged.select("conv_id", "turn", "message", "role", F.posexplode(let(chunks, log)).alias("seq", "e"))
    return rows.select("conv_id", "turn", "message", "role", "seq", "e.kind", "e.text")


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return summarise(render(fold(event_log(turns.unionByName(extra)))))
