"""Structure repair of conversations: the cheapest edits that make the roles alternate, least audit among ties.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials. Turns
may be kept (0), given another role (3), deleted (4, a must for blank and
repeated ones) or inserted empty (3); a cut-off turn that stays costs 3 more.

A cost DP over (turn, state of that pattern) leaves the arcs that lie on some
cheapest path. Nodes are ranked by the first 1, 2, 4, ... audit letters that
follow them (prefix doubling); each node takes its least arc by letter and rank
of what follows, and the path is read off through doubled pointers. No node
has two arcs of one letter, so the pointer of every length is unique.

Turns are put in order by one range sort, which a large conversation may span;
its rows are cut into blocks of 65 536 turns. Equal rows are counted before the
shuffle, first occurrences found on text digests and without the texts. Costs
pass from block to block through one task backwards, edits forwards: both are
sequential over a conversation, hold one block at a time and spill in the sort.

Defined results: null role or text is one space, null turns come first, a null
conversation id is one conversation; turns that tie are ordered by role and
text; equal rows lie together; an empty table gives no rows; other columns are
ignored; long texts are whole, only their digests are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import read
from newsquant.session import cut_lineage, ship_package

#: Turns of one block, as a power of two.
BLOCK_BITS = 16
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
LETTERS = "DIKR"
#: States of the pattern: nothing yet, after system, after user, after assistant; what comes next is a user or an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: State after keeping a turn of initial s, u, a or another, by the state before; -1 where that is not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Cost of what must still be inserted when no turn is left.
END = [0, 2 * INSERT, INSERT, 0]
TAIL = ["", "II", "I", ""]
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Code of a turn that must go; others are the initial, plus 4 where the text is cut off.
GONE = 8

INK = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?][\x20\x09-\x0D]*\z"


def ordered(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number `n`, numbered in order by `at`, landed in the shared folder."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = ["conv_id", "turn", "role", "text"]
    near = [F.substring(c, 1, 32) for c in ("role", "text")]  # Spark samples the range keys to the driver
    rows = rows.groupBy(*key).agg(F.count("*").alias("n")).repartitionByRange("conv_id", "turn", *near).sortWithinPartitions(*key)
    blank = ~F.col("text").rlike(INK)
    return cut_lineage(rows.select(*key, "n", blank.alias("blank"), (~blank & ~F.col("text").rlike(CLOSED)).alias("cut"),
                                   F.monotonically_increasing_id().alias("at")))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, block, codes): one letter a turn, blocks of a conversation in order."""
    marks = rows.select("conv_id", "at", "role", F.sha2("text", 256).alias("digest"), "blank", "cut")
    first = marks.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first")).withColumnsRenamed(
        {"conv_id": "conv_", "role": "role_", "digest": "digest_"})
    same = F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.col("cut"), 4).otherwise(0)
    code = F.when(F.col("blank") | (F.col("at") > F.col("first")), F.lit(GONE)).otherwise(code)
    listed = marks.join(first, same).select("conv_id", "at", F.shiftright("at", BLOCK_BITS).alias("block"), code.cast("string").alias("code"))
    per_block = listed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("a"))
    return per_block.select("conv_id", "block", F.array_join("a.code", "").alias("codes"))


def costs(codes: list[int], beyond: list[int]) -> np.ndarray:
    """Least cost from (turn, state) to the end, for every turn of a block and what follows it."""
    out = [beyond]
    for code in reversed(codes):
        after = out[-1]
        c = [DELETE + x for x in after]
        if code != GONE:
            extra = CUT if code >= 4 else 0
            for s in range(4):
                c[s] = min(c[s], REROLE + extra + after[NEXT[s]])
                if (to := KEPT[s][code & 3]) >= 0:
                    c[s] = min(c[s], KEEP + extra + after[to])
        c[USER], c[ASSISTANT] = min(c[USER], INSERT + c[ASSISTANT]), min(c[ASSISTANT], INSERT + c[USER])
        c[START], c[SYSTEM] = min(c[START], INSERT + c[USER]), min(c[SYSTEM], INSERT + c[USER])
        out.append(c)
    return np.array(out[::-1], dtype=np.int64)


def cheapest_arcs(codes: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Targets by (node, letter) of the arcs on cheapest paths, -1 for none; node = 4 * turn + state."""
    m = len(codes)
    here, there = 4 * np.arange(m)[:, None], 4 * np.arange(1, m + 1)[:, None]
    state = np.arange(4)[None, :]
    extra = np.where((codes >= 4) & (codes != GONE), CUT, 0)[:, None]
    stays = (codes != GONE)[:, None]
    kept = KEPT.T[codes & 3]
    now, after = cost[:-1], cost[1:]
    to = np.full((m, 4, 4), -1, dtype=np.int64)
    for letter, target, fits in (
        (0, there + state, now == DELETE + after),
        (1, here + NEXT, now == INSERT + now[:, NEXT]),
        (2, there + kept, stays & (kept >= 0) & (now == KEEP + extra + np.take_along_axis(after, np.maximum(kept, 0), 1))),
        (3, there + NEXT, stays & (now == REROLE + extra + after[:, NEXT])),
    ):
        to[:, :, letter] = np.where(fits, target, -1)
    return to.reshape(4 * m, 4)


def least_paths(codes: list[int], beyond: list[int]) -> tuple[list[str], list[int], list[int]]:
    """Audit letters and state at the end for each state at the start of a block, and the costs from there."""
    cost = costs(codes, beyond)
    to = cheapest_arcs(np.array(codes), cost)
    inner, leave = len(to), np.arange(4)
    exits = inner + leave
    size = inner + 4
    rank = np.concatenate([(to >= 0).argmax(1) + 1, np.zeros(4, np.int64)])
    hop = np.concatenate([to[np.arange(inner), rank[:inner] - 1], exits])
    while (hop < inner).any():  # ranks by 1, 2, 4, ... letters
        rank = np.unique(rank * (size + 1) + rank[hop], return_inverse=True)[1]
        hop = hop[hop]
    order = np.where(to >= 0, np.arange(4) * (size + 1) + rank[to], 4 * (size + 1))
    letter = order.argmin(1)
    hop = np.concatenate([to[np.arange(inner), letter], exits])
    letter = np.concatenate([letter, np.full(4, -1)])
    path = leave[:, None]
    while (path[:, -1] < inner).any():
        path = np.concatenate([path, hop[path]], axis=1)
        hop = hop[hop]
    names = np.frombuffer(LETTERS.encode(), np.uint8)
    audits = [names[a[a >= 0]].tobytes().decode() for a in letter[path]]
    return audits, (path[:, -1] - inner).tolist(), cost[0].tolist()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation, last first: the audits and ends of each by the state at its start."""
    conv, beyond, begun = None, END, False
    for b in batches:
        audits, ends = [], []
        for c, codes in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not begun or c != conv:
                conv, beyond, begun = c, END, True
            audit, end, beyond = least_paths([ord(x) - 48 for x in codes], beyond)
            audits.append(audit)
            ends.append(end)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))],
                                         ["conv_id", "block", "codes", "audits", "ends"])


_EDIT = ["conv_id", "place", "turn", "was", "fault", "edit", "role", "text"]
EDITS = "conv_id {}, place bigint, turn {}, was string, fault string, edit string, role string, text string"


class _Conversation:
    """Follows one conversation forwards: which block's audit holds, and the state of the pattern."""

    def __init__(self, conv):
        self.conv, self.state, self.end, self.place = conv, START, START, 0

    def block(self, codes: str, audits: list[str], ends: list[int]) -> None:
        self.codes, self.letters, self.state = iter(codes), iter(audits[self.end]), self.end
        self.end = ends[self.end]

    def _row(self, turn, was, fault, edit, role, text):
        self.place += 1
        return self.conv, self.place - 1, turn, was, fault, edit, role, text

    def insert(self):
        self.state = int(NEXT[self.state])
        return self._row(None, None, None, "I", ROLE[self.state], "")

    def turn(self, turn, role, text, n, blank) -> Iterator[tuple]:
        code = int(next(self.codes))
        fault = "blank" if blank else "duplicate" if code == GONE else "truncated" if code >= 4 else None
        while (letter := next(self.letters)) == "I":
            yield self.insert()
        new = None
        if letter == "K":
            self.state, new = int(KEPT[self.state][code & 3]), role
        elif letter == "R":
            self.state = int(NEXT[self.state])
            new = ROLE[self.state]
        yield self._row(turn, role, fault, letter, new, text)
        for _ in range(n - 1):
            yield self._row(turn, role, "blank" if blank else "duplicate", "D", None, text)

    def close(self) -> Iterator[tuple]:
        for _ in TAIL[self.end]:
            yield self.insert()


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order from each conversation's blocks and turns, sorted together."""
    now, types = None, None

    def rows() -> Iterator[tuple]:
        nonlocal now, types
        for b in batches:
            types = types or [b.schema.field(0).type, pa.int64(), b.schema.field(1).type, *[pa.string()] * 5]
            for conv, turn, role, text, n, blank, codes, audits, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        yield from now.close()
                    now = _Conversation(conv)
                if codes is not None:
                    now.block(codes, audits, ends)
                else:
                    yield from now.turn(turn, role, text, n, blank)
        if now is not None:
            yield from now.close()

    done, size = [], 0
    for row in rows():
        done.append(row)
        size += len(row[-1])
        if len(done) == 4096 or size > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], _EDIT)
            done, size = [], 0
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], _EDIT)


def repair(turns: DataFrame) -> DataFrame:
    """One row per edit of each conversation's (conv_id, turn, role, text) rows.

    `edit` is the initial of Keep, Rerole, Delete or Insert, `was` the role
    before (null if inserted), `role` the one after (null if deleted), `fault`
    blank, duplicate, truncated or null. The rows of a conversation lie in one
    partition in the order of `place`; those with a role are the repaired one.
    """
    ship_package(turns.sparkSession)
    rows = ordered(turns)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    solved = coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(
        _solve, f"conv_id {kind['conv_id']}, block bigint, codes string, audits array<string>, ends array<int>")
    heads = solved.withColumn("at", F.shiftleft("block", BLOCK_BITS)).drop("block")
    mixed = rows.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    mixed = mixed.sortWithinPartitions("conv_id", "at", F.col("codes").isNull())
    return mixed.select("conv_id", "turn", "role", "text", "n", "blank", "codes", "audits", "ends").mapInArrow(
        _edits, EDITS.format(kind["conv_id"], kind["turn"]))


def damaged(turns: DataFrame) -> DataFrame:
    """The query's damage, by the checksum of `conv_id:turn`: rows dropped, emptied, cut off, repeated or made user turns."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = turns.filter(way != 0).select("conv_id", "turn", F.when(way == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                                         F.explode(F.array_repeat(F.lit(0), F.when(way == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


class _Digest:
    def __init__(self, conv):
        self.conv, self.sum, self.first = conv, hashlib.sha256(), True
        self.low = self.high = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(["blank", "duplicate", "truncated"], 0)
        self.audit = []

    def add(self, turn, was, fault, edit, role, text) -> None:
        self.audit.append(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (CUT if fault == "truncated" and edit != "D" else 0)
        if role is not None:
            self.sum.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False
        if was is None:
            return
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = was[:1]

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sum.hexdigest()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, types = None, None
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    for b in batches:
        types = types or [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
        done = []
        for conv, _, *edit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(*edit)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), types, strict=True)], names)


def repair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    digests = repair(damaged(turns)).mapInArrow(_digests, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")
    every = turns.select(F.col("conv_id").alias("conv_")).distinct()
    out = every.join(digests, F.col("conv_").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("conv_").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
