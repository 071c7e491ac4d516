"""Conversation structure repair by Four-Russians block tables: cheapest edits that make roles alternate.

A conversation is a row of symbols: a message's role initial, and whether it is blank or repeated (it has to
go), truncated, or sound. Edits move through four states: nothing yet, a system message, a user's
turn, an assistant's turn. The costs from a place to the end, one for each state, less their smallest, make up one
of a few dozen vectors. What a message does to each vector is worked out once, and from that what each block of ``BLOCK``
messages does, for all symbols. A conversation is then read backward by one lookup a block; the vectors at the
blocks' ends are kept, and going forward a block is expanded backward from its end, so that among
edits of equal cost the smallest in ASCII order can be told.

Messages are dealt out by ranges of (conversation, turn) and sorted, so that a long conversation spans tasks and
lies in pieces of bounded size. A conversation inside one piece is done at once. Of the others
each piece gives the vector before it for every vector that may follow; these small rows meet by conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT is added where a truncated message stays
BLOCK = 3
INITIALS = "sua"
SYMBOLS = 9  # 0: has to go; 1 to 4: s, u, a, other; 5 to 8: the same, truncated
NEVER = 1 << 40
#: The state that a user's or an assistant's message leads to, and which of the two a state allows.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Costs at the end: a user's turn wants an answer, a system message alone wants both.
END = (0, 2 * INSERT, INSERT, 0)


def kept_state(state: int, symbol: int) -> int | None:
    """Where a message leads that stays as it is, if it may."""
    initial = (symbol - 1) % 4 if symbol else 3
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if initial < 3 and NEXT[state] == (USER, ASSISTANT)[initial - 1] else None


def closed(costs: list[int]) -> list[int]:
    """Costs when messages may be inserted first."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a message from those after it."""
    cut = CUT if symbol > 4 else 0
    costs = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if symbol:
            ways.append(REROLE + cut + after[NEXT[state]])
            if (to := kept_state(state, symbol)) is not None:
                ways.append(KEEP + cut + after[to])
        costs.append(min(ways))
    return tuple(min(c, NEVER) for c in closed(costs))


def lowered(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs less their smallest, and that; a state that can't reach the end stays at NEVER."""
    low = min(costs)
    return tuple(NEVER if c >= NEVER // 2 else c - low for c in costs), low


class Tables:
    """All vectors that occur, and the transitions of single messages and of blocks between them."""

    def __init__(self) -> None:
        unit = [tuple(0 if s == t else NEVER for s in range(4)) for t in range(4)]
        self.vectors = list(dict.fromkeys(lowered(tuple(closed(list(v))))[0] for v in [END, *unit]))
        self.ids = {v: i for i, v in enumerate(self.vectors)}
        to, cost = [], []
        for v in self.vectors:  # grows while it is read
            for symbol in range(SYMBOLS):
                low, by = lowered(before(symbol, v))
                if low not in self.ids:
                    self.ids[low] = len(self.vectors)
                    self.vectors.append(low)
                to.append(self.ids[low])
                cost.append(by)
        self.to, self.cost = (np.array(x, np.int64).reshape(-1, SYMBOLS) for x in (to, cost))
        # A block is a number in base SYMBOLS, its first message the highest digit; its last message comes first.
        block, by = self.to, self.cost
        for _ in range(BLOCK - 1):
            longer = self.to[block], by[:, :, None] + self.cost[block]
            block, by = (x.transpose(0, 2, 1).reshape(len(self.vectors), -1) for x in longer)
        self.block_to, self.block_cost = block.tolist(), by.tolist()
        self.end, self.units = self.ids[lowered(END)[0]], [self.ids[lowered(tuple(closed(list(u))))[0]] for u in unit]
        self.traced: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def backward(self, symbols: bytes, last: int) -> tuple[list[int], int, int]:
        """The vectors at the ends of all blocks (the first may be short), the vector in front, and the cost taken off."""
        ends, v, total = [last], last, 0
        head = len(symbols) % BLOCK
        for at in range(len(symbols) - BLOCK, head - 1, -BLOCK):
            code = number(symbols[at : at + BLOCK])
            v, total = self.block_to[v][code], total + self.block_cost[v][code]
            ends.append(v)
        for symbol in symbols[:head][::-1]:
            v, total = int(self.to[v][symbol]), total + int(self.cost[v][symbol])
        return ends[::-1], v, total

    def forward(self, symbols: bytes, last: int, state: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest edits, and the state they end in."""
        ends, _, _ = self.backward(symbols, last)
        head, out = len(symbols) % BLOCK, []
        cuts = [0, *range(head, len(symbols) + 1, BLOCK)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo < hi:
                key = (ends[k], number(symbols[lo:hi]), hi - lo, state)
                if key not in self.traced:
                    self.traced[key] = self.expanded(symbols[lo:hi], ends[k], state)
                edits, state = self.traced[key]
                out.append(edits)
        return "".join(out), state

    def expanded(self, symbols: bytes, last: int, state: int) -> tuple[str, int]:
        """One block's edits: its vectors, with their true differences, from its end; then choices from its start."""
        costs = [self.vectors[last]]
        for symbol in symbols[::-1]:
            costs.append(before(symbol, costs[-1]))
        costs.reverse()
        out = []
        for i, symbol in enumerate(symbols):
            here, after, cut = costs[i], costs[i + 1], CUT if symbol > 4 else 0
            while DELETE + after[state] != here[state]:
                to = kept_state(state, symbol) if symbol else None
                if INSERT + here[NEXT[state]] == here[state]:
                    out.append("I")
                    state = NEXT[state]
                    continue
                out.append("K" if to is not None and KEEP + cut + after[to] == here[state] else "R")
                state = to if out[-1] == "K" else NEXT[state]
                break
            else:
                out.append("D")
        return "".join(out), state


def number(symbols: bytes) -> int:
    code = 0
    for s in symbols:
        code = code * SYMBOLS + s
    return code


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """What is inserted after the last message."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


def repeats(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, key``: at which later turns a message of an earlier turn stands again.

    First turns are combined before they are shuffled, so a message found everywhere is no hot spot.
    """
    keys = rows.select("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("key"), F.struct("turn").alias("t"))
    first = keys.groupBy("conv_id", "role", "key").agg(F.min("t").alias("first"), F.max("t").alias("last")).filter("NOT (first <=> last)")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    later = keys.join(first, same).filter("NOT (t <=> first)")
    return later.select("conv_id", F.col("t.turn").alias("turn"), "role", "key").distinct()


def pieces(rows: DataFrame, *, most_rows: int, most_chars: int) -> DataFrame:
    """Conversations in order, in bounded pieces: ``conv_id, part, piece, whole``, counts, ends, ``symbols`` and ``messages``.

    ``whole``: the piece is all of its conversation. Of the conversations at the ends of a task's rows that isn't known.
    """
    fields = [rows.schema["conv_id"]]
    fields += [T.StructField(n, T.LongType()) for n in ("part", "piece", *COUNTS)]
    fields += [T.StructField("whole", T.BooleanType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]
    fields += [T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()), T.StructField("symbols", T.BinaryType()), T.StructField("messages", T.ArrayType(MESSAGE))]
    out = T.StructType(fields)
    conv_type = pa.int64() if isinstance(rows.schema["conv_id"].dataType, T.LongType) else pa.string()
    types = [conv_type, *[pa.int64()] * 8, pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]

    data = rows.select("conv_id", "turn", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("binary").alias("key"))
    marks = stored(repeats(rows), "repeats").select("conv_id", "turn", F.lit(0).alias("kind"), "role", F.lit(None).cast("string").alias("text"), "key")
    ordered = data.unionByName(marks).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "kind", "role", "text")

    def run(batches):
        from pyspark import TaskContext

        part, number_of = TaskContext.get().partitionId(), 0
        done, sealed, held = [], 0, None  # rows ready to go, their characters, the open piece

        def opened(conv) -> dict:
            return {"conv": conv, "symbols": bytearray(), "messages": [], "chars": 0, "initials": [None, None], "ends": [None, None], **dict.fromkeys(COUNTS, 0)}

        def seal(p: dict, whole: bool) -> None:
            nonlocal number_of, sealed
            done.append((p["conv"], part, number_of, *(p[c] for c in COUNTS), whole, *p["ends"], *p["initials"], bytes(p["symbols"]), p["messages"]))
            number_of, sealed = number_of + 1, sealed + p["chars"] + 100 * p["rows"]

        def flush():
            nonlocal done, sealed
            columns = list(zip(*done)) if done else [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], out.fieldNames())
            done, sealed = [], 0
            return batch

        marked: set = set()
        place = previous = None
        single = False  # the open piece began its conversation, inside this task's rows
        conversations = 0
        for b in batches:
            for conv, turn, kind, role, text, key in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "role", "text", "key"))):
                if held is None or conv != held["conv"]:
                    if held is not None:
                        seal(held, single and conversations > 1)
                    conversations, single = conversations + 1, True
                    held, place, previous = opened(conv), None, None
                    if sealed > most_chars:
                        yield flush()
                if place != (turn,):
                    marked, place, previous = set(), (turn,), None
                if kind == 0:
                    marked.add((role, key))
                    continue
                if held["rows"] >= most_rows or held["rows"] and held["chars"] > most_chars:
                    seal(held, False)
                    single, held = False, opened(conv)
                    if sealed > most_chars:
                        yield flush()
                last = text.rstrip(SPACE)[-1:]
                initial = role[:1]
                symbol = INITIALS.find(initial) + 1 if initial and initial in INITIALS else 4
                if not last:
                    held["blank"], symbol = held["blank"] + 1, 0
                elif previous == (role, text) or marked and (role, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()) in marked:
                    held["duplicate"], symbol = held["duplicate"] + 1, 0
                elif last not in ".!?":
                    held["truncated"], symbol = held["truncated"] + 1, symbol + 4
                previous = (role, text)
                if held["rows"]:
                    held["illegal"] += held["initials"][1] + initial not in ("su", "ua", "au")
                else:
                    held["initials"][0] = initial
                held["initials"][1] = initial
                if turn is not None:
                    # Turns ascend, so the first is the lowest.
                    held["turns"] += held["ends"][1] != turn
                    held["ends"] = [turn if held["ends"][0] is None else held["ends"][0], turn]
                held["rows"] += 1
                held["chars"] += len(text)
                held["symbols"].append(symbol)
                held["messages"].append({"role": role, "text": text})
        if held is not None:
            seal(held, False)
        yield flush()

    return ordered.mapInArrow(run, out)


def ways(rest: DataFrame) -> DataFrame:
    """``piece`` rows with the vector that follows each (``last``): vectors in front are combined from the end.

    A row of a conversation stands for up to ``most_rows`` messages, so even a very long one is a small group here.
    """
    conv = rest.schema["conv_id"]

    def fronts(batches):
        t = tables()
        for b in batches:
            found = [[t.backward(s, u) for u in t.units] for s in b.column("symbols").to_pylist()]
            front = [[x for _, v, by in ways_ for x in (v, by)] for ways_ in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "piece")), pa.array(front, pa.list_(pa.int64()))], ["conv_id", "part", "piece", "front"])

    def follow(table: pa.Table) -> pa.Table:
        t, table = tables(), table.sort_by([("part", "ascending"), ("piece", "ascending")])
        last, v = [], END
        for front in table.column("front").to_pylist()[::-1]:
            last.append(t.ids[lowered(v)[0]])
            v = tuple(min(min(NEVER, t.vectors[front[2 * u]][s] + front[2 * u + 1] + v[u]) for u in range(4)) for s in range(4))
        return table.select(["conv_id", "part", "piece"]).append_column("last", pa.array(last[::-1], pa.int64()))

    schema = T.StructType([conv, T.StructField("part", T.LongType()), T.StructField("piece", T.LongType())])
    small = rest.select("conv_id", "part", "piece", "symbols").mapInArrow(fronts, T.StructType([*schema, T.StructField("front", T.ArrayType(T.LongType()))]))
    return small.groupBy("conv_id").applyInArrow(follow, T.StructType([*schema, T.StructField("last", T.LongType())]))


def edited(audit: str, messages: list[dict], state: int) -> list[dict]:
    """The messages that edits leave, from the state they begin in."""
    out, at = [], 0
    for e in audit:
        if e == "I":
            state = NEXT[state]
            out.append({"role": ("user", "assistant")[state - USER], "text": ""})
            continue
        message, at = messages[at], at + 1
        if e == "R":
            state = NEXT[state]
            out.append({"role": ("user", "assistant")[state - USER], "text": message["text"]})
        elif e == "K":
            state = SYSTEM if message["role"][:1] == "s" else NEXT[state]
            out.append(message)
    return out


def cost_of(audit: str, symbols: bytes) -> int:
    total, at = 0, 0
    for e in audit:
        total += {"I": INSERT, "D": DELETE, "R": REROLE, "K": KEEP}[e]
        if e != "I":
            total += CUT if e != "D" and symbols[at] > 4 else 0
            at += 1
    return total


def traced(df: DataFrame, whole: bool) -> DataFrame:
    """Pieces with their edits: ``audit, cost`` and the ``repaired`` messages.

    A whole conversation starts with nothing and ends for good. Of other pieces the vector that follows is known (``last``);
    where they start (``state``) is known in the second of two passes. The first gives the state each start leads to (``to``).
    """
    fields = [f for f in df.schema if f.name not in ("symbols", "messages", "last", "state", "closes")]
    more = [T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("repaired", T.ArrayType(MESSAGE))]

    def run(batches):
        t = tables()
        for b in batches:
            symbols, messages = b.column("symbols").to_pylist(), b.column("messages").to_pylist()
            starts = [START] * b.num_rows if whole else b.column("state").to_pylist()
            lasts = [t.end] * b.num_rows if whole else b.column("last").to_pylist()
            closes = [True] * b.num_rows if whole else b.column("closes").to_pylist()
            audits = []
            for s, v, q, closing_ in zip(symbols, lasts, starts, closes):
                audit, to = t.forward(s, v, q)
                audits.append(audit + (closing(to) if closing_ else ""))
            repaired = [edited(a, m, q) for a, m, q in zip(audits, messages, starts)]
            kept = [b.column(f.name) for f in fields]
            made = [pa.array(audits, pa.string()), pa.array([cost_of(a, s) for a, s in zip(audits, symbols)], pa.int64()), pa.array(repaired, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*kept, *made], [f.name for f in fields] + ["audit", "cost", "repaired"])

    return df.mapInArrow(run, T.StructType([*fields, *more]))


def starts(rest: DataFrame) -> DataFrame:
    """``conv_id, part, piece, state, closes``: where each piece starts, and whether it is the last of its conversation."""
    conv = rest.schema["conv_id"]
    schema = T.StructType([conv, T.StructField("part", T.LongType()), T.StructField("piece", T.LongType())])

    def leads(batches):
        t = tables()
        for b in batches:
            to = [[t.forward(s, v, q)[1] for q in range(4)] for s, v in zip(b.column("symbols").to_pylist(), b.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "piece")), pa.array(to, pa.list_(pa.int64()))], ["conv_id", "part", "piece", "to"])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("piece", "ascending")])
        state, out = START, []
        for to in table.column("to").to_pylist():
            out.append(state)
            state = to[state]
        closes = [False] * (len(out) - 1) + [True]
        return table.select(["conv_id", "part", "piece"]).append_column("state", pa.array(out, pa.int64())).append_column("closes", pa.array(closes))

    small = rest.select("conv_id", "part", "piece", "symbols", "last").mapInArrow(leads, T.StructType([*schema, T.StructField("to", T.ArrayType(T.LongType()))]))
    return small.groupBy("conv_id").applyInArrow(walk, T.StructType([*schema, T.StructField("state", T.LongType()), T.StructField("closes", T.BooleanType())]))


def repaired(rows: DataFrame, *, most_rows: int = 4_096, most_chars: int = 1 << 20) -> DataFrame:
    """Repaired conversations in pieces: ``conv_id, part, piece, whole, audit, cost, repaired`` (role, text) and counts.

    ``rows``: ``conv_id, turn, role, text``, other columns are not looked at. Null roles and texts are one space; a null conversation id is a
    conversation like others; null turns come first. Messages of one turn are ordered by role and text, equal ones
    are repeats. Conversations without rows have no piece. Pieces of a conversation are in order of ``part, piece``. A
    very long text is a piece by itself.

    A message's first fault counts: blank, duplicate (role and text seen earlier), truncated. Edits: keep (K), change the role
    to user or assistant (R), delete (D; blank and repeated messages must go), insert an empty message (I). Roles
    then read: a system message or none, then pairs of user and assistant, or nothing at all.
    """
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    plain = plain.withColumn("conv_id", F.col("conv_id").cast("long" if isinstance(plain.schema["conv_id"].dataType, T.IntegralType) else "string"))
    cut = stored(pieces(plain, most_rows=most_rows, most_chars=most_chars), "pieces")
    rest = cut.filter("NOT whole")
    key = ["conv_id", "part", "piece"]
    # Part and piece name a piece; the id is in the small rows for grouping alone.
    led = stored(rest.join(ways(rest).drop("conv_id"), key[1:]), "led")
    return traced(cut.filter("whole"), True).unionByName(traced(led.join(starts(led).drop("conv_id"), key[1:]), False))


def lines(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"]))


def report(parts: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repaired`: ``gaps``, faults, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    The digest of a conversation in several pieces is taken by reading them in order in one task, message by message:
    a digest of one text can't be split.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    done = parts.filter("whole").select("conv_id", gaps.alias("gaps"), *counts, "audit", F.sha2(F.array_join(lines(F.col("repaired")), "\n"), 256).alias("repaired_sha256"))

    def fold(batches):
        state = None

        def closed_row() -> pa.RecordBatch:
            spread = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            values = [state["conv"], spread, *(state[c] for c in counts), "".join(state["audit"]), state["digest"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        names = ["conv_id", "gaps", *counts, "audit", "repaired_sha256"]
        for b in batches:
            types = [b.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for i in range(b.num_rows):
                p = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if state is None or state["conv"] != p["conv_id"]:
                    if state is not None:
                        yield closed_row()
                    state = {"conv": p["conv_id"], **dict.fromkeys(counts, 0), "turns": 0, "low": None, "high": None, "initial": None, "audit": [], "digest": hashlib.sha256(), "some": False}
                for c in counts:
                    state[c] += p[c]
                if state["initial"] is not None:
                    state["illegal"] += state["initial"] + p["first_initial"] not in ("su", "ua", "au")
                state["initial"] = p["last_initial"]
                # A turn may stand at the end of one piece and the start of the next.
                state["turns"] += p["turns"] - (p["low"] is not None and p["low"] == state["high"])
                state["low"] = p["low"] if state["low"] is None else state["low"]
                state["high"] = p["high"] if p["high"] is not None else state["high"]
                state["audit"].append(p["audit"])
                for m in p["repaired"]:
                    state["digest"].update((("\n" if state["some"] else "") + m["role"] + ":" + m["text"]).encode("utf-8", "surrogatepass"))
                    state["some"] = True
        if state is not None:
            yield closed_row()

    split = parts.filter("NOT whole").drop("whole", "rows").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return done.unionByName(split.mapInArrow(fold, done.schema))
