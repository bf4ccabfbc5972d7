"""Cheapest repair of conversations, by dynamic programming over secondary-sorted streams.

Rows are dealt out by conversation and sorted by turn; one pass reads them as a stream, so a conversation of
any length needs the state of the program, not its rows. The program walks the automaton of
``(s?(ua)+)?`` over role initials: nothing yet, after a system turn, after a user turn, after an answer. Of
each state it holds the least cost, the place of its edits in ASCII order and a running SHA-256 of what it
keeps. Edits are compared without being held: two states' edits before a row have as many Keep, Rerole and
Delete in them and end in one, so neither is the beginning of the other, and their order stays. Backpointers
take four bytes a row and go to a temporary file of the task beyond ``SPILL`` bytes; they give the audit.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Bytes of backpointers that a task holds of one conversation.
SPILL = 4 << 20
_EMPTY, _SYSTEM, _USER, _ANSWER = range(4)
_NONE = 255
_AFTER_INSERT = (_USER, _USER, _ANSWER, _USER)
_EDITS = "DKR"
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@lru_cache(maxsize=1 << 16)
def _steps(letter: str, bad: bool, cut: bool, costs: tuple, ranks: tuple) -> tuple[tuple, tuple, bytes]:
    """Costs (from the least one) and ranks of the states after a row, and their backpointers: the state
    before, whether a turn is inserted first, the edit."""
    best: dict[int, tuple] = {}
    for before, cost in enumerate(costs):
        if cost is None:
            continue
        for inserted in (0, 1):
            at = _AFTER_INSERT[before] if inserted else before
            start = cost + 2 * inserted
            reached = [("D", 3, at)]
            if not bad:
                if letter == "s" and at == _EMPTY:
                    reached.append(("K", cut, _SYSTEM))
                if (letter == "a" if at == _USER else letter == "u"):
                    reached.append(("K", cut, _ANSWER if at == _USER else _USER))
                reached.append(("R", 2 + cut, _ANSWER if at == _USER else _USER))
            for edit, price, state in reached:
                found = (start + price, ranks[before], "I" * inserted + edit, before)
                if state not in best or found < best[state]:
                    best[state] = found
    order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    back = bytes(best[s][3] | (len(best[s][2]) - 1) << 2 | _EDITS.index(best[s][2][-1]) << 3 if s in best else _NONE for s in range(4))
    return tuple(best[s][0] if s in best else None for s in range(4)), tuple(order.get(s) for s in range(4)), back


class _Pointers:
    """Backpointers of one conversation, the later part in memory and the rest in a file."""

    def __init__(self, spill: int):
        self.rows, self.spill, self.file, self.held = 0, spill, None, bytearray()

    def add(self, back: bytes) -> None:
        self.rows += 1
        self.held += back
        if len(self.held) >= self.spill:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held = bytearray()

    def _backwards(self) -> Iterator[bytes]:
        yield bytes(self.held)
        if self.file is not None:
            end = self.file.tell()
            size = max(4, self.spill // 4 * 4)
            while end:
                start = max(0, end - size)
                self.file.seek(start)
                yield self.file.read(end - start)
                end = start
            self.file.close()

    def audit(self, state: int) -> str:
        out = bytearray()
        for part in self._backwards():
            for i in range(len(part) - 4, -1, -4):
                b = part[i + state]
                out.append(ord(_EDITS[b >> 3]))
                if b & 4:
                    out.append(73)
                state = b & 3
        return out[::-1].decode()


class _Conversation:
    def __init__(self, spill: int):
        self.count = dict.fromkeys(_COUNTS, 0)
        self.base, self.costs, self.ranks = 0, (0, None, None, None), (0, None, None, None)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.pointers = _Pointers(spill)
        self.turns: tuple = (None, None, 0)
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        end = text.rstrip(_SPACE)
        blank, cut = not end, bool(end) and end[-1] not in ".!?"
        c, initial = self.count, role[:1]
        c["blank"] += blank
        c["duplicate"] += repeated and not blank
        c["truncated"] += cut and not repeated
        c["illegal"] += self.initial is not None and self.initial + initial not in _LEGAL
        self.initial = initial
        if turn is not None:
            first, last, n = self.turns
            self.turns = (turn if first is None else first, turn, n + (turn != last or first is None))
        bad = blank or repeated
        costs, self.ranks, back = _steps(initial if initial and initial in "sua" else "o", bad, cut and not bad, self.costs, self.ranks)
        low = min(x for x in costs if x is not None)
        self.base += low
        self.costs = tuple(None if x is None else x - low for x in costs)
        body = None
        hashes: list = [None] * 4
        for state, b in enumerate(back):
            if b == _NONE:
                continue
            before, edit, h = b & 3, _EDITS[b >> 3], self.hashes[b & 3]
            lead, filled = b"", before != _EMPTY
            if b & 4:
                lead = (b"\n" if filled else b"") + (b"assistant:" if before == _USER else b"user:")
                filled = True
            if edit == "D" and not lead:
                hashes[state] = h
                continue
            h = h.copy()
            if edit != "D":
                body = text.encode("utf-8", "surrogatepass") if body is None else body
                shown = role.encode("utf-8", "surrogatepass") if edit == "K" else b"assistant" if state == _ANSWER else b"user"
                h.update(lead + (b"\n" if filled else b"") + shown + b":")
                h.update(body)
            else:
                h.update(lead)
            hashes[state] = h
        self.hashes = hashes
        self.pointers.add(back)

    def result(self) -> dict:
        rest = {_EMPTY: 0, _SYSTEM: 4, _USER: 2, _ANSWER: 0}
        state = min((s for s in range(4) if self.costs[s] is not None), key=lambda s: (self.costs[s] + rest[s], self.ranks[s]))
        h, tail = self.hashes[state].copy(), {_SYSTEM: "II", _USER: "I"}.get(state, "")
        if state == _SYSTEM:
            h.update(b"\nuser:")
        if tail:
            h.update(b"\nassistant:")
        first, last, n = self.turns
        self.count["gaps"] = last - first + 1 - n if n else 0
        self.count["cost"] = self.base + self.costs[state] + rest[state]
        return self.count | {"audit": self.pointers.audit(state) + tail, "repaired_sha256": h.hexdigest()}


def _repaired(spill: int):
    columns = ["conv", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, None
        for batch in batches:
            done = []
            for conv, null, turn, role, text, dropped, repeated in zip(*(batch[c].tolist() for c in ("conv", "no_turn", "turn", "role", "text", "dropped", "repeated"))):
                if at is None or conv != now:
                    if at is not None:
                        done.append({"conv": now} | at.result())
                    now, at = conv, _Conversation(spill)
                if not dropped:
                    at.add(None if null else int(turn), role, text, bool(repeated))
            yield pd.DataFrame(done, columns=columns)
        if at is not None:
            yield pd.DataFrame([{"conv": now} | at.result()], columns=columns)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: a fifth of the rows with a fault, by the CRC-32 of ``conv_id:turn``
    modulo 20. 0 drops the row (it stays, marked, so that its conversation is still known), 1 empties its
    text, 2 takes the sentence ends out, 3 repeats it, 4 gives it to the user. Nulls are one space each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")
    # a dropped row says nothing but its conversation
    keep = lambda c: F.when(~F.col("dropped"), F.col(c))
    return out.select("conv_id", keep("turn").alias("turn"), keep("role").alias("role"), keep("text").alias("text"), "dropped")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows in the order of the program, with what has been said before marked."""
    said = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("repeated", F.row_number().over(said) > 1)
    return marked.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "dropped", "turn", "role", "text")


def repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, dropped): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, null turns first, equal turns by role and text. Rows that are ``dropped`` only
    name their conversation; one that has no others gives zeros, an empty audit and the hash of nothing. Rows
    with a null conv_id make one conversation. A row with neither role nor text counts as blank; an unknown
    or empty role is illegal beside any other. Other columns are not looked at.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = _ordered(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.when(~F.col("dropped"), " ")).alias("role"), F.coalesce("text", F.when(~F.col("dropped"), " ")).alias("text"), "dropped"))
    sent = ordered.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").isNull().alias("no_turn"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", "text", "dropped", "repeated")
    schema = "conv string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return sent.mapInPandas(_repaired(spill), schema).select(F.col("conv").cast(kind).alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, audit, at, n, last, fresh = None, "", 0, 0, "", True

    def placed(inserts: bool) -> Iterator[tuple]:
        nonlocal at, n, last
        while at < len(audit) and audit[at] == "I" and inserts:
            last = "assistant" if last[:1] == "u" else "user"
            yield (now, n, last, "", True)
            at, n = at + 1, n + 1

    for batch in batches:
        out: list[tuple] = []
        for conv, role, text, edits in zip(*(batch[c].tolist() for c in ("conv", "role", "text", "audit"))):
            if fresh or conv != now:
                out += placed(True)
                now, audit, at, n, last, fresh = conv, "", 0, 0, "", False
            if edits is not None:
                audit = edits
                continue
            out += placed(True)
            edit, at = audit[at], at + 1
            if edit != "D":
                last = role if edit == "K" else "assistant" if last[:1] == "u" else "user"
                out.append((now, n, last, text, False))
                n += 1
        yield pd.DataFrame(out, columns=["conv", "position", "role", "text", "inserted"])
    yield pd.DataFrame(list(placed(True)), columns=["conv", "position", "role", "text", "inserted"])


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, position, role, text, inserted: the repaired conversations, from the rows and the audits that
    ``repair`` gave for them. An audit is read once, before its conversation's rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    both = (
        rows.filter(~F.col("dropped")).select("conv_id", F.lit(1).alias("step"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(None).cast("string").alias("audit"))
        .unionByName(repairs.select("conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit"))
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "text")
    sent = ordered.select(F.col("conv_id").cast("string").alias("conv"), "role", "text", "audit")
    return sent.mapInPandas(_edited, "conv string, position long, role string, text string, inserted boolean").select(F.col("conv").cast(kind).alias("conv_id"), "position", "role", "text", "inserted")
