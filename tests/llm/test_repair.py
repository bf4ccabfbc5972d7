"""Conversation repair against exhaustive search, its defined cases, giant conversations."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from chronoloom.llm import conversation_repair as cr
from chronoloom.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string, dropped boolean, conv string, audit string, n long"
SF = "/root/testdata/sf0.01"


def searched(rows):
    """Least (cost, audit) of all edits of ``rows`` and the repaired turns, taken from the end."""

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        after = lambda r: r[:1] != "" and ((r[0] in "su") if not last else last + r[0] in ("su", "ua", "au"))
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        add = lambda edit, price, rest, turn=(): found.append((rest[0] + price, edit + rest[1], turn + rest[2]))
        for new in ("user", "assistant"):
            if after(new) and inserted < 3:
                add("I", 2, best(i, new[0], inserted + 1), ((new, ""),))
        if i < len(rows):
            role, text, bad, cut = rows[i]
            add("D", 3, best(i + 1, last, 0))
            if not bad:
                if after(role):
                    add("K", cut, best(i + 1, role[0], 0), ((role, text),))
                for new in ("user", "assistant"):
                    if after(new):
                        add("R", 2 + cut, best(i + 1, new[0], 0), ((new, text),))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def expected(rows):
    """The columns of one conversation from (turn, role, text) in order."""
    seen, judged, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        blank, again = not end, (role, text) in seen
        seen.add((role, text))
        cut = bool(end) and not again and end[-1] not in ".!?"
        n["blank"] += blank
        n["duplicate"] += again and not blank
        n["truncated"] += cut
        judged.append((role, text, blank or again, cut))
    n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = searched(judged)
    return {"gaps": gaps, **n, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}, out


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        at = out.setdefault(conv, [])
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        at += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def test_whole_table_against_a_search(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = damaged([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    got = {r["conv_id"]: r.asDict() for r in registry.op13_conversation_repair(spark, SF).collect()}
    assert set(got) == set(want) and len(got) == 100
    for c, rows in want.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == expected(rows)[0], rows


@pytest.fixture(scope="module")
def random_rows():
    rng, rows = random.Random(7), []
    for c in range(300):
        for t in range(rng.randrange(0, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Yes.", "no", "", " \t", None, "Why?", "Z \x1c.", "é"])
            rows.append((c if rng.random() > 0.01 else None, rng.choice([t, t, t, 2 * t, None]), role, text))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, False, "k", "a", 1) for c, t, r, x in rows], SCHEMA)


@pytest.mark.parametrize("batch,spill", [(10000, cr.SPILL), (1, 4), (3, 8)])
def test_random_conversations_against_a_search(spark, random_rows, batch, spill):
    want = damaged(random_rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = cr.damaged(as_frame(spark, random_rows).drop("dropped"))
        repairs = cr.repair(rows, spill)
        got = {r["conv_id"]: r.asDict() for r in repairs.collect()}
        turns = {}
        for r in cr.apply_repairs(rows, repairs).orderBy("conv_id", "position").collect():
            turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want)
    for c, x in want.items():
        row, out = expected(x)
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == row, x
        assert turns.get(c, []) == list(out)


def test_giant_conversation_spills_and_is_read_as_a_stream(spark):
    n = 60_000
    rows = spark.range(n).select("id").selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 1000 = 999 THEN 'tool' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '.') AS text", "false AS dropped")
    r = cr.repair(rows, spill=4096).collect()[0]
    assert r["audit"] == "".join("R" if i % 1000 == 999 else "K" for i in range(n)) and r["cost"] == 2 * (n // 1000)
    text = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:t{i}." for i in range(n))
    assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_defined_cases(spark):
    assert cr.repair(cr.damaged(as_frame(spark, []))).count() == 0
    lost = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = cr.repair(cr.damaged(as_frame(spark, [(lost, 0, "user", "gone.")]))).collect()[0]
    assert (r["conv_id"], r["cost"], r["audit"], r["gaps"]) == (lost, 0, "", 0) and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    long = "word " * 200_000 + "end."
    r = cr.repair(as_frame(spark, [(1, 0, "user", long), (1, 1, "assistant", long)])).collect()[0]
    assert r["audit"] == "KK" and r["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
