"""Conversation repair against all edit sequences of a plain search."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import conversation_repair as C

WORDS = r"[^\x20\x09-\x0d]"


def damaged(rows):
    """Conversations after damage, by conv_id, in order."""
    out = {}
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for rs in out.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def plainly(rows):
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        found = re.findall(WORDS, text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        """(cost, audit, lines) of the least way from here."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for r, to in step[state].items():
                if r in full:
                    c, a, lines = best(i, to, inserted + 1)
                    ways.append((c + 3, "I" + a, (f"{full[r]}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, lines = best(i + 1, state)
            ways.append((c + 4, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for r, to in step[state].items():
                    if role[:1] == r:
                        c, a, lines = best(i + 1, to)
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                    if r in full:
                        c, a, lines = best(i + 1, to)
                        ways.append((c + 3 + more, "R" + a, (f"{full[r]}:{text}", *lines)))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, lines = best(0, "")
    return [gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(df, rows, **how):
    want = {c: plainly(rs) for c, rs in damaged(rows).items()}
    got = {r.conv_id: list(r)[1:] for r in C.repair_report(df, C.damage(df), **how).collect()}
    assert got == want


def conversations(dice, n, longest):
    texts = ["Yes.", "Yes.", "No", "Why?", " \t", "", None, "ok! ", "word " * 3, "é.\x0b", "one. two", "\xa0"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "User", "ugh", "tool"]
    out = []
    for c in range(n):
        length = dice.randrange(1, longest)
        tidy = dice.random() < 0.5
        for t in range(length):
            role = ["user", "assistant"][t % 2] if tidy and dice.random() < 0.8 else dice.choice(roles)
            text = f"{dice.randrange(50)} {dice.choice(texts)}" if dice.random() < 0.6 else dice.choice(texts)
            out.append((c if c else None, None if dice.random() < 0.05 else t + 2 * (dice.random() < 0.1), role, text))
    return out


def test_many_short(spark):
    rows = conversations(random.Random(1), 400, 9)
    check(table(spark, rows), rows)


@pytest.mark.parametrize("block_rows,fan", [(3, 2), (7, 3)])
def test_blocks_and_chains_of_blocks(spark, block_rows, fan):
    rows = conversations(random.Random(block_rows), 12, 60)
    check(table(spark, rows), rows, block_rows=block_rows, fan=fan)


def test_one_conversation_over_all_tasks(spark):
    dice = random.Random(4)
    rows = [(7, t, dice.choice(["user", "assistant"]), dice.choice(["Yes.", f"{t}.", f"{t}"])) for t in range(120)] + [(8, 0, "user", "Hi.")]
    rows += [(7, 5, "user", "Again.")] * 40
    check(table(spark, rows).repartition(5), rows, block_rows=10, fan=4)


def test_none_and_all_dropped(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi.")]
    df = table(spark, rows).withColumn("blk", F.lit("own")).withColumn("edit", F.lit(1))
    empty = hashlib.sha256().hexdigest()
    assert [list(r) for r in C.repair_report(df, C.damage(df)).collect()] == [[dropped, 0, 0, 0, 0, 0, 0, "", empty]]
    assert C.repair_report(table(spark, []), C.damage(table(spark, []))).collect() == []
    assert C.repair(table(spark, [])).collect() == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a" * 3_000_000 + "."), (1, 1, "assistant", "b. " * 1_000_000), (2, 0, "assistant", "x."), (2, 1, "user", "y?")]
    check(table(spark, rows), rows, block_bytes=1_000_000)
