"""Conversation repair against a search over all edit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusbank.llm import conversation_repair as cr

SPACES = " \t\n\v\f\r"


def repaired(rows, audit):
    """Repaired lines of an audit string, or None when it does not fit the rows."""
    out, at = [], 0
    for letter in audit:
        state = "".join(role[:1] for role, _ in out)
        follow = "assistant" if state.endswith("u") else "user"
        if letter == "I":
            out.append((follow, ""))
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            out.append((role, text))
        elif letter == "R":
            out.append((follow, text))
    return out


def brute(rows):
    """(counts, cost, audit, sha) of damaged rows [(turn, role, text)] by trying all edits."""
    kinds, seen = [], set()
    for turn, role, text in rows:
        core = text.strip(SPACES)
        kinds.append("blank" if not core else "duplicate" if (role, text) in seen
                     else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best, pairs = None, [(role, text) for _, role, text in rows]
    slots = [["", "I", "II"]] * (len(rows) + 1)
    letters = [["D"] if k in ("blank", "duplicate") else ["K", "R", "D"] for k in kinds]
    for picked in itertools.product(*letters):
        for inserts in itertools.product(*slots):
            if sum(map(len, inserts)) > 2:
                continue
            audit = "".join(i + p for i, p in itertools.zip_longest(inserts, picked, fillvalue=""))
            out = repaired(pairs, audit)
            if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                continue
            cost = (5 * audit.count("I") + audit.count("R") + 2 * audit.count("D")
                    + 5 * sum(k == "truncated" and p != "D" for k, p in zip(kinds, picked)))
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, best[0],
            best[1], hashlib.sha256(text.encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
                         .encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        elif hit == 2:
            text = re.sub("[.!?]", "", text)
        elif hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def by_conversation(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    return {c: [r[1:] for r in order if r[0] == c] for c in {r[0] for r in rows}}


def made(n, most, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([None, *range(9)]),
                         rng.choice(["user", "assistant", "system", "tool", "", None, "user"]),
                         rng.choice(["Yes.", "No!", "cut", "  ", "", None, "Été ?\n", "a "])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_report_against_all_edits(spark):
    rows = made(250, 6, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_turn", F.lit("x")).repartition(7)
    got = {r[0]: tuple(r)[1:] for r in cr.repair_report(df).collect()}
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == {c: brute(v) for c, v in by_conversation(plain).items()}


def test_query_against_plain_damage(spark, tmp_path):
    rows = made(300, 5, 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in cr.op11_conversation_repair(spark, str(tmp_path)).collect()}
    left = by_conversation(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: brute(left[c]) if c in left else nothing for c in {r[0] for r in rows}}
    assert nothing in got.values()


def test_repaired_turns_give_the_digest(spark):
    rows = made(60, 9, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    report = {r.conv_id: r for r in cr.repair_report(df).collect()}
    turns = {}
    for r in cr.repaired_turns(df).orderBy("conv_id", "place").collect():
        assert r.place == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append((r.edit, f"{r.role}:{r.text}"))
    for conv, r in report.items():
        lines = turns.get(conv, [])
        text = "\n".join(x for _, x in lines)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
        assert [e for e, _ in lines] == [e for e in r.audit if e != "D"]


def streamed(rows, held, size):
    import pandas as pd

    frame = pd.DataFrame([("1", str(t), r, x, False) for t, r, x in rows],
                         columns=["k", "t", "r", "x", "late"])
    frames = (frame[k:k + size] for k in range(0, len(frame), size))
    return pd.concat(list(cr.reports(frames, held))).values.tolist()


@pytest.mark.parametrize("held", [4, 20, 1 << 20])
def test_giant_conversation_spills(held):
    rng = random.Random(held)
    rows = [(k, rng.choice(["user", "assistant", "assistant", "system"]),
             rng.choice([f"{k}.", f"{k}", ""])) for k in range(3000)]
    (report,) = streamed(rows, held, 97)
    assert report == streamed(rows, 1 << 20, 3000)[0]
    out = repaired([(r, x) for _, r, x in rows], report[7])
    text = "\n".join(f"{r}:{x}" for r, x in out)
    assert hashlib.sha256(text.encode()).hexdigest() == report[8]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))


def test_hot_conversation_long_text_and_empty_table(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(4000)]
    rows += [(2, 0, "user", "x " * 600_000 + "."), (2, 1, "assistant", "y.")]
    got = {r.conv_id: r for r in cr.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].cost, got[1].audit) == (0, "K" * 4000) and got[2].audit == "KK"
    assert cr.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
