"""Conversation repair against all possible edits, and split conversations against whole ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from gleanwork.llm import conversations, queries

BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Plain version of the dealt faults."""
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        if kind == 0:
            continue
        said = "user" if kind == 4 else shown[2]
        told = "" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3]
        out += [(conv, turn, said, told)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.strip(BLANKS)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, faults):
    """(cost, audit, repaired rows) of all edits with up to two inserts in a place whose roles fit the pattern."""
    n = len(rows)
    for edits in itertools.product("KRD", repeat=n):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=n + 1):
            audit = "".join("I" * i + e for i, e in zip(inserts, (*edits, ""), strict=True))
            kept = [k for k, e in enumerate(audit) if e != "D"]
            which = [sum(c != "I" for c in audit[:k]) for k in kept]
            # From what is kept as it is, roles of the others follow by alternation.
            for start in ("", "s"):
                want = start + ("ua" * (len(kept) + 1))[: len(kept) - len(start)]
                if len(want) != len(kept) or not re.fullmatch("(s?(ua)+)?", want):
                    continue
                if any((audit[k] == "K" and rows[w][2][:1] != r) or (audit[k] != "K" and r == "s") for k, w, r in zip(kept, which, want, strict=True)):
                    continue
                cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit) + 5 * sum(e != "D" and f == "truncated" for e, f in zip(edits, faults, strict=True))
                full = {"u": "user", "a": "assistant"}
                made = [(rows[w][2] if audit[k] == "K" else full[r], "" if audit[k] == "I" else rows[w][3]) for k, w, r in zip(kept, which, want, strict=True)]
                yield cost, audit, made


def reports(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        faults = faults_of(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, made = min(every_repair(own, faults), key=lambda c: c[:2])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def tuples(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_rows(seed, conversations_=12, longest=4):
    rng = random.Random(seed)
    texts = ["Fine.", "Well", "What?", " ", "", "Cut off", "Fine. ", "a.b", "! "]
    return [(c, t, rng.choice(["user", "assistant", "system", "tool", "u", ""]), rng.choice(texts)) for c in range(conversations_) for t in sorted(rng.sample(range(9), rng.randint(1, longest)))]


@pytest.mark.parametrize("seed", range(3))
def test_lightest_of_all_repairs(spark, seed, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 2)
    rows = random_rows(seed)
    got = conversations.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert tuples(got) == reports(rows, {r[0] for r in rows})


def test_nulls_ties_and_dropped_conversations(spark):
    rows = [(None, 0, "user", "One."), (None, 1, "assistant", "Two."), (1, None, "system", "S."), (1, 3, "user", None), (1, 3, None, "x."), (2, 7, "user", "Alone."), (3, None, None, None)]
    rows += [(9, 1, "user", "Same.")] * 3
    schema = "conv_id long, turn long, role string, text string, conv string, items int"
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = tuples(conversations.report(df, ids=df.union(spark.createDataFrame([(77, 0, "user", "x", "", 1)], schema))))
    assert got == reports(filled, {r[0] for r in rows} | {77})
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[9][2] == 2


def test_damage(spark):
    rows = random_rows(5, 30) + [(None, 2, None, "a.b!c?"), (4, None, "user", None)]
    got = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, damaged(rows)))


def test_one_conversation_in_many_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "again.", " "])) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = tuples(conversations.report(df))[5]
    monkeypatch.setattr(conversations, "BLOCK", 16)
    assert tuples(conversations.report(df))[5] == whole
    # The agenda over all rows at once.
    faults = [{"blank": 2, "duplicate": 2, "truncated": 1, "": 0}[f] for f in faults_of(rows)]
    ends = conversations.lightest([r[2][0] for r in rows], faults, 0)
    cost, audit = min((c + 5 * len(conversations.MISSING[q]), a + conversations.MISSING[q]) for q, (c, a) in ends.items())
    assert whole[5:7] == (cost, audit)
    made = sorted(conversations.repaired(df).collect(), key=lambda r: r.place)
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made).encode()).hexdigest() == whole[7]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in made)) and [r.place for r in made] == list(range(len(made)))


def test_very_long_text_and_empty_table(spark):
    text = "w " * 1_000_000 + "."
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "ok.")], "conv_id long, turn long, role string, text string")
    assert tuples(conversations.report(df))[1][5:] == (0, "KK", hashlib.sha256(f"user:{text}\nassistant:ok.".encode()).hexdigest())
    none = conversations.report(conversations.damage(df.limit(0)), ids=df.limit(0))
    assert none.count() == 0 and none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = tuples(queries.QUERIES["op13_conversation_repair"](spark, sf_dir))
    hurt = damaged(rows)
    short = {c for c in {r[0] for r in rows} if sum(r[0] == c for r in hurt) <= 5}
    assert set(got) == {r[0] for r in rows} and len(short) > 5
    assert {c: got[c] for c in short} == reports(hurt, short)
