"""Prefix tries against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from millrace.llm import prefixes, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, group string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def brute(rows):
    built, members, children = rebuilt(rows), defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df, **more):
    return sorted((tuple(r) for r in prefixes.conversation_trie(df, **more).collect()), key=str)


def made(seed=3):
    draw, rows = random.Random(seed), []
    for c in range(-12, 90):
        if c % 11 != 3:
            for t in range(draw.randint(0, 12)):
                rows.append((c, t if draw.random() < 0.95 else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", None, "ccc"]) if t else draw.choice(["sys", "sys2"])))
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(9 + c % 3)]  # copies behind one first turn
    rows += [(c, t, "user", f"log {t}") for c in range(300, 320) for t in range(c - 299)]  # each goes on where the last one ended
    return rows + [(None, 1, "user", "nobody"), (8, 2, "user", "tie"), (8, 2, "user", "eit"), (8, 2, "user", "tie"), (7, 3, "a", "bc"), (9, 3, "ab", "c")]


@pytest.mark.parametrize("group_turns", [200_000, 40, 3])
def test_tries_of_made_conversations(spark, group_turns):
    """With small groups, subtries are dealt again by the next turn, several times."""
    rows = made()
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], SCHEMA).repartition(3)
    assert nodes(df, group_turns=group_turns) == brute(rows)


def test_tries_of_the_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_prefix_trie(spark, DATA).collect()), key=str) == brute(rows)


def test_odd_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nodes(empty) == []
    # ids of one part of the hashed ends, of several parts, and below zero; a conversation that becomes turnless
    gone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    for rows in ([(c, 0, "u", "x") for c in (-9000, -1, 0, 4095, 4096, 99999)], [(gone, 0, None, None)], [(5, None, None, None), (5, None, "r", "long " * 20_000)]):
        df = spark.createDataFrame([(*r, 1, "g") for r in rows], SCHEMA)
        assert nodes(df) == brute(rows)


def test_a_long_chain_needs_no_recursion(spark):
    rows = [(c, t, "u", str(t)) for c in (0, 5) for t in range(3000)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], SCHEMA)
    assert nodes(df, group_turns=1000) == brute(rows)
