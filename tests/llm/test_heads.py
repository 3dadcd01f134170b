"""Members of a group beside its head: one join, which makes no rows that nothing asks for."""

import re

import numpy as np

from millrace.llm import passages


def test_members_beside_heads(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(int(g), int(n), int(l), int(l) + 40) for g, n, l in zip(rng.integers(0, 30, 400), rng.integers(0, 12, 400), rng.integers(0, 9, 400))})
    rows = [(*r, bool(rng.random() < 0.15)) for r in rows]
    members = spark.createDataFrame(rows, "g long, node long, l int, r int, open boolean")
    want = set()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        head = min(own)
        a_open = any(r[4] for r in own if r[1] == head[1])
        want |= {(g, head[1], head[2], head[3], n, l, r, o, a_open) for _, n, l, r, o in own if n != head[1]}
    assert {tuple(r) for r in passages._beside_heads(members).collect()} == want
    asked = passages._beside_heads(members, True)
    assert {tuple(r) for r in asked.collect()} == {w for w in want if w[7] or w[8]} and any(not w[7] and not w[8] for w in want)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join .*", plan)
    assert len(joins) == 1 and "open" in joins[0]  # the condition is the join's, so that other rows aren't made
