"""Repair of conversations against a search through all repairs."""

import itertools
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair


def plain(initials, faults):
    """(cost, audit) of the cheapest repair, by breadth over all edits with up to two rows put in at a place."""
    best = {0: (0, "")}
    inserted = lambda states: {
        q: min(found)
        for q, found in itertools.groupby(
            sorted((q2, (c + 3 * k, a + "I" * k)) for q, (c, a) in states.items() for k in range(3) for q2 in [reach(q, k)] if q2 is not None),
            key=lambda x: x[0],
        )
        for found in [[f for _, f in found]]
    }

    def reach(q, k):
        for _ in range(k):
            q = 3 if q == 2 else 2
        return q

    for said, fault in zip(initials, faults):
        step = {}
        for q, (c, a) in inserted(best).items():
            options = [(q, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for out in "sua":
                    to = repair.STEPS.get((q, out))
                    if to is not None and (out == said or out in "ua"):
                        options.append((to, c + more + (0 if out == said else 3), a + ("K" if out == said else "R")))
            for to, cost, audit in options:
                step[to] = min(step.get(to, (cost, audit)), (cost, audit))
        best = step
    return min(v for q, v in inserted(best).items() if q in (0, 3))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suuaaax"), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])), max_size=9))
def test_lightest(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    step = repair.lightest(initials, faults)
    audit, cost = "", step.cost
    while step.letter:
        audit, step = audit + step.letter, step.rest
    assert (cost, audit) == plain(initials, faults)


def test_long_conversations():
    for initials in (["s"] * 20_000, ["u", "a"] * 10_000, ["u"] * 20_000):
        began = time.time()
        assert repair.lightest(initials, [""] * len(initials)).cost >= 0
        assert time.time() - began < 20


def test_repaired_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 3, "user", " \t"), (1, None, "system", "Be kind."),
        (2, 0, "assistant", "No end"), (3, 0, None, None), (None, 2, "user", "Alone?"), (4, 0, "user", "gone"),
    ]
    df = spark.createDataFrame([(*r, r[3] != "gone", "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, present boolean, rows string")
    from pyspark.sql import functions as F

    got = {r["conv_id"]: r for r in repair.repair(df, present=F.col("present")).collect()}
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"], one["cost"], one["audit"]) == (1, 1, 1, 0, 1, 8, "KKKDD")
    assert [tuple(t) for t in one["repaired"]] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Yes.")]
    assert (got[2]["cost"], got[2]["audit"], got[2]["truncated"]) == (4, "D", 1)
    assert (got[3]["audit"], got[3]["blank"], got[3]["repaired"]) == ("D", 1, [])
    assert (got[None]["audit"], got[None]["cost"]) == ("KI", 3) and [tuple(t) for t in got[None]["repaired"]][1] == ("assistant", "")
    assert (got[4]["cost"], got[4]["audit"], got[4]["repaired"], got[4]["rows"]) == (0, "", [], [])
    assert repair.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("fate, change", [(0, "dropped"), (1, "emptied"), (2, "stops removed"), (3, "twice"), (4, "user")])
def test_damage(spark, fate, change):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == fate)
    df = spark.createDataFrame([(7, turn, "assistant", "A. b! c? d")], "conv_id bigint, turn bigint, role string, text string")
    got = repair.damage(df).collect()
    assert [r["present"] for r in got] == ([False] if fate == 0 else [True] * (1 + (fate == 3)))
    assert got[0]["text"] == {1: "", 2: "A b c d"}.get(fate, "A. b! c? d") and got[0]["role"] == ("user" if fate == 4 else "assistant")
