"""Conversations repaired at the least cost by a lightest-derivation agenda.

A repaired conversation gives the roles ``(s?(ua)+)?``.  An item says: from
this state of that pattern on, the rows from here on can be repaired.  Axioms
are the ends of a well-formed conversation and what each row may become;
deductions put an edit before an item.  An item weighs (cost, audit).  Edits
are put in front, so that the order of weights is kept by every deduction, and
a deduction costs more or covers one row more than the item it is drawn from:
popped by (cost, rows covered, audit), an item is final when it comes up, and
the search stops when the goal does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, arrow_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: States of ``(s?(ua)+)?``: nothing said, system said, user said, pair closed.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BACK = {o: [(q, to) for (q, said), to in STEPS.items() if said == o] for o in "sua"}
FINAL = (0, 3)
OUT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, edits array<struct<row:int,role:string>>"


class Derived(NamedTuple):
    """How an item is derived: its cost, the edit in front, and what follows it."""

    cost: int
    letter: str
    row: int
    role: str | None
    rest: Any


def _faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row: blank, duplicate, truncated, or none."""
    seen: set[tuple[str, str]] = set()
    found = []
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def lightest(initials: list[str], faults: list[str]) -> Derived:
    """The derivation of the goal: rows from the first on, with nothing said yet."""
    n = len(initials)
    best: list[dict[int, Derived]] = [{} for _ in range(n + 1)]
    done: list[set[int]] = [set() for _ in range(n + 1)]
    agenda: list[tuple[int, int, int]] = []
    known: dict[tuple[int, int], bool] = {}

    def earlier(a: Derived, b: Derived) -> bool:
        """Whether the audit of ``a`` comes before that of ``b``; what is found out is kept for the tails."""
        walked = []
        while a is not b and a.letter == b.letter and (id(a), id(b)) not in known:
            walked.append((id(a), id(b)))
            a, b = a.rest, b.rest
        said = False if a is b else a.letter < b.letter if a.letter != b.letter else known[id(a), id(b)]
        for pair in walked[1:]:  # the first is a candidate, which may go
            known[pair] = said
        return said

    def offer(q: int, i: int, made: Derived) -> None:
        old = best[i].get(q)
        if q not in done[i] and (old is None or made.cost < old.cost or made.cost == old.cost and earlier(made, old)):
            best[i][q] = made
            heapq.heappush(agenda, (made.cost, n - i, q))

    for q in FINAL:
        offer(q, n, Derived(0, "", n, None, None))
    while agenda:
        cost, covered, q = heapq.heappop(agenda)
        i = n - covered
        item = best[i][q]
        if q in done[i] or item.cost != cost:
            continue
        done[i].add(q)
        if q == 0 and i == 0:
            return item
        for letter, role in ROLES.items():
            for before, to in BACK[letter]:
                if to == q:
                    offer(before, i, Derived(cost + INSERT, "I", -1, role, item))
        if i == 0:
            continue
        k = i - 1
        offer(q, k, Derived(cost + DELETE, "D", -2, None, item))
        if faults[k] in ("blank", "duplicate"):
            continue
        more = TRUNCATED if faults[k] == "truncated" else 0
        for letter in "sua":
            for before, to in BACK[letter]:
                if to == q and letter == initials[k]:
                    offer(before, k, Derived(cost + more, "K", k, None, item))
                elif to == q and letter in ROLES:
                    offer(before, k, Derived(cost + more + REROLE, "R", k, ROLES[letter], item))
    raise AssertionError("every row can be deleted, so the goal is always derived")


def _repair(rows: list[dict]) -> dict:
    said = [(r["role"], r["text"]) for r in rows]
    faults = _faults(said)
    initials = [role[:1] for role, _ in said]
    step = lightest(initials, faults)
    cost, audit, edits = step.cost, [], []
    while step.letter:
        audit.append(step.letter)
        if step.letter != "D":
            edits.append({"row": step.row, "role": step.role})
        step = step.rest
    turns = {r["turn"] for r in rows} - {None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{kind: faults.count(kind) for kind in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": "".join(audit),
        "edits": edits,
    }


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row a conversation: ``conv``, the figures of ``OUT``, ``rows`` as read and ``repaired``, an array of (role, text).

    Rows are read by turn (nulls first), then role and text.  A row is blank
    without a character that shows, a duplicate if its role and text stand in
    an earlier one, truncated if its last such character is not one of
    ``.!?``.  Keep, Rerole, Delete and Insert cost 0, 3, 4 and 3, truncated
    rows that stay 3 more; blank and duplicate ones must go.  Of the cheapest
    repairs the one with the least audit string is taken.  Null roles and
    texts read as one blank; null ids are one conversation; rows that are not
    ``present`` are left out but still name their conversation, which then may
    have no rows.  An empty table gives no rows.  A conversation is read and
    repaired as one row.
    """
    arrow_batches(rows.sparkSession, 200)
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    heard = own if present is None else F.when(present, own)
    whole = rows.groupBy(F.col(conv).alias("_conv")).agg(F.sort_array(F.collect_list(heard)).alias("rows"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_repair(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([t[name] for t in told], kind) for name, kind in _ARROW]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[name for name, _ in _ARROW]])

    done = whole.mapInArrow(run, ", ".join([*kinds, OUT]))
    kept = lambda e: F.get("rows", e["row"])
    mended = F.transform(
        "edits",
        lambda e: F.struct(
            F.coalesce(e["role"], kept(e)["role"]).alias("role"), F.when(e["row"] < 0, F.lit("")).otherwise(kept(e)["text"]).alias("text")
        ),
    )
    figures = [c.split()[0] for c in OUT.split(", ")[:-1]]
    return done.select(F.col("_conv").alias(conv), *figures, "rows", mended.alias("repaired"))


_ARROW = [
    *[(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()),
    ("edits", pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))),
]


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` rows damaged by the remainder of a checksum, with ``present``: false for what is dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    marked = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("_fate"))
    twice = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_fate") != 0).alias("present"), twice.alias("_copy"),
    )
