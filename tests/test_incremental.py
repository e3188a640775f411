import random

import pytest

from deducta.plans import incremental as I
from deducta.plans.fixpoint import evaluate
from deducta.plans.rules import parse

from .conftest import rows

RULES = """J(x, z) :- L(x, y), R(y, z)
P(x) :- J(x, z), not B(x)
Reach(x, y) :- L(x, y)
Reach(x, z) :- L(x, y), Reach(y, z), not B(y)"""
ARITY = {"L": 2, "R": 2, "B": 1}


def frame(spark, tuples, n):
    return spark.createDataFrame(sorted(tuples), ", ".join(f"c{i} long" for i in range(n)))


def test_maintained_equals_complete(spark):
    rng, rules = random.Random(5), parse(RULES)
    state = {"L": {(rng.randrange(5), rng.randrange(5)) for _ in range(7)}, "R": {(rng.randrange(5), rng.randrange(5)) for _ in range(7)}, "B": {(1,)}}
    kept = I.Maintained(rules, {n: frame(spark, s, ARITY[n]) for n, s in state.items()}, ["P", "Reach"])
    seen = {t: rows(kept.read(t)) for t in ("J", "P", "Reach")}
    for _ in range(3):
        changes = {}
        for n in rng.sample(sorted(state), 2):
            more = {tuple(rng.randrange(5) for _ in range(ARITY[n])) for _ in range(2)}
            less = ({tuple(rng.randrange(5) for _ in range(ARITY[n]))} | set(rng.sample(sorted(state[n]), min(2, len(state[n]))))) - more
            changes[n] = I.delta(frame(spark, more, ARITY[n]), frame(spark, less, ARITY[n]))
            state[n] = (state[n] | more) - less
        visible = kept.advance(changes)
        full = evaluate(rules, {n: frame(spark, s, ARITY[n]) for n, s in state.items()}, *seen)
        for t in seen:
            want = rows(full[t])
            assert rows(kept.read(t)) == want
            got = {(r[:-1], r[-1]) for r in rows(visible[t])} if t in visible else set()
            assert got == {(x, 1) for x in want - seen[t]} | {(x, -1) for x in seen[t] - want}
            seen[t] = want


def test_support_counts_hide_changes_between_positive_counts(spark):
    kept = I.Maintained(parse("P(x) :- L(x, y)"), {"L": frame(spark, {(1, 1), (1, 2), (2, 1)}, 2)}, ["P"])
    out = kept.advance({"L": I.delta(None, frame(spark, {(1, 1), (2, 1)}, 2))})
    assert rows(out["P"]) == {(2, -1)} and rows(kept.support("P")) == {(1, 1)}


def test_negative_support_is_an_error(spark):
    counts = spark.createDataFrame([(1, 1)], "c0 long, w__ long")
    with pytest.raises(Exception, match="E_SUPPORT"):
        I.advance(counts, spark.createDataFrame([(1, -2)], "c0 long, w__ long")).collect()


def test_settling_drops_what_changes_nothing(spark):
    d = I.delta(frame(spark, {(1,), (2,)}, 1), frame(spark, {(2,), (3,), (4,)}, 1))
    assert rows(I.settle(d, frame(spark, {(1,), (3,)}, 1))) == {(3, -1)}


def test_traces_compact_and_stored_facts_of_derived_heads(spark, monkeypatch):
    monkeypatch.setattr(I, "COMPACT_AFTER", 1)
    rules = parse("R(x, y) :- E(x, y)\nR(x, z) :- E(x, y), R(y, z)\nQ(x) :- R(0, x)\nQ(x) :- S(x), not E(x, x)")
    state = {"E": {(0, 1), (1, 2)}, "S": {(7,), (9,)}, "R": {(0, 5)}, "Q": {(1,)}}
    size = {"E": 2, "S": 1, "R": 2, "Q": 1}
    kept = I.Maintained(rules, {n: frame(spark, s, size[n]) for n, s in state.items()}, ["Q", "R"])
    steps = [{"E": ({(2, 0)}, {(1, 2)})}, {"R": ({(5, 6)}, {(0, 5)}), "S": ({(8,)}, {(7,)})}, {"Q": (set(), {(1,)}), "E": ({(9, 9)}, {(0, 1)})}]
    for step in steps:
        kept.advance({n: I.delta(frame(spark, more, size[n]), frame(spark, less, size[n])) for n, (more, less) in step.items()})
        for n, (more, less) in step.items():
            state[n] = (state[n] | more) - less
        full = evaluate(rules, {n: frame(spark, s, size[n]) for n, s in state.items()}, "Q", "R")
        assert all(rows(kept.read(t)) == rows(full[t]) for t in ("Q", "R"))
