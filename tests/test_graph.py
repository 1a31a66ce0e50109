"""Small graphs with known values, and the level engine against a plain fold."""

import random

import pytest

from trivane.graph import Graph
from trivane.plans import levels


def build(spark, rule, n):
    g = Graph(spark)
    ins = [g.input(f"i{k}") for k in range(n)]
    out = g.computed("out", rule)
    for i in ins:
        g.connect(i, out)
    return g, ins, out


CASES = [
        ("MvMul", 2, [(0, True)], None), ("MvMul", 2, [(0, True), (1, True)], True), ("MvAdd", 2, [(1, True), (0, False)], False), ("and", 2, [(0, True), (1, False)], False),
        ("or", 2, [(0, True)], None), ("or", 2, [(0, True), (1, True)], True), ("not", 1, [(0, True)], None), ("not", 1, [(0, False)], False), ("id", 1, [(0, True), (0, False), (0, None)], False),
]


def test_push(spark):
    """All cases in one graph, so that it is evaluated once."""
    g, outs = Graph(spark), []
    for rule, n, writes, _ in CASES:
        ins = [g.input(f"i{k}") for k in range(n)]
        outs.append(g.computed("out", rule))
        for i in ins:
            g.connect(i, outs[-1])
        for k, v in writes:
            g.set(ins[k], v)
    assert [g.get(x) for x in outs] == [want for *_, want in CASES]


def test_glitch_free(spark):
    g = Graph(spark)
    n0 = g.input("0")
    n1, n2, n3 = g.computed("1", "Identity"), g.computed("2", "MeetAll"), g.computed("3", "JoinAny")
    for a, b in ((n0, n1), (n0, n2), (n1, n2), (n2, n3)):
        g.connect(a, b)
    g.set(n0, False)
    g.set(n0, True)
    assert [g.get(x) for x in (n1, n2, n3)] == [True] * 3


def test_chain_amplification(spark):
    """A chain of relays under alternating writes: later pending writes are held back."""
    depth = 6
    edges = spark.createDataFrame([(k, k + 1) for k in range(depth)], "src long, tgt long")
    rules = spark.createDataFrame([(k + 1, "Identity") for k in range(depth)], "node long, rule string")
    writes = spark.createDataFrame([(s, 0, 1 if s % 2 == 0 else -1) for s in range(20)], "seq long, node long, val int")
    log = levels.propagate(writes, rules, edges)
    assert levels.amplification(log).first()["changes"] == 20 + depth
    same = spark.createDataFrame([(s, 0, 1) for s in range(20)], "seq long, node long, val int")
    assert levels.propagate(same, rules, edges).count() == 1 + depth


def test_cycle_is_found(spark):
    with pytest.raises(levels.StepLimitExceeded):
        levels.levels(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, tgt long"))


def test_lazy_and_structure(spark):
    g, (a,), out = build(spark, "id", 1)
    g.make_lazy(out)
    g.set(a, True)
    assert g.get(out) is None and g.demand(out) is True
    # A second pair: what is cut off keeps its value; what is connected later is not evaluated by that.
    b, cut, late = g.input("b"), g.computed("cut", "id"), g.computed("late", "id")
    g.connect(b, cut)
    g.set(b, True)
    g.disconnect(b, cut)
    g.set(b, False)
    g.connect(b, late)
    gone = g.input("gone")
    g.delete_node(gone)
    assert g.input("next").id == gone.id + 1
    with pytest.raises(RuntimeError):
        g.disconnect(b, cut)
    for use in (lambda: g.set(gone, True), lambda: g.get(gone), lambda: g.connect(gone, cut)):
        with pytest.raises(RuntimeError):
            use()
    assert g.get(cut) is True and g.get(late) is None and g.edge_count() == 2 and g.node_count() == 6


def test_regions_and_stabilize(spark):
    """Regions are hints; stabilizing takes a contested node to what its expression folds to."""
    g, (a, b), out = build(spark, "and", 2)
    g.declare_region(out, members=[a, b, out], stability="epoch_tracked", compile="lazy")
    for wrong in ({"stability": "none"}, {"compile": "none"}):
        with pytest.raises(ValueError):
            g.declare_region(out, **wrong)
    g.set(a, True)
    g.set(b, True)
    g.set(b, None)
    free = g.computed("free", "MvMul")
    g.set(free, False)
    g.stabilize()
    assert g.get(out) is True and g.get(free) is None and Graph(spark).values() == {}
    empty = Graph(spark)
    empty.stabilize()
    assert empty.values() == {}


def fold(writes, rules, edges):
    """One write after the other, nodes in order of level."""
    ready = {"Identity": 1, "MeetAll": 1, "JoinAny": 1, "MvNeg": -1, "BochvarFold": 1}
    deps, val, log = {}, {}, []
    for s, t in edges:
        deps.setdefault(t, []).append(s)
    for seq, node, v in writes:
        if val.get(node, -1) == v:
            continue
        log.append((node, seq, val.get(node, -1), v))
        val[node], moved = v, {node}
        for t in sorted(deps):
            if moved & set(deps[t]):
                d = [val.get(s, -1) for s in deps[t]]
                new = 0 if 0 in d else val.get(t, -1) if -1 in d else ready[rules[t]]
                if new != val.get(t, -1):
                    log.append((t, seq, val.get(t, -1), new))
                    val[t] = new
                    moved.add(t)
    return sorted(log)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 4
    rules = {n + k: r.choice(["Identity", "MeetAll", "JoinAny", "MvNeg", "BochvarFold"]) for k in range(6)}
    edges = [(s, t) for t in rules for s in r.sample(range(t), min(t, r.randint(1, 3)))]
    writes = [(s, r.randrange(n), r.choice([-1, 0, 1, 1])) for s in range(40)]
    got = levels.propagate(spark.createDataFrame(writes, "seq long, node long, val int"), spark.createDataFrame(list(rules.items()), "node long, rule string"), spark.createDataFrame(edges, "src long, tgt long"))
    assert sorted((x.node, x.seq, x.old, x.val) for x in got.collect()) == fold(writes, rules, edges)
