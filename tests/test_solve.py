"""Rewriting keeps an expression's value for every assignment."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from trivane.operators.solve import CONSTANTS, FOLD, normalise, parse, show

LEAF = st.sampled_from(["neg", "zero", "pos", "x", "y"])
EXPR = st.recursive(LEAF, lambda e: st.one_of(st.tuples(st.just("mv-neg"), e), *[st.tuples(st.just(o), e, e) for o in ("mv-add", "mv-mul", "meet", "join", "b-add")], st.tuples(st.just("merge"), e, e, e)), max_leaves=12)


def value(e, env):
    if isinstance(e, str):
        return CONSTANTS.get(e, env.get(e))
    return FOLD[e[0]](*[value(x, env) for x in e[1:]])


@settings(max_examples=300, deadline=None)
@given(EXPR)
def test_value_is_kept(e):
    n = normalise(e)
    assert parse(show(n)) == n
    for x, y in itertools.product((-1, 0, 1), repeat=2):
        assert value(e, {"x": x, "y": y}) == value(n, {"x": x, "y": y})
