"""Three-valued algebra on columns that hold -1 (pending), 0 (contested) and 1 (present).

Everything is integer arithmetic on built-in functions, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG, ZERO, POS = -1, 0, 1


def _int(c: Column) -> Column:
    return c.cast("int")


def mv_neg(x):
    return _int(-x)


def mv_add(x, y):
    return _int(F.least(F.lit(1), x + y + 1))


def mv_mul(x, y):
    return _int(F.greatest(F.lit(-1), x + y - 1))


def mv_sub(x, y):
    return _int(F.greatest(F.lit(-1), x - y - 1))


def mv_impl(x, y):
    return _int(F.least(F.lit(1), y - x + 1))


def meet(x, y):
    return _int(F.least(x, y))


def join(x, y):
    return _int(F.greatest(x, y))


def median(x, y, z):
    return _int(x + y + z - F.greatest(x, y, z) - F.least(x, y, z))


def merge(base, left, right):
    return median(base, left, right)


def _infect(x, y, other):
    return F.when((x == 0) | (y == 0), F.lit(0)).otherwise(other)


def bochvar_add(x, y):
    return _infect(x, y, mv_add(x, y))


def bochvar_mul(x, y):
    return _infect(x, y, mv_mul(x, y))


def bochvar_meet(x, y):
    return _infect(x, y, meet(x, y))


def is_ready(x):
    return x == 1


def is_conflicted(x):
    return x == 0


def is_pending(x):
    return x == -1


def from_flag(flag):
    """True is 1, false 0, null -1."""
    return F.when(flag.isNull(), -1).when(flag, 1).otherwise(0)


def to_flag(x):
    return F.when(x == 1, F.lit(True)).when(x == 0, F.lit(False))


def from_wire(code):
    """The value of a wire code, null for codes that are none."""
    return F.when(code.isin(-1, 0, 1), _int(code))


def display(x):
    return F.when(x == -1, "-1").when(x == 0, " 0").when(x == 1, "+1")


# Folds over groups. Each is a combination of partial aggregates.


def meet_all(v):
    return _int(F.coalesce(F.min(v), F.lit(1)))


def join_any(v):
    return _int(F.coalesce(F.max(v), F.lit(-1)))


def fold_add(v):
    return _int(F.when(F.max(F.when(v == 0, 1).otherwise(0)) == 1, 0).otherwise(F.coalesce(F.max(v), F.lit(-1))))


def propagation_state(v):
    return F.when(F.max(F.when(v == 0, 1).otherwise(0)) == 1, "Conflicted").when(F.coalesce(F.min(v), F.lit(1)) == 1, "Ready").otherwise("Pending")


def quiescent(v):
    return F.coalesce(F.min(v) >= 0, F.lit(True))


def counters(v) -> list[Column]:
    """neg, zero and pos: how many inputs hold each value."""
    return [F.count(F.when(v == k, 1)).alias(n) for n, k in (("neg", -1), ("zero", 0), ("pos", 1))]


def aggregate_of(neg, zero):
    """The value that counters stand for: contested before pending."""
    return F.when(zero > 0, 0).when(neg > 0, -1).otherwise(1)


#: Rules by name, with their wire byte.
RULES = {"Identity": 1, "MvNeg": 2, "MvAdd": 3, "MvMul": 4, "MvSub": 5, "Merge": 6, "MeetAll": 7, "JoinAny": 8, "BochvarFold": 9, "PowerProduct": 10}
#: Inputs that a rule needs, and its value when all inputs are present.
ARITY = {"Identity": 1, "MvNeg": 1, "MvAdd": 2, "MvMul": 2, "MvSub": 2, "Merge": 3, "MeetAll": 0, "JoinAny": 0, "BochvarFold": 0, "PowerProduct": 2}
READY = {"Identity": 1, "MvNeg": -1, "MvAdd": 1, "MvMul": 1, "MvSub": -1, "Merge": 1, "MeetAll": 1, "JoinAny": 1, "BochvarFold": 1, "PowerProduct": 1}
#: Names that the builder accepts for rules.
ALIASES = {"and": "MeetAll", "all": "MeetAll", "or": "JoinAny", "any": "JoinAny", "not": "MvNeg", "neg": "MvNeg", "majority": "Merge", "fold": "BochvarFold", "bochvar": "BochvarFold", "identity": "Identity", "id": "Identity"}


def pure(rule: str, v, pos) -> Column:
    """A rule over a group's values in their positions from 0, on any values; -1 if there are too few."""
    at = lambda k: F.max(F.when(pos == k, v))
    least = lambda c: _int(F.coalesce(c, F.lit(-1)))
    return {
        "Identity": lambda: least(at(0)),
        "MvNeg": lambda: least(mv_neg(at(0))),
        "MvAdd": lambda: least(F.when(at(1).isNotNull(), mv_add(at(0), at(1)))),
        "MvMul": lambda: least(F.when(at(1).isNotNull(), mv_mul(at(0), at(1)))),
        "MvSub": lambda: least(F.when(at(1).isNotNull(), mv_sub(at(0), at(1)))),
        "Merge": lambda: least(F.when(at(2).isNotNull(), median(at(0), at(1), at(2)))),
        "MeetAll": lambda: meet_all(v),
        "JoinAny": lambda: join_any(v),
        "BochvarFold": lambda: fold_add(v),
        "PowerProduct": lambda: least(F.when(at(1).isNotNull(), mv_mul(at(0), at(1)))),
    }[rule]()


def ready_value(rule: Column, n_deps: Column) -> Column:
    """The value of a node whose inputs are all present, by rule name and number of inputs."""
    out = F.lit(None).cast("int")
    for name, n in ARITY.items():
        empty = -1 if name in ("JoinAny", "BochvarFold") else 1
        value = F.when(n_deps == 0, empty).otherwise(READY[name]) if n == 0 else F.when(n_deps >= n, READY[name]).otherwise(-1)
        out = F.when(rule == name, value).otherwise(out)
    return out


def gated(rule: Column, neg: Column, zero: Column, n_deps: Column) -> Column:
    """What a push evaluates to: 0 if any input is contested, null (keep the old value) if any is
    pending, else the rule's value."""
    return F.when(zero > 0, F.lit(0)).when(neg > 0, F.lit(None).cast("int")).otherwise(ready_value(rule, n_deps))
