"""Bit gates, logical clocks, vector clocks and projection masks on columns.

Masks are longs used with bit operations only, so that a mask with the top bit set is one like others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clock dimensions in the order in which an advance is looked for, and their mask bits.
DIMS = {"t_identity": 1, "t_attribute": 2, "t_dependency": 4, "t_egraph": 8, "t_boundary": 16}
ALL_DIMS = 31
#: Shape bits of deltas.
PERSISTENCE, ECLASS, EMITTED = 1, 2, 4
#: Projection presets: dims, shape (null: any).
PRESETS = {"wildcard": (ALL_DIMS, None), "attribute_only": (2, None), "structural": (1 | 4, PERSISTENCE), "boundary": (16, EMITTED)}


def has_all(x, bits):
    return x.bitwiseAND(bits) == bits


def meets(x, y):
    return x.bitwiseAND(y) != 0


def flows_to(source, target):
    return source.bitwiseAND(target) == source


def allows(label, provided):
    """The label's capability bits are all provided."""
    return has_all(provided, label)


def scope_contains(scope, bits):
    return has_all(scope, bits)


def authority_reason(capability, scope, lattice, capability_got, scope_got, class_got) -> Column:
    """The first check that fails, or null: capability, then scope, then lattice."""
    return (
        F.when(~has_all(capability, capability_got), "CapabilityDenied")
        .when(~has_all(scope, scope_got), "ScopeViolation")
        .when(~flows_to(class_got, lattice), "LatticeViolation")
    )


def dominates(a: dict, b: dict) -> Column:
    """Every clock of ``a`` is at least that of ``b``."""
    out = F.lit(True)
    for d in DIMS:
        out = out & (a[d] >= b[d])
    return out


def clock_meet(a: dict, b: dict) -> dict:
    return {d: F.least(a[d], b[d]) for d in DIMS}


def clock_join(a: dict, b: dict) -> dict:
    return {d: F.greatest(a[d], b[d]) for d in DIMS}


def advanced_dim(prev: dict, now: dict) -> Column:
    """The first dimension that advanced: identity, dependency, attribute, egraph, boundary; null if none."""
    out = F.lit(None).cast("string")
    for d in reversed(["t_identity", "t_dependency", "t_attribute", "t_egraph", "t_boundary"]):
        out = F.when(now[d] > prev[d], d[2:]).otherwise(out)
    return out


def should_propagate(mask, clock: dict, seen: dict) -> Column:
    """Some masked dimension went past what was last seen."""
    out = F.lit(False)
    for d, bit in DIMS.items():
        out = out | ((mask.bitwiseAND(F.lit(bit)) != 0) & (clock[d] > seen[d]))
    return out


def vector_merge(a, b):
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def vector_dominates(a, b):
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.element_at(a, e["key"]), F.lit(0)) >= e["value"])


def vector_tick(a, partition):
    return vector_merge(a, F.create_map(partition, F.coalesce(F.element_at(a, partition), F.lit(0)) + 1))


def paths_match(a, b):
    """Two path sets meet; an empty one is a wildcard."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def affects(dims, paths, shape, d_dims, d_paths, d_shape):
    """A projection mask observes a delta."""
    return meets(dims, d_dims) & paths_match(paths, d_paths) & (shape.isNull() | meets(F.coalesce(shape, F.lit(0)), d_shape))


def covers(dims, paths, shape, dims2, paths2, shape2):
    """A mask observes all that another does: true subset of bits, of paths and of shapes."""
    return (
        has_all(dims, dims2)
        & ((F.size(paths) == 0) | ((F.size(paths2) > 0) & (F.size(F.array_except(paths2, paths)) == 0)))
        & (shape.isNull() | F.coalesce(has_all(shape, shape2), F.lit(False)))
    )


def triggers(sensitivity, observed, before, after):
    """Whether a dependency of this sensitivity reacts to an observed change of state class."""
    return observed & (
        (sensitivity == "Exact")
        | ((sensitivity == "Monotone") & (before == "Pending") & (after == "Definite"))
        | ((sensitivity == "StableOnly") & (after == "Definite"))
        | ((sensitivity == "Edge") & (before != after))
    )


def state_class(val, zero_kind):
    return F.when(zero_kind.isNotNull(), "Uncertain").when(val.isNotNull(), "Definite").otherwise("Pending")
