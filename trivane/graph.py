"""A builder: graphs and writes in Python, evaluated by the op-log engine.

The builder appends operations to a log and hands out integer handles; ``log()`` gives the log as a DataFrame,
``result()`` what the engine makes of it (kept until the next operation). Values are read in one go, so many
operations followed by a few reads are cheap. Lazy nodes are evaluated on ``demand`` only; connecting,
disconnecting and deleting evaluate nothing.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.ternary import ALIASES, RULES
from .plans import engine

FLAGS = {True: 1, False: 0, None: -1}
#: Names that a region's declaration takes.
STABILITY, COMPILE = ("pinned", "epoch_tracked"), ("eager", "lazy", "never")


@dataclass(frozen=True)
class Handle:
    """A node; handles of equal number are equal."""

    id: int
    name: str

    def __repr__(self) -> str:
        return f"Handle({self.id}, {self.name!r})"


class Graph:
    """A log of operations on one graph."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, {}
        self.edges: dict[int, tuple[int, int]] = {}
        self.ops: list[dict] = []
        self._ids, self._edge_ids = itertools.count(), itertools.count()
        self._result: engine.Result | None = None
        self._values: dict[int, int] | None = None

    def _apply(self, op: int, **operands) -> None:
        self.ops.append({"seq": len(self.ops) + 1, "op": op, **operands})
        self._result = self._values = None

    def _known(self, *nodes: Handle) -> None:
        for n in nodes:
            if n.id not in self.names:
                raise RuntimeError(f"node {n!r} is not in this graph")

    def _add(self, name: str, rule: str) -> Handle:
        h = Handle(next(self._ids), name)
        self.names[h.id] = name
        self._apply(1, node=h.id, rule=rule)
        return h

    def input(self, name: str) -> Handle:
        return self._add(name, "Input")

    def computed(self, name: str, rule: str = "and", lazy: bool = False) -> Handle:
        rule = ALIASES.get(rule, rule)
        if rule not in RULES:
            raise ValueError(f"unknown rule {rule!r}")
        h = self._add(name, rule)
        if lazy:
            self.make_lazy(h)
        return h

    def connect(self, src: Handle, tgt: Handle) -> None:
        self._known(src, tgt)
        edge = next(self._edge_ids)
        self.edges[edge] = (src.id, tgt.id)
        self._apply(2, node=tgt.id, other=src.id, edge=edge)

    def disconnect(self, src: Handle, tgt: Handle) -> None:
        """Drop the first edge between the two; an error if there is none. The target keeps its value."""
        edge = next((k for k, e in self.edges.items() if e == (src.id, tgt.id)), None)
        if edge is None:
            raise RuntimeError("no such edge")
        self.edges.pop(edge)
        self._apply(7, edge=edge)

    def delete_node(self, node: Handle) -> None:
        """Drop a node and its edges; what depends on it keeps its value."""
        self._known(node)
        self.names.pop(node.id)
        self.edges = {k: e for k, e in self.edges.items() if node.id not in e}
        self._apply(6, node=node.id)

    def set(self, node: Handle, flag: bool | None) -> None:
        self._known(node)
        self._apply(3, node=node.id, val=FLAGS[flag])

    def make_lazy(self, node: Handle) -> None:
        self._known(node)
        self._apply(9, node=node.id, mode="Lazy")

    def make_eager(self, node: Handle) -> None:
        """From now on pushed again; the value stays until an input changes."""
        self._known(node)
        self._apply(9, node=node.id, mode="Eager")

    def demand(self, node: Handle) -> bool | None:
        """Evaluate a node now, and pending inputs before it; what is still pending leaves it as it was."""
        self._known(node)
        self._apply(8, node=node.id)
        return self.get(node)

    def stabilize(self) -> None:
        """Try to resolve all contested nodes as one section."""
        self._apply(11)

    def declare_region(self, root: Handle, max_depth: int | None = None, members: list[Handle] | None = None, stability: str = "pinned", compile: str = "eager") -> None:
        """A hint that nodes belong together: explicit members, or inputs up to ``max_depth`` (8) steps. Changes no value."""
        if stability not in STABILITY:
            raise ValueError(f"unknown stability {stability!r}; use one of {STABILITY}")
        if compile not in COMPILE:
            raise ValueError(f"unknown compile {compile!r}; use one of {COMPILE}")
        self._known(root, *(members or []))
        self._apply(18, node=root.id)

    def log(self) -> DataFrame:
        """All operations, with the engine's columns."""
        schema = ", ".join(f"{c} {k}" for c, k in engine.FIELDS.items())
        return self.spark.createDataFrame([tuple(o.get(c) for c in engine.FIELDS) for o in self.ops], schema)

    def result(self) -> engine.Result:
        if self._result is None:
            self._result = engine.run(self.log())
        return self._result

    def changes(self) -> DataFrame:
        return self.result().changes

    def values(self) -> dict[int, int]:
        """Last values by handle number; a builder's graph is small, unlike the logs that the operators take."""
        if self._values is None:
            self._values = {r["node"]: r["val"] for r in self.result().values.collect()} if self.ops else {}
        return self._values

    def get(self, node: Handle) -> bool | None:
        self._known(node)
        return {1: True, 0: False, -1: None}[self.values()[node.id]]

    def node_count(self) -> int:
        return len(self.names)

    def edge_count(self) -> int:
        return len(self.edges)

    def __repr__(self) -> str:
        return f"Graph(nodes={self.node_count()}, edges={self.edge_count()})"
