"""Conflict resolution by rewriting, and region evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ternary as t
from ..storage import scratch

CONSTANTS = {"neg": -1, "zero": 0, "pos": 1}
NAMES = {v: k for k, v in CONSTANTS.items()}
#: Evaluation on constants, for folding.
FOLD = {
    "mv-neg": lambda a: -a, "mv-add": lambda a, b: min(1, a + b + 1), "mv-mul": lambda a, b: max(-1, a + b - 1), "meet": min, "join": max,
    "mv-sub": lambda a, b: max(-1, a - b - 1),
    "b-add": lambda a, b: 0 if 0 in (a, b) else min(1, a + b + 1), "merge": lambda a, b, c: sorted((a, b, c))[1],
}
COMMUTES = {"mv-add": (0, 1), "mv-mul": (0, 1), "merge": (1, 2)}


def parse(text: str):
    """An expression from prefix notation: names and (op args...)."""
    words = text.replace("(", " ( ").replace(")", " ) ").split()

    def read(i):
        if words[i] != "(":
            return words[i], i + 1
        args, i = [], i + 1
        while words[i] != ")":
            x, i = read(i)
            args.append(x)
        return tuple(args), i + 1

    return read(0)[0]


def show(e) -> str:
    return e if isinstance(e, str) else "(" + " ".join(show(x) for x in e) + ")"


def normalise(e):
    """Bottom-up: constants fold, the algebra's identities apply until nothing changes, commuting arguments are sorted."""
    if isinstance(e, str):
        return e
    e = (e[0], *map(normalise, e[1:]))
    op, args = e[0], list(e[1:])
    if all(a in CONSTANTS for a in args):
        return NAMES[FOLD[op](*[CONSTANTS[a] for a in args])]
    if op in COMMUTES:
        i, j = COMMUTES[op]
        args[i], args[j] = sorted((args[i], args[j]), key=lambda x: (x not in CONSTANTS, show(x)))
    negated = lambda x: x[1] if isinstance(x, tuple) and x[0] == "mv-neg" else None
    if op == "mv-neg":
        if negated(args[0]) or (isinstance(args[0], tuple) and args[0][0] == "mv-neg"):
            return args[0][1]
        if isinstance(args[0], tuple) and args[0][0] == "mv-add":
            return normalise(("mv-mul", ("mv-neg", args[0][1]), ("mv-neg", args[0][2])))
    if op == "mv-add":
        if args[0] == "neg":
            return args[1]
        if negated(args[0]) == args[1] or negated(args[1]) == args[0]:
            return "pos"
    if op == "mv-mul" and args[0] == "pos":
        return args[1]
    if op == "merge" and args[1] == args[2]:
        return args[1]
    if op == "b-add" and "zero" in args:
        return "zero"
    if op == "meet" and args[0] in ("neg", "pos"):
        return "neg" if args[0] == "neg" else args[1]
    if op == "join" and args[0] in ("neg", "pos"):
        return "pos" if args[0] == "pos" else args[1]
    return (op, *args)


#: Operator of each rule in expressions, and how many inputs it takes: 0 for a fold of all.
OPERATORS = {"Identity": (None, 1), "MvNeg": ("mv-neg", 1), "MvAdd": ("mv-add", 2), "MvMul": ("mv-mul", 2), "MvSub": ("mv-sub", 2), "Merge": ("merge", 3), "PowerProduct": ("mv-mul", 2),
             "MeetAll": ("meet", 0), "JoinAny": ("join", 0), "BochvarFold": ("b-add", 0)}


def rule_expression(rule: str, args: list):
    """A rule over its inputs' expressions; inputs that are missing are pending."""
    op, n = OPERATORS[rule]
    if n == 0:
        out = args[0] if args else "neg"
        for x in args[1:]:
            out = (op, out, x)
        return out
    args = (args + ["neg"] * n)[:n]
    return args[0] if op is None else (op, *args)


def member_forms(members: dict[int, tuple[int, str, list[int], list[int]]]) -> dict[int, object]:
    """Normal forms of a section's members: {node: (value, rule, inputs, their values)}.

    An input node is its value; an input that is no member is a symbol, whatever its value, and is never
    rewritten; a member met again below itself is a symbol as well.
    """
    forms, open_ = {}, set()

    def form(n):
        if n in forms:
            return forms[n]
        if n in open_:
            return f"mu_{n}"
        value, rule, srcs, _ = members[n]
        if rule == "Input":
            out = NAMES[value]
        else:
            open_.add(n)
            out = normalise(rule_expression(rule, [form(s) if s in members else f"bnd_{s}" for s in srcs]))
            open_.discard(n)
        forms[n] = out
        return out

    for n in sorted(members):
        form(n)
    return forms


def settle(members: dict[int, tuple[int, str, list[int], list[int]]], oscillates: bool = False) -> tuple[str, int | None]:
    """(outcome, value) of a section: all members come to one constant that is no contest, or what stands against it."""
    forms = member_forms(members)
    found = {CONSTANTS.get(f) if isinstance(f, str) else None for f in forms.values()}
    agreed = found - {None, 0}
    if len(agreed) > 1:
        return "Structural", None
    if found and found == agreed:
        return "Accepted", agreed.pop()
    pinned = any(v == 0 for _, rule, srcs, vals in members.values() if rule != "Input" for s, v in zip(srcs, vals, strict=True) if s not in members)
    return ("Boundary" if pinned or oscillates else "Structural"), None


def normalised(expressions: DataFrame) -> DataFrame:
    """(id, expr) with the normal form of each expression and its constant, null if it is none. A region's
    expression has at most 64 nodes, so a batch at a time goes through plain Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [normalise(parse(x)) for x in b["expr"]]
            yield pd.DataFrame({"id": b["id"], "normal": [show(x) for x in out], "constant": pd.array([CONSTANTS.get(x) if isinstance(x, str) else None for x in out], dtype="Int32")})

    return expressions.select("id", "expr").mapInPandas(run, "id long, normal string, constant int")


def compliance(roots: DataFrame) -> DataFrame:
    """Regions (region, constant, pinned, oscillates) to accepted value or kind of obstruction."""
    g = roots.groupBy("region").agg(
        F.count_distinct("constant").alias("kinds"), F.max(F.col("constant").isNull()).alias("open"), F.max(F.coalesce(F.col("constant") == 0, F.lit(False))).alias("zero"),
        F.max("pinned").alias("pinned"), F.max("oscillates").alias("oscillates"), F.min("constant").alias("value"))
    ok = (F.col("kinds") == 1) & ~F.col("open") & ~F.col("zero")
    outcome = F.when(ok, "Accepted").when(F.col("kinds") > 1, "Structural").when(F.col("pinned") | F.col("oscillates"), "Boundary").otherwise("Structural")
    return g.select("region", outcome.alias("outcome"), F.when(ok, F.col("value")).alias("value"))


def section(values: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Upstream of ``seeds`` (node) through contested nodes: (node, member); others met are boundary pins.

    Without ``depth`` the section ends where no contested node leads on.
    """
    from ..plans.levels import closure

    into = edges.join(values.where("val = 0").select(F.col("node").alias("tgt")), "tgt")
    reached = closure(into.select("src", "tgt"), seeds, depth)
    r = reached.join(values, "node", "left").join(seeds.select("node", F.lit(True).alias("seed")), "node", "left")
    return r.select("node", F.coalesce(F.col("seed"), F.col("val") == 0, F.lit(False)).alias("member"))


def evaluate_region(values: DataFrame, edges: DataFrame, rules: DataFrame, levels: DataFrame) -> DataFrame:
    """Lattice evaluation (pure rules on any values, pending overwrites) of computed nodes, level by level: all values (node, val).

    ``edges`` may have ``pos``, an input's position (from 0), for rules that tell their inputs apart; without it
    inputs are in order of their identifiers. Each level writes its own nodes and reads only its inputs.
    """
    spark = values.sparkSession
    top = levels.agg(F.max("level")).first()[0] or 0
    if "pos" not in edges.columns:
        edges = edges.withColumn("pos", F.row_number().over(Window.partitionBy("tgt").orderBy("src")) - 1)
    base = scratch(spark, "region")
    schema = values.select("node", F.col("val").cast("int").alias("val")).schema
    values.select("node", F.col("val").cast("int").alias("val")).join(levels.where("level > 0"), "node", "left_anti").write.parquet(f"{base}/level=0")
    for k in range(1, top + 1):
        at = levels.where(F.col("level") == k).select(F.col("node").alias("tgt")).join(rules.withColumnRenamed("node", "tgt"), "tgt")
        now = spark.read.schema(schema).parquet(base).select(F.col("node").alias("src"), "val")
        g = at.join(edges, "tgt").join(now, "src").groupBy(F.col("tgt").alias("node"), "rule")
        out = F.lit(None).cast("int")
        for rule in t.RULES:
            out = F.when(F.col("rule") == rule, F.col(f"_{rule}")).otherwise(out)
        found = g.agg(*[t.pure(rule, F.col("val"), F.col("pos")).alias(f"_{rule}") for rule in t.RULES]).select("node", out.alias("val"))
        found.write.parquet(f"{base}/level={k}")
    return spark.read.schema(schema).parquet(base).select("node", "val")


def tree_reduce(cells: DataFrame, fanout: int, f) -> DataFrame:
    """(idx, v) reduced by groups of ``fanout`` until one cell is left: (level, idx, v)."""
    level, now, n = 0, cells, (cells.agg(F.max("idx")).first()[0] or 0) + 1
    out = None
    while n > 1:
        level += 1
        now = now.groupBy(F.floor(F.col("idx") / fanout).alias("idx")).agg(f(F.col("v")).alias("v"))
        row = now.select(F.lit(level).alias("level"), "idx", "v")
        out = row if out is None else out.union(row)
        n = -(-n // fanout)
    return out
