"""Similarity join of word-shingle sets by T-occurrence search (DivideSkip).

Two sets link when their Jaccard similarity is at least ``percent`` / 100, so they must share at least
``T = ceil(percent * (n1 + n2) / (100 + percent))`` shingles. DivideSkip divides a set's inverted lists
into short ones, which are merged, and up to T - 1 long ones, which are only probed by binary search.

1.  One pass counts shingles over all documents into a sketch, whose width follows the texts' size up to
    ``MOST_WIDTH`` (its only use is the global order "rare first", any order is correct), and reduces
    each document to (doc_id, size, fingerprint). Documents with equal sets become one node, however
    many they are. A node is named by 64 bits, unless a second 64-bit fingerprint tells that two sets
    share the name: then by the second.
2.  The index: each node enters its short lists, the ``n - ceil(p * n) + 1`` rarest shingles; at least
    one of them is shared by every linking pair. Postings travel packed, deduplicated by node before
    the shuffle; of a list that is long within one buffer a single posting does, its members are tied
    together there. So neither copies nor a shingle of many documents make a large task.
3.  Lists of up to ``LIST`` nodes are merged into candidate pairs under size and position filters. Nodes
    of longer lists form clusters, which are searched block by block inside tasks, again by T-occurrence
    search, and give only a spanning forest of links. First every block meets itself and some anchors of its
    class; nodes that are in one component by then need not meet again, so a group of near copies, however
    large, costs work in proportion to it, and no group is expanded into all pairs.
4.  T-occurrences of a candidate pair are counted on its short lists: it stays if they leave T in reach
    (at least T - L of them, DivideSkip's merge threshold); what is left is verified on whole sets by
    binary probes. Components follow.

Nothing is capped or sampled. Shingles are compared by 64-bit hashes: the result is exact unless two
different shingles of two compared documents, or both fingerprints of two different sets, agree by chance.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, lean, partitions, plan_bytes, written
from .components import components
from .textops import U, chunks, gram_sets, mix

#: Counters of the frequency sketch, at least and at most, and the rows that they travel in.
LEAST_WIDTH, MOST_WIDTH, SLICES = 1 << 20, 1 << 23, 128
#: Bytes of text for each counter, and for each partition of the token space.
COUNTER_BYTES, PART_BYTES = 16, 64 << 20
#: Longer lists are joined in blocks of so many nodes.
LIST, BLOCK = 48, 256
ROWS = 2000
FLUSH_BYTES = 8 << 20


def need(n1, n2, percent: int):
    """Smallest overlap of linking sets of these sizes."""
    return -(-percent * (n1 + n2) // (100 + percent))


def fingerprint(s: np.ndarray, salt: int = 0x51ED270B) -> int:
    """One 64-bit value of a sorted distinct set; another salt gives an independent one."""
    if not len(s):
        return 0
    return int(mix((mix(s + U(salt)).sum(dtype=U) + U(len(s)))[None])[0].view(np.int64))


def second(s: np.ndarray) -> int:
    return fingerprint(s ^ U(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F)


def _name(s: np.ndarray, shared: frozenset) -> int:
    """A set's node: its fingerprint, or the second one if the first is shared by different sets."""
    fp = fingerprint(s)
    return second(s) if fp in shared else fp


def sketch_width(nbytes: int) -> int:
    """Counters for texts of so many bytes: a power of two."""
    return min(max(LEAST_WIDTH, 1 << max(0, nbytes // COUNTER_BYTES).bit_length()), MOST_WIDTH)


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, set, text bytes) of a batch's texts."""
    col = batch.column(batch.schema.get_field_index("text"))
    for i, _, data, off in chunks(col):
        for k, s in enumerate(gram_sets(data, off, shingle)):
            yield i + k, s, int(off[k + 1] - off[k])


def _nodes_and_counts(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(width, np.uint32)
        for b in batches:
            ns, fps, more = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, s, _ in _sets(b, shingle):
                ns[i], fps[i], more[i] = len(s), fingerprint(s), second(s) if len(s) else 0
                np.add.at(counts, (s & U(width - 1)).astype(np.int64), np.uint32(1))
            none = pa.nulls(b.num_rows, pa.int32())
            yield _batch(schema, b.column(b.schema.get_field_index("doc_id")), ns, fps, more, none, pa.nulls(b.num_rows, pa.binary()))
        # A task's counts travel as bytes: what exceeds them is frequent enough to come last.
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)
        keep = [k for k in range(SLICES) if parts[k].any()]
        if keep:
            n = pa.nulls(len(keep), pa.int64())
            yield _batch(schema, n, n, n, n, keep, [zlib.compress(parts[k].tobytes(), 1) for k in keep])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, fp long, fp2 long, slice int, counts binary")


def _add(kind):
    """Sum sketch slices of counters of ``kind`` as they stream by; memory is that of one sketch."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(c.as_buffer()), kind).astype(np.uint32)
                total[k] = np.minimum(total[k], np.uint32(1 << 31)) + np.minimum(x, np.uint32((1 << 31) - 1)) if k in total else x
        if total:
            yield _batch(schema, list(total), [zlib.compress(v.tobytes(), 1) for v in total.values()])

    return run


def _levels(rows: DataFrame, width: int) -> np.ndarray:
    """Logarithmic counts, one byte a counter: at most ``MOST_WIDTH`` whatever the corpus."""
    p = partitions(rows.sparkSession)
    rows = rows.select("slice", "counts").withColumn("salt", F.floor(F.spark_partition_id() / 64)).repartition(p, "slice", "salt").drop("salt")
    rows = rows.mapInArrow(lean(_add(np.uint8)), "slice int, counts binary").repartition(p, "slice").mapInArrow(lean(_add(np.uint32)), "slice int, counts binary")
    out = np.zeros((SLICES, width // SLICES), np.uint8)
    for r in rows.toLocalIterator():  # at most SLICES rows
        x = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
        out[r["slice"]] = np.ceil(2 * np.log2(1.0 + x.astype(np.float32))).astype(np.uint8)
    return out.reshape(-1)


def _postings(docs: DataFrame, shingle: int, percent: int, levels, shared: frozenset, parts: int) -> DataFrame:
    """Short-list entries, packed by partition of the token space: columns p, token, fp, n, pos.

    Rows without token tie nodes together (fp to n). A size of 0 marks a posting that stands for a long list.
    """
    schema = pa.schema([("p", pa.int32()), ("token", pa.binary()), ("fp", pa.binary()), ("n", pa.binary()), ("pos", pa.binary())])

    def flush(held):
        token, fp, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((fp, token))
        token, fp, n, pos = token[order], fp[order], n[order], pos[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(start, len(token)))
        long, head = np.repeat(count > LIST, count), np.repeat(start, count)
        first = head == np.arange(len(token))
        if long.any():
            tied = long & ~first
            edges = np.unique(np.stack([fp[head[tied]], fp[tied]], 1), axis=0)
            yield _batch(schema, [int(mix(edges[:1, 0].view(U))[0] % U(parts))], pa.nulls(1, pa.binary()), [edges[:, 0].tobytes()], [edges[:, 1].tobytes()], pa.nulls(1, pa.binary()))
            n[long] = 0
            keep = ~long | first
            token, fp, n, pos = token[keep], fp[keep], n[keep], pos[keep]
        p = (mix(token) % U(parts)).astype(np.int32)
        order = np.argsort(p, kind="stable")
        cuts = np.flatnonzero(np.diff(p[order], prepend=-1))
        ends = [*cuts[1:].tolist(), len(p)]
        cols = [[x[order[a:b]].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)] for x in (token, fp, n, pos)]
        yield _batch(schema, p[order][cuts], *cols)

    def run(batches):
        level = levels.value
        held, seen, size = [], set(), 0
        for b in batches:
            for _, s, nbytes in _sets(b, shingle):
                size += nbytes
                if len(s) and (fp := _name(s, shared)) not in seen:
                    seen.add(fp)
                    q = _short(s, level, percent)
                    held.append((q, np.full(len(q), fp, np.int64), np.full(len(q), len(s), np.int32), np.arange(len(q), dtype=np.int32)))
                if size >= FLUSH_BYTES:
                    if held:
                        yield from flush(held)
                    held, seen, size = [], set(), 0
        if held:
            yield from flush(held)

    return docs.select("text").mapInArrow(lean(run), "p int, token binary, fp binary, n binary, pos binary")


def _merge(percent: int):
    """Merge the short lists of a partition of the token space: candidate pairs and long-list members."""
    schema = pa.schema([("long", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        tied = pc.is_null(t["token"])
        out = []
        for x, y in zip(t["fp"].filter(tied), t["n"].filter(tied), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            out.append(_batch(schema, np.ones(len(a), bool), a, b))
        t = t.filter(pc.invert(tied))
        if not t.num_rows:
            return pa.Table.from_batches(out, schema)
        token, fp, n, pos = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[c]]) for c, kind in (("token", np.uint64), ("fp", np.int64), ("n", np.int32), ("pos", np.int32)))
        order = np.lexsort((n, fp, token))  # of equal entries the mark of a long list comes first
        token, fp, n, pos = token[order], fp[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
        token, fp, n, pos = token[keep], fp[keep], n[keep], pos[keep]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(start, len(token)))
        size = np.repeat(np.where(np.minimum.reduceat(n, start) == 0, LIST + 1, count), count)
        # Long lists: each member with the list's first.
        at = size > LIST
        if at.any():
            edges = np.unique(np.stack([np.repeat(fp[start], count)[at], fp[at]], 1), axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            out.append(_batch(schema, np.ones(len(edges), bool), edges[:, 0], edges[:, 1]))
        at = (size > 1) & (size <= LIST)
        token, fp, n, pos = token[at], fp[at], n[at], pos[at]
        found = []
        for d in range(1, LIST):
            i = np.flatnonzero(token[d:] == token[:-d]) if len(token) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + d
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            left = np.minimum(n[i] - pos[i], n[j] - pos[j])
            ok = (100 * low >= percent * high) & (left >= need(n[i], n[j], percent))
            found.append(np.stack([fp[i[ok]], fp[j[ok]]], 1))  # sorted by fp within a list
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            out.append(_batch(schema, np.zeros(len(pairs), bool), pairs[:, 0], pairs[:, 1]))
        return pa.Table.from_batches(out, schema)

    return run


def links_of(sets: list[np.ndarray], percent: int, across: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among ``sets``: T-occurrence search with DivideSkip.

    ``across`` gives each set's side (0 or 1); with it only pairs of different sides are sought.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sets) or not sizes.sum():
        return
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    tokens, starts = np.unique(flat[order], return_index=True)
    owner = owner[order]  # inverted lists, each sorted by owner
    ends = np.append(starts[1:], len(flat))
    root = np.arange(len(sets))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q in np.argsort(sizes, kind="stable").tolist():
        n = int(sizes[q])
        if not n:
            continue
        low = -(-percent * n // 100)
        least = need(n, low, percent)  # the overlap that the smallest partner needs
        k = np.searchsorted(tokens, sets[q])
        length = ends[k] - starts[k]
        by = np.argsort(length, kind="stable")
        # Divide: the longest lists are probed, as many as DivideSkip's rule of thumb allows.
        skip = min(least - 1, int(least / (0.01 * np.log2(max(2, int(length.max()))) + 1)))
        short, long = k[by[: n - skip]], k[by[n - skip :]]
        merged = np.concatenate([owner[starts[x] : ends[x]] for x in short.tolist()]) if len(short) else np.zeros(0, np.int32)
        seen = np.bincount(merged, minlength=len(sets))
        cand = np.flatnonzero(seen >= max(1, least - skip))
        cand = cand[(cand != q) & (sizes[cand] >= low) & ((sizes[cand] < n) | (sizes[cand] == n) & (cand < q))]
        if across is not None:
            cand = cand[across[cand] != across[q]]
        if not len(cand):
            continue
        total = seen[cand].astype(np.int64)
        bound = need(n, sizes[cand], percent)
        left = len(long)
        for x in long.tolist():  # probe, dropping what can no longer reach its bound
            left -= 1
            run = owner[starts[x] : ends[x]]
            at = np.searchsorted(run, cand)
            total += (at < len(run)) & (run[np.minimum(at, len(run) - 1)] == cand)
            if left % 16 == 0:
                ok = total + left >= bound
                cand, total, bound = cand[ok], total[ok], bound[ok]
                if not len(cand):
                    break
        for c in cand[total >= bound].tolist() if len(cand) else []:
            a, b = find(q), find(c)
            if a != b:
                root[a] = b
                yield q, c


def _short(s: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """A set's short lists: its rarest shingles in the global order."""
    order = np.argsort(level[(s & U(len(level) - 1)).astype(np.int64)], kind="stable")
    return s[order[: len(s) - (percent * len(s) + 99) // 100 + 1]]


def _reach(percent: int, levels):
    """DivideSkip's merge threshold: keep pairs whose shared short lists leave the overlap in reach.

    The set whose short lists end first in the global order has all its other shared shingles among
    its long lists, so the overlap is at most the shared short lists and the number of those.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        level = levels.value
        for t in batches:
            a, b, na, nb, qa, qb = (t.column(i) for i in range(6))
            sizes = zip(na.to_pylist(), nb.to_pylist(), strict=True)
            ok = []
            for i, (m, n) in enumerate(sizes):
                x, y = np.frombuffer(qa[i].as_buffer(), U), np.frombuffer(qb[i].as_buffer(), U)
                ends = [(level[int(q[-1] & U(len(level) - 1))], q[-1]) for q in (x, y)]
                rest = m - len(x) if ends[0] <= ends[1] else n - len(y)
                ok.append(len(np.intersect1d(x, y, assume_unique=True)) + rest >= need(m, n, percent))
            keep = pa.array(ok, pa.bool_())
            yield _batch(schema, a.filter(keep), b.filter(keep))

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            a, c, sa, sc = (b.column(i) for i in range(4))
            ok = []
            for i in range(b.num_rows):
                x, y = np.frombuffer(sa[i].as_buffer(), U), np.frombuffer(sc[i].as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(shared >= need(len(x), len(y), percent))
            m = pa.array(ok, pa.bool_())
            yield _batch(schema, a.filter(m), c.filter(m))

    return run


def jaccard_groups(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of non-white-space after lower-casing A-Z. A set is a text's distinct word n-grams,
    the whole sequence if it has fewer words. A null, empty or blank text has an empty set, links
    with nothing and is its own component. component_id is the smallest doc_id of the component (a
    null doc_id never is, unless alone). Repeated rows give repeated rows. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    nbytes = plan_bytes(docs.select("text"))
    width, parts = sketch_width(nbytes), max(8 * partitions(spark), nbytes // PART_BYTES)
    with arrow_rows(spark, ROWS):
        first = written(_nodes_and_counts(docs, shingle, width), "jaccard-nodes")
        nodes = first.where("slice is null").select("doc_id", "n", "fp", "fp2")
        levels = spark.sparkContext.broadcast(_levels(first.where("slice is not null"), width))
        classes = nodes.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), (F.min("fp2") != F.max("fp2")).alias("shared"))
        classes = written(classes, "jaccard-classes")
        # Fingerprints that different sets share: none in all likelihood, a handful in 10^10 documents.
        shared = frozenset(r["fp"] for r in classes.where("shared").select("fp").collect())
        if shared:
            nodes = written(nodes.withColumn("fp", F.when(F.col("fp").isin(list(shared)), F.col("fp2")).otherwise(F.col("fp"))), "jaccard-named")
            classes = written(nodes.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "jaccard-classes")
        merged = _postings(docs, shingle, percent, levels, shared, parts).groupBy("p").applyInArrow(_merge(percent), "long boolean, a long, b long")
        merged = written(merged.distinct(), "jaccard-merged")
        pairs, hot = merged.where("not long").select("a", "b"), merged.where("long").select("a", "b")
        ends = merged.select(F.col("a").alias("fp")).union(merged.select("b")).distinct()
        wanted = written(ends.join(classes, "fp"), "jaccard-wanted")
        sets = _sets_of(docs, wanted, shingle, percent, levels, shared)
        head = lambda c: sets.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("q").alias(f"q{c}"))
        near = pairs.join(head("b"), "b").join(head("a"), "a").select("a", "b", "na", "nb", "qa", "qb")
        pairs = written(near.mapInArrow(lean(_reach(percent, levels)), "a long, b long"), "jaccard-near")
        whole = _only(sets, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")))
        side = lambda c: whole.select(F.col("fp").alias(c), F.col("s").alias(f"s{c}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
        links = both.mapInArrow(lean(_verify(percent)), "a long, b long")
        if not hot.isEmpty():
            links = links.union(_block_links(hot, wanted, sets, percent))
        links = written(links, "jaccard-links")
        levels.destroy()
    roots = components(links)
    known = classes.join(roots, classes.fp == roots.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = written(known.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id"), "jaccard-label")
    out = nodes.join(label, (nodes.fp == label._fp) & (nodes.n > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, percent: int, levels, shared: frozenset) -> DataFrame:
    """(fp, n, q, s): size, short lists and set of each wanted node, from its document of smallest doc_id."""
    schema = pa.schema([("id", pa.int64()), ("f", pa.int64()), ("n", pa.int64()), ("q", pa.binary()), ("s", pa.binary())])

    def run(batches):
        level = levels.value
        for b in batches:
            ids = b.column(0).to_pylist()
            rows, size = [], 0
            for i, s, _ in _sets(b, shingle):
                if len(s):
                    rows.append((ids[i], _name(s, shared), len(s), _short(s, level, percent).tobytes(), s.tobytes()))
                    size += s.nbytes
                if size > 4 << 20:
                    yield _batch(schema, *zip(*rows, strict=True))
                    rows, size = [], 0
            if rows:
                yield _batch(schema, *zip(*rows, strict=True))

    ids = written(wanted.select(F.col("doc_id").alias("_wanted")).distinct(), "jaccard-ids")  # of known size: broadcast if small
    some = docs.select("doc_id", "text").join(ids, docs.doc_id.eqNullSafe(F.col("_wanted")), "left_semi")
    found = written(some.mapInArrow(lean(run), "id long, f long, n long, q binary, s binary"), "jaccard-sets")
    # Nodes met in several documents (repeated rows, rows that share a doc_id) keep one.
    twice = found.groupBy("f").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first")).where("rows > 1")
    if not twice.isEmpty():
        twice = written(twice.select(F.col("f").alias("t"), "first"), "jaccard-twice")
        many = found.join(twice, found.f == twice.t).where(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["f"]).select("f", "n", "q", "s")
        found = written(found.join(twice, found.f == twice.t, "left_anti").select("f", "n", "q", "s").union(many), "jaccard-sets")
    return found.select(F.col("f").alias("fp"), "n", "q", "s")


def _only(sets: DataFrame, fps: DataFrame) -> DataFrame:
    """``sets`` of ``fps`` (fp). Few are known where sets are read; many leave them dealt by fp, as the next join wants them."""
    return sets.join(written(fps.distinct(), "jaccard-only"), "fp", "left_semi")


def _block_links(hot: DataFrame, wanted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within clusters of long-list members, block against block.

    A cluster of at most two blocks is one group. Larger ones are split by size class, whose neighbours alone
    can link, and by hash within a class, so a cluster of any size becomes bounded groups. Two rounds: every
    block meets itself and some anchors of its class; then, of each cluster, what is not in its largest
    component meets everything.
    """
    cluster = written(components(hot), "jaccard-clusters")
    ratio = float(np.log(100 / percent)) if percent < 100 else 1.0
    size_class = F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int")
    m = written(cluster.join(wanted.select("fp", "n"), cluster.node == F.col("fp")).select("fp", F.col("root").alias("cluster"), size_class.alias("g")), "jaccard-members")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key = lambda g1, i, g2, j, side: F.struct(g1.alias("g1"), i.alias("i"), g2.alias("g2"), j.alias("j"), side.cast("int").alias("side"))
    g, i = F.col("g"), F.col("i")

    def blocks(members: DataFrame) -> DataFrame:
        """``members`` and their block: i of ``blocks`` in their class."""
        sizes = written(members.groupBy("cluster", "g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "jaccard-blocks")
        return members.join(sizes, ["cluster", "g"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), sizes

    def search(t: pa.Table) -> pa.Table:
        fp = t["fp"].to_pylist()
        side = t["side"].to_numpy()
        found = list(links_of([np.frombuffer(x.as_buffer(), U) for x in t["s"].combine_chunks()], percent, None if (side < 0).all() else side))
        return pa.table([pa.array([fp[a] for a, _ in found], pa.int64()), pa.array([fp[b] for _, b in found], pa.int64())], schema=schema)

    def met(name: str, *keyed: DataFrame) -> DataFrame:
        """Links within the groups of all of ``keyed``, whose whole sets are fetched once."""
        rows = [d.select("fp", "cluster", F.lit(n).alias("kind"), F.explode("k").alias("k")).select("fp", "cluster", "kind", "k.*") for n, d in enumerate(keyed)]
        rows = written(functools.reduce(DataFrame.union, rows), "jaccard-groups")
        return written(rows.join(_only(sets, rows.select("fp")).select("fp", "s"), "fp").groupBy("kind", "cluster", "g1", "i", "g2", "j").applyInArrow(search, "a long, b long"), name)

    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    zero, minus = F.lit(0), F.lit(-1)
    total = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("total"))
    m = written(m.join(total, "cluster").withColumn("large", F.col("total") > 2 * BLOCK).drop("total"), "jaccard-members", replaces=m)
    large = m.where("large").drop("large")
    small = m.where("not large").withColumn("k", F.array(key(minus, zero, minus, zero, minus)))
    if large.isEmpty():
        return met("jaccard-small", small)
    # Anchors of a class, about a quarter of a block, are in all its blocks.
    first, _ = blocks(large)
    anchor = F.pmod(F.xxhash64("fp", F.lit(1)), 4 * F.col("blocks")) == 0
    places = F.when(anchor, F.transform(upto(F.col("blocks")), lambda j: key(g, j, g, j, minus))).otherwise(F.array(key(g, i, g, i, minus)))
    links = met("jaccard-near", small, first.withColumn("k", places))
    m = large
    # In what follows two members of a cluster's largest component need not meet.
    known = m.join(components(links), F.col("node") == F.col("fp"), "left").select("fp", "cluster", "g", F.coalesce("root", "fp").alias("root"))
    known = written(known, "jaccard-known")
    most = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "root")).alias("top")).select("cluster", F.col("top.root").alias("top"))
    known = written(known.join(most, "cluster").select("fp", "cluster", "g", (F.col("root") == F.col("top")).alias("in_top")), "jaccard-sides")
    rest, counts = blocks(known.where("not in_top").select("fp", "cluster", "g"))
    counts = counts.select("cluster", "g", "blocks")
    around = lambda k, name: counts.select("cluster", (F.col("g") + k).alias("g"), F.col("blocks").alias(name))
    # What is left among itself: blocks of a class, and of a class with the next one.
    pairs = rest.join(around(-1, "above"), ["cluster", "g"], "left").join(around(1, "below"), ["cluster", "g"], "left")
    same = F.transform(upto(F.col("blocks")), lambda j: key(g, F.least(i, j), g, F.greatest(i, j), F.when(i == j, -1).when(i < j, 0).otherwise(1)))
    up = F.transform(upto(F.coalesce("above", zero)), lambda j: key(g, i, g + 1, j, zero))
    down = F.transform(upto(F.coalesce("below", zero)), lambda j: key(g - 1, j, g, i, F.lit(1)))
    among = pairs.withColumn("k", F.concat(same, up, down))
    # What is left with the largest component: blocks of one side with those of the other, three classes wide.
    top, sizes = blocks(known.where("in_top").select("fp", "cluster", "g"))
    there = sizes.select("cluster", "g", F.col("blocks").alias("there"))
    near = lambda t, d: t.withColumn("d", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)]))).withColumn("to", F.col("g") + d * F.col("d"))
    left = near(rest, 1).join(there.withColumnRenamed("g", "to"), ["cluster", "to"])
    left = left.withColumn("k", F.transform(upto(F.col("there")), lambda j: key(g, i, F.col("to"), j, zero)))
    here = counts.select("cluster", F.col("g").alias("to"), F.col("blocks").alias("here"))
    right = near(top, 1).join(here, ["cluster", "to"])
    right = right.withColumn("k", F.transform(upto(F.col("here")), lambda j: key(F.col("to"), j, g, i, F.lit(1))))
    across = left.select("fp", "cluster", "k").union(right.select("fp", "cluster", "k"))
    return links.union(met("jaccard-rest", among, across))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    t AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
    c AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.b, r.root FROM r JOIN c ON c.a = r.doc_id)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
    FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
