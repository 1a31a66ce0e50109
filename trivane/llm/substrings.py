"""Exact substring dedup by level-wise doubling of repeated word windows.

A window of ``window`` words is removed from a document if the same word sequence also starts in a
document with a smaller doc_id. Windows are sought level by level. Lengths double up to the wanted
one (for 13: 7, then 13, twice seven overlapping in one word); only windows repeated at one length
are extended to the next, and the search ends when no candidates survive.

The first level is thinned without loss: of the 7-word windows within each 13-word window the one of
smallest hash is its anchor, equal 13-word windows have equal anchors, so about a quarter of all
windows is looked at. Each level is one exchange: documents send their distinct window hashes, packed
by partition of the hash space, and get back one bit for each, gathered by sending buffer. A hash that several documents of one
buffer share is settled there and sent once, so a passage in a third of all documents costs one entry
a buffer, not one a document. Spark groups (and spills) what is dealt, a partition of the hash space or a
buffer's answers at a time reach Python; there are the more partitions the larger the texts are.

Earlier levels only choose candidates and use 64-bit hashes. The last one, which decides, uses two independent
hashes of words and windows, 128 bits: of 10^14 windows any two that differ agree with a probability below 10^-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bound_batches, lean, partitions, plan_bytes, written
from .jaccard import _batch
from .textops import U, chunks, grams, mix, word_hashes, word_spans

ROWS = 1000
FLUSH_BYTES = 12 << 20
#: Bytes of text, at most, for which there is one partition of the hash space; about a third of that is sent to it.
PART_BYTES = 32 << 20
#: A null doc_id counts as larger than all others.
NULL_ID = np.iinfo(np.int64).max


def lengths(window: int) -> list[int]:
    """Window lengths of the levels: halves (rounded up) from ``window`` down to about 7."""
    out = [window]
    while out[0] > 12:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (mix(h ^ U(0xA5A5A5A5)) % U(parts)).astype(np.int32)


class Texts:
    """Word hashes of the rows of a batch, a chunk at a time."""

    def __init__(self, batch: pa.RecordBatch):
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        self.batch, self.ids = batch, get("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.keys, self.text = get("key").to_numpy(zero_copy_only=False), get("text")

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable]]:
        """(row, its word hashes, its bytes, a function for its words' second hashes)."""
        for i, _, data, off in chunks(self.text):
            starts, ends, first = word_spans(data, off)
            words = word_hashes(data, starts, ends)
            for k in range(len(off) - 1):
                at, own = slice(first[k], first[k + 1]), data[off[k] : off[k + 1]]
                yield i + k, words[at], own, partial(word_hashes, own, starts[at] - off[k], ends[at] - off[k], second=True)


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    return grams(words, np.array([0, len(words)]), n)[0]


def _anchors(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Each window's anchor: the smallest hash of the ``base``-word windows within."""
    g = _windows(words, base)
    span = window - base + 1
    if len(g) < span:
        return np.zeros(0, U)
    out = g[: len(g) - span + 1].copy()
    for k in range(1, span):
        np.minimum(out, g[k : k + len(out)], out=out)
    return out


def _unpack(hashes: np.ndarray, reply: dict | None, parts: int) -> np.ndarray:
    """A level's bit for each of a document's hashes: those settled at once, then the others by partition."""
    bits = np.zeros(len(hashes), bool)
    if reply:
        unpack = lambda x, n: np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:n].astype(bool)
        bits |= unpack(reply["local"], len(bits))
        rest = np.flatnonzero(~bits)
        order = np.argsort(_part(hashes[rest], parts), kind="stable")
        bits[rest[order]] = unpack(reply["rest"], len(rest))
    return bits


class State:
    """What a document knows after some levels: the windows still candidates at the next length."""

    def __init__(self, words: np.ndarray, second: Callable, levels: list[int], replies: list, parts: int):
        window, base = levels[-1], levels[0]
        self.where, self.hashes, self.more = np.zeros(0, np.int64), np.zeros(0, U), None
        if len(words) < window:
            return
        # Level 0: anchors, or windows themselves if there is only one level.
        self.where = np.arange(len(words) - window + 1)
        if len(levels) > 1:
            index = self._distinct(_anchors(words, window, base)[None])
        else:
            index = self._distinct(_windows(words, window)[None], _windows(second(), window)[None])
        for k, reply in enumerate(replies):
            self.where = self.where[_unpack(self.hashes, reply, parts)[index].all(axis=0)]
            if k + 1 < len(levels):
                # A window lives on if its first and its last part of the next length do.
                n = levels[k + 1]
                both = np.stack([self.where, self.where + window - n]) if n < window else self.where[None]
                final = k + 2 == len(levels) and len(self.where)
                index = self._distinct(_windows(words, n)[both], _windows(second(), n)[both] if final else None)

    def _distinct(self, h: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """Keep the distinct hashes, sorted; where each of ``h`` is among them."""
        if more is None:
            self.hashes, index = np.unique(h, return_inverse=True)
            self.more = None
            return index.reshape(h.shape)
        one, two = h.ravel(), more.ravel()
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        self.hashes, self.more = one[new], two[new]
        index = np.empty(len(one), np.int64)
        index[order] = np.cumsum(new) - 1
        return index.reshape(h.shape)


#: What documents send, by partition p of the hash space. A buffer s also sends one row without hashes: all
#: its documents and the bits settled within, which passes by. Rows without documents only tell hashes.
ASKED = pa.schema([("p", pa.int32()), ("s", pa.int64()), ("ids", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("more", pa.binary()), ("bits", pa.binary())])
ASKED_SQL = "p int, s long, ids binary, docs binary, counts binary, hashes binary, more binary, bits binary"
SAID = pa.schema([("s", pa.int64()), ("p", pa.int32()), ("ids", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])
SAID_SQL = "s long, p int, ids binary, docs binary, counts binary, bits binary"
BITS = {"bitorder": "little"}


def _cuts(p: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(p, prepend=-1)).tolist()
    return list(zip(at, [*at[1:], len(p)], strict=True))


def _changes(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Where a new hash begins among sorted ones."""
    return np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])


def _send(level: int, levels: list[int], parts: int):
    """Documents send the hashes of their candidates at a level."""
    final = level == len(levels) - 1

    def rows(p, name, **cols):
        n = len(p)
        col = lambda c: pa.array(cols[c], pa.binary()) if c in cols else pa.nulls(n, pa.binary())
        return _batch(ASKED, np.asarray(p, np.int32), np.full(n, name, np.int64), *[col(c) for c in ASKED.names[2:]])

    def flush(held):
        ids, keys = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        sizes = np.array([len(x[2]) for x in held])
        h = np.concatenate([x[2] for x in held])
        more = np.concatenate([x[3] for x in held]) if final else np.zeros(len(h), U)
        doc = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        # The buffer's name depends on its content alone, so a task run again gives it again.
        with np.errstate(over="ignore"):
            name = int(mix(mix(ids.view(U)) + mix(keys.view(U) + U(len(ids)))).sum(dtype=U)[None].view(np.int64)[0])
        order = np.lexsort((ids[doc], more, h))
        start = np.flatnonzero(_changes(h[order], more[order]))
        count = np.diff(np.append(start, len(h)))
        low = np.repeat(ids[doc][order][start], count)
        high = np.repeat(ids[doc][order][np.append(start[1:], len(h)) - 1], count)
        local = np.zeros(len(h), bool)
        # In the last level a window is settled if a smaller document has it, before that if any other.
        local[order] = low < ids[doc][order] if final else low < high
        yield rows([abs(name) % parts], name, ids=[ids.tobytes()], docs=[keys.tobytes()], counts=[sizes.astype(np.int32).tobytes()], bits=[np.packbits(local, **BITS).tobytes()])
        ask = np.flatnonzero(~local)
        p = _part(h[ask], parts)
        by = np.argsort(p, kind="stable")
        ask, p = ask[by], p[by]
        made = ([], [], [], [], [])
        cuts = _cuts(p)
        for a, b in cuts:
            d, n = np.unique(doc[ask[a:b]], return_counts=True)
            for row, x in zip(made, (ids[d], d.astype(np.int32), n.astype(np.int32), h[ask[a:b]], more[ask[a:b]]), strict=True):
                row.append(x.tobytes())
        if cuts:
            yield rows(p[[a for a, _ in cuts]], name, ids=made[0], docs=made[1], counts=made[2], hashes=made[3], **({"more": made[4]} if final else {}))
        if not final:  # one entry for each hash settled here, so that others learn of it
            told = h[order][start[low[start] < high[start]]]
            p = _part(told, parts)
            by = np.argsort(p, kind="stable")
            told, p = told[by], p[by]
            if cuts := _cuts(p):
                yield rows(p[[a for a, _ in cuts]], name, hashes=[told[a:b].tobytes() for a, b in cuts])

    def run(batches):
        held, size = [], 0
        for b in batches:
            t = Texts(b)
            got = [b.column(b.schema.get_field_index(f"r{k}")) for k in range(level)]
            for i, words, data, second in t.rows():
                state = State(words, second, levels, [g[i].as_py() for g in got], parts)
                size += len(data)
                if len(state.hashes):
                    held.append((t.ids[i], t.keys[i], state.hashes, state.more))
                if size >= FLUSH_BYTES:
                    if held:
                        yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _answer(final: bool):
    """A partition of the hash space answers: one bit for each hash of each document."""

    def run(t: pa.Table) -> pa.Table:
        asked, told, passing, out = [], [], [], []
        for k, (p, s, ids, docs, counts, hashes, more) in enumerate(zip(*(t.column(c).to_pylist() for c in range(7)), strict=True)):
            if hashes is None:
                passing.append(k)
            elif ids is None:
                told.append(np.frombuffer(hashes, U))
            else:
                asked.append((p, s, np.frombuffer(ids, np.int64), docs, np.frombuffer(counts, np.int32), np.frombuffer(hashes, U), more))
        if passing:
            x = t.take(pa.array(passing))
            x = [x.column(c).combine_chunks() for c in ("s", "ids", "docs", "counts", "bits")]
            out.append(_batch(SAID, x[0], np.full(len(passing), -1, np.int32), *x[1:]))
        if asked:
            h = np.concatenate([x[5] for x in asked])
            more = np.concatenate([np.frombuffer(x[6], U) for x in asked]) if final else np.zeros(len(h), U)
            doc = np.concatenate([np.repeat(x[2], x[4]) for x in asked])
            order = np.lexsort((doc, more, h))
            hs, ds = h[order], doc[order]
            start = np.flatnonzero(_changes(hs, more[order]))
            count = np.diff(np.append(start, len(hs)))
            bit = np.zeros(len(h), bool)
            if final:
                bit[order] = np.repeat(ds[start], count) < ds
            else:
                many = ds[start] < ds[np.append(start[1:], len(hs)) - 1]
                if told:
                    many |= np.isin(hs[start], np.concatenate(told))
                bit[order] = np.repeat(many, count)
            ends = np.cumsum([len(x[5]) for x in asked])
            bits = [np.packbits(bit[e - len(x[5]) : e], **BITS).tobytes() for e, x in zip(ends, asked, strict=True)]
            out.append(_batch(SAID, [x[1] for x in asked], [x[0] for x in asked], pa.nulls(len(asked), pa.binary()), [x[3] for x in asked], [x[4].tobytes() for x in asked], bits))
        return pa.Table.from_batches(out, SAID)

    return run


def _gather(t: pa.Table) -> pa.Table:
    """A buffer's answers become one row for each of its documents that has a bit set."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("s", pa.int64()), ("local", pa.binary()), ("rest", pa.binary())])
    rows = {r["p"]: r for r in t.to_pylist()}  # repeated rows may give equal buffers
    own = rows.pop(-1)
    ids, keys, sizes = np.frombuffer(own["ids"], np.int64), np.frombuffer(own["docs"], np.int64), np.frombuffer(own["counts"], np.int32)
    local = np.unpackbits(np.frombuffer(own["bits"], np.uint8), **BITS)[: sizes.sum()]
    doc, bits = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
    for p in sorted(rows):
        n = np.frombuffer(rows[p]["counts"], np.int32)
        doc.append(np.repeat(np.frombuffer(rows[p]["docs"], np.int32), n))
        bits.append(np.unpackbits(np.frombuffer(rows[p]["bits"], np.uint8), **BITS)[: n.sum()])
    doc, bits = np.concatenate(doc), np.concatenate(bits)
    bits = bits[np.argsort(doc, kind="stable")]
    ends, last = np.cumsum(sizes), np.cumsum(np.bincount(doc, minlength=len(ids)))
    out = ([], [], [], [], [])
    for d in range(len(ids)):
        x, y = local[ends[d] - sizes[d] : ends[d]], bits[(last[d - 1] if d else 0) : last[d]]
        if x.any() or y.any():
            for o, v in zip(out, (int(ids[d]), int(keys[d]), own["s"], np.packbits(x, **BITS).tobytes(), np.packbits(y, **BITS).tobytes()), strict=True):
                o.append(v)
    return pa.Table.from_batches([_batch(schema, pa.array([None if i == NULL_ID else i for i in out[0]], pa.int64()), *out[1:])])


def _finish(levels: list[int], parts: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            t = Texts(b)
            got = [b.column(b.schema.get_field_index(f"r{k}")) for k in range(len(levels))]
            out, size, ids = ([], [], [], []), 0, b.column(b.schema.get_field_index("doc_id"))
            begin = 0
            for i, words, data, second in t.rows():
                kept = data.tobytes().split()  # splits on the same six bytes
                gone = 0
                replies = [g[i].as_py() for g in got]
                if replies[-1]:
                    alive = State(words, second, levels, replies, parts).where
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, alive, 1)
                    np.add.at(edge, alive + levels[-1], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = int(len(words) - keep.sum())
                    kept = compress(kept, keep.tolist())
                kept = b" ".join(kept)
                size += len(kept)
                for x, y in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    x.append(y)
                if size > 4 << 20:
                    yield _batch(schema, ids.slice(begin, len(out[0])), *out)
                    begin, size, out = begin + len(out[0]), 0, ([], [], [], [])
            if out[0]:
                yield _batch(schema, ids.slice(begin, len(out[0])), *out)

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (UTF-8 bytes).

    Words are runs of non-white-space, unchanged. Each word covered by a window whose word sequence also
    starts in a document of smaller doc_id is removed; windows are judged on the input. kept joins
    the remaining words by one space. A null or empty text has no words. A null doc_id counts as the
    largest; rows that share a doc_id never cover each other, and repeated rows get equal results. Texts
    shorter than a window are kept. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark, ROWS)
    parts = max(4 * partitions(spark), plan_bytes(docs.select("text")) // PART_BYTES)
    levels = lengths(window)
    d = docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("key"), "text")
    known = None
    bits = "struct<s:bigint,local:binary,rest:binary>"

    def with_replies(how: str) -> DataFrame:
        if known is None:
            return d
        r = known.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
        return d.join(r, d.doc_id.eqNullSafe(r._id) & (d.key == r._key), how).drop("_id", "_key")

    with arrow_rows(spark, ROWS):
        for k in range(len(levels)):
            final = k == len(levels) - 1
            asked = with_replies("inner").mapInArrow(lean(_send(k, levels, parts)), ASKED_SQL)
            said = asked.groupBy("p").applyInArrow(_answer(final), SAID_SQL)
            said = said.groupBy("s").applyInArrow(_gather, "doc_id long, key long, s long, local binary, rest binary")
            # Repeated rows may have been sent from several buffers; each one's answers are complete.
            said = said.groupBy("doc_id", "key").agg(F.min(F.struct("s", "local", "rest")).cast(bits).alias(f"r{k}"))
            if known is not None:
                r = known.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
                said = said.join(r, said.doc_id.eqNullSafe(r._id) & (said.key == r._key)).drop("_id", "_key")
            known = written(said, "substrings-level")
            if known.isEmpty():
                break
        for k in range(len(levels)):
            if f"r{k}" not in known.columns:
                known = known.withColumn(f"r{k}", F.lit(None).cast(bits))
        out = with_replies("left").mapInArrow(lean(_finish(levels, parts)), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out


def op2_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")


OP2_SQL = """
    WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (
        SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
    m AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
    c AS (SELECT doc_id, i FROM s JOIN m USING (s) WHERE m.first < doc_id),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM c),
    gone AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
    k AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, w, gone FROM w LEFT JOIN gone USING (doc_id)),
    e AS (SELECT doc_id, n, r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM k WHERE n > 0),
    x AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
    SELECT k.doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM k LEFT JOIN x USING (doc_id)
"""
