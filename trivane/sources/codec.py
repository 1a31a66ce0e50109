"""The binary operation log: preamble, records, payloads. All integers are little-endian.

The layout is a table of fields for each opcode, read and written by one generic coder. Streams are
binary files; ``read_log`` frames them a file at a time inside tasks.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.ternary import RULES

#: Fixed values of the format.
MAGIC, VERSION = b"PGRS", 3
PREAMBLE, HEADER = struct.Struct("<4sHHQQQ"), struct.Struct("<HHIQQQQQ")
PROFILE = 0x0100
FIELDS = {
    1: "node:Q typ:str rule:B attrs:map", 2: "edge_id:Q src:Q tgt:Q dep_kind:B port_kind:B port_name:str", 3: "node:Q val:t", 4: "node:Q", 5: "src:Q node:Q",
    6: "node:Q", 7: "edge_id:Q", 8: "node:Q", 9: "node:Q mode:B", 10: "node:Q", 11: "nodes:list", 12: "partition:Q root:Q lattice:Q domain:Q", 13: "node:Q partition:Q",
    14: "partition:Q lattice:Q domain:Q", 15: "src:Q node:Q lattice:Q capability:B scope:Q", 16: "node:Q strategy:B domain:B iterations:I convergence:B",
    17: "node:Q priority:B retry:B", 18: "root:Q boundary:B region:region stability:B compile:B",
}
REMOTE = "source_partition:Q source_uid:Q source_version:Q payload_kind:B zero_kind:zk frontier:clock authority:Q emitted:Q capability:B scope:Q"
#: The largest valid byte of fields that are enumerations, with the error for others.
LIMITS = {"rule": (10, "UnknownNodeRule"), "mode": (2, "UnknownExecMode"), "port_kind": (3, "UnknownPortKind"), "dep_kind": (1, "UnknownDepKind"), "payload_kind": (1, "UnknownPayloadKind"), "stability": (1, "UnknownStabilityContract"), "compile": (2, "UnknownCompilePolicy"), "boundary": (2, "UnknownRegionBoundaryTag")}
#: Trust levels of profiles by their byte.
TRUST = {1: "Advisory", 2: "Asserted", 3: "Attested"}
NAN = struct.pack("<Q", 0x7FF8000000000000)


class CodecError(ValueError):
    """A payload that is none; the message names the error."""


def _pack_attr(v) -> bytes:
    tag, x = v
    if tag == 1:
        return struct.pack("<BB", 1, bool(x))
    if tag in (2, 7):
        return struct.pack("<Bq", tag, x)
    if tag == 3:
        return b"\x03" + (NAN if math.isnan(x) else struct.pack("<d", x))
    if tag == 4:
        s = x.encode()
        return struct.pack("<BH", 4, len(s)) + s
    if tag == 6:
        return struct.pack("<Bb", 6, x)
    raise CodecError(f"UnsupportedAttrTag({tag})")


def encode(op: int, f: dict) -> bytes:
    """The payload of an operation with these fields."""
    out = []
    for name, kind in (x.split(":") for x in FIELDS[op].split() + (REMOTE.split() if f.get("dep_kind") == 1 else [])):
        x = f.get(name)
        if kind == "str":
            s = (x or "").encode()
            out.append(struct.pack("<H", len(s)) + s)
        elif kind == "t":
            out.append(struct.pack("<b", x))
        elif kind == "list":
            out.append(struct.pack(f"<I{len(x or [])}Q", len(x or []), *(x or [])))
        elif kind == "map":
            items = sorted((x or {}).items(), key=lambda e: e[0].encode())
            out.append(struct.pack("<H", len(items)) + b"".join(struct.pack("<H", len(k.encode())) + k.encode() + _pack_attr(v) for k, v in items))
        elif kind == "zk":
            out.append(struct.pack("<B", x) if f["payload_kind"] == 1 else b"")
        elif kind == "clock":
            out.append(struct.pack("<H", len(x or {})) + b"".join(struct.pack("<QQ", *e) for e in sorted((x or {}).items())))
        elif kind == "region":
            out.append(struct.pack("<I", x) if f["boundary"] == 0 else struct.pack(f"<I{len(x)}Q", len(x), *x) if f["boundary"] == 1 else struct.pack("<Q", x))
        else:
            out.append(struct.pack("<" + kind, x))
    return b"".join(out)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            raise CodecError(f"PayloadTruncated({n}, {len(self.data) - self.at})")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str):
        s = struct.Struct("<" + kind)
        return s.unpack(self.take(s.size))[0]

    def text(self) -> str:
        try:
            return self.take(self.number("H")).decode()
        except UnicodeDecodeError:
            raise CodecError("InvalidUtf8") from None

    def ternary(self) -> int:
        x = self.number("b")
        if x not in (-1, 0, 1):
            raise CodecError(f"InvalidTernary({x})")
        return x

    def attr(self):
        tag = self.number("B")
        if tag == 1:
            return 1, self.number("B") != 0
        if tag in (2, 7):
            return 2, self.number("q")
        if tag == 3:
            x = self.number("d")
            return 3, math.nan if math.isnan(x) else x
        if tag == 4:
            return 4, self.text()
        if tag == 6:
            return 6, self.ternary()
        raise CodecError(f"UnsupportedAttrTag({tag})")


def decode(op: int, payload: bytes) -> dict:
    """The fields of a payload."""
    if op not in FIELDS:
        raise CodecError(f"UnknownOpcode({op})")
    r, f = Reader(payload), {}
    fields = FIELDS[op].split()
    while fields:
        name, kind = fields.pop(0).split(":")
        if kind == "str":
            f[name] = r.text()
        elif kind == "t":
            f[name] = r.ternary()
        elif kind == "list":
            f[name] = [r.number("Q") for _ in range(r.number("I"))]
        elif kind == "map":
            f[name] = dict((r.text(), r.attr()) for _ in range(r.number("H")))
        elif kind == "zk":
            if f["payload_kind"] == 1:
                f[name] = r.number("B")
                if f[name] > 5:
                    raise CodecError(f"UnknownZeroKind({f[name]})")
        elif kind == "clock":
            f[name] = dict((r.number("Q"), r.number("Q")) for _ in range(r.number("H")))
        elif kind == "region":
            f[name] = r.number("I") if f["boundary"] == 0 else [r.number("Q") for _ in range(r.number("I"))] if f["boundary"] == 1 else r.number("Q")
        else:
            f[name] = r.number(kind)
        if name in LIMITS and f[name] > LIMITS[name][0]:
            raise CodecError(f"{LIMITS[name][1]}({f[name]})")
        if name == "port_name" and f["dep_kind"] == 1:
            fields = REMOTE.split()
    return f


def record(op: int, payload: bytes, tenant=0, session=0, partition=0, epoch=0, seq=0, flags=0) -> bytes:
    return HEADER.pack(op, flags, HEADER.size + len(payload), tenant, session, partition, epoch, seq) + payload


def preamble(path: int, session: int, features: int = 0, flags: int = 0) -> bytes:
    return PREAMBLE.pack(MAGIC, VERSION, flags, features, path, session)


def read_preamble(data: bytes) -> dict:
    magic, version, flags, features, path, session = PREAMBLE.unpack_from(data)
    if magic != MAGIC:
        raise CodecError("BadMagic")
    if version != VERSION:
        raise CodecError(f"UnsupportedVersion({version})")
    return {"flags": flags, "features": features, "path": path, "session": session}


def frames(data: bytes) -> Iterator[tuple]:
    """(opcode, flags, length, tenant, session, partition, epoch, seq, payload, error) of a stream's records.

    Any opcode is stepped over by its length. A length below the header's, and bytes that end within a header or
    a payload, are a last record with an error: what follows cannot be framed.
    """
    at = PREAMBLE.size
    while at < len(data):
        if at + HEADER.size > len(data):
            yield *[None] * 8, data[at:], f"HeaderTruncated({len(data) - at})"
            return
        head = HEADER.unpack_from(data, at)
        length, left = head[2], len(data) - at
        error = f"InvalidLength({length})" if length < HEADER.size else f"RecordTruncated({length}, {left})" if length > left else None
        yield *head, data[at + HEADER.size : at + max(length, HEADER.size)], error
        if error:
            return
        at += length


RECORDS = "path long, stream_session long, pos int, opcode int, flags int, length long, tenant_id long, session_id long, partition_id long, causal_epoch long, stream_seq long, payload binary, error string"


def signed(x: int | None) -> int | None:
    """An unsigned 64-bit number as the long of the same bits: the format's numbers from 2^63 on are negative in tables."""
    return x if x is None or x < 1 << 63 else x - (1 << 64)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of the binary logs below ``path``, a row each; files are independent streams. Damage is a row with an error."""
    schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[k]) for c, k in (x.split() for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                p = read_preamble(data)
                rows = [(signed(p["path"]), signed(p["session"]), i, *[signed(x) if isinstance(x, int) else x for x in f]) for i, f in enumerate(frames(data))]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def profile_decode(data: bytes) -> dict:
    """A session profile: version 1 has one mask for all four axes, version 2 has four."""
    r = Reader(data)
    f = {"profile_id": r.number("I"), "version": r.number("H"), "trust": r.number("B")}
    if f["trust"] not in TRUST:
        raise CodecError(f"UnknownTrustLevel({f['trust']})")
    if f["version"] not in (1, 2):
        raise CodecError(f"UnknownProfileVersion({f['version']})")
    masks = [r.number("Q")] * 4 if f["version"] == 1 else [r.number("Q") for _ in range(4)]
    f.update(zip(("assertion", "delegation", "observability", "disclosure"), masks, strict=True))
    f.update({k: r.number("Q") for k in ("issuer", "session", "generation", "expiry")})
    return f | {"signature": r.take(r.number("H"))}


def profile_encode(f: dict) -> bytes:
    masks = [f["assertion"]] if f["version"] == 1 else [f[k] for k in ("assertion", "delegation", "observability", "disclosure")]
    return struct.pack("<IHB", f["profile_id"], f["version"], f["trust"]) + struct.pack(f"<{len(masks) + 4}QH", *masks, *(f[k] for k in ("issuer", "session", "generation", "expiry")), len(f["signature"])) + f["signature"]


#: Modes, rules and kinds of ports by their byte in payloads.
MODES, PORTS = ("Eager", "Lazy", "Stabilizing"), ("signal", "effort", "flow", "bond")
RULE_OF = {0: "Input", **{code: name for name, code in RULES.items()}}
OPERATIONS = "error string, op int, node long, other long, edge long, rule string, mode string, port string, val int, part long, lattice long, capability int, scope long, remote boolean, nodes array<long>"


def operation(op: int, payload: bytes) -> dict:
    """A payload's fields as the columns of the op-log engine."""
    f = decode(op, payload)
    long = lambda k: signed(f.get(k))
    out = {"op": op, "node": long("node"), "val": f.get("val"), "part": long("partition"), "lattice": long("lattice"), "capability": f.get("capability"), "scope": long("scope")}
    if op == 1:
        out["rule"] = RULE_OF[f["rule"]]
    elif op == 2:
        far = f["dep_kind"] == 1
        out |= {"node": long("tgt"), "other": long("src"), "edge": long("edge_id"), "port": PORTS[f["port_kind"]], "remote": far, "lattice": long("emitted") if far else None}
    elif op == 5:
        out["other"] = long("src")
    elif op == 7:
        out["edge"] = long("edge_id")
    elif op == 9:
        out["mode"] = MODES[f["mode"]]
    elif op == 11:
        out["nodes"] = [signed(x) for x in f["nodes"]] or None
    elif op in (12, 14):
        out["scope"] = long("domain")
    elif op == 15:
        out["other"] = long("src")
    elif op == 18:
        out["node"] = long("root")
    return out


def operations(records: DataFrame) -> DataFrame:
    """``records`` (opcode, payload, ...) and their operations (``OPERATIONS``); a payload that is none has an error."""
    schema = records.schema
    names = [c.split()[0] for c in OPERATIONS.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    kinds = [types[c.split()[1]] for c in OPERATIONS.split(", ")]
    keep = [c for c in schema.names if c not in ("payload", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for op, payload in zip(b.column("opcode").to_pylist(), b.column("payload").to_pylist(), strict=True):
                try:
                    row = operation(op, payload or b"")
                except CodecError as e:
                    row = {"op": op, "error": str(e)}
                rows.append([row.get(n) for n in names])
            cols = list(zip(*rows, strict=True)) or [[]] * (len(names))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made], names=[*keep, *names])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in keep), *(c for c in OPERATIONS.split(", "))])
    return records.mapInArrow(run, fields)
