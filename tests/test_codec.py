"""The binary log: round trips, errors, reading files."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trivane.sources import codec

U64 = st.integers(0, 2**64 - 1)
ATTR = st.one_of(st.tuples(st.just(1), st.booleans()), st.tuples(st.just(2), st.integers(-(2**63), 2**63 - 1)), st.tuples(st.just(3), st.floats(allow_nan=False)), st.tuples(st.just(4), st.text(max_size=20)), st.tuples(st.just(6), st.sampled_from([-1, 0, 1])))


@settings(max_examples=60, deadline=None)
@given(U64, st.text(max_size=10), st.integers(0, 10), st.dictionaries(st.text(max_size=8), ATTR, max_size=5))
def test_node_create(node, typ, rule, attrs):
    f = {"node": node, "typ": typ, "rule": rule, "attrs": attrs}
    assert codec.decode(1, codec.encode(1, f)) == f


@pytest.mark.parametrize(
    ("op", "fields"),
    [
        (2, {"edge_id": 1, "src": 2, "tgt": 3, "dep_kind": 0, "port_kind": 2, "port_name": "p"}),
        (2, {"edge_id": 1, "src": 2, "tgt": 3, "dep_kind": 1, "port_kind": 0, "port_name": "", "source_partition": 4, "source_uid": 5, "source_version": 6, "payload_kind": 1, "zero_kind": 3, "frontier": {7: 8}, "authority": 9, "emitted": 1, "capability": 2, "scope": 3}),
        (3, {"node": 1, "val": -1}), (4, {"node": 1}), (5, {"src": 1, "node": 2}), (6, {"node": 1}), (7, {"edge_id": 1}), (8, {"node": 1}), (9, {"node": 1, "mode": 2}), (10, {"node": 1}), (11, {"nodes": [1, 2]}),
        (12, {"partition": 1, "root": 2, "lattice": 3, "domain": 4}), (13, {"node": 1, "partition": 2}), (14, {"partition": 1, "lattice": 2, "domain": 3}), (15, {"src": 1, "node": 2, "lattice": 3, "capability": 4, "scope": 5}),
        (16, {"node": 1, "strategy": 0, "domain": 1, "iterations": 256, "convergence": 2}), (17, {"node": 1, "priority": 1, "retry": 0}), (18, {"root": 1, "boundary": 1, "region": [2, 3], "stability": 0, "compile": 1}), (18, {"root": 1, "boundary": 0, "region": 9, "stability": 1, "compile": 2}),
    ],
)
def test_round_trip(op, fields):
    assert codec.decode(op, codec.encode(op, fields)) == fields


def test_errors():
    for op, data, name in ((99, b"", "UnknownOpcode"), (3, b"\0" * 8, "PayloadTruncated"), (3, b"\0" * 8 + b"\x05", "InvalidTernary"), (9, b"\0" * 8 + b"\x07", "UnknownExecMode"), (1, b"\0" * 8 + b"\0\0" + b"\x0b", "UnknownNodeRule")):
        with pytest.raises(codec.CodecError, match=name):
            codec.decode(op, data)
    assert math.isnan(codec.decode(1, codec.encode(1, {"node": 1, "typ": "", "rule": 0, "attrs": {"x": (3, math.nan)}}))["attrs"]["x"][1])


def test_profiles():
    f = {"profile_id": 1, "version": 2, "trust": 1, "assertion": 1, "delegation": 2, "observability": 3, "disclosure": 4, "issuer": 5, "session": 6, "generation": 7, "expiry": 8, "signature": b"s" * 64}
    assert codec.profile_decode(codec.profile_encode(f)) == f
    one = codec.profile_decode(codec.profile_encode(f | {"version": 1}))
    assert (one["assertion"], one["disclosure"]) == (1, 1)


def test_read_log(spark, tmp_path):
    for k in range(2):
        body = codec.preamble(path=k, session=5 + k) + codec.record(3, codec.encode(3, {"node": 1, "val": 1}), session=5 + k, seq=1) + codec.record(777, b"xyz", session=5 + k, seq=2) + codec.record(8, codec.encode(8, {"node": 1}), session=5 + k, seq=3)
        (tmp_path / f"{k}.bin").write_bytes(body)
    got = codec.read_log(spark, str(tmp_path)).orderBy("path", "pos").collect()
    assert [(r.path, r.opcode, r.stream_seq, len(r.payload)) for r in got] == [(k, o, s, n) for k in range(2) for o, s, n in ((3, 1, 9), (777, 2, 3), (8, 3, 8))]


def test_profiles_have_three_trust_levels():
    f = {"profile_id": 1, "version": 2, "assertion": 1, "delegation": 2, "observability": 3, "disclosure": 4, "issuer": 5, "session": 6, "generation": 7, "expiry": 8, "signature": b""}
    for trust in (1, 2, 3):
        assert codec.profile_decode(codec.profile_encode(f | {"trust": trust}))["trust"] == trust
    for trust in (0, 4):
        with pytest.raises(codec.CodecError, match="UnknownTrustLevel"):
            codec.profile_decode(codec.profile_encode(f | {"trust": trust}))


def test_damaged_logs(spark, tmp_path):
    """What cannot be framed is a last record with an error; numbers from 2^63 on keep their bits."""
    good = codec.preamble(path=0, session=2**64 - 5) + codec.record(3, codec.encode(3, {"node": 1, "val": 1}), session=2**64 - 5, seq=1)
    for k, (tail, error) in enumerate([(b"\x01\x02", "HeaderTruncated"), (codec.record(3, b"x" * 9)[:-4], "RecordTruncated"), (codec.HEADER.pack(3, 0, 20, 0, 0, 0, 0, 2) + b"rest", "InvalidLength")]):
        rows = list(codec.frames(good + tail))
        assert [r[-1] and r[-1].split("(")[0] for r in rows] == [None, error]
        (tmp_path / f"{k}.bin").write_bytes(good + tail)
    got = codec.read_log(spark, str(tmp_path)).collect()
    assert sorted(r.error.split("(")[0] for r in got if r.error) == ["HeaderTruncated", "InvalidLength", "RecordTruncated"]
    assert {r.stream_session for r in got} == {-5}


def test_bytes_to_values(spark, tmp_path):
    """Two streams build and drive one graph; damaged, replayed and malformed records leave no trace."""
    from trivane.plans import ingest

    def stream(path, ops):
        out = codec.preamble(path, 10 + path)
        for i, (op, f, *seq) in enumerate(ops):
            out += codec.record(op, f if isinstance(f, bytes) else codec.encode(op, f), session=10 + path, seq=seq[0] if seq else i + 1)
        return out

    edge = lambda k, s, t: (2, {"edge_id": k, "src": s, "tgt": t, "dep_kind": 0, "port_kind": 0, "port_name": ""})
    node = lambda n, rule: (1, {"node": n, "typ": "t", "rule": rule, "attrs": {}})
    one = [node(1, 0), node(2, 0), node(3, 7), edge(1, 1, 3), edge(2, 2, 3), (3, {"node": 1, "val": 1}), (777, b"??"), (3, b"short"), (3, {"node": 2, "val": 0}, 2)]
    two = [(3, {"node": 2, "val": 1}), node(4, 2), edge(3, 3, 4), (8, {"node": 4}), (3, {"node": 9, "val": 1})]
    (tmp_path / "a.bin").write_bytes(stream(0, one) + b"\0")
    (tmp_path / "b.bin").write_bytes(stream(1, two))
    result, refused = ingest.apply_logs(spark, str(tmp_path))
    assert {r.node: r.val for r in result.values.collect()} == {1: 1, 2: 1, 3: 1, 4: -1}
    assert sorted((r.path, r.pos, r.error.split("(")[0]) for r in refused.collect()) == [(0, 7, "PayloadTruncated"), (0, 8, "StreamSeqGap"), (0, 9, "HeaderTruncated")]
    assert [(r.node, r.reason) for r in result.errors.collect()] == [(9, "NodeNotFound")]
