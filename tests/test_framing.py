import gzip
import random
import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions import framing
from millrace.functions.checksums import combine, combined
from millrace.operators import members


def decode(data):
    return b"".join(raw for raw, _ in framing.members(data))


def kind(data):
    with pytest.raises(framing.GzError) as e:
        decode(data)
    return e.value.kind


ONE = framing.compressed(b"hello world, hello world")


def with_header(flags, fields=b""):
    return ONE[:3] + bytes([flags]) + ONE[4:10] + fields + ONE[10:]


def test_errors():
    assert kind(b"") == "Truncated"
    assert kind(ONE[:9]) == "Truncated"
    assert kind(b"\x1f\x8c" + ONE[2:]) == "BadMagic"
    assert kind(ONE[:2] + b"\x07" + ONE[3:]) == "UnsupportedMethod"
    for bit in (5, 6, 7):
        assert kind(with_header(1 << bit)) == "ReservedFlags"
    crc, size = struct.unpack("<II", ONE[-8:])
    assert kind(ONE[:-8] + struct.pack("<II", crc ^ 1, size)) == "CrcMismatch"
    assert kind(ONE[:-8] + struct.pack("<II", crc, size + 1)) == "IsizeMismatch"
    assert kind(ONE[:-8] + struct.pack("<II", crc ^ 1, size + 1)) == "CrcMismatch"
    assert kind(ONE + b"\0" * 512) == "BadMagic"
    assert kind(ONE + b"\0") == "Truncated"
    assert kind(ONE + b"some text after it") == "BadMagic"
    assert kind(ONE[:10] + bytes([7]) + ONE[11:]) == "Deflate"  # reserved block type


@pytest.mark.parametrize("cut", range(1, len(ONE)))
def test_every_cut_is_an_error(cut):
    assert kind(ONE[:cut]) in ("Truncated", "Deflate")


def test_header_fields_are_accepted():
    extra = b"AB\x03\x00xyz" + b"BC\x02\x00\x10\x00"
    assert decode(with_header(1)) == decode(ONE)
    assert decode(with_header(8, b"name\0")) == decode(ONE)
    assert decode(with_header(16, b"comment\0")) == decode(ONE)
    assert decode(with_header(2, b"\xff\xff")) == decode(ONE)  # the header checksum is not compared
    assert framing.bgzf_size(extra) == 17
    assert framing.bgzf_size(b"BC\x04\x00\0\0\0\0") is None
    assert decode(with_header(4 | 8 | 16 | 2, struct.pack("<H", 7) + b"AB\x03\x00xyz" + b"n\0c\0" + b"\0\0")) == decode(ONE)


def test_members():
    empty = framing.compressed(b"")
    data = empty + framing.compressed(b"alpha") + empty + empty + framing.compressed(b"beta", 9) + empty
    assert decode(data) == gzip.decompress(data) == b"alphabeta"
    rows = [r for _, r in framing.members(data)]
    assert [r["raw_length"] for r in rows] == [0, 5, 0, 0, 4, 0] and rows[1]["header_offset"] == rows[0]["trailer_offset"] + 8
    assert decode(b"".join(framing.compressed(f"member-{i}-payload\n".encode()) for i in range(500))).count(b"\n") == 500
    blocks = framing.bgzf(bytes(range(256)) * 1000, 1000)
    assert decode(blocks) == gzip.decompress(blocks) == bytes(range(256)) * 1000
    assert kind(blocks[:-10]) == "Truncated"


@given(st.binary(max_size=300), st.lists(st.integers(0, 300), max_size=4), st.integers(0, 9))
def test_any_split_into_members(raw, cuts, level):
    cuts = sorted({0, *(c for c in cuts if c < len(raw)), len(raw)})
    data = b"".join(framing.compressed(raw[a:b], level) for a, b in zip(cuts, cuts[1:])) or framing.compressed(b"")
    assert decode(data) == raw == gzip.decompress(data)


@given(st.binary(max_size=200), st.binary(max_size=200))
def test_combine(a, b):
    assert combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_combined_over_many_pieces(spark):
    rng = random.Random(1)
    whole = {k: [rng.randbytes(rng.randint(0, 20)) for _ in range(n)] for k, n in (("a", 3000), ("b", 1))}
    rows = [(k, i, zlib.crc32(p), len(p)) for k, ps in whole.items() for i, p in enumerate(ps)]
    got = {r["k"]: (r["crc"], r["length"]) for r in combined(spark.createDataFrame(rows, "k string, seq bigint, crc bigint, length bigint"), ["k"]).collect()}
    assert got == {k: (zlib.crc32(b"".join(ps)), sum(map(len, ps))) for k, ps in whole.items()}


def test_decoded_members_without_rows():
    parts = [b"", b"a", b"x" * 100_000, bytes(range(256)) * 300, b"tail"]
    for data in (b"".join(map(framing.compressed, parts)), framing.bgzf(b"".join(parts), 1000), framing.bgzf(parts[2]) + framing.compressed(b"z")):
        assert list(framing.raws(data)) == [raw for raw, _ in framing.members(data)]
        for k in (len(data) - 1, len(data) - 5, 3, 12):
            for bad in (data[:k], data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :], data + b"\0"):
                said = []
                for way in (framing.raws, lambda d: (raw for raw, _ in framing.members(d))):
                    try:
                        said.append(list(way(bad)))
                    except framing.GzError as why:
                        said.append(why.kind)
                assert said[0] == said[1]


def test_lines_of_small_members_share_batches():
    """One batch per member would cost more than its lines."""
    content = b"".join(framing.compressed(b"line %d\n" % i) for i in range(3000))
    made = []

    class Frame:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            made.extend(run(iter([pa.RecordBatch.from_pydict({"path": ["a"], "content": [content]})])))

    members.gz_lines(Frame())
    assert [b.num_rows for b in made] == [3000] and made[0].column("value")[7].as_py() == "line 7"
