"""gzip framing (RFC 1952) and the BGZF extra field: small parsers that tasks call on bytes."""

from __future__ import annotations

import struct
import zlib

# Fixed values of the formats: magic, flag bits, the smallest header and trailer.
MAGIC = b"\x1f\x8b"
FHCRC, FEXTRA, FNAME, FCOMMENT, RESERVED = 2, 4, 8, 16, 0xE0
HEADER, TRAILER = 10, 8


class GzError(ValueError):
    """kind is one of Truncated, BadMagic, UnsupportedMethod, ReservedFlags, Deflate, CrcMismatch,
    IsizeMismatch."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind


def header(data, at: int = 0) -> tuple[int, int, int | None]:
    """Of the header at a place: where the body starts, the flags, and the whole size of a BGZF
    block (None if it isn't one). FHCRC is skipped and not compared; FTEXT is accepted."""
    if len(data) - at < HEADER:
        raise GzError("Truncated", "header")
    if bytes(data[at : at + 2]) != MAGIC:
        raise GzError("BadMagic")
    if data[at + 2] != 8:
        raise GzError("UnsupportedMethod", str(data[at + 2]))
    flags, block, end = data[at + 3], None, at + HEADER
    if flags & RESERVED:
        raise GzError("ReservedFlags", str(flags))
    if flags & FEXTRA:
        if len(data) < end + 2:
            raise GzError("Truncated", "extra field")
        stop = end + 2 + struct.unpack_from("<H", data, end)[0]
        if len(data) < stop:
            raise GzError("Truncated", "extra field")
        block, end = bgzf_size(bytes(data[end + 2 : stop])), stop
    for flag in (FNAME, FCOMMENT):
        if flags & flag:
            while end < len(data) and data[end]:
                end += 1
            end += 1
            if end > len(data):
                raise GzError("Truncated", "text field")
    if flags & FHCRC:
        end += 2
    if end > len(data):
        raise GzError("Truncated", "header checksum")
    return end, flags, block


def bgzf_size(extra: bytes) -> int | None:
    """Block size from the BC subfield among all subfields."""
    at = 0
    while at + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + size
    return None


def member(data, at: int = 0) -> tuple[bytes, dict]:
    """Decodes the member at a place: its bytes, and its row of the member table. CRC32 is compared
    before the length."""
    body, flags, block = header(data, at)
    if block is not None and at + block > len(data):
        raise GzError("Truncated", "BGZF block")
    engine, parts, end, step = zlib.decompressobj(-15), [], body, 1 << 12
    while not engine.eof:
        # what follows the member is copied by zlib, so little more than the member is fed
        part = data[end : end + step]
        if not len(part):
            raise GzError("Truncated", "body")
        try:
            parts.append(engine.decompress(part))
        except zlib.error as why:
            raise GzError("Deflate", str(why)) from None
        end, step = end + len(part), min(2 * step, 1 << 20)
    end -= len(engine.unused_data)
    if end + TRAILER > len(data):
        raise GzError("Truncated", "trailer")
    raw = b"".join(parts)
    crc, size = struct.unpack_from("<II", data, end)
    row = {
        "header_offset": at, "body_offset": body, "trailer_offset": end, "flg": flags, "bgzf_block_size": block, "crc32_expected": crc, "isize_expected": size,
        "crc32_actual": zlib.crc32(raw), "raw_length": len(raw), "crc_ok": zlib.crc32(raw) == crc, "isize_ok": len(raw) & 0xFFFFFFFF == size,
    }
    return raw, row


def _checked(row: dict, at: int) -> None:
    if not row["crc_ok"]:
        raise GzError("CrcMismatch", f"at {at}")
    if not row["isize_ok"]:
        raise GzError("IsizeMismatch", f"at {at}")


def members(data):
    """All members of a file's bytes, in order; raises at the first that is not valid. Whatever
    follows a trailer must be a member; no bytes at all are an error."""
    at = 0
    while at == 0 or at < len(data):
        raw, row = member(data, at)
        _checked(row, at)
        yield raw, row
        at = row["trailer_offset"] + TRAILER


def raws(data):
    """What members() decodes, without the rows: zlib reads headers and compares trailers itself. Whatever it
    doesn't take is looked at by member(), which says what is wrong."""
    at, step = 0, 1 << 9
    while at == 0 or at < len(data):
        engine, parts, end = zlib.decompressobj(31), [], at
        try:
            while not engine.eof and (part := data[end : end + step]):
                parts.append(engine.decompress(part))
                end, step = end + len(part), min(2 * step, 1 << 20)
            # a BGZF block's size is a matter of member()
            good = engine.eof and not data[at + 3] & FEXTRA
        except zlib.error:
            good = False
        if good:
            end -= len(engine.unused_data)
            yield parts[0] if len(parts) == 1 else b"".join(parts)
        else:
            raw, row = member(data, at)
            _checked(row, at)
            yield raw
            end = row["trailer_offset"] + TRAILER
        at, step = end, max(1 << 9, min(1 << 14, 2 * (end - at)))


def stream(read, at: int, size: int, step: int = 1 << 18):
    """Decoded pieces of the members from a place of a file on, read as they are asked for. read(place,
    n) gives bytes of the file, size is its length."""
    while at < size:
        end = at + header(read(at, 1 << 17))[0]
        engine, crc, n = zlib.decompressobj(-15), 0, 0
        while not engine.eof:
            part = read(end, step)
            if not part:
                raise GzError("Truncated", "body")
            try:
                raw = engine.decompress(part)
            except zlib.error as why:
                raise GzError("Deflate", str(why)) from None
            crc, n, end = zlib.crc32(raw, crc), n + len(raw), end + len(part)
            yield raw
        end -= len(engine.unused_data)
        trailer = read(end, TRAILER)
        if len(trailer) < TRAILER:
            raise GzError("Truncated", "trailer")
        if struct.unpack("<II", trailer) != (crc, n & 0xFFFFFFFF):
            raise GzError("CrcMismatch" if struct.unpack("<II", trailer)[0] != crc else "IsizeMismatch", f"at {at}")
        at = end + TRAILER


def compressed(raw: bytes, level: int = 6, extra: bytes = b"") -> bytes:
    """One gzip member, for writing."""
    body = zlib.compress(raw, level, -15)
    field = struct.pack("<H", len(extra)) + extra if extra else b""
    return MAGIC + bytes([8, FEXTRA if extra else 0, 0, 0, 0, 0, 0, 255]) + field + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def bgzf(raw: bytes, block: int = 48_000, level: int = 6, end: bool = True) -> bytes:
    """raw as BGZF blocks, with the empty block at the end if end is set."""
    out = []
    for part in [raw[at : at + block] for at in range(0, len(raw), block)] + [b""] * end:
        size = len(compressed(part, level, b"BC\x02\x00\x00\x00"))
        out.append(compressed(part, level, b"BC\x02\x00" + struct.pack("<H", size - 1)))
    return b"".join(out)
