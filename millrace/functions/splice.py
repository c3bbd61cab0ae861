"""Decoding DEFLATE from any bit with zlib, without knowing what stands before.

Before the first wanted bit go empty blocks whose length has the same residue modulo 8, so that
stored blocks keep the file's byte grid; after the last wanted bit goes an empty final block, whose
end tells whether the stretch ended at a block's end. Where the 32 KiB before a stretch are not
known, it is decoded with three dictionaries; bytes in which two of them differ are copies from the
unknown window, and the dictionaries' values spell their place there. Stretches go to zlib and come out
in pieces, so that what is held doesn't grow with what they decode to."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from millrace.functions.framing import TRAILER, GzError, header

WINDOW = 1 << 15
#: So many bytes of a stretch go to zlib at a time, and a decoded piece has at most so many.
FED, PIECE = 1 << 16, 1 << 20
_PLACE = np.arange(WINDOW)
DICTIONARIES = [(_PLACE & 255).astype(np.uint8).tobytes(), (_PLACE >> 8).astype(np.uint8).tobytes(), ((_PLACE & 255) ^ 255).astype(np.uint8).tobytes()]
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
_FIXED, _FINAL = 0b10, 0b11  # empty blocks with fixed codes, 10 bits


def _dynamic() -> int:
    """An empty block with dynamic codes: 93 bits."""
    bits = [(0, 1), (2, 2), (0, 5), (0, 5), (15, 4)]
    bits += [(1 if symbol in (1, 18) else 0, 3) for symbol in _ORDER]
    bits += [(1, 1), (127, 7), (1, 1), (107, 7), (0, 1), (0, 1), (0, 1)]
    value = at = 0
    for v, n in bits:
        value |= v << at
        at += n
    return value


def prelude(phase: int) -> tuple[bytes, int]:
    """Whole bytes of empty blocks, and the phase bits that follow them."""
    value, bits = (_dynamic(), 93) if phase % 2 else (0, 0)
    while bits % 8 != phase:
        value |= _FIXED << bits
        bits += 10
    return (value & ((1 << (bits - phase)) - 1)).to_bytes((bits - phase) // 8, "little"), value >> (bits - phase)


def spliced(data: bytes, start: int, stop: int | None, base: int = 0) -> tuple[bytes, int]:
    """A DEFLATE stream of the bits from start to stop, and how many bytes of it stand before the
    byte of start. data begins at byte base of the file."""
    head, low = prelude(start % 8)
    body = bytearray(data[start // 8 - base : None if stop is None else -(-stop // 8) - base])
    if start % 8:
        body[0] = body[0] & (0xFF ^ ((1 << start % 8) - 1)) | low
    if stop is not None:
        rest = stop % 8
        last = (body.pop() & ((1 << rest) - 1)) if rest else 0
        body += (last | _FINAL << rest).to_bytes(-(-(rest + 10) // 8), "little")
    return head + bytes(body), len(head)


@dataclass
class Chunk:
    """What a stretch decodes to, or the end of that; length: of all of it. places are positions in data that are copies
    of the window's byte at the same index of sources (0 is the oldest). members: position in what is decoded, CRC32 and
    length of each member that ends in the stretch."""

    data: bytes = b""
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sources: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    members: list = field(default_factory=list)
    error: str | None = None
    length: int = 0


def _slices(data: bytes, start: int, stop: int | None, base: int) -> Iterator[bytes]:
    """spliced() in slices, without a copy of a long stretch."""
    first, end = start // 8 - base, len(data) if stop is None else -(-stop // 8) - base
    if end - first <= 2 * FED:
        yield spliced(data, start, stop, base)[0]
        return
    view = memoryview(data)[:end]
    yield spliced(view[: first + FED], start, None, base)[0]
    for at in range(first + FED, end - FED, FED):
        yield view[at : min(at + FED, end - FED)]
    yield spliced(view, 8 * (base + end - FED), stop, base)[0]


def streamed(data: bytes, start: int, stop: int | None, dictionaries: list[bytes | None], base: int = 0) -> Iterator[tuple[list[bytes], tuple[int, int] | None]]:
    """The blocks from bit start to bit stop (None: to the end of the file) in pieces, each decoded behind each of the
    dictionaries (None: nothing comes before; after a member's end there is one way only). Where a member ends comes an
    empty list, with the CRC32 and length of its trailer."""
    at = start
    while True:
        source, ahead, fed, rest = _slices(data, at, stop, base), len(prelude(at % 8)[0]), 0, b""
        engines = [zlib.decompressobj(-15, zdict=d) if d else zlib.decompressobj(-15) for d in dictionaries]
        try:
            while not engines[0].eof:
                if not rest:
                    rest = next(source, b"")
                    fed += len(rest)
                raws = [engine.decompress(rest, PIECE) for engine in engines]
                if raws[0]:
                    yield raws, None
                elif not rest:
                    break
                # what dictionaries hold has no part in where codes end
                rest = engines[0].unconsumed_tail
        except zlib.error as why:
            raise GzError("Deflate", str(why)) from None
        if not engines[0].eof:
            raise GzError("Truncated", "body")
        unused = len(engines[0].unused_data)
        if stop is not None and not unused and next(source, None) is None:
            return
        after = at // 8 + fed - unused - ahead
        limit = base + len(data) if stop is None else -(-stop // 8)
        if after + TRAILER > limit:
            raise GzError("Truncated", "trailer")
        yield [], struct.unpack_from("<II", data, after - base)
        if stop is None and after + TRAILER == limit:
            return
        body = header(data, after + TRAILER - base)[0] + base
        if stop is not None and 8 * body > stop:
            raise GzError("Truncated", "the end lies in a header")
        at, dictionaries = 8 * body, [None]
        if at == stop:
            return


def decode(data: bytes, start: int, stop: int | None, known: bool, base: int = 0, last: int | None = None) -> Chunk:
    """The blocks from bit start to bit stop (None: to the end of the file). known: start is a member's
    first bit, so nothing comes before. error is set if stop is not the end of a block, given start. Only the last
    bytes are kept if last says how many."""
    out, ways = Chunk(), [bytearray() for _ in ([None] if known else DICTIONARIES)]
    try:
        for raws, trailer in streamed(data, start, stop, [None] if known else DICTIONARIES, base):
            if trailer:
                out.members.append((out.length, *trailer))
                continue
            out.length += len(raws[0])
            for way, raw in zip(ways, raws if len(raws) == len(ways) else raws * len(ways)):
                way += raw
                if last is not None and len(way) > last:
                    del way[:-last]
    except GzError as why:
        out.error = str(why)
    out.data = bytes(ways[0])
    if not known:
        low, high, other = (np.frombuffer(x, np.uint8) for x in ways)
        out.places = np.flatnonzero(low != other)
        out.sources = low[out.places].astype(np.int64) + 256 * high[out.places].astype(np.int64)
    return out


def resolved(chunk_data: bytes, places: np.ndarray, sources: np.ndarray, window: bytes) -> bytes:
    """chunk_data with the window's bytes in place; a copy from before the start of data is an error."""
    if not len(places):
        return chunk_data
    at = sources.astype(np.int64) - (WINDOW - len(window))
    if at.min() < 0:
        raise GzError("Deflate", "a copy from before the start")
    own = np.frombuffer(chunk_data, np.uint8).copy()
    own[places] = np.frombuffer(window, np.uint8)[at]
    return own.tobytes()


def after(window: np.ndarray, tail: bytes, places: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The window behind a chunk's tail, from that before it. Values are bytes, or 256 and the place in
    a window further back that a byte is copied from."""
    own = np.frombuffer(tail, np.uint8).astype(np.uint16)
    own[places] = window[sources]
    return np.concatenate([window, own])[-WINDOW:]


def filled(window: np.ndarray, before: bytes) -> bytes:
    """A window of values as bytes, given the window (whole, or all there is) that its copies come from."""
    missing = WINDOW - len(before)
    known = np.frombuffer(bytes(missing) + before, np.uint8)
    out = np.where(window < 256, window, known[np.maximum(window.astype(np.int64) - 256, 0)]).astype(np.uint8)
    # what would come from before the file's start is left out; a copy of it fails where it is resolved
    start = int(np.argmax(~((window >= 256) & (window < 256 + missing)))) if ((window < 256) | (window >= 256 + missing)).any() else WINDOW
    return out[start:].tobytes()


def find_block(data: bytes, start: int, stop: int, base: int = 0, trial: int = 8192) -> int | None:
    """The first bit from start (before stop) at which a non-final dynamic block seems to begin: its
    header is possible, its code-length code is complete, and a trial decode goes well."""
    step = 1 << 15
    for lo in range(start // 8, -(-stop // 8), step):
        part = np.frombuffer(data[lo - base : lo - base + step + 16], np.uint8)
        bit = np.append(np.unpackbits(part, bitorder="little"), np.zeros(128, np.uint8)).astype(np.int32)
        n = min(8 * step, 8 * len(part))
        cut = lambda at, size: sum(bit[at + i] << i for i in range(size))
        at = np.flatnonzero((bit[:n] == 0) & (bit[1 : n + 1] == 0) & (bit[2 : n + 2] == 1))
        at = at[(8 * lo + at >= start) & (8 * lo + at < stop)]
        at = at[(cut(at + 3, 5) <= 29) & (cut(at + 8, 5) <= 29)]
        count = cut(at + 13, 4) + 4
        kraft = np.zeros(len(at), np.int64)
        for i in range(19):
            size = cut(at + 17 + 3 * i, 3)
            kraft += np.where((i < count) & (size > 0), 128 >> size, 0)
        for b in at[kraft == 128].tolist():
            here = 8 * lo + b
            stream, _ = spliced(data[: here // 8 - base + trial], here, None, base)
            try:
                engine = zlib.decompressobj(-15, zdict=DICTIONARIES[0])
                if engine.decompress(stream) or engine.eof:
                    return here
            except zlib.error:
                continue
    return None


#: A chain of stored blocks has at least so many headers.
CHAIN = 3


def find_chain(data: bytes, start: int, stop: int, base: int = 0) -> tuple[int, int] | None:
    """The first byte from start (before stop) at which CHAIN stored blocks or more follow each other, and the last
    header of the chain. A stored block ends at a byte's end, so the next one's header is a byte, and then its length
    twice, the second time inverted."""

    def length(at: int) -> int:
        """Of the block whose header is at a place of data, 0 if there is none."""
        head = data[at : at + 5]
        n = int.from_bytes(head[1:3], "little")
        return n if len(head) == 5 and head[0] in (0, 1) and n ^ int.from_bytes(head[3:5], "little") == 0xFFFF else 0

    step = 1 << 20
    for lo in range(start - base, stop - base, step):
        part = np.frombuffer(data[lo : min(lo + step, stop - base) + 4], np.uint8)
        if len(part) < 5:
            return None
        n = len(part) - 4
        for at in (lo + np.flatnonzero((part[:n] == 0) & (part[1 : n + 1] ^ part[3 : n + 3] == 255) & (part[2 : n + 2] ^ part[4 : n + 4] == 255))).tolist():
            last, seen = at, 1
            while size := length(last):
                if data[last] or not length(last + 5 + size):
                    break
                last, seen = last + 5 + size, seen + 1
            if seen >= CHAIN:
                return base + at, base + last
    return None
