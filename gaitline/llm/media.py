"""Media columns: motion-JPEG in AVI (operator 3).

A binary column holds AVI files of baseline JPEG pictures. Writing stores any byte string
without loss: byte v becomes a flat 8x8 block of grey v, that is a block whose only
coefficient is the DC one (quantiser 8), so that every decoder gives v back. Reading
parses the RIFF chunks and the frame index, decodes the luminance of the intra frames
(interleaved components of any sampling, restarts, the standard's Huffman tables where a
frame has none) and finds shots. The decoder runs all frames of a batch in lock step: one
numpy step handles one symbol of every frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, fresh, text_slices

SIDE = 24  # blocks on each side of a written frame
FRAME = SIDE * SIDE  # payload bytes of a frame
FPS = 25
_CHUNK_FRAMES = 8192
_CHUNK_BYTES = 3_000_000  # of payloads or media at a time; decoding takes about fifty times that

# Code counts by length and symbols of the standard's Huffman tables, by class and number as in a frame, and the order of coefficients.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
STANDARD = {
    0x00: (DC_COUNTS, DC_SYMBOLS),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), DC_SYMBOLS),
    0x10: (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
            "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6"
            "c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    0x11: (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        bytes.fromhex(
            "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a43444546474849"
            "4a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4"
            "c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))  # along the diagonals, turning at each end
# Our own frames have the end of block only.
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as the JPEG standard numbers them."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _frame_header() -> bytes:
    side = SIDE * 8
    return (
        b"\xff\xd8"
        + _marker(0xDB, b"\0" + bytes([8]) + bytes([1] * 63))
        + _marker(0xC0, struct.pack(">BHHBBBB", 8, side, side, 1, 1, 0x11, 0))
        + _marker(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS)
        + _marker(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS)
        + _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@lru_cache(maxsize=1)
def _dc_writer() -> tuple[np.ndarray, np.ndarray, bytes]:
    """For a difference of -255..255 (index + 255): bits with the end of block behind them, their number; the frame header."""
    code = {s: (c, n) for s, c, n in _codes(DC_COUNTS, DC_SYMBOLS)}
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        c, n = code[cat]
        bits[d + 255] = (((c << cat) | (d if d >= 0 else d + (1 << cat) - 1)) << 1)
        size[d + 255] = n + cat + 1
    return bits, size, _frame_header()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """One JPEG picture for each row of ``samples`` (n, 576) uint8."""
    bits, size, header = _dc_writer()
    value = samples.astype(np.int64)
    step = np.diff(value, axis=1, prepend=128) + 255
    code, length = bits[step], size[step]
    ends = np.cumsum(length, axis=1)
    total = (ends[:, -1] + 7) // 8
    base = np.r_[0, np.cumsum(total)]
    pos = ((ends - length) + base[:-1, None] * 8).ravel()
    shifted = code.ravel() << (24 - (pos & 7) - length.ravel())
    at, n = pos >> 3, int(base[-1]) + 3
    out = np.zeros(n)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(at + k, weights=(shifted >> shift) & 255, minlength=n)[:n]
    buf = out.astype(np.uint8)
    buf[base[1:] - 1] |= ((1 << (total * 8 - ends[:, -1])) - 1).astype(np.uint8)
    raw, cut = buf.tobytes(), base.tolist()
    return [header + raw[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip(cut, cut[1:])]


def write_avi(frames: list[bytes], side: int = SIDE * 8, fps: int = FPS) -> bytes:
    """An AVI file with one video stream and an idx1 index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, n, 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """The frames of an AVI file in the order of its index (of its chunks, where it has none) and its frames a second.

    Raises ValueError if the bytes are no AVI file.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, found, rate = None, b"", [], float(FPS)

    def walk(at: int, end: int) -> None:
        nonlocal movi, index, rate
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                    if media[at + 8 + size + (size & 1) :][:4] == b"idx1":
                        at += 8 + size + (size & 1)
                        continue
                walk(at + 12, min(at + 8 + size, end))
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            elif name == b"avih":
                rate = 1e6 / max(1, int.from_bytes(media[at + 8 : at + 12], "little"))
            elif name[2:] in (b"dc", b"db"):
                found.append((at + 8, size))
            at += 8 + size + (size & 1)

    walk(12, len(media))
    if index and movi is not None:
        found = [(movi + off + 8, size) for name, _, off, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if name[2:] in (b"dc", b"db")]
    return [media[a : a + n] for a, n in found], rate


@dataclass(frozen=True)
class Picture:
    """What the markers of a frame say: its size, the blocks of one unit (component, across, down; component 0 is the luminance) with their tables, and how units repeat."""

    wide: int
    high: int
    units_across: int
    units_down: int
    blocks: list[tuple[int, int, int]]
    tables: list[tuple[np.ndarray, np.ndarray]]
    sampling: tuple[int, int]
    quant: np.ndarray
    restart: int


def _table(counts: bytes, symbols: bytes) -> np.ndarray:
    """The codes by their first 16 bits: length | size << 5 | run << 9."""
    lut = np.zeros(65536, np.int64)
    for s, c, length in _codes(counts, symbols):
        lut[c << (16 - length) : (c + 1) << (16 - length)] = length | (s & 15) << 5 | (s >> 4) << 9
    return lut


@lru_cache(maxsize=4)
def _standard(number: int) -> np.ndarray:
    return _table(*STANDARD[number])


@lru_cache(maxsize=64)
def _picture(header: bytes) -> Picture:
    """Reads the markers of a frame. Raises ValueError where it is no baseline picture with all its components in one scan."""
    at, quant, huff, shape, scan, restart = 2, {}, {}, None, [], 0
    while at + 4 <= len(header):
        kind, size = header[at + 1], int.from_bytes(header[at + 2 : at + 4], "big")
        body = header[at + 4 : at + 2 + size]
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.array([int.from_bytes(body[1 + k * wide : 1 + (k + 1) * wide], "big") for k in range(64)])
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC0:
            bits, high, wide, parts = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not (high and wide):
                raise ValueError("pictures of 8 bits and a known size only")
            shape = (wide, high, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)])
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("baseline pictures only")
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
        at += 2 + size
    if shape is None or len(scan) != len(shape[2]):
        raise ValueError("pictures with all components in one scan only")
    wide, high, parts = shape
    if len(parts) == 1:  # a single component is not interleaved, whatever its sampling
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if (parts[0][1], parts[0][2]) != (most_h, most_v):
        raise ValueError("pictures of full luminance only")
    get = lambda number: huff[number] if number in huff else _standard(number)
    use = {c: (get(dc), get(0x10 | ac)) for c, dc, ac in scan}
    blocks = [(k, i, j) for k, (_, h, v, _) in enumerate(parts) for j in range(v) for i in range(h)]
    return Picture(wide, high, -(-wide // (8 * most_h)), -(-high // (8 * most_v)), blocks, [use[p[0]] for p in parts], (most_h, most_v), quant[parts[0][3]], restart)


def _split(frame: bytes, known: bytes) -> tuple[bytes, bytes]:
    """Header up to and with the scan header, and the coded bits without stuffing and restart marks."""
    if known and frame.startswith(known):
        cut = len(known)
    else:
        cut = 2
        while frame[cut + 1] != 0xDA:
            cut += 2 + int.from_bytes(frame[cut + 2 : cut + 4], "big")
        cut += 2 + int.from_bytes(frame[cut + 2 : cut + 4], "big")
    end = frame.rfind(b"\xff\xd9", cut)
    coded = frame[cut : end if end >= 0 else len(frame)]
    return frame[:cut], _MARKS.sub(lambda m: b"" if m[1] != b"\0" else b"\xff", coded) if _MARKS.search(coded.replace(b"\xff\0", b"")) else coded.replace(b"\xff\0", b"\xff")


_MARKS = re.compile(rb"\xff([\0\xd0-\xd7])")
#: Samples of a block from its coefficients, along one side.
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5**0.5 if u == 0 else 1.0) / 2 for u in range(8)] for x in range(8)])


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The luminance of each JPEG picture, as uint8 in reading order: one value for every block where all of them are flat, else one for every sample."""
    out: list = [None] * len(frames)
    groups: dict[bytes, list[tuple[int, bytes]]] = {}
    known = b""
    for k, f in enumerate(frames):
        known, bits = _split(f, known)
        groups.setdefault(known, []).append((k, bits))
    for header, members in groups.items():
        for a in range(0, len(members), _CHUNK_FRAMES):
            part = members[a : a + _CHUNK_FRAMES]
            for (k, _), row in zip(part, _lock_step(_picture(header), [b for _, b in part]), strict=True):
                out[k] = row
    return out


def _lock_step(picture: Picture, coded: list[bytes]) -> list[np.ndarray]:
    n, (h, v) = len(coded), picture.sampling
    across, down = picture.units_across * h, picture.units_down * v
    raw = np.frombuffer(b"".join(b + b"\xff" * 8 for b in coded), np.uint8).astype(np.int64)
    window = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]
    pos = np.r_[0, np.cumsum([len(b) + 8 for b in coded])[:-1]] * 8
    last = (len(window) - 1) * 8

    def symbol(pos, lut):
        x, sh = window[pos >> 3], pos & 7
        entry = lut[(x >> (24 - sh)) & 0xFFFF]
        length, size = entry & 31, entry >> 5 & 15
        if not length.all():
            raise ValueError("broken picture data")
        return x, sh, entry, length, size

    def number(x, sh, length, size):
        value = (x >> (40 - sh - length - size)) & ((1 << size) - 1)
        return np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)

    dc = np.zeros((across * down, n), np.int32)
    level = [np.zeros(n, np.int64) for _ in picture.tables]
    waves: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # frames, block, places and values of other coefficients
    for unit in range(picture.units_across * picture.units_down):
        if picture.restart and unit and unit % picture.restart == 0:
            pos = np.minimum((pos + 7) >> 3 << 3, last)
            level = [np.zeros(n, np.int64) for _ in picture.tables]
        for part, i, j in picture.blocks:
            dc_lut, ac_lut = picture.tables[part]
            block = (unit // picture.units_across * v + j) * across + unit % picture.units_across * h + i
            x, sh, _, length, size = symbol(pos, dc_lut)
            level[part] = level[part] + number(x, sh, length, size)
            if part == 0:
                dc[block] = level[0]
            pos = np.minimum(pos + length + size, last)
            busy, k = None, None
            while True:
                x, sh, entry, length, size = symbol(pos if busy is None else pos[busy], ac_lut)
                run = entry >> 9 & 15
                if busy is None:
                    pos = np.minimum(pos + length + size, last)
                    if not (size | run).any():
                        break
                    busy, k = np.arange(n), np.ones(n, np.int64)
                else:
                    pos[busy] = np.minimum(pos[busy] + length + size, last)
                k = k + run
                if part == 0 and (hit := (size > 0) & (k < 64)).any():
                    waves.append((busy[hit], block, k[hit], number(x, sh, length, size)[hit]))
                go = ((size > 0) | (run == 15)) & (k < 63)
                busy, k = busy[go], k[go] + 1
                if not len(busy):
                    break
    flat = np.clip((dc * picture.quant[0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    if not waves:
        return list(np.ascontiguousarray(flat.T))
    owner = np.concatenate([w[0] for w in waves])
    block, place, value = np.repeat([w[1] for w in waves], [len(w[0]) for w in waves]), np.concatenate([w[2] for w in waves]), np.concatenate([w[3] for w in waves])
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(n + 1))
    out = []
    for f in range(n):
        mine = order[ends[f] : ends[f + 1]]
        if not len(mine):
            out.append(flat[:, f].copy())
            continue
        coefficients = np.zeros((across * down, 64))
        coefficients[:, 0] = dc[:, f] * picture.quant[0]
        coefficients[block[mine], ZIGZAG[place[mine]]] = value[mine] * picture.quant[place[mine]]
        samples = _COSINES @ coefficients.reshape(-1, 8, 8) @ _COSINES.T
        rows = np.clip(np.rint(samples) + 128, 0, 255).astype(np.uint8).reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)
        out.append(rows[: picture.high, : picture.wide].ravel())
    return out


def shots(rows: np.ndarray, window: int = 4, factor: float = 2.0, least: float = 0.08) -> list[tuple[int, int]]:
    """Ranges of frames between cuts. rows: a histogram of each frame, as shares.

    A cut lies where the histogram changes by more than ``least`` and more than the mean
    plus ``factor`` deviations of the changes around it, and by no less than its neighbours.
    """
    change = np.abs(np.diff(rows, axis=0)).sum(axis=1) / 2
    n, cuts = len(change), [0]
    for k in range(n):
        around = np.r_[change[max(0, k - window) : k], change[k + 1 : k + 1 + window]]
        bar = around.mean() + factor * around.std() if len(around) else 0.0
        if change[k] > max(least, bar) and change[k] >= change[max(0, k - 1) : k + 2].max():
            cuts.append(k + 1)
    return list(zip(cuts, [*cuts[1:], n + 1]))


def to_media(df: DataFrame, keep: list[str], payload_col: str) -> DataFrame:
    """``keep`` and a binary column ``media``: the AVI file that stores ``payload_col`` (binary, null as empty).

    The payload is padded with bytes 255 to a positive multiple of 576. No shuffle.
    """
    rows = df.select(*map(column, (*keep, payload_col)))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, len(keep), _CHUNK_BYTES):
            raw = [x or b"" for x in batch.column(len(keep)).to_pylist()]
            sizes = [max(1, -(-len(x) // FRAME)) for x in raw]
            samples = np.frombuffer(b"".join(x + b"\xff" * (n * FRAME - len(x)) for x, n in zip(raw, sizes, strict=True)), np.uint8).reshape(-1, FRAME)
            pictures = [p for k in range(0, len(samples), _CHUNK_FRAMES // 8) for p in encode_frames(samples[k : k + _CHUNK_FRAMES // 8])]
            ends = np.cumsum(sizes).tolist()
            media = [write_avi(pictures[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def read_media(df: DataFrame, keep: list[str], media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """``keep``, digests of the stored file and of the bytes read back, and ``clips``: array of (clip, first_frame, frames, start_s, end_s).

    Media that is null or no motion-JPEG AVI gives nulls and an ``error`` text; it never ends the job.
    """
    rows = df.select(*map(column, (*keep, media_col)))
    schema = ", ".join(f"`{c.replace('`', '``')}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double>>, levels string, error string" + ", payload binary" * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])), pa.string(), pa.string()] + [pa.binary()] * with_payload
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "levels", "error"] + ["payload"] * with_payload

    def rows_of(media: list) -> list[tuple]:
        opened, frames = [], []
        for m in media:
            try:
                own, rate = read_avi(m) if m is not None else ([], FPS)
                decoded = None
                if m is None or not own:
                    raise ValueError("no frames")
                _picture(_split(own[0], b"")[0])
            except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
                own, rate, decoded = [], FPS, str(e) or "broken file"
            opened.append((len(own), rate, decoded))
            frames += own
        try:
            grey = decode_frames(frames)
        except (ValueError, KeyError, IndexError, TypeError, struct.error):
            if len(media) > 1:  # one bad picture must not spoil the others
                return [r for m in media for r in rows_of([m])]
            opened, grey = [(0, FPS, "broken picture data")], []
        sizes = np.array([len(g) for g in grey], np.int64)
        flat = np.concatenate(grey) if grey else np.zeros(0, np.uint8)
        hist = np.bincount(np.repeat(np.arange(len(grey)), sizes) * 16 + (flat >> 4), minlength=16 * len(grey)).reshape(-1, 16) / np.maximum(sizes, 1)[:, None] if grey else np.zeros((0, 16))
        out, at, byte = [], 0, 0
        for m, (n, rate, error) in zip(media, opened, strict=True):
            if error:
                out.append((None, None, None, None, len(m) if m is not None else None, hashlib.sha256(m).hexdigest() if m is not None else None, None, None, error) + (None,) * with_payload)
                continue
            size = int(sizes[at : at + n].sum())
            payload = flat[byte : byte + size].tobytes()
            clips = shots(hist[at : at + n])
            share = hist[at : at + n].mean(axis=0)
            out.append((len(payload.rstrip(b"\xff")), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), [{"clip": k, "first_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate} for k, (a, b) in enumerate(clips)], "".join(format(int(x * 255 + 0.5), "02x") for x in share), None) + (payload,) * with_payload)
            at, byte = at + n, byte + size
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, len(keep), _CHUNK_BYTES):
            columns = list(zip(*rows_of(batch.column(len(keep)).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True))], names=[*keep, *names])

    return rows.mapInArrow(run, schema)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest row of each text stored as media and read back: see :func:`read_media`; ``feature`` is its shots in milliseconds and its grey levels.

    A missing text counts as empty (one frame of bytes 255); a text is stored whole, however long; an empty table gives an
    empty one. Equal texts give equal values; other columns are not read. No shuffle.
    """
    (payload,) = fresh(docs, "payload")
    texts = docs.select(column(id_col), F.encode(F.coalesce(column(text_col), F.lit("")), "UTF-8").alias(payload))
    ms = lambda c: F.round(c * 1000).cast("long").cast("string")
    ranges = F.transform("clips", lambda c: F.concat(ms(c["start_s"]), F.lit("-"), ms(c["end_s"])))
    return read_media(to_media(texts, [id_col], payload), [id_col]).select(column(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.array_join(ranges, ","), F.lit("|"), "levels").alias("feature"))


def clip_rows(df: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """One row per shot: ``keep``, clip, first_frame, frames, start_s, end_s."""
    return read_media(df, keep, media_col).select(*keep, F.inline("clips"))
