"""Pictures that others might have written: colour, all coefficients, restarts, the standard's Huffman tables."""

import math
import struct

import numpy as np
import pytest

from gaitline.llm import media


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, code, length):
        self.text += format(code, f"0{length}b") if length else ""

    def take(self):
        self.text += "1" * (-len(self.text) % 8)
        raw = bytes(int(self.text[k : k + 8], 2) for k in range(0, len(self.text), 8))
        self.text = ""
        return raw.replace(b"\xff", b"\xff\0")


def encode(planes, quant, restart=0, own_tables=False, sampling=2):
    """A plain baseline encoder: planes (a luminance, and none or two at 1 / sampling of its size), and the luminance that a decoder should give."""
    side = len(planes) > 1 and sampling or 1
    high, wide = planes[0].shape
    down, across = -(-high // (8 * side)), -(-wide // (8 * side))
    code = {n: {s: (c, k) for s, c, k in media._codes(*media.STANDARD[n])} for n in media.STANDARD}
    zigzag = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    wave = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
    padded = [np.pad(p, ((0, down * 8 * (side if k == 0 else 1) - p.shape[0]), (0, across * 8 * (side if k == 0 else 1) - p.shape[1])), mode="edge").astype(float) for k, p in enumerate(planes)]
    back = np.zeros_like(padded[0])
    out, bits, last, count = b"", Bits(), [0] * len(planes), 0
    for y in range(down):
        for x in range(across):
            if restart and count and count % restart == 0:
                out += bits.take() + bytes([0xFF, 0xD0 + (count // restart - 1) % 8])
                last = [0] * len(planes)
            count += 1
            for c, plane in enumerate(padded):
                n = side if c == 0 else 1
                for j in range(n):
                    for i in range(n):
                        top, left = (y * n + j) * 8, (x * n + i) * 8
                        raw = np.rint((wave @ (plane[top : top + 8, left : left + 8] - 128) @ wave.T).ravel()[zigzag] / quant).astype(int)
                        if c == 0:
                            natural = np.zeros(64)
                            natural[zigzag] = raw * quant
                            back[top : top + 8, left : left + 8] = wave.T @ natural.reshape(8, 8) @ wave + 128
                        table, step = min(c, 1), raw[0] - last[c]
                        last[c] = raw[0]
                        size = int(abs(step)).bit_length()
                        bits.put(*code[table][size])
                        bits.put(step if step >= 0 else step + (1 << size) - 1, size)
                        run = 0
                        top_k = max([k for k in range(1, 64) if raw[k]], default=0)
                        for k in range(1, top_k + 1):
                            if not raw[k]:
                                run += 1
                                continue
                            while run > 15:
                                bits.put(*code[0x10 + table][0xF0])
                                run -= 16
                            size = int(abs(raw[k])).bit_length()
                            bits.put(*code[0x10 + table][run << 4 | size])
                            bits.put(int(raw[k]) if raw[k] >= 0 else int(raw[k]) + (1 << size) - 1, size)
                            run = 0
                        if top_k < 63:
                            bits.put(*code[0x10 + table][0])
    head = b"\xff\xd8" + media._marker(0xE0, b"AVI1\0") + media._marker(0xDB, b"\0" + bytes(int(q) for q in quant))
    parts = bytes(v for c in range(len(planes)) for v in (c + 1, (side << 4 | side) if c == 0 else 0x11, 0))
    head += media._marker(0xC0, struct.pack(">BHHB", 8, high, wide, len(planes)) + parts)
    if own_tables:
        head += b"".join(media._marker(0xC4, bytes([n]) + media.STANDARD[n][0] + media.STANDARD[n][1]) for n in media.STANDARD)
    if restart:
        head += media._marker(0xDD, struct.pack(">H", restart))
    head += media._marker(0xDA, bytes([len(planes)]) + bytes(v for c in range(len(planes)) for v in (c + 1, 0x11 * min(c, 1))) + bytes([0, 63, 0]))
    return head + out + bits.take() + b"\xff\xd9", np.clip(np.rint(back), 0, 255).astype(int)[:high, :wide]


@pytest.mark.parametrize(("colour", "restart", "own_tables", "sampling"), [(False, 0, False, 1), (True, 0, True, 2), (True, 3, False, 2), (True, 1, False, 1), (False, 2, True, 1)])
def test_foreign_pictures(colour, restart, own_tables, sampling):
    rng = np.random.default_rng(7)
    quant = np.array([8 + k // 4 for k in range(64)])
    frames, want = [], []
    for k in range(5):
        y = np.add.outer(np.linspace(0, 200, 37), 30 * np.sin(np.arange(53) / (2 + k))) + rng.normal(0, 12, (37, 53))
        planes = [np.clip(y, 0, 255)] + ([rng.integers(0, 256, (-(-37 // sampling), -(-53 // sampling))).astype(float) for _ in range(2)] if colour else [])
        frame, back = encode(planes, quant, restart, own_tables, sampling)
        frames.append(frame)
        want.append(back)
    got = media.decode_frames(frames)
    for g, w in zip(got, want, strict=True):
        assert np.abs(g.reshape(37, 53).astype(int) - w).max() <= 1


def test_files_of_others(spark):
    quant = np.full(64, 6)
    dark, light = np.full((32, 48), 40.0) + np.arange(48), np.full((32, 48), 150.0) + np.arange(48)
    chroma = [np.full((16, 24), 128.0)] * 2
    frames = [encode([p, *chroma], quant)[0] for p in [dark] * 6 + [light] * 5]
    progressive = frames[0].replace(b"\xff\xc0", b"\xff\xc2", 1)
    cut = frames[0][: len(frames[0]) // 2]
    files = [media.write_avi(frames, 48), media.write_avi([progressive], 48), media.write_avi([frames[0], cut[:40]], 48), media.write_avi([], 48)]
    rows = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "k int, media binary")
    got = {r.k: r for r in media.read_media(rows, ["k"]).collect()}
    assert [(c.first_frame, c.frames) for c in got[0].clips] == [(0, 6), (6, 5)] and got[0].error is None and got[0].payload_bytes == 11 * 32 * 48
    assert all(got[k].error and got[k].media_bytes for k in (1, 2, 3))
    assert media.clip_rows(rows, ["k"]).count() == 2
