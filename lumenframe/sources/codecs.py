"""PNG, BMP and JPEG encoders over numpy arrays."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter

import numpy as np


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray) -> bytes:
    """PNG of an array (h, w, 1), (h, w, 3) or (h, w, 4) of bytes in the order b, g, r, a."""
    h, w, n = pixels.shape
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[n]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels[..., order].reshape(h, w * n)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP; gray is repeated, alpha left out."""
    h, w, n = pixels.shape
    body = np.repeat(pixels, 3, axis=2) if n == 1 else pixels[..., :3]
    lines = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    lines[:, : 3 * w] = body[::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def code_lengths(counts: Counter[int]) -> list[tuple[int, int]]:
    """(length, symbol) of a prefix code of at most 16 bits, as a JPEG table lists them; no code is all ones."""
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, (-1,))]  # -1 takes the code of ones
    heapq.heapify(heap)
    length = dict.fromkeys((-1, *counts), 0)
    tie = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        heapq.heappush(heap, (n + m, tie, a + b))
        tie += 1
    at = Counter(length.values())
    for long in range(max(at), 16, -1):  # two of the longest codes move up below a shorter one
        while at[long]:
            free = next(j for j in range(long - 2, 0, -1) if at[j])
            at[long] -= 2
            at[long - 1] += 1
            at[free + 1] += 2
            at[free] -= 1
    at[max(n for n in at if at[n])] -= 1  # that of ones
    lengths = [n for n in range(1, 17) for _ in range(at[n])]
    return list(zip(lengths, sorted(counts, key=lambda s: (-counts[s], s)), strict=True))


def _codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol to (code, length)."""
    out, code, last = {}, 0, 0
    for n, s in lengths:
        code <<= n - last
        out[s] = (code, n)
        code, last = code + 1, n
    return out


def _zigzag() -> list[tuple[int, int]]:
    """(row, column) of the places of a block by diagonals, up and down in turn."""
    return sorted(np.ndindex(8, 8), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def _blocks(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Quantised cosine transforms of the 8 x 8 blocks of a plane, row by row; the last row and column are repeated."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    cosines = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    cut = full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint(cosines @ cut @ cosines.T / steps).astype(np.int64)


def _symbols(block: list[int], before: int) -> list[tuple[int, int, int]]:
    """(symbol, bits, number of bits) of a block in zigzag order, that of the mean first."""
    bits = lambda v: ((v if v > 0 else v + (1 << abs(v).bit_length()) - 1), abs(v).bit_length())
    diff = block[0] - before
    out, zeros = [(abs(diff).bit_length(), *bits(diff))], 0
    last = max((i for i in range(1, 64) if block[i]), default=0)
    for v in block[1 : last + 1]:
        if not v:
            zeros += 1
            continue
        while zeros > 15:
            out.append((0xF0, 0, 0))
            zeros -= 16
        out.append((zeros << 4 | abs(v).bit_length(), *bits(v)))
        zeros = 0
    return out + [(0, 0, 0)] * (last < 63)


def jpeg(pixels: np.ndarray, quality: int = 90) -> bytes:
    """Baseline JPEG without subsampling; alpha left out.  Steps grow with the frequency, codes are the image's own."""
    h, w, n = pixels.shape
    if n == 1:
        planes = [pixels[..., 0].astype(float)]
    else:
        b, g, r = (pixels[..., i].astype(float) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    steps = np.clip(np.rint((10 + 5 * np.add.outer(np.arange(8), np.arange(8))) * (100 - quality) / 50), 1, 255)
    order = _zigzag()
    rows, columns = ([p[i] for p in order] for i in (0, 1))
    made = [_blocks(p, steps)[:, rows, columns].tolist() for p in planes]
    units, before = [], [0] * len(planes)
    for unit in zip(*made, strict=True):
        for c, block in enumerate(unit):
            units.append(_symbols(block, before[c]))
            before[c] = block[0]
    tables = [code_lengths(Counter(u[0][0] for u in units)), code_lengths(Counter(s for u in units for s, _, _ in u[1:]) or Counter([0]))]
    codes = [_codes(t) for t in tables]
    text = []
    for u in units:
        for i, (s, value, size) in enumerate(u):
            code, length = codes[i > 0][s]
            text.append(f"{code:0{length}b}" + (f"{value:0{size}b}" if size else ""))
    body = "".join(text)
    body += "1" * (-len(body) % 8)
    segment = lambda kind, data: struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data
    names = range(1, len(planes) + 1)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + segment(0xDB, bytes([0, *(int(steps[p]) for p in order)]))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([c, 0x11, 0]) for c in names))
    for i, t in enumerate(tables):
        out += segment(0xC4, bytes([i << 4, *(sum(length == k for length, _ in t) for k in range(1, 17)), *(s for _, s in t)]))
    out += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c, 0]) for c in names) + b"\0\x3f\0")
    return out + int(body, 2).to_bytes(len(body) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


ENCODERS = {"png": png, "bmp": bmp, "jpg": jpeg}


def encode(kind: str, height: int, width: int, n_channels: int, data: bytes) -> bytes:
    if kind not in ENCODERS:
        raise ValueError(f"images are written as {', '.join(ENCODERS)}, not {kind}")
    return ENCODERS[kind](np.frombuffer(data, np.uint8).reshape(height, width, n_channels))
