"""The first component of sequential DCT JPEG frames, as ordinary motion-JPEG files hold them.

Reads baseline and extended sequential Huffman frames of 8 bits (SOF0, SOF1) of
any size, component count and sampling, in one scan or several, with restart
intervals.  Frames without Huffman tables, which motion-JPEG allows, use the
standard's tables.  Progressive, arithmetic and 12-bit frames raise ValueError,
and so does damage (or
struct.error or IndexError, where a segment is cut).  Memory is that of one frame.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The standard's typical Huffman tables, as numbers of codes by length and symbols by code.
#: Keys are class (0 DC, 1 AC) and table number (0 luminance, 1 chrominance).
TYPICAL = {
    (0, 0): ("00010501010101010100000000000000", "000102030405060708090a0b"),
    (0, 1): ("00030101010101010101010000000000", "000102030405060708090a0b"),
    (1, 0): (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    (1, 1): (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def _zigzag() -> list[int]:
    """Places in a block of 8 x 8 by diagonals, every other one upwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Rows are the cosine waves of the transform.
_WAVES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]


def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: symbol * 32 + code length, or 0 where no code fits."""
    if sum(counts) > len(symbols):
        raise ValueError("Huffman table too short")
    table, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - length)
            start = code << (16 - length)
            if start + span > 65536:
                raise ValueError("Huffman codes overflow")
            table[start : start + span] = [symbols[at] * 32 + length] * span
            code, at = code + 1, at + 1
        code <<= 1
    return table


_TYPICAL_LOOKUPS: dict = {}


def _typical(key: tuple[int, int]) -> list[int]:
    if key not in _TYPICAL_LOOKUPS:
        if key not in TYPICAL:
            raise ValueError("unknown Huffman table")
        _TYPICAL_LOOKUPS[key] = lookup(*(bytes.fromhex(x) for x in TYPICAL[key]))
    return _TYPICAL_LOOKUPS[key]


@dataclass
class _Component:
    across: int
    down: int
    quantiser: int
    blocks_wide: int = 0
    blocks_high: int = 0
    blocks: list = field(default_factory=list)


class _Bits:
    """The bits of one restart interval; ones follow its end."""

    def __init__(self, data: bytes) -> None:
        self.size = 8 * len(data)
        self.data = data + b"\xff" * 8
        self.at = 0

    def window(self) -> int:
        """The next 32 bits."""
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 5], "big") >> (8 - (self.at & 7))) & 0xFFFFFFFF

    def block(self, dc: list[int], ac: list[int], before: int) -> list[int]:
        """Coefficients of a block in natural order; the first is a difference to ``before``."""
        out, k = [0] * 64, 0
        while k < 64:
            bits = self.window()
            found = (ac if k else dc)[bits >> 16]
            if not found or self.at >= self.size:
                raise ValueError("scan too short or damaged")
            length, symbol = found & 31, found >> 5
            run, n = (symbol >> 4, symbol & 15) if k else (0, symbol)
            if n > 15:
                raise ValueError("unsupported coefficient size")
            value = (bits << length & 0xFFFFFFFF) >> (32 - n) if n else 0
            if n and value >> (n - 1) == 0:
                value -= (1 << n) - 1
            self.at += length + n
            if k == 0:
                out[0] = before + value
                k = 1
            elif n:
                k += run
                if k > 63:
                    raise ValueError("coefficient outside its block")
                out[ZIGZAG[k]] = value
                k += 1
            elif run == 15:
                k += 16
            else:
                break
        return out


def _intervals(jpeg: bytes, at: int) -> tuple[list[bytes], int]:
    """Unstuffed bytes of the restart intervals of the scan at ``at``, and where its data end."""
    parts, start = [], at
    while True:
        at = jpeg.find(b"\xff", at)
        if at < 0 or at + 1 >= len(jpeg):
            at = len(jpeg)
            break
        marker = jpeg[at + 1]
        if 0xD0 <= marker <= 0xD7:
            parts.append(jpeg[start:at])
            start = at + 2
        elif marker not in (0x00, 0xFF):
            break
        at += 1 if marker == 0xFF else 2
    parts.append(jpeg[start:at])
    return [x.replace(b"\xff\x00", b"\xff") for x in parts], at


def decode_grey(jpeg: bytes) -> np.ndarray:
    """Samples (height, width) of the first component."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG start")
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], list[int]] = {}
    parts: dict[int, _Component] = {}
    first, interval, at, height, width = None, 0, 2, 0, 0
    most = (1, 1)
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = jpeg[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if len(body) != size - 2:
            raise ValueError("segment too short")
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                if len(body) <= n:
                    raise ValueError("quantiser too short")
                q = np.zeros(64)
                q[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1")
                quantisers[number], body = q, body[1 + n :]
        elif marker == 0xC4:
            while len(body) > 16:
                counts = body[1:17]
                n = sum(counts)
                tables[body[0] >> 4, body[0] & 15] = lookup(counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width or len(body) < 6 + 3 * n:
                raise ValueError("unsupported frame size or precision")
            parts = {body[6 + 3 * k]: _Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if not parts or any(not (0 < c.across <= 4 and 0 < c.down <= 4) for c in parts.values()):
                raise ValueError("unsupported sampling")
            first = next(iter(parts.values()))
            most = (max(c.across for c in parts.values()), max(c.down for c in parts.values()))
            for c in parts.values():
                c.blocks_wide = -(-width // (8 * most[0])) * c.across
                c.blocks_high = -(-height // (8 * most[1])) * c.down
            # A block takes two bits at least, so damage can't claim more than its bytes hold.
            if sum(c.blocks_wide * c.blocks_high for c in parts.values()) > 4 * len(jpeg):
                raise ValueError("frame larger than its data")
            for c in parts.values():
                c.blocks = [None] * (c.blocks_wide * c.blocks_high)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("unsupported JPEG process")
        elif marker == 0xDA:
            if first is None:
                raise ValueError("scan before its frame")
            data, at = _intervals(jpeg, at)
            _scan(body, parts, tables, data, interval, most, height, width)
    if first is None or any(b is None for b in first.blocks) or first.quantiser not in quantisers:
        raise ValueError("no whole first component")
    x = (np.array(first.blocks, np.float64) * quantisers[first.quantiser]).reshape(-1, 8, 8)
    x = np.clip(np.rint(_WAVES.T @ x @ _WAVES + 128), 0, 255).astype(np.uint8)
    x = x.reshape(first.blocks_high, first.blocks_wide, 8, 8).swapaxes(1, 2).reshape(8 * first.blocks_high, 8 * first.blocks_wide)
    if (first.across, first.down) != most:
        x = x.repeat(most[1] // first.down, axis=0).repeat(most[0] // first.across, axis=1)
    return x[:height, :width]


def _scan(head: bytes, parts: dict[int, _Component], tables: dict, data: list[bytes], interval: int, most: tuple[int, int], height: int, width: int) -> None:
    """Fill the blocks of the components of one scan."""
    used = []
    for k in range(head[0]):
        name, choice = head[1 + 2 * k], head[2 + 2 * k]
        if name not in parts:
            raise ValueError("scan of an unknown component")
        dc, ac = ((tables.get(key) or _typical(key)) for key in ((0, choice >> 4), (1, choice & 15)))
        used.append((parts[name], dc, ac))
    if len(used) == 1:
        # A component on its own has no blocks beyond its samples.
        c = used[0][0]
        wide, high = (-(-(-(-n * s // m)) // 8) for n, s, m in ((width, c.across, most[0]), (height, c.down, most[1])))
        units = [[(0, y * c.blocks_wide + x)] for y in range(high) for x in range(wide)]
        for k in range(len(c.blocks)):
            c.blocks[k] = [0] * 64
    else:
        wide, high = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
        units = [
            [(k, (y * c.down + v) * c.blocks_wide + x * c.across + h) for k, (c, _, _) in enumerate(used) for v in range(c.down) for h in range(c.across)]
            for y in range(high)
            for x in range(wide)
        ]
    step = interval or len(units)
    if len(data) < -(-len(units) // step):
        raise ValueError("scan too short")
    for start, own in zip(range(0, len(units), step), data, strict=False):
        bits, before = _Bits(own), [0] * len(used)
        for unit in units[start : start + step]:
            for k, place in unit:
                c, dc, ac = used[k]
                block = bits.block(dc, ac, before[k])
                before[k] = block[0]
                c.blocks[place] = block
