"""Progressive JPEG: payloads stored without loss as quantised coefficients, and a decoder to RGB tensors.

Writing: three components, chroma halved both ways (4:2:0). Each payload byte is one quantised coefficient, in the
zigzag order of its block: at the DC place the byte itself, elsewhere the value of eight magnitude bits that read as
that byte (128..255 or -255..-128), so that no coefficient is zero. Entropy coding loses nothing. Scans: DC without its
low bit; AC bands without it (luma 1-5 and 6-63, chroma 1-63), which is spectral selection; then the low bits, which is
successive approximation. Codes are as short as their tables allow, and most scans have a single symbol.

Reading: scans accumulate into coefficient arrays. The symbol, its length and the next code's place are looked up for
every bit of a scan at once, a walk over the places gives the symbols, and their values are taken as arrays; scans of a
single symbol need no walk. Only refinements, whose bits depend on what stands already, go symbol by symbol. Restart
intervals are read. Planes come from an inverse transform in numpy, chroma is repeated to full size. What is malformed,
cut off or of another kind raises Unreadable.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BLOCK, UNIT, MCU_BLOCKS = 64, 576, 6
APP_NAME = b"LXPAY\x00"
SIDE_LIMIT = 65535 // 16


def zigzag() -> list[int]:
    """Row-major index of each zigzag place."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return [r * 8 + c for r, c in cells]


def inverse_basis() -> np.ndarray:
    """Row: zigzag coefficient, column: sample of the 8 x 8 block, row-major."""
    x = np.arange(8)
    cosine = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("ux,vy->uvxy", cosine, cosine).reshape(64, 64)
    return full[zigzag()].astype(np.float32)


BASIS = inverse_basis()


# ---------------------------------------------------------------- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(kind: int, number: int, lengths: dict[int, list[int]]) -> bytes:
    """lengths: symbols by code length."""
    counts = bytes(len(lengths.get(n, [])) for n in range(1, 17))
    return segment(0xC4, bytes([kind << 4 | number]) + counts + bytes(s for n in range(1, 17) for s in lengths.get(n, [])))


def scan(components: list[tuple[int, int, int]], band: tuple[int, int], high: int, low: int, bits: bytes) -> bytes:
    """components: (id, DC table, AC table)."""
    head = bytes([len(components)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in components) + bytes([*band, high << 4 | low])
    return segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last one filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)])).tobytes()


#: DC sizes 0 to 7 in four bits each; AC tables of one symbol: size 7 without a run, and end of block.
TABLES = huffman_segment(0, 0, {4: list(range(8))}) + huffman_segment(1, 0, {1: [0x07]}) + huffman_segment(1, 1, {1: [0x00]})
QUANTISERS = segment(0xDB, bytes([0]) + bytes([1] * 64))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds a payload of whole blocks of 64 bytes."""
    blocks = len(payload) // BLOCK
    if not blocks or blocks * BLOCK != len(payload):
        raise ValueError("a payload is one or more blocks of 64 bytes")
    mcus = -(-blocks // MCU_BLOCKS)
    wide = int(np.ceil(np.sqrt(mcus)))
    tall = -(-mcus // wide)
    if max(wide, tall) > SIDE_LIMIT:
        raise ValueError("the payload exceeds the largest image")
    data = np.full(wide * tall * MCU_BLOCKS * BLOCK, 255, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    data = data.reshape(tall, wide, MCU_BLOCKS, BLOCK)
    luma = data[:, :, :4].reshape(tall, wide, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    planes = [luma, data[:, :, 4].reshape(-1, BLOCK), data[:, :, 5].reshape(-1, BLOCK)]

    dc = data[..., 0].reshape(-1, MCU_BLOCKS)
    high = (dc >> 1).astype(np.int16)
    step = np.empty_like(high)
    step[:, 1:4] = high[:, 1:4] - high[:, 0:3]
    step[:, 0] = high[:, 0] - np.concatenate(([0], high[:-1, 3]))
    step[:, 4:] = np.diff(high[:, 4:], axis=0, prepend=np.zeros((1, 2), dtype=np.int16))
    step = step.ravel()
    size = np.ceil(np.log2(np.abs(step) + 1)).astype(np.int16)
    value = np.where(step < 0, step + (1 << size) - 1, step)
    code = (size.astype(np.uint16) << 12) | (value.astype(np.uint16) << (12 - size).astype(np.uint16))
    bits = np.unpackbits(code.astype(">u2").view(np.uint8)).reshape(-1, 16)
    first_dc = packed(bits[np.arange(16) < (size + 4)[:, None]])

    def coarse(plane, a, b):  # a code bit 0 and seven magnitude bits: the byte without its low bit
        return (plane[:, a : b + 1] >> 1).tobytes()

    def fine(plane):  # a code bit 0 and a low bit of each magnitude
        low = (plane & 1) ^ (plane < 128)
        low[:, 0] = 0
        return np.packbits(low, axis=1).tobytes()

    scans = [scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], (0, 0), 0, 1, first_dc)]
    scans += [scan([(k, 0, 0)], (a, b), 0, 1, coarse(planes[k - 1], a, b)) for k, a, b in ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))]
    scans.append(scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], (0, 0), 1, 0, packed((dc & 1).ravel())))
    scans += [scan([(k, 0, 1)], (1, 63), 1, 0, fine(planes[k - 1])) for k in (1, 2, 3)]
    frame = struct.pack(">BHHB", 8, tall * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"".join([b"\xff\xd8", segment(0xEF, APP_NAME + struct.pack(">Q", blocks)), QUANTISERS, segment(0xC2, frame), TABLES, *scans, b"\xff\xd9"])


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    grid: tuple[int, int]  # blocks down and across, in whole MCUs
    own: tuple[int, int]  # those of a scan of this component alone
    values: np.ndarray  # coefficients: blocks down, across, zigzag


@dataclass
class Huffman:
    symbol: np.ndarray  # by the next 16 bits
    length: np.ndarray
    single: tuple[int, int] | None  # symbol and length, if there is one code


@lru_cache(maxsize=64)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    symbol, length, code, k = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            a, b = code << (16 - n), (code + 1) << (16 - n)
            symbol[a:b], length[a:b] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    only = (symbols[0], next(n for n in range(1, 17) if counts[n - 1])) if k == 1 else None
    return Huffman(symbol, length, only)


class Unreadable(ValueError):
    """The reason why an image cannot be read."""


def code_windows(data: bytes) -> np.ndarray:
    """The 16 bits from each bit on, ones after the end."""
    raw = np.frombuffer(data + b"\xff\xff\xff", dtype=np.uint8).astype(np.uint32)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (three[: len(data), None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).ravel()


def bit_array(data: bytes, count: int) -> np.ndarray:
    if count > 8 * len(data):
        raise Unreadable("a scan is cut off")
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-count // 8)))[:count]


def extended(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of `size` bits as signed numbers: those with a leading 0 are negative."""
    return np.where((size > 0) & (raw >> np.maximum(size - 1, 0) == 0), raw - (1 << size) + 1, raw)


class Bits:
    """Entropy-coded data read bit by bit, for refinements."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist(), 0
        self.windows = code_windows(data).tolist()

    def take(self, n: int) -> int:
        value = 0
        if self.at + n > len(self.bits):
            raise Unreadable("a scan is cut off")
        for x in self.bits[self.at : self.at + n]:
            value = value << 1 | x
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        if self.at >= len(self.bits):
            raise Unreadable("a scan is cut off")
        window = self.windows[self.at]
        n = int(table.length[window])
        if not n:
            raise Unreadable("a code that its table lacks")
        self.at += n
        return int(table.symbol[window])


def scan_order(parts: list[Component], mcus: tuple[int, int]) -> list[tuple[Component, np.ndarray]]:
    """For an interleaved scan: each component with its block numbers, MCU by MCU."""
    down, across = np.indices(mcus).reshape(2, -1)
    out = []
    for c in parts:
        r = (down[:, None] * c.down + np.repeat(np.arange(c.down), c.across)).astype(np.int64)
        k = across[:, None] * c.across + np.tile(np.arange(c.across), c.down)
        out.append((c, r * c.grid[1] + k))
    return out


def dc_scan(order: list[tuple[Component, np.ndarray]], data: bytes, tables, high: int, low: int) -> None:
    """A restart interval: order has each component with its block numbers, a row an MCU."""
    n, width = sum(x.size for _, x in order), sum(x.shape[1] for _, x in order)
    if high:
        values = bit_array(data, n).astype(np.int16) << low
    else:
        windows = code_windows(data)
        # Where the next code begins, from every bit, for each component of an MCU in turn.
        steps, kinds = {}, [i for i, (_, x) in enumerate(order) for _ in range(x.shape[1])]
        for table in tables:
            if id(table) not in steps:
                steps[id(table)] = (np.arange(len(windows)) + table.length[windows] + table.symbol[windows]).tolist()
        jumps, at, starts = [steps[id(tables[i])] for i in kinds], 0, []
        try:
            for k in range(n):
                starts.append(at)
                at = jumps[k % len(jumps)][at]
        except IndexError:
            raise Unreadable("a scan is cut off") from None
        starts, which = np.array(starts), np.resize(np.array(kinds), n)
        length, size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i, table in enumerate(tables):
            own = which == i
            length[own], size[own] = table.length[windows[starts[own]]], table.symbol[windows[starts[own]]]
        if (length == 0).any() or (size > 11).any():
            raise Unreadable("a code that its table lacks")
        windows = np.concatenate([windows, [0xFFFF]])
        values = extended(windows[np.minimum(starts + length, len(windows) - 1)].astype(np.int64) >> (16 - size), size)
    at, values = 0, values.reshape(-1, width)
    for c, blocks in order:
        own = values[:, at : at + blocks.shape[1]]
        flat = c.values.reshape(-1, BLOCK)
        if high:
            flat[blocks.ravel(), 0] |= own.ravel().astype(np.int16)
        else:
            flat[blocks.ravel(), 0] = np.cumsum(own.ravel()) << low
        at += blocks.shape[1]


def ac_first(c: Component, blocks: np.ndarray, data: bytes, table: Huffman, a: int, b: int, low: int) -> None:
    """A restart interval of a first scan; blocks are its block numbers in order."""
    flat, count = c.values.reshape(-1, BLOCK), len(blocks) * (b - a + 1)
    if table.single and 0 < table.single[0] < 16:
        size, code = table.single
        if size + code == 8:
            if count > len(data):
                raise Unreadable("a scan is cut off")
            raw = np.frombuffer(data, dtype=np.uint8, count=count) & ((1 << size) - 1)
        else:
            raw = bit_array(data, count * (size + code)).reshape(count, -1)[:, code:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        flat[blocks, a : b + 1] = (extended(raw.astype(np.int16), np.int16(size)) * (1 << low)).reshape(len(blocks), -1)
        return
    windows = code_windows(data)
    symbols, lengths = table.symbol[windows].astype(np.int64), table.length[windows].astype(np.int64)
    runs, sizes = symbols >> 4, symbols & 15
    more = np.where(sizes > 0, sizes, np.where(runs < 15, runs, 0))  # bits behind a code: of a value, or of a run of ends
    after = (np.arange(len(windows)) + np.maximum(lengths, 1) + more).tolist()
    at, starts = 0, []
    while at < len(after):
        starts.append(at)
        at = after[at]
    starts = np.array(starts, dtype=np.int64)
    n, run, size, own = lengths[starts], runs[starts], sizes[starts], more[starts]
    value = np.concatenate([windows, [0xFFFF]])[np.minimum(starts + n, len(windows))].astype(np.int64) >> (16 - own)
    places, chosen, block, place, used = [], [], 0, a, 0
    for r, s, v in zip(run.tolist(), size.tolist(), value.tolist(), strict=True):
        if block >= len(blocks):
            break
        if s:
            place += r
            if place > b:
                raise Unreadable("a coefficient outside its band")
            places.append((block, place))
            chosen.append(used)
            place += 1
        elif r == 15:
            place += 16
        else:
            block, place = block + (1 << r) + v, a
        if place > b:
            block, place = block + 1, a
        used += 1
    if block != len(blocks):
        raise Unreadable("a scan is cut off")
    if (n[:used] == 0).any():
        raise Unreadable("a code that its table lacks")
    if places:
        where, chosen = np.array(places), np.array(chosen)
        flat[blocks[where[:, 0]], where[:, 1]] = extended(value[chosen], size[chosen]) * (1 << low)


def ac_refine(c: Component, blocks: np.ndarray, data: bytes, table: Huffman, a: int, b: int, low: int) -> None:
    """A restart interval of a refinement; blocks are its block numbers in order."""
    flat, n, one = c.values.reshape(-1, BLOCK), b - a + 1, 1 << low
    if table.single and table.single[0] == 0 and (flat[blocks, a : b + 1] != 0).all():
        more = bit_array(data, len(blocks) * (table.single[1] + n)).reshape(len(blocks), -1)[:, table.single[1] :].astype(np.int16) << low
        now = flat[blocks, a : b + 1]
        flat[blocks, a : b + 1] = now + np.where(now < 0, -more, more)
        return
    bits, skip = Bits(data), 0
    for number in blocks.tolist():
        block, at = flat[number].tolist(), a

        def correct(at, block=block):
            if bits.take(1) and not abs(block[at]) & one:
                block[at] += one if block[at] > 0 else -one

        while not skip and at <= b:
            run, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif run < 15:
                skip = (1 << run) + (bits.take(run) if run else 0)
                break
            while at <= b:
                if block[at]:
                    correct(at)
                elif run == 0:
                    break
                else:
                    run -= 1
                at += 1
            if value:
                if at > b:
                    raise Unreadable("a coefficient outside its band")
                block[at] = value
            at += 1
        if skip:
            for x in range(at, b + 1):
                if block[x]:
                    correct(x)
            skip -= 1
        flat[number] = block


SCAN_END = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])", re.DOTALL)
RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


class Image:
    """A parsed progressive JPEG: coefficients of its components, quantisers, and the payload's number of blocks (None
    in images that encode() did not make)."""

    def __init__(self, data: bytes) -> None:
        try:
            self.parse(data)
            if not self.components:
                raise Unreadable("no frame")
        except (IndexError, KeyError, TypeError, struct.error) as e:
            raise Unreadable(f"cut off or malformed ({type(e).__name__})") from None
        except Unreadable:
            raise
        except ValueError as e:  # of numpy, on segments that are too short
            raise Unreadable(f"malformed: {e}") from None

    def parse(self, data: bytes) -> None:
        self.quantisers: dict[int, np.ndarray] = {}
        self.components: dict[int, Component] = {}
        self.payload_blocks, tables, at, self.interval = None, {}, 2, 0
        if data[:2] != b"\xff\xd8":
            raise Unreadable("not a JPEG")
        while True:
            if data[at] != 0xFF:
                raise Unreadable("no marker where one must stand")
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=1).astype(np.float32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = huffman(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC2:
                self.frame(body, len(data))
            elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)):
                raise Unreadable("not a progressive Huffman frame")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xEF and body.startswith(APP_NAME):
                self.payload_blocks = struct.unpack_from(">Q", body, len(APP_NAME))[0]
            elif marker == 0xDA:
                end = SCAN_END.search(data, at)
                if not end:
                    raise Unreadable("a scan is cut off")
                parts = [x.replace(b"\xff\x00", b"\xff") for x in RESTART.split(data[at : end.start()])]
                self.read_scan(body, parts, tables)
                at = end.start()

    def frame(self, body: bytes, weight: int) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        specs = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if self.components or precision != 8 or n not in (1, 3) or not self.height or not self.width or any(not 1 <= x <= 4 for s in specs for x in s[1:3]):
            raise Unreadable("a frame of another kind: 8 bits, one or three components and a height are read")
        self.across, self.down = max(s[1] for s in specs), max(s[2] for s in specs)
        if any(self.across % s[1] or self.down % s[2] for s in specs):
            raise Unreadable("sampling in fractions is not read")
        self.mcus = (-(-self.height // (8 * self.down)), -(-self.width // (8 * self.across)))
        if self.mcus[0] * self.mcus[1] > 8 * weight:  # a block takes a bit at least
            raise Unreadable("larger than its data")
        for number, h, v, table in specs:
            grid = (self.mcus[0] * v, self.mcus[1] * h)
            own = (-(-self.height * v // (8 * self.down)), -(-self.width * h // (8 * self.across)))
            self.components[number] = Component(number, h, v, table, grid, own, np.zeros((*grid, BLOCK), dtype=np.int16))

    def read_scan(self, head: bytes, parts: list[bytes], tables) -> None:
        chosen = [(self.components[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(head[0])]
        a, b, high, low = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
        components = [c for c, _ in chosen]
        if not chosen or b > 63 or a > b or low > 13 or (a == 0 and b > 0) or (a > 0 and len(chosen) > 1):
            raise Unreadable("a scan of a kind that progressive frames lack")
        if len(components) > 1:
            order = scan_order(components, self.mcus)
        else:
            c = components[0]
            order = [(c, (np.arange(c.own[0])[:, None] * c.grid[1] + np.arange(c.own[1])).reshape(-1, 1))]
        units = len(order[0][1])
        step = self.interval or units
        if len(parts) != -(-units // step):
            raise Unreadable("restart marks do not fit the interval")
        for i, data in enumerate(parts):
            some = [(c, x[i * step : (i + 1) * step]) for c, x in order]
            if a == 0:
                dc_scan(some, data, [None if high else tables[0, t >> 4] for _, t in chosen], high, low)
            else:
                (ac_refine if high else ac_first)(some[0][0], some[0][1].ravel(), data, tables[1, chosen[0][1] & 15], a, b, low)

    def payload(self) -> bytes:
        """The bytes that encode() stored."""
        if self.payload_blocks is None or len(self.components) != 3:
            raise Unreadable("holds no payload")
        y, cb, cr = (c.values for c in self.components.values())
        tall, wide = self.mcus
        data = np.empty((tall, wide, MCU_BLOCKS, BLOCK), dtype=np.uint8)
        for values, at in ((y.reshape(tall, 2, wide, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(tall, wide, 4, BLOCK), slice(0, 4)), (cb[:, :, None], slice(4, 5)), (cr[:, :, None], slice(5, 6))):
            data[:, :, at] = values + 255 * (values < 0)  # negative values stand for bytes below 128
        return data.tobytes()[: self.payload_blocks * BLOCK]

    def rgb(self) -> np.ndarray:
        """The full-resolution RGB tensor, uint8: channel, row, column."""
        planes = []
        for c in self.components.values():
            if c.table not in self.quantisers:
                raise Unreadable("a quantiser is missing")
            flat = c.values.reshape(-1, BLOCK).astype(np.float32) * self.quantisers[c.table]
            samples = np.clip(np.rint(flat @ BASIS) + 128, 0, 255).astype(np.uint8)
            plane = samples.reshape(*c.grid, 8, 8).transpose(0, 2, 1, 3).reshape(c.grid[0] * 8, c.grid[1] * 8)
            down, across = self.down // c.down, self.across // c.across
            if down > 1 or across > 1:
                plane = np.repeat(np.repeat(plane, down, axis=0), across, axis=1)
            planes.append(plane[: self.height, : self.width].astype(np.float32))
        if len(planes) == 1:
            return np.repeat(planes[0].astype(np.uint8)[None], 3, axis=0)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((3, *y.shape), dtype=np.uint8)
        for i, channel in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            np.copyto(out[i], np.clip(np.rint(channel), 0, 255), casting="unsafe")
        return out
