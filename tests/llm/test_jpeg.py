"""The JPEG reader against streams made here, with tables of many symbols, end-of-band runs, refinements and restarts."""

import struct

import numpy as np
import pytest

from lexmill.llm import jpeg, media

ZIGZAG = jpeg.zigzag()
# A table of all symbols: 8 bits for those below 200, 9 for the rest.
CODES = {s: (f"{s:08b}" if s < 200 else f"{400 + s - 200:09b}") for s in range(256)}
TABLE = bytes([0] * 7 + [200, 56] + [0] * 7) + bytes(range(256))


def bits_of(v, size):
    return f"{v if v >= 0 else v + (1 << size) - 1:0{size}b}" if size else ""


def stuffed(bits):
    bits += "1" * (-len(bits) % 8)
    return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00") if bits else b""


def dc_first(mcus, low):
    """mcus: lists of (component, block)."""
    out, last = "", {}
    for mcu in mcus:
        for c, block in mcu:
            v = int(block[0]) >> low
            d, last[c] = v - last.get(c, 0), v
            size = abs(d).bit_length()
            out += CODES[size] + bits_of(d, size)
    return out


def shrunk(v, low):
    return (abs(int(v)) >> low) * (1 if v >= 0 else -1)


def ends(run):
    n = run.bit_length() - 1
    return CODES[n << 4] + (f"{run - (1 << n):0{n}b}" if n else "")


def ac_first(blocks, a, b, low):
    out, run = "", 0
    for block in blocks:
        values = [shrunk(v, low) for v in block[a : b + 1]]
        zeros = 0
        if any(values):
            out, run = out + (ends(run) if run else ""), 0
        for v in values:
            if not v:
                zeros += 1
                continue
            out += CODES[0xF0] * (zeros // 16)
            size = abs(v).bit_length()
            out, zeros = out + CODES[zeros % 16 << 4 | size] + bits_of(v, size), 0
        run += zeros > 0
        if run == 0x7FFF:
            out, run = out + ends(run), 0
    return out + (ends(run) if run else "")


def ac_refine(blocks, a, b, low):
    out, run, held = "", 0, ""  # held: corrections that follow the run
    for block in blocks:
        values = [abs(int(v)) >> low for v in block[a : b + 1]]
        last = max((i for i, v in enumerate(values) if v == 1), default=-1)
        zeros, own = 0, ""
        for i, v in enumerate(values):
            if i > last:
                own += str(v & 1) if v > 1 else ""
                continue
            if v == 0:
                if zeros == 15 and any(x == 1 for x in values[i:]):
                    if run:
                        out, run, held = out + ends(run) + held, 0, ""
                    out, zeros, own = out + CODES[0xF0] + own, 0, ""
                else:
                    zeros += 1
            elif v > 1:
                own += str(v & 1)
            else:
                if run:
                    out, run, held = out + ends(run) + held, 0, ""
                out += CODES[zeros << 4 | 1] + ("1" if block[a + i] > 0 else "0") + own
                zeros, own = 0, ""
        if last < b - a:
            run, held = run + 1, held + own
    return out + (ends(run) + held if run else "")


def image(planes, sampling, height, width, interval, quant):
    """A progressive JPEG of coefficient planes (rows, columns, zigzag), with restarts every interval units."""
    down, across = max(v for _, v in sampling), max(h for h, _ in sampling)
    tall, wide = -(-height // (8 * down)), -(-width // (8 * across))
    own = [(-(-height * v // (8 * down)), -(-width * h // (8 * across))) for h, v in sampling]
    parts = [b"\xff\xd8", jpeg.segment(0xDB, b"\x00" + bytes(int(q) for q in quant)), jpeg.segment(0xC4, b"\x00" + TABLE), jpeg.segment(0xC4, b"\x10" + TABLE)]
    parts.append(jpeg.segment(0xC2, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
    if interval:
        parts.append(jpeg.segment(0xDD, struct.pack(">H", interval)))

    def scan(components, band, high, low, units, code):
        head = bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([*band, high << 4 | low])
        step, data = interval or len(units), b""
        for i, at in enumerate(range(0, len(units), step)):
            data += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + stuffed(code(units[at : at + step]))
        parts.append(jpeg.segment(0xDA, head) + data)

    if len(planes) > 1:
        mcus = [[(c, planes[c][r * v + y, k * h + x]) for c, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)] for r in range(tall) for k in range(wide)]
    else:
        mcus = [[(0, planes[0][r, k])] for r in range(own[0][0]) for k in range(own[0][1])]
    every = list(range(len(planes)))
    scan(every, (0, 0), 0, 1, mcus, lambda u: dc_first(u, 1))
    lists = [[planes[c][r, k] for r in range(own[c][0]) for k in range(own[c][1])] for c in every]
    for c in every:
        scan([c], (1, 5), 0, 2, lists[c], lambda u: ac_first(u, 1, 5, 2))
        scan([c], (6, 63), 0, 2, lists[c], lambda u: ac_first(u, 6, 63, 2))
    for low in (1, 0):
        for c in every:
            scan([c], (1, 63), low + 1, low, lists[c], lambda u, low=low: ac_refine(u, 1, 63, low))
    scan(every, (0, 0), 1, 0, mcus, lambda u: "".join(str(int(b[0]) & 1) for m in u for _, b in m))
    return b"".join([*parts, b"\xff\xd9"])


def planes_of(rng, sampling, height, width):
    down, across = max(v for _, v in sampling), max(h for h, _ in sampling)
    tall, wide = -(-height // (8 * down)), -(-width // (8 * across))
    out = []
    for h, v in sampling:
        x = rng.integers(-40, 40, (tall * v, wide * h, 64)) * (rng.random((tall * v, wide * h, 64)) < 0.12) * (rng.random((tall * v, wide * h, 1)) < 0.6)
        x[:, :, 0] = rng.integers(-200, 200, x.shape[:2])
        out.append(x)
    return out


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize(("sampling", "height", "width"), [([(2, 2), (1, 1), (1, 1)], 37, 51), ([(1, 1)] * 3, 16, 24), ([(2, 1), (1, 1), (1, 1)], 9, 70), ([(1, 1)], 41, 23)])
def test_streams(sampling, height, width, interval):
    rng = np.random.default_rng(height + interval)
    planes, quant = planes_of(rng, sampling, height, width), rng.integers(1, 9, 64)
    found = jpeg.Image(image(planes, sampling, height, width, interval, quant))
    for c, want in zip(found.components.values(), planes, strict=True):
        assert (c.values[: c.own[0], : c.own[1]] == want[: c.own[0], : c.own[1]]).all()
    assert found.payload_blocks is None
    # Direct inverse transform in double precision, sample by sample.
    x = np.arange(8)
    cosine = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 1 / 2)
    down, across = max(v for _, v in sampling), max(h for h, _ in sampling)
    full = []
    for c, (h, v) in zip(found.components.values(), sampling, strict=True):
        plane = np.zeros((c.grid[0] * 8, c.grid[1] * 8))
        for r in range(c.grid[0]):
            for k in range(c.grid[1]):
                block = np.zeros(64)
                block[ZIGZAG] = c.values[r, k] * quant
                plane[r * 8 : r * 8 + 8, k * 8 : k * 8 + 8] = cosine.T @ block.reshape(8, 8) @ cosine + 128
        plane = np.clip(np.rint(plane), 0, 255)
        full.append(np.kron(plane, np.ones((down // v, across // h)))[:height, :width])
    if len(full) == 1:
        want = np.stack(full * 3)
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]), 0, 255)
    got = found.rgb().astype(float)
    assert got.shape == want.shape and np.abs(got - want).max() <= 2.5  # a sample rounds by one, colours carry it on
    assert media.feature(found.rgb()).startswith(f"{width}x{height};")


def test_unreadable(spark):
    rng = np.random.default_rng(3)
    good = image(planes_of(rng, [(2, 2), (1, 1), (1, 1)], 20, 20), [(2, 2), (1, 1), (1, 1)], 20, 20, 2, np.ones(64))
    own = jpeg.encode(b"x" * 576)
    bad = [b"", b"\xff\xd8", b"GIF89a", own[:200], own[:-60], good[: len(good) // 2], own.replace(b"\xff\xc2", b"\xff\xc0"), good.replace(b"\xff\xd1", b"\xff\xd1\xff\xd2"), b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc2\x00\x11\x08\xff\xff\xff\xff\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00\xff\xd9"]
    for blob in bad:
        with pytest.raises(jpeg.Unreadable):
            jpeg.Image(blob).rgb()
    for i in range(400):  # any damage is told as such, or read
        blob = bytearray(good if i % 2 else own)
        for _ in range(3):
            blob[rng.integers(2, len(blob))] = rng.integers(256)
        try:
            jpeg.Image(bytes(blob)).rgb()
        except jpeg.Unreadable:
            pass
    rows = media.decode_media(spark.createDataFrame([(i, b) for i, b in enumerate([good, own, *bad, None])], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r.error is None for r in rows] == [True, True, *[False] * len(bad), True]
    assert rows[0].payload_bytes is None and len(rows[0].tensor) == 3 * 20 * 20 and rows[1].payload_bytes == 576
    assert all(r.tensor is None and r.media_bytes is not None for r in rows[2:-1]) and rows[-1].media_bytes is None
