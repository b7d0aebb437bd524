"""Sound of any rate and coding, view descriptors, long correlations and linkage of many clips."""

from __future__ import annotations

import itertools
import math
import struct
import time

import numpy as np
import pytest
from cadenza.functions import views
from cadenza.operators import clusters, signal
from cadenza.sources import media, sound

RATE = signal.SAMPLE_RATE


def wave(samples: np.ndarray, rate: int, bits: int = 16, coding: int = 1, extensible: bool = False) -> bytes:
    """A WAVE file of (frames, channels) from -1 to 1."""
    samples = samples.reshape(len(samples), -1)
    body = encoded(samples, bits, coding == 3, "<")
    size = bits // 8 * samples.shape[1]
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else coding, samples.shape[1], rate, rate * size, size, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 0, coding) + b"\0" * 14
    chunks = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def encoded(samples: np.ndarray, bits: int, floats: bool, order: str) -> bytes:
    if floats:
        return samples.astype(f"{order}f{bits // 8}").tobytes()
    if bits == 8:
        return (np.rint(samples * 127) + 128).astype(np.uint8).tobytes()
    whole = np.rint(samples * (2 ** (bits - 1) - 1)).astype(np.int64)
    if bits == 24:
        raw = whole.astype(f"{order}i4").tobytes()
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 4)
        return (parts[:, :3] if order == "<" else parts[:, 1:]).tobytes()
    return whole.astype(f"{order}i{bits // 8}").tobytes()


def aiff(samples: np.ndarray, rate: int, bits: int, coding: bytes | None = None) -> bytes:
    samples = samples.reshape(len(samples), -1)
    mantissa, exponent = rate, 16383 + 63
    while mantissa < 1 << 63:
        mantissa, exponent = mantissa << 1, exponent - 1
    body = encoded(samples, bits, coding == b"fl32", "<" if coding == b"sowt" else ">")
    comm = struct.pack(">HIH", samples.shape[1], len(samples), bits) + struct.pack(">HQ", exponent, mantissa) + ((coding + b"\0\0") if coding else b"")
    chunks = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", len(body) + 8, 0, 0) + body
    return b"FORM" + struct.pack(">I", len(chunks) + 4) + (b"AIFC" if coding else b"AIFF") + chunks


def tone(rate: int, seconds: float = 2.0, hertz: float = 440.0) -> np.ndarray:
    return 0.5 * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate", [48_000, 44_100, 96_000, 32_000, 8_000, 11_025])
def test_tones_at_any_rate(rate):
    """A tone comes out as the same tone at the wanted rate, away from the ends of the file."""
    got = sound.resampled(sound.opened(wave(tone(rate), rate), RATE), RATE)
    want = tone(RATE)
    assert len(got) == len(want)
    assert np.abs(got - want)[400:-400].max() < 2e-3
    high = tone(rate, hertz=7000.0) if rate > 20_000 else None  # beyond the band of the result
    if high is not None:
        assert np.abs(sound.resampled(sound.opened(wave(high, rate), RATE), RATE))[400:-400].max() < 2e-3


def test_blocks_leave_no_seams(monkeypatch):
    rng = np.random.default_rng(1)
    own = sound.opened(wave(rng.uniform(-0.5, 0.5, 60_000), 48_000), RATE)
    whole = sound.resampled(own, RATE)
    monkeypatch.setattr(sound, "BLOCK_FRAMES", 1000)
    assert np.abs(sound.resampled(own, RATE) - whole).max() <= 1 / 32768


def test_codings_and_channels():
    left, right = tone(RATE), tone(RATE, hertz=300.0)
    both = np.column_stack([left, right])
    want = (left + right) / 2
    files = [(wave(both, RATE, b), 2e-2 if b == 8 else 1e-4) for b in (8, 16, 24, 32)] + [(wave(both, RATE, b, 3), 1e-4) for b in (32, 64)] + [(wave(both, RATE, 24, 1, True), 1e-4)]
    files += [(aiff(both, RATE, b), 1e-4) for b in (16, 24, 32)] + [(aiff(both, RATE, 16, b"sowt"), 1e-4), (aiff(both, RATE, 32, b"fl32"), 1e-4)]
    for data, near in files:
        own = sound.opened(data, 1)
        assert (own.rate, own.channels, len(own)) == (RATE, 2, len(want))
        assert np.abs(sound.resampled(own, RATE) - want).max() < near
    for bad in (b"", b"RIFF0000WAVE", b"RIFF0000AVI " + b"x" * 30, wave(both, RATE, 16).replace(b"data", b"dat_"), wave(both, RATE, 16, 2), aiff(both, RATE, 16, b"ulaw")):
        with pytest.raises(ValueError):
            sound.opened(bad, RATE)


def test_signatures_equal_those_of_rows(spark):
    """In the batch as by rows; at 48 kHz in stereo nearly as at the rate of the analysis."""
    rng = np.random.default_rng(2)
    loud = np.repeat(rng.uniform(0.0, 0.6, 60), 2000)
    hertz = np.arange(len(loud)) / RATE
    native = loud * np.sin(2 * np.pi * 300 * hertz)
    other = np.interp(np.arange(int(len(loud) * 48_000 / RATE)) / 48_000, hertz, loud)
    other *= np.sin(2 * np.pi * 300 * np.arange(len(other)) / 48_000)
    files = spark.createDataFrame([("a", bytearray(wave(native, RATE))), ("b", bytearray(wave(np.column_stack([other, other]), 48_000, 24)))], "path string, content binary")
    got = {r.path: r for r in media.signatures(files).collect()}
    rows = {r.series: r["values"] for r in signal.as_arrays(signal.signature(media.pcm_samples(files))).collect()}
    for p in "ab":
        assert np.allclose(got[p].signature, rows[p], atol=1e-4)
    assert (got["b"].sample_rate, got["b"].channels) == (48_000, 2) and math.isclose(got["a"].seconds, got["b"].seconds, abs_tol=1e-3)
    score, seconds = signal.sliding_similarity(np.array(got["a"].signature, float), np.array(got["b"].signature, float))
    assert score > 0.999 and seconds <= 1 / 20


def test_long_sliding_products():
    rng = np.random.default_rng(4)
    for n, m in ((5000, 900), (40_000, 300), (3000, 3000), (20_000, 19_990), (16_384 * 3, 4096)):
        long, short = rng.normal(size=n), rng.normal(size=m)
        assert np.allclose(signal.sliding_products(long, short), np.correlate(long, short, "valid"), atol=1e-8)
    hours = rng.normal(size=20 * 3600 * 4)
    began = time.perf_counter()
    score, seconds = signal.sliding_similarity(hours[50_000:140_000], hours)
    assert math.isclose(score, 1, abs_tol=1e-9) and seconds == 2500 and time.perf_counter() - began < 10


def brute_linkage(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: (sum(d[a][b] for a in groups[p[0]] for b in groups[p[1]]) / (len(groups[p[0]]) * len(groups[p[1]])), p))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_with_ties_and_many_clips():
    rng = np.random.default_rng(5)
    for n in (*range(1, 13), 13, 14):
        d = np.triu(rng.integers(0, 4, (n, n)) / 8, 1)
        d += d.T
        for k, label in clusters.average_linkage(d, list(range(1, n + 1))).items():
            assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == brute_linkage(d, k)
    for x in (rng.normal(size=(3000, 16)), np.ones((3000, 16))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        began = time.perf_counter()
        clusters.average_linkage(np.clip(1 - np.maximum(x @ x.T, 0), 0, 1), list(range(1, 9)))
        assert time.perf_counter() - began < 20


# ---- descriptors, pixel by pixel


def loop_area(image, height, width):
    h, w = len(image), len(image[0])
    out = [[0.0] * width for _ in range(height)]
    for i in range(height):
        for j in range(width):
            total = 0.0
            for y in range(h):
                dy = min((i + 1) * h / height, y + 1) - max(i * h / height, y)
                if dy > 0:
                    for x in range(w):
                        dx = min((j + 1) * w / width, x + 1) - max(j * w / width, x)
                        if dx > 0:
                            total += image[y][x] * dx * dy
            out[i][j] = total * height * width / (h * w)
    return out


def loop_filter(image, kernel, reflect):
    h, w = len(image), len(image[0])
    fold = (lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k) if reflect else (lambda k, n: min(max(k, 0), n - 1))
    return [[sum(kernel[a][b] * image[fold(y + a - 1, h)][fold(x + b - 1, w)] for a in range(3) for b in range(3)) for x in range(w)] for y in range(h)]


def loop_equalised(image):
    h, w = 36, 64
    th, tw = 6, 11  # 64 columns are filled up to 66 by reflection
    maps = {}
    for a in range(6):
        for b in range(6):
            hist = [0] * 256
            for y in range(a * th, a * th + th):
                for x in range(b * tw, b * tw + tw):
                    hist[image[y][x if x < w else 2 * w - 2 - x]] += 1
            over = sum(max(0, v - 1) for v in hist)  # the limit is int(2 * 66 / 256), but 1 at least
            hist = [min(v, 1) + over // 256 for v in hist]
            rest, at, step = over % 256, 0, max(256 // max(1, over % 256), 1)
            while rest and at < 256:
                hist[at] += 1
                at, rest = at + step, rest - 1
            total, table = 0, []
            for v in hist:
                total += v
                table.append(round(min(255, total * (255 / 66))))
            maps[a, b] = table
    out = []
    for y in range(h):
        row = []
        for x in range(w):
            v, u = y / th - 0.5, x / tw - 0.5
            y0, x0 = math.floor(v), math.floor(u)
            fy, fx = v - y0, u - x0
            at = lambda a, b: maps[min(max(y0 + a, 0), 5), min(max(x0 + b, 0), 5)][image[y][x]]
            row.append(round((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy))
        out.append(row)
    return out


def loop_edges(image):
    gx, gy = loop_filter(image, ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)), False), loop_filter(image, ((-1, -2, -1), (0, 0, 0), (1, 2, 1)), False)
    h, w = len(image), len(image[0])
    size = lambda y, x: abs(gx[y][x]) + abs(gy[y][x]) if 0 <= y < h and 0 <= x < w else 0
    ridge = set()
    for y in range(h):
        for x in range(w):
            m, dx, dy = size(y, x), gx[y][x], gy[y][x]
            if abs(dy) < abs(dx) * math.tan(math.pi / 8):
                top = m > size(y, x - 1) and m >= size(y, x + 1)
            elif abs(dy) > abs(dx) * math.tan(3 * math.pi / 8):
                top = m > size(y - 1, x) and m >= size(y + 1, x)
            else:
                s = -1 if (dx < 0) != (dy < 0) else 1
                top = m > size(y - 1, x - s) and m > size(y + 1, x + s)
            if top and m > 48:
                ridge.add((y, x))
    todo = [p for p in ridge if size(*p) > 144]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if p in ridge and p not in found:
                found.add(p)
                todo.append(p)
    return [[float((y, x) in found) for x in range(w)] for y in range(h)]


def loop_descriptor(grey):
    small = [[round(v) for v in row] for row in loop_area(grey, 36, 64)]
    blurred = [[round(v) / 255 for v in row] for row in loop_filter(loop_equalised(small), ((1 / 16, 1 / 8, 1 / 16), (1 / 8, 1 / 4, 1 / 8), (1 / 16, 1 / 8, 1 / 16)), True)]
    flat = [v for row in blurred for v in row]
    mean = sum(flat) / len(flat)
    std = math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat))
    level = [[(v - mean) / std if std >= 1e-6 else 0.0 for v in row] for row in blurred]
    edge = loop_edges([[int(min(1, max(0, (v + 3) / 6)) * 255) for v in row] for row in level])
    gx, gy = loop_filter(level, ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)), True), loop_filter(level, ((-1, -2, -1), (0, 0, 0), (1, 2, 1)), True)
    weights = [0.0] * 8
    for row_x, row_y in zip(gx, gy):
        for a, b in zip(row_x, row_y):
            weights[min(7, int(math.atan2(b, a) % (2 * math.pi) / (2 * math.pi) * 8))] += math.hypot(a, b)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) if sum(y * y for y in v) >= 1e-12 else 0.0 for x in v]
    return unit([v for row in loop_area(level, 9, 16) for v in row] + [v for row in loop_area(edge, 9, 16) for v in row] + unit(weights))


def scenes():
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:72, 0:128]
    yield np.uint8(127 + 100 * np.sin(x / 9.0) * np.cos(y / 7.0))
    yield np.uint8(np.where((x // 16 + y // 12) % 2, 220, 30) + rng.integers(0, 20, x.shape))
    yield np.full((40, 70), 90, np.uint8)
    yield np.uint8(np.clip(255 * np.hypot(x - 64, y - 36) / 70, 0, 255))[:50, :90]


def test_descriptors_equal_plain_loops():
    for grey in scenes():
        got, want = views.frame_descriptor(grey), np.array(loop_descriptor(grey.tolist()))
        assert got.shape == (296,) and np.allclose(got, want, atol=0.02) and float(got @ want) >= 0.999 * float(want @ want)


def test_descriptors_of_videos(spark):
    frames = [(v, p, g.shape[1], g.shape[0], g) for v, gs in (("a", list(scenes())[:2]), ("b", list(scenes())[3:])) for p, g in zip(views.POSITIONS, gs)]
    rows = [(v, p, w, h, bytearray(g.tobytes())) for v, p, w, h, g in frames] + [("none", 0.5, 4, 4, None), ("short", 0.5, 4, 4, bytearray(b"abc")), ("a", 0.9, 3, 3, None)]
    kind = "video string, position double, width int, height int, grey binary"
    got = {r.video: r.descriptor for r in views.descriptors(spark.createDataFrame(rows, kind)).collect()}
    assert got["none"] is None and got["short"] is None and set(got) == {"a", "b", "none", "short"}
    for v in "ab":
        mean = np.mean([views.frame_descriptor(g) for w, _, _, _, g in frames if w == v], axis=0)
        assert np.allclose(got[v], mean / np.linalg.norm(mean), atol=1e-6)
    signed = [(v, p, w, h, g.astype(np.int8).ravel().tolist()) for v, p, w, h, g in frames]
    again = {r.video: r.descriptor for r in views.descriptors(spark.createDataFrame(signed, kind.replace("binary", "array<tinyint>"))).collect()}
    assert all(np.allclose(again[v], got[v]) for v in "ab")
