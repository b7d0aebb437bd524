"""Sound files as samples at the rate of the analysis, in numpy, block by block.

WAVE and AIFF headers are read for coding, channels and rate. Channels are averaged, other
rates are brought to the wanted one by a polyphase windowed-sinc filter, and samples take
the steps of 16 bits, as the analysis is defined on those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import gcd
from typing import NamedTuple

import numpy as np

#: Frames of a file that are decoded at a time.
BLOCK_FRAMES = 1 << 18
#: Zero crossings of the sinc on either side, the shape of its window, and the share of the band that is kept.
CROSSINGS, KAISER, BAND = 24, 9.0, 0.92


class Sound(NamedTuple):
    """What a file says of its samples, and their bytes."""

    data: memoryview
    rate: int
    channels: int
    kind: str  # of a sample: u1, i2, i3, i4, f4 or f8, with < or > before it

    @property
    def width(self) -> int:
        return int(self.kind[-1])

    def __len__(self) -> int:
        return len(self.data) // (self.width * self.channels)

    def frames(self, first: int, last: int) -> np.ndarray:
        """Frames [first, last) as the mean of their channels, from -1 to 1."""
        size = self.width * self.channels
        raw = self.data[first * size : last * size]
        order, form = self.kind[0], self.kind[1:]
        if form == "i3":
            parts = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            low, mid, high = (parts[:, k].astype(np.int32) for k in ((0, 1, 2) if order == "<" else (2, 1, 0)))
            value = ((high << 24 | mid << 16 | low << 8) >> 8) / float(1 << 23)
        elif form == "u1":
            value = (np.frombuffer(raw, np.uint8) - 128.0) / 128
        elif form[0] == "i":
            value = np.frombuffer(raw, order + form) / float(1 << (8 * self.width - 1))
        else:
            value = np.frombuffer(raw, order + form).astype(float)
        return value if self.channels == 1 else value.reshape(-1, self.channels).mean(axis=1)


def _chunks(content: memoryview, at: int, order: str) -> Iterator[tuple[bytes, memoryview]]:
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4 : at + 8], order)
        yield bytes(content[at : at + 4]), content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _extended(raw: bytes) -> float:
    """A number of 80 bits: sign and exponent, then 64 bits with their leading one."""
    exponent = int.from_bytes(raw[:2], "big")
    return int.from_bytes(raw[2:10], "big") * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def opened(content: bytes, raw_rate: int) -> Sound:
    """A RIFF or AIFF file, or 16-bit mono samples at raw_rate if there is no header; nothing at all, and other codings, are errors."""
    view = memoryview(bytes(content))
    if not len(view):
        raise ValueError("no samples")
    name, form = bytes(view[:4]), bytes(view[8:12])
    if name == b"RIFF":
        if form != b"WAVE":
            raise ValueError("no WAVE file")
        found = dict(_chunks(view, 12, "little"))
        head, data = bytes(found.get(b"fmt ", b"")), found.get(b"data")
        if len(head) < 16 or data is None:
            raise ValueError("no format or no data chunk")
        number = lambda a, n=2: int.from_bytes(head[a : a + n], "little")
        coding, channels, rate, bits = number(0), number(2), number(4, 4), number(14)
        coding = number(24) if coding == 0xFFFE and len(head) >= 26 else coding
        kind = {(1, 8): "u1", (1, 16): "i2", (1, 24): "i3", (1, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((coding, bits))
        order = "<"
    elif name == b"FORM" and form in (b"AIFF", b"AIFC"):
        found = dict(_chunks(view, 12, "big"))
        head, data = bytes(found.get(b"COMM", b"")), found.get(b"SSND")
        if len(head) < 18 or data is None:
            raise ValueError("no format or no data chunk")
        channels, bits, rate = int.from_bytes(head[:2], "big"), int.from_bytes(head[6:8], "big"), round(_extended(head[8:18]))
        coding, order = (head[18:22] if form == b"AIFC" else b"NONE"), ">"
        data = data[8 + int.from_bytes(data[:4], "big") :]
        if coding == b"sowt":
            order, coding = "<", b"NONE"
        kind = {(b"NONE", 16): "i2", (b"NONE", 24): "i3", (b"NONE", 32): "i4", (b"fl32", 32): "f4", (b"FL32", 32): "f4", (b"fl64", 64): "f8"}.get((coding, bits))
    else:
        return Sound(view[: len(view) // 2 * 2], raw_rate, 1, "<i2")
    if kind is None or channels < 1 or rate < 1:
        raise ValueError(f"samples that are not PCM: coding {coding}, {bits} bits, {channels} channels at {rate}")
    whole = len(data) // (int(kind[-1]) * channels) * int(kind[-1]) * channels
    return Sound(data[:whole], rate, channels, order + kind)


@cache
def _phases(up: int, down: int) -> np.ndarray:
    """Weights of the frames around each of ``up`` places between two frames; each row sums to 1."""
    wide = max(1.0, down / up)
    half = int(np.ceil(CROSSINGS * wide))
    at = np.arange(1 - half, half + 1) - np.arange(up)[:, None] / up
    weights = np.sinc(at * BAND / wide) * np.i0(KAISER * np.sqrt(np.maximum(0, 1 - (at / half) ** 2)))
    return weights / weights.sum(axis=1, keepdims=True)


def resampled(sound: Sound, rate: int) -> np.ndarray:
    """All samples at a rate, as floats in steps of 16 bits: as many as fit into the file's time."""
    n = len(sound)
    if sound.rate == rate:
        out = np.concatenate([sound.frames(a, min(n, a + BLOCK_FRAMES)).astype(np.float32) for a in range(0, n, BLOCK_FRAMES)] or [np.zeros(0, np.float32)])
        return np.rint(np.clip(out * 32768, -32768, 32767)).astype(np.float32) / 32768
    common = gcd(sound.rate, rate)
    up, down = rate // common, sound.rate // common
    weights = _phases(up, down)
    half = weights.shape[1] // 2
    total = -(-n * up // down)
    out = np.zeros(total, np.float32)
    step = max(1, BLOCK_FRAMES // down) * up  # outputs of a block: whole turns of the phases
    for a in range(0, total, step):
        b = min(total, a + step)
        first = a * down // up
        lo, hi = first - half + 1, (b - 1) * down // up + half + 1
        block = np.pad(sound.frames(max(0, lo), min(n, hi)), (max(0, -lo), max(0, hi - n)))
        views = np.lib.stride_tricks.sliding_window_view(block, weights.shape[1])
        for phase in range(min(up, b - a)):  # outputs of one phase lie ``down`` frames apart
            k = np.arange(a + phase, b, up)
            out[k] = views[(k * down // up) - first] @ weights[(k[0] * down) % up]
    return np.rint(np.clip(out * 32768, -32768, 32767)).astype(np.float32) / 32768
