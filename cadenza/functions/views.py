"""Descriptors of camera views from grey frames, in numpy on Arrow batches.

A frame is brought to 64 x 36, equalised, blurred and standardised; its intensities and
edges, averaged over a grid of 16 x 9, and its gradients by direction make 296 numbers. A
video's descriptor is the mean of its frames' at unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes, limits and thresholds of the analysis, and where in a video its frames lie.
WIDTH, HEIGHT, GRID_WIDTH, GRID_HEIGHT, BINS = 64, 36, 16, 9, 8
TILES, CLIP = 6, 2.0
EDGE_LOW, EDGE_HIGH = 48, 144
POSITIONS = (0.15, 0.35, 0.55, 0.75, 0.90)
SIZE = 2 * GRID_WIDTH * GRID_HEIGHT + BINS


@lru_cache
def _shares(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n cells lies in each of m equal stretches of them, as shares of the stretch."""
    low, high = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
    return np.maximum(0, np.minimum(high, np.arange(n) + 1) - np.maximum(low, np.arange(n))) * m / n


def area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of a coarser grid."""
    return _shares(image.shape[0], height) @ image.astype(float) @ _shares(image.shape[1], width).T


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum())
    return x / norm if norm >= 1e-6 else np.zeros_like(x)


def _standard(x: np.ndarray) -> np.ndarray:
    std = x.std()
    return (x - x.mean()) / std if std >= 1e-6 else np.zeros_like(x)


def equalised(image: np.ndarray) -> np.ndarray:
    """Contrast-limited equalisation: each of TILES x TILES tiles maps grey levels by its clipped histogram, pixels mix the maps of the tiles around them."""
    height, width = image.shape
    whole = np.pad(image, ((0, -height % TILES), (0, -width % TILES)), mode="reflect")
    th, tw = whole.shape[0] // TILES, whole.shape[1] // TILES
    limit = max(1, int(CLIP * th * tw / 256))
    tiles = whole.reshape(TILES, th, TILES, tw).swapaxes(1, 2).reshape(TILES * TILES, th * tw)
    counts = np.stack([np.bincount(t, minlength=256) for t in tiles])
    over = np.maximum(counts - limit, 0).sum(axis=1)
    counts = np.minimum(counts, limit) + (over // 256)[:, None]
    for k, rest in enumerate(over % 256):  # what is left over goes to levels spread evenly
        if rest:
            counts[k, : rest * (256 // rest) : 256 // rest] += 1
    maps = np.rint(np.clip(np.cumsum(counts, axis=1) * (255 / (th * tw)), 0, 255)).reshape(TILES, TILES, 256)
    y, x = np.arange(height) / th - 0.5, np.arange(width) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[np.clip(y0 + a, 0, TILES - 1)[:, None], np.clip(x0 + b, 0, TILES - 1)[None, :], image]
    mixed = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.rint(mixed).astype(np.uint8)


def _weighted(image: np.ndarray, down: tuple, across: tuple, mode: str = "reflect") -> np.ndarray:
    """A 3 x 3 filter that is a column of weights times a row of them."""
    p = np.pad(image.astype(float), 1, mode=mode)
    rows = sum(w * p[k : k + image.shape[0], :] for k, w in enumerate(down))
    return sum(w * rows[:, k : k + image.shape[1]] for k, w in enumerate(across))


def gradients(image: np.ndarray, mode: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    return _weighted(image, (1, 2, 1), (-1, 0, 1), mode), _weighted(image, (-1, 0, 1), (1, 2, 1), mode)


def edges(image: np.ndarray) -> np.ndarray:
    """Pixels on ridges of the gradient that are strong, or hang together with strong ones."""
    gx, gy = gradients(image, "edge")
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    near = lambda dy, dx: p[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    flat, steep = np.abs(gy) < np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) > np.abs(gx) * np.tan(3 * np.pi / 8)
    rising = (gx < 0) != (gy < 0)
    across = (size > near(0, -1)) & (size >= near(0, 1))
    along = (size > near(-1, 0)) & (size >= near(1, 0))
    slant = np.where(rising, (size > near(-1, 1)) & (size > near(1, -1)), (size > near(-1, -1)) & (size > near(1, 1)))
    ridge = np.where(flat, across, np.where(steep, along, slant)) & (size > EDGE_LOW)
    found = ridge & (size > EDGE_HIGH)
    while True:
        q = np.pad(found, 1)
        wide = ridge & np.logical_or.reduce([q[a : a + size.shape[0], b : b + size.shape[1]] for a in range(3) for b in range(3)])
        if (wide == found).all():
            return found
        found = wide


def orientations(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Lengths of gradients added up by direction in BINS parts of a turn."""
    turn = np.mod(np.arctan2(gy, gx), 2 * np.pi)
    slot = np.minimum((turn * (BINS / (2 * np.pi))).astype(int), BINS - 1)
    return np.bincount(slot.ravel(), np.hypot(gx, gy).ravel(), BINS)


def frame_descriptor(grey: np.ndarray) -> np.ndarray:
    """The SIZE numbers of one grey frame (height, width) of bytes, at unit length."""
    small = np.rint(area(grey, HEIGHT, WIDTH)).astype(np.uint8)
    blurred = np.rint(_weighted(equalised(small), (0.25, 0.5, 0.25), (0.25, 0.5, 0.25))) / 255
    level = _standard(blurred)
    edge = edges((np.clip((level + 3) / 6, 0, 1) * 255).astype(np.uint8))
    return _unit(np.concatenate([area(level, GRID_HEIGHT, GRID_WIDTH).ravel(), area(edge, GRID_HEIGHT, GRID_WIDTH).ravel(), _unit(orientations(*gradients(level)))]))


def descriptors(frames: DataFrame, key: str = "video") -> DataFrame:
    """(key, descriptor) of (key, position, width, height, grey), grey a frame's bytes by rows, as binary or array<tinyint>.

    Frames are described where they are read, once each; a video's then come together, and
    a task adds up one video's after another. A frame that is null or has another number of
    bytes does not count; a video without any has a null descriptor.
    """
    binary = frames.schema["grey"].dataType.typeName() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for width, height, grey in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                pixels = None if grey is None or not width or not height else np.frombuffer(grey, np.uint8) if binary else np.array(grey, np.int8).view(np.uint8)
                found.append(None if pixels is None or len(pixels) != width * height else frame_descriptor(pixels.reshape(height, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key, "found"])

    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(key, "width", "height", "grey").mapInArrow(run, f"`{key}` {kind}, found array<double>")
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(_means, f"`{key}` {kind}, descriptor array<float>").toDF(key, "descriptor")


def _described(names: pa.Array, total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Means of n frames at unit length, 0 where they are shorter than 1e-6, null without frames."""
    mean = total / np.maximum(n, 1)[:, None]
    norm = np.sqrt(np.cumsum(mean * mean, axis=1)[:, -1:])
    unit = np.where(norm >= 1e-6, mean / np.where(norm >= 1e-6, norm, 1), 0).astype(np.float32)
    ends = np.arange(len(n) + 1, dtype=np.int32) * SIZE
    return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()), mask=pa.array(n == 0))], names=["name", "descriptor"])


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, descriptor) of (name, found) rows, equal names one after another."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        code = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        has = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        found = np.zeros((len(batch), SIZE))
        found[has] = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        names, total, n = batch.column(0).take(pa.array(heads)), np.add.reduceat(found, heads), np.add.reduceat(has.astype(int), heads)
        if held is not None and held[0][0].equals(names[0]):
            total[0] += held[1][0]
            n[0] += held[2][0]
        elif held is not None:
            yield _described(*held)
        if len(n) > 1:
            yield _described(names[:-1], total[:-1], n[:-1])
        held = names[-1:], total[-1:], n[-1:]  # it may go on
    if held is not None:
        yield _described(*held)
