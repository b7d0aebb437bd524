"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Every benchmark item is cut to 5-word shingles; the bag of them has a 128-bit SimHash.
Over each document slides a window of as many words as an item has. A window can only
reach the similarity asked for if that share of its shingles is found in some item, so
windows with fewer such shingles are left out, without loss; the others get their SimHash
from running sums. Sixteen blocks of eight bits index the items, each under all values up
to two bits away: a window within 47 bits of an item has one block at most two bits away,
so all within RADIUS are found. Candidates are held against the item exactly: the sum of
the lesser shingle weights over that of the greater, a shingle's weight being the number
of times that it stands in the window or item.

Documents are only mapped over. Items come in slices of bounded size, each broadcast
once; more items than one slice holds mean more passes, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadenza.llm.words import U64, Words, chunks, mix, roll

N = 5
#: Bits in which a window may differ; at a similarity of 0.75 some 22 do, with a deviation of 4.3.
RADIUS = 42
#: Bounds of what is broadcast at a time.
SLICE_ITEMS = 20_000
SLICE_CHARS = 8_000_000
_WINDOWS = 4096
_NEAR = np.array([x for x in range(256) if x.bit_count() <= 2])


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 128 bits of each shingle."""
    both = np.stack((h, mix(h ^ U64(0x5851F42D4C957F2D))), axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """(windows, 16) bytes of the windows of size shingles that begin at start."""
    low = start[0]
    total = np.zeros((start[-1] + size - low + 1, 128), np.int32)
    np.cumsum(_signs(h[low : start[-1] + size]), axis=0, out=total[1:])
    return np.packbits(total[start - low + size] - total[start - low] > 0, axis=1)


class Items:
    """A slice of the benchmark, indexed."""

    def __init__(self, ids: list, texts: list[str | None], percent: int):
        self.percent = percent
        self.ids, self.bags, sizes, prints = [], [], [], []
        for at, b, data, offs in chunks(pa.array(texts, pa.string())):
            words = Words(data, offs, lower=True)
            h = words.hashes()
            for i in range(b - at):
                g = roll(h[words.first[i] : words.first[i + 1]], N)
                if len(g):
                    self.ids.append(ids[at + i])
                    self.bags.append(np.unique(g, return_counts=True))
                    sizes.append(len(g))
                    prints.append(_fingerprints(g, np.zeros(1, np.int64), len(g))[0])
        self.size = np.array(sizes, np.int64)
        self.print = np.array(prints, np.uint8).reshape(-1, 16)
        shingle = np.concatenate([v for v, _ in self.bags]) if self.bags else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(self.bags)), [len(v) for v, _ in self.bags])
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.owner = shingle[order], owner[order]
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.shingle & U64((1 << 22) - 1)).astype(np.int64)] = True
        self.least = int(np.ceil(percent * self.size.min() / 100)) if len(self.size) else 0
        # block and value to items, by item size
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size):
            own = np.flatnonzero(self.size == size)
            key = (np.arange(16) * 256)[None, :, None] + (self.print[own][:, :, None] ^ _NEAR[None, None, :].astype(np.uint8))
            key, item = key.reshape(-1), np.repeat(own, 16 * len(_NEAR))
            order = np.argsort(key, kind="stable")
            self.index[int(size)] = (np.searchsorted(key[order], np.arange(16 * 256 + 1)), item[order])

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Which shingles stand in an item."""
        found = self.bloom[(h & U64((1 << 22) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(found)
        at = np.minimum(np.searchsorted(self.shingle, h[maybe]), max(0, len(self.shingle) - 1))
        found[maybe] = self.shingle[at] == h[maybe] if len(self.shingle) else False
        return found

    def similarity(self, item: int, g: np.ndarray) -> float:
        values, counts = self.bags[item]
        v, c = np.unique(g, return_counts=True)
        _, x, y = np.intersect1d(values, v, assume_unique=True, return_indices=True)
        least = int(np.minimum(counts[x], c[y]).sum())
        return least / (int(self.size[item]) + len(g) - least)

    def matches(self, g: np.ndarray, hit: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item: (similarity, first word, bits that differ) of its best window in one document's shingles."""
        best: dict[int, tuple[float, int, int]] = {}
        own = np.unique(g[hit])
        low, high = np.searchsorted(self.shingle, own), np.searchsorted(self.shingle, own, "right")
        items = np.unique(self.owner[np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)])
        total = np.concatenate(([0], np.cumsum(hit)))
        for size in np.unique(self.size[items]).tolist():
            width = min(size, len(g))
            start = np.flatnonzero(100 * (total[width:] - total[: len(total) - width]) >= self.percent * size)
            if not len(start):
                continue
            heads, found = self.index[size]
            for part in np.split(start, np.flatnonzero((np.diff(start) > size) | (np.arange(1, len(start)) % _WINDOWS == 0)) + 1):
                prints = _fingerprints(g, part, width)
                key = (np.arange(16) * 256)[None, :] + prints
                a, b = heads[key.reshape(-1)], heads[key.reshape(-1) + 1]
                n = b - a
                item = found[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                pair = np.unique(np.repeat(np.repeat(np.arange(len(part)), 16), n) * len(self.ids) + item)
                w, item = pair // len(self.ids), pair % len(self.ids)
                bits = np.bitwise_count(prints[w] ^ self.print[item]).sum(axis=1)
                for i in np.flatnonzero(bits <= RADIUS):
                    k, at = int(item[i]), int(part[w[i]])
                    s = self.similarity(k, g[at : at + width])
                    if 100 * s >= self.percent and (s, -at) > (best.get(k, (-1.0,))[0], -best.get(k, (0, 1 << 60))[1]):
                        best[k] = (s, at, int(bits[i]))
        return best

    def search(self, text: pa.Array) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
        """(row, matches) of the rows with any."""
        if not self.ids:
            return
        for a, b, data, offs in chunks(text):
            words = Words(data, offs, lower=True)
            g = roll(words.hashes(), N)
            hit = self.hits(g)
            total = np.concatenate(([0], np.cumsum(hit)))
            low = np.minimum(words.first[:-1], len(g))
            high = np.clip(words.first[1:] - N + 1, low, len(g))
            for i in np.flatnonzero(total[high] - total[low] >= self.least):
                if high[i] > low[i] and (found := self.matches(g[low[i] : high[i]], hit[low[i] : high[i]])):
                    yield a + int(i), found


def _slices(benchmark: DataFrame, id_col: str, text_col: str, percent: int) -> Iterator[Items]:
    """Items in the order of their ids, some at a time."""
    ids, texts, chars = [], [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).orderBy(id_col, text_col).toLocalIterator():
        if ids and (len(ids) >= SLICE_ITEMS or chars >= SLICE_CHARS):
            yield Items(ids, texts, percent)
            ids, texts, chars = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        chars += len(row[1] or "")
    if ids:
        yield Items(ids, texts, percent)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, bits, similarity): for each document row and item found in it the most similar window, the first of equals.

    Null, empty and shorter texts than five words have no shingle, in documents and in
    items, and match nothing. A document shorter than an item is one window; of a longer
    one, however long, all windows count. Repeated rows match each by itself; ids may be
    null and of any type. Other columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {texts.schema[0].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, first_word long, n_words long, bits int, similarity double"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = spark.createDataFrame([], schema)
    for items in _slices(benchmark, item_col, item_text_col, percent):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                rows, more = [], []
                for row, found in items.search(batch.column(1)):
                    for k, (s, at, bits) in sorted(found.items()):
                        rows.append(row)
                        more.append((items.ids[k], at, int(items.size[k]) + N - 1, bits, s))
                cols = list(zip(*more, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True))],
                    names=["doc_id", "item_id", "first_word", "n_words", "bits", "similarity"],
                )

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows, with all their columns, in which no item is found.

    Null, empty and very short texts stay, repeated rows go or stay alike, and of texts of
    any length all windows count. Without benchmark items all rows stay; an empty table
    gives no rows.
    """
    at = documents.columns.index(text_col)
    for items in _slices(benchmark, item_col, item_text_col, percent):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[row for row, _ in shared.value.search(batch.column(at))]] = False
                yield batch.filter(pa.array(good))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
