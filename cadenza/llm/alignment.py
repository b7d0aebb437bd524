"""Alignment of two tokenizers' tokens, and corpus-wide counts of the pairs that it links.

Tokens of both sides are byte ranges of one string: a space, then the text. Tokens that
overlap are joined by an edge; the connected components of that bipartite graph, found by
union-find over arrays of many texts at a time, are the least groups that both sides cut
alike. The members of a component whose ranges end together are linked, and links are
counted over the corpus by their pair of identifiers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.store import keep, shared_folder
from cadenza.llm.tokens import tokenizer_path
from cadenza.llm.words import chunks

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most pairs whose counts are broadcast, the frequent ones first; others are joined.
MOST_BROADCAST = 1_000_000
#: Bytes of text that are aligned at a time; one longer text makes a chunk of its own.
ALIGN_BYTES = 1 << 19


class Vocabulary:
    """An encoder of lists of texts, and the bytes of each of its tokens."""

    def __init__(self, encode, pieces: list[bytes], space: bool):
        self.encode, self.space = encode, space
        self.sizes = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def __len__(self) -> int:
        return len(self.sizes)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of all texts, tokens of each) of a space and the text."""
        found = self.encode([" " + t for t in texts] if self.space else texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.empty(int(counts.sum()), np.int64)
        at = 0
        for x in found:
            ids[at : at + len(x)] = x
            at += len(x)
        return ids, counts

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        size = self.sizes[ids]
        first = np.cumsum(size) - size
        return self.data[np.repeat(self.starts[ids] - first, size) + np.arange(int(size.sum()))]


@cache
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file; its entries spell bytes by printable characters.

    The file ranks its entries as its merges make them, which is checked, so the faster
    encoder by ranks finds the same tokens.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    vocabulary, special = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    pieces = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens", ()))]) + 1)
    for token, i in vocabulary.items():
        pieces[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if sorted(merged) != merged:
        raise ValueError(f"{path}: entries are not ranked as they are merged")
    ranks = {pieces[i]: i for token, i in vocabulary.items() if token not in special}
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(lambda texts: [encoding.encode_ordinary(t) for t in texts], pieces, True)


@cache
def sentence_pieces(path: str) -> Vocabulary:
    """A sentence piece model, which adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in names]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), pieces, False)


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes hangs together with, by union-find: roots are hooked on lesser ones, and paths halved, until no edge joins two roots."""
    parent = np.arange(n)
    while len(left):
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
        left, right = parent[left], parent[right]
        apart = left != right
        left, right = left[apart], right[apart]
    return parent


def groups(end_a: np.ndarray, end_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A token, of each B token), from 0 in order; both cover the same size bytes without gaps and end where given."""
    mark = np.zeros(size + 1, np.uint8)
    mark[end_a] = 1
    mark[end_b] |= 2
    kind = mark[np.flatnonzero(mark)]
    # a stretch between neighbouring ends lies in one token of each side: those overlap
    in_a, in_b = kind & 1, kind >> 1
    edge_a, edge_b = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
    n = len(end_a)
    root = components(n + len(end_b), edge_a, edge_b + n)
    of_a = np.cumsum(root[:n] == np.arange(n)) - 1
    return of_a, of_a[root[n:]]


@cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 .. n - 1, with room for one character more, and how many there are."""
    width = len(str(n)) + 1
    text = b"".join(str(i).encode().ljust(width, b",") for i in range(n))
    return np.frombuffer(text, np.uint8).reshape(n, width), np.array([len(str(i)) for i in range(n)])


class Aligned:
    """The tokens, groups and links of a list of texts, flat, with the tokens of each text counted."""

    def __init__(self, a: Vocabulary, b: Vocabulary, data: np.ndarray, offs: np.ndarray, texts: list[str]):
        some = [i for i, t in enumerate(texts) if t]
        ids, counts = zip(*(v.tokens([texts[i] for i in some]) for v in (a, b)), strict=True) if some else ((np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2)
        first = [np.concatenate(([0], np.cumsum(c))) for c in counts]
        spelt = [v.joined(x) for v, x in zip((a, b), ids, strict=True)]
        ends = [np.cumsum(v.sizes[x]) for v, x in zip((a, b), ids, strict=True)]
        cuts = [np.concatenate(([0], e))[f] for e, f in zip(ends, first, strict=True)]
        whole = np.zeros(len(some), bool)
        for k, i in enumerate(some):
            own = [s[c[k] : c[k + 1]] for s, c in zip(spelt, cuts, strict=True)]
            whole[k] = all(len(s) == offs[i + 1] - offs[i] + 1 and s[0] == 0x20 and np.array_equal(s[1:], data[offs[i] : offs[i + 1]]) for s in own)
        if not whole.all():
            ids = [x[np.repeat(whole, c)] for x, c in zip(ids, counts, strict=True)]
            counts = [np.where(whole, c, 0) for c in counts]
            ends = [np.cumsum(v.sizes[x]) for v, x in zip((a, b), ids, strict=True)]
        n = len(texts)
        self.counts = []
        for c in counts:
            full = np.zeros(n, np.int64)
            full[some] = c
            self.counts.append(full)
        self.ids, self.ends = list(ids), ends
        self.group = groups(ends[0], ends[1], int(ends[0][-1]) if len(ends[0]) else 0)
        # the last tokens of a component are its members that end together
        self.last = [np.flatnonzero(np.diff(g, append=-1)) for g in self.group]
        if not np.array_equal(ends[0][self.last[0]], ends[1][self.last[1]]):
            raise AssertionError("groups that do not end together")
        self.text = np.repeat(np.arange(n), self.counts[0])[self.last[0]]
        self.n_groups = np.bincount(self.text, minlength=n)
        self.pair = self.ids[0][self.last[0]] * len(b) + self.ids[1][self.last[1]]

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(characters, where each text's begin, with the total at the end) of ``a1,a2|b1;a3|b2``."""
        (ids_a, ids_b), (of_a, of_b), (last_a, last_b) = self.ids, self.group, self.last
        total = len(ids_a) + len(ids_b)
        begin_b = np.concatenate(([0], last_b + 1))
        place_a = np.arange(len(ids_a)) + begin_b[of_a]
        place_b = np.arange(len(ids_b)) + last_a[of_b] + 1
        ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        tokens = self.counts[0] + self.counts[1]
        ends = np.cumsum(tokens)
        digits, sizes = _decimals(1 << max(10, int(ids.max(initial=0)).bit_length()))
        size = sizes[ids]
        rows = digits[ids]
        rows[np.arange(total), size] = mark
        long = size + 1
        long[ends[tokens > 0] - 1] -= 1
        chars = rows[np.arange(rows.shape[1]) < long[:, None]]
        at = np.concatenate(([0], np.cumsum(long)))
        return chars, at[np.concatenate(([0], ends))]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def align(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, details: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pair, times; with details also a_ids, b_ids and group_ends.

    pair holds the distinct linked pairs of a text, as a * (size of B) + b, and times how
    often each is linked; group_ends are byte offsets in the space and the text. Null and
    empty texts, and those that either side does not spell back, have no tokens. Rows are
    taken one by one, repeated ones too; of texts of any length all tokens count, and one
    text's tokens must fit a task. An empty table gives no rows.
    """
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    kind = documents.schema[id_col].dataType.simpleString()
    more = "a_ids array<int>, b_ids array<int>, group_ends array<long>" if details else ""
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<int>" + (f", {more}" if more else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), sentence_pieces(b_path)
        for batch in batches:
            text = batch.column(1)
            for lo, hi, data, offs in chunks(text, ALIGN_BYTES):
                found = Aligned(a, b, data, offs, [t or "" for t in text.slice(lo, hi - lo).to_pylist()])
                chars, at = found.spelled()
                digests = [hashlib.sha256(chars[x:y]).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]
                span = len(a) * len(b)
                own, times = np.unique(found.text * span + found.pair, return_counts=True)
                distinct = np.bincount(own // span, minlength=hi - lo)
                cols = [
                    batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (*found.counts, found.n_groups, found.n_groups)), pa.array(digests, pa.string()),
                    _lists(own % span, distinct, pa.int64()), _lists(times, distinct, pa.int32()),
                ]
                if details:
                    base = np.concatenate(([0], np.cumsum(np.where(found.counts[0] > 0, np.diff(offs) + 1, 0))))[:-1]
                    ends = found.ends[0][found.last[0]] - base[found.text]
                    cols += [*(_lists(i, c, pa.int32()) for i, c in zip(found.ids, found.counts, strict=True)), _lists(ends, found.n_groups, pa.int64())]
                names = [c.split(" ")[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def _links(aligned: DataFrame, *keep_columns: str) -> DataFrame:
    return aligned.select(*keep_columns, F.inline(F.arrays_zip("pair", "times")))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n, best): how many links of all aligned texts hold a pair, and whether none of its B identifier has more; from align's rows."""
    counts = _links(aligned).groupBy("pair").agg(F.sum("times").alias("n"))
    counts = counts.withColumn("b", F.col("pair") % size_b)
    # an identifier of B meets as many rows as A has identifiers at most
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", F.expr(f"pair div {size_b}").alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _cutoff(counts: DataFrame, most: int) -> int:
    """The least power of two that no more than ``most`` pairs reach, 0 if all fit."""
    bits = F.length(F.bin("n"))
    have, total = counts.groupBy(bits.alias("bits")).count().orderBy(F.desc("bits")).collect(), 0  # a row for each length of a count
    for row in have:
        if total + row["count"] > most:
            return 1 << row["bits"]
        total += row["count"]
    return 0


def _sums(links: DataFrame) -> DataFrame:
    total = lambda c: F.sum(F.col("times") * c).cast("long")
    best: Column = F.col("best").cast("long")
    return links.groupBy("row").agg(total(best).alias("n_best"), total(F.col("n")).alias("count_sum"))


def alignments(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair is as frequent, over all rows, as any of its B
    identifier; count_sum adds up their pairs' counts. Rows are treated as in ``align``;
    repeated rows count as often as they stand. An empty table gives no rows.
    """
    b_path = b_path or tokenizer_path(B_FILE)
    folder = shared_folder(documents.sparkSession)
    rows = align(documents, id_col, text_col, a_path, b_path).withColumn("row", F.monotonically_increasing_id())
    rows = keep(rows, folder)  # written, so that numbers stay
    counts = keep(pair_counts(rows, len(sentence_pieces(b_path))).select("pair", "n", "best"), folder)
    cutoff = _cutoff(counts, MOST_BROADCAST)
    links, frequent = _links(rows, "row"), F.broadcast(counts.where(F.col("n") >= cutoff))
    sums = _sums(links.join(frequent, "pair"))
    if cutoff:  # the others stand in fewer than cutoff links each, so that none is hot
        rare = links.join(frequent.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") < cutoff).hint("shuffle_merge"), "pair")
        sums = sums.unionByName(_sums(rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pair", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
