"""Language-model scores: unigram counts and a log-bilinear neural model.

The model predicts a token from the two before it: each context word's vector is scaled
by the weights of its position, and the sum is multiplied with output vectors, to which
biases are added. Every word used at least USES times has vectors of its own, so the
vocabulary grows with the corpus, up to the HOT words that a broadcast holds. Outputs have
three steps, so that normalisation stays bounded: over the most frequent words, bundles of
the further ones and classes of all other words; over the groups of the bundle; then over
the words of the group. Further words stand side by side in the order of their counts.
Words without vectors fall in classes by their ending, inside which they share out the
class by their counts.

Vectors are learned in numpy by noise-contrastive estimation, with noise for each step;
there the odds of a noise token are taken to within one per cent. Scores are normalised
exactly.
Texts are dealt to lessons of about LESSON tokens by a hash of id and text, and lessons to
rounds; in a round each lesson starts from the same vectors and learns from all its texts
in the order of their hashes, and the changes are averaged with their token counts as
weights. So every token is learned from once, and the vectors depend on the rows alone,
not on how many tasks there are or where the rows lie.

Unigram counts cover all training texts. The most frequent HOT tokens are broadcast, at
16 bytes each; counts of the others meet the documents that hold them in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.store import keep, shared_folder
from cadenza.llm.words import U64, Words, chunks

#: Words of the first step; classes of words without vectors; vector size.
VOCABULARY, CLASSES, SIZE = 64, 63, 16
#: Uses from which a word has vectors; words of a group.
USES, GROUP = 32, 128
END = 0
#: Bound of the broadcast counts, and of the words with vectors.
HOT = 200_000
FOLDS, HELD_OUT = 7, 2
#: Learning: tokens of a step, noise tokens that a step shares, rate and its least share, tokens after which it is halved.
STEP, NOISE, RATE, LEAST, HALF = 4096, 64, 0.1, 0.1, 2_000_000
#: Expected tokens of a lesson, and rounds. Texts of one hash may make a lesson larger; from MOST tokens on it goes on as another.
LESSON, MOST, ROUNDS = 2_000_000, 4_000_000, 3
#: Tasks that learn in a round, if there are as many lessons.
TASKS = 20_000
#: Tokens of a step that meet its noise at a time, whose scores fit a cache.
NEAR = 512
#: Rows of the model that travel together; tokens scored at a time, and those of them whose scores fit a cache.
BLOCK, SLICE, CACHED = 1024, 1 << 19, 256
#: Words of groups, the most frequent ones, whose share as context in each outcome of the first step is worked out once.
FREQUENT = 8192
#: Bytes of text counted, encoded and scored at a time, and those parsed at a time, which fit a cache.
SCORED, PARSED = 1 << 22, 1 << 18
#: Bits of a token hash that lead to its place among sorted ones.
LEADING = 20
#: Scores below this need no shift before they become exponentials.
PLAIN = 80.0
_END_HASH = 0x1E3D


class Shape(NamedTuple):
    """Rows of the model: end, words of the first step, classes, bundles; from ``middle`` on the groups, from ``first`` on their words."""

    vocabulary: int
    grouped: int
    group: int

    @property
    def bundles_at(self) -> int:
        return 1 + self.vocabulary + CLASSES

    @property
    def groups(self) -> int:
        return -(-self.grouped // self.group)

    @property
    def fan(self) -> int:
        """Groups of a bundle: about as many as there are bundles."""
        return max(1, math.isqrt(max(0, self.groups - 1)) + 1)

    @property
    def middle(self) -> int:
        return self.bundles_at - (-self.groups // self.fan)

    @property
    def first(self) -> int:
        return self.middle + self.groups

    @property
    def rows(self) -> int:
        return self.first + self.grouped

    @property
    def levels(self) -> tuple[tuple[int, int], ...]:
        """The rows among which the outcomes of each step are."""
        return (0, self.middle), (self.middle, self.first), (self.first, self.rows)

    def groups_of(self, ids: np.ndarray) -> np.ndarray:
        """The row of the group for each id from ``first`` on."""
        return self.middle + (ids - self.first) // self.group

    def upper(self, ids: np.ndarray) -> np.ndarray:
        """The outcome of the first step for each id."""
        return np.where(ids < self.first, ids, self.bundles_at + (ids - self.first) // (self.group * self.fan))


class Coder(NamedTuple):
    """Token hashes to model ids and counts."""

    shape: Shape

    words: np.ndarray  # sorted hashes of the vocabulary
    ids: np.ndarray
    hot: np.ndarray  # sorted hashes
    leads: np.ndarray  # the first of them for each value of the leading bits
    counts: np.ndarray
    hot_ids: np.ndarray  # model ids of the hot tokens, -1 for those of classes


def _parsed(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, data, offs in chunks(text, PARSED):
        w = Words(data, offs, lower=True)
        h = w.hashes() >> U64(1)
        ending = w.data[w.end - 1].astype(np.int64) * 31 + np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0)
        ends = w.first[1:]
        yield a, b, ends + np.arange(1, len(ends) + 1), np.insert(h, ends, U64(_END_HASH)), np.insert((ending % CLASSES).astype(np.int8), ends, -1)


def _texts(text: pa.Array, limit: int = SCORED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets, hashes, classes) of the tokens of chunks; each text's tokens end with END."""
    for a, b, _, _ in chunks(text, limit):
        parts = list(_parsed(text.slice(a, b - a)))
        sizes = np.cumsum([0, *(len(h) for *_, h, _ in parts)])
        offs = np.concatenate(([0], *(ends + at for (_, _, ends, _, _), at in zip(parts, sizes, strict=False))))
        yield a, b, offs, *(np.concatenate([part[k] for part in parts]) for k in (3, 4))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id hashes as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def count_tokens(train: DataFrame) -> DataFrame:
    """(token, cls, n) over all rows of (text); token is a 63-bit hash, cls -1 the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h, cls in _texts(batch.column(0)):
                token, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(cls[_places(h, token)].astype(np.int32)), pa.array(n.astype(np.int64))], names=["token", "cls", "n"])

    return train.select("text").mapInArrow(run, "token long, cls int, n long").groupBy("token", "cls").agg(F.sum("n").alias("n"))


def _places(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A place in h of each of its distinct tokens: by their leading bits, and by sorting for those that share them."""
    lead = U64(63 - LEADING)
    last = np.zeros(1 << LEADING, np.int32)
    last[h >> lead] = np.arange(len(h), dtype=np.int32)
    at = last[token >> lead]
    other = np.flatnonzero(h[at] != token)
    if len(other):
        left = np.flatnonzero(np.isin(last[h >> lead], at[other]))
        order = left[np.argsort(h[left], kind="stable")]
        at[other] = order[np.searchsorted(h[order], token[other])]
    return at


def _hot(counts: DataFrame) -> pd.DataFrame:
    """The HOT most used tokens; of tokens used alike those of the least hashes.

    A histogram of uses, with a bin for each count up to 1,024 and 64 for each doubling
    after that, finds the bin at which HOT is reached; of that bin come the tokens below
    a hash that lets as many pass as there is room for, give or take its deviation. So a
    bounded number of rows reaches the driver, however many tokens tie.
    """
    n = F.col("n")
    level = F.when(n <= 1024, n).otherwise(1024 + F.floor(64 * F.log2(n / F.lit(1024.0)))).cast("int")
    words = counts.where("cls >= 0").withColumn("level", level)
    so_far, wanted = 0, F.lit(True)
    for row in sorted(words.groupBy("level").agg(F.count(F.lit(1)).alias("tokens")).collect(), reverse=True):
        if so_far + row["tokens"] > HOT:
            below = int((HOT - so_far) / row["tokens"] * 2**63)
            wanted = (F.col("level") > row["level"]) | ((F.col("level") == row["level"]) & (F.col("token") < below))
            break
        so_far += row["tokens"]
    hot = words.where(wanted).select("token", "cls", "n").toPandas()
    return hot.sort_values(["n", "token"], ascending=[False, True]).head(HOT)


def _coder(counts: DataFrame, hot: pd.DataFrame) -> Coder:
    most, grouped = min(VOCABULARY, len(hot)), int((hot["n"].to_numpy()[VOCABULARY:] >= USES).sum())
    shape = Shape(VOCABULARY, grouped, GROUP)
    words = hot["token"].to_numpy()[: most + grouped].astype(np.int64)
    ids = np.concatenate((np.arange(1, most + 1), shape.first + np.arange(grouped)))
    order = np.argsort(words)
    end = counts.where("cls = -1").first()
    tokens = np.append(hot["token"].to_numpy().astype(np.int64), _END_HASH)
    n = np.append(hot["n"].to_numpy().astype(np.int64), end["n"] if end else 0)
    by = np.argsort(tokens)
    known = np.full(len(tokens), -1, np.int64)
    known[: len(ids)], known[-1] = ids, END
    leads = np.searchsorted(tokens[by], np.arange(1 << LEADING, dtype=np.int64) << (63 - LEADING)).astype(np.int32)
    return Coder(shape, words[order], ids[order].astype(np.int64), tokens[by], leads, n[by], known[by])


def _hot_places(coder: Coder, h: np.ndarray) -> np.ndarray:
    """The place of each token among the hot ones, or -1; from where its leading bits begin it is a step or two."""
    h, last = h.view(np.int64), len(coder.hot) - 1
    at = np.minimum(coder.leads.take(h >> (63 - LEADING)), last)
    found = coder.hot.take(at)
    less = np.flatnonzero((found < h) & (at < last))
    while len(less):
        at[less] += 1
        found[less] = coder.hot.take(at[less])
        less = less[(found[less] < h[less]) & (at[less] < last)]
    return np.where(found == h, at, -1)


def _model_ids(coder: Coder, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return _ids_and_counts(coder, h, cls)[0]


def _class_ids(coder: Coder, cls: np.ndarray) -> np.ndarray:
    return np.where(cls < 0, END, 1 + coder.shape.vocabulary + cls.astype(np.int64))


def _ids_and_counts(coder: Coder, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model ids, and counts of the tokens that are broadcast, -1 for others."""
    at = _hot_places(coder, h)
    known = np.where(at < 0, -1, coder.hot_ids.take(at))
    return np.where(known < 0, _class_ids(coder, cls), known), np.where(at < 0, -1, coder.counts.take(at))


def _pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each id ends): seven bits of an id a byte, the low ones first; all bytes but an id's last have the high bit."""
    size = 1 + (ids >= 1 << 7) + (ids >= 1 << 14) + (ids >= 1 << 21)
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(4):
        of = np.flatnonzero(size > k)
        out[ends[of] - size[of] + k] = (ids[of] >> 7 * k) & 127 | (size[of] > k + 1) << 7
    return out, ends


def _unpack(packed: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(packed < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size, out = ends - starts, (packed[starts] & 127).astype(np.int64)
    for k in range(1, 4):
        of = np.flatnonzero(size >= k)
        out[of] |= (packed[starts[of] + k] & 127).astype(np.int64) << 7 * k
    return out


def _contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two tokens back in texts that end with END each; before a text stand end tokens."""
    one = np.concatenate(([END], ids[:-1]))
    two = np.concatenate(([END], one[:-1]))
    return one, np.where(one == END, END, two)


class Model:
    """Context vectors R, output vectors Q, biases b and position weights C, and the sums of squared gradients of their rows."""

    def __init__(self, R: np.ndarray, Q: np.ndarray, b: np.ndarray, C: np.ndarray, sums: dict[str, np.ndarray] | None = None):
        self.R, self.Q, self.b, self.C = R, Q, b, C
        self.outputs = self.last = self.before = self.shares = None  # for scoring, when learning is over
        self.longest = 0.0
        self.sums = sums or {k: np.full(len(x), 1e-8, np.float32) for k, x in (("R", R), ("Q", Q), ("b", b), ("C", C))}

    @classmethod
    def start(cls, noise: np.ndarray) -> Model:
        rng = np.random.Generator(np.random.PCG64(7))
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(small(len(noise), SIZE), small(len(noise), SIZE), np.log(noise).astype(np.float32), np.ones((2, SIZE), np.float32))

    def flat(self) -> np.ndarray:
        """(rows + 2, 2 * SIZE + 4): a row for each token, then the position weights."""
        rows = np.concatenate((self.R, self.Q, self.b[:, None], *(self.sums[k][:, None] for k in ("R", "Q", "b"))), axis=1)
        last = np.zeros((2, rows.shape[1]), np.float32)
        last[:, :SIZE], last[:, -1] = self.C, self.sums["C"]
        return np.concatenate((rows, last))

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        flat = flat.astype(np.float32)
        at, v = 2 * SIZE, len(flat) - 2
        sums = {k: flat[:v, at + 1 + i].copy() for i, k in enumerate(("R", "Q", "b"))} | {"C": flat[v:, -1].copy()}
        return cls(flat[:v, :SIZE].copy(), flat[:v, SIZE:at].copy(), flat[:v, at].copy(), flat[v:, :SIZE].copy(), sums)

    def learn(self, own: np.ndarray, steps: list[tuple], log_noise: np.ndarray, rate: float) -> None:
        """Noise-contrastive estimation of (places, targets, shared noise tokens) steps, without places of all; log(k * chance of noise) is taken off each score.

        own: the tokens from two before the first to the last, whose contexts they are.
        """
        begins = own[1:-1] == END
        x = self.R.take(own, axis=0)
        x1, x2 = x[1:-1], x[:-2].copy()
        x2[begins] = self.R[END]
        hat = np.ones((len(x1), SIZE + 1), np.float32)  # the bias is an output's last number
        np.add(x1 * self.C[0], x2 * self.C[1], out=hat[:, :SIZE])
        d_hat = np.zeros_like(x2)
        rows, sums, at, h, owed = [], [], None, hat, d_hat
        for places, target, drawn in steps:
            if places is not at:  # steps of the same places come one after the other
                if at is not None:
                    d_hat[at] += owed
                at, h = places, hat.take(places, axis=0)
                owed = np.zeros((len(h), SIZE), np.float32)
            n, k = len(target), np.float32(math.log(len(drawn)))
            q, other = self.Q.take(target, axis=0), np.empty((len(drawn), SIZE + 1), np.float32)
            other[:, :SIZE], other[:, SIZE] = self.Q.take(drawn, axis=0), self.b.take(drawn) - log_noise.take(drawn) - k
            with np.errstate(over="ignore"):  # an infinite exponential is a chance of 0
                good = (h[:, :SIZE] * q) @ np.ones(SIZE, np.float32) + (self.b.take(target) - log_noise.take(target) - k)
                g = 1 / (np.exp(good) + 1)  # 1 - P(data)
            q *= g[:, None]
            owed += q
            d = np.empty((n + len(drawn), SIZE + 1), np.float32)
            np.multiply(g[:, None], h, out=d[:n])
            d[n:] = 0
            _against(h, other, owed, d[n:])
            for part, y in zip((rows, sums), _by_row(np.concatenate((target, drawn)), d), strict=True):
                part.append(y)
        if at is not None:
            d_hat[at] += owed
        row, d = np.concatenate(rows), np.concatenate(sums)  # steps have rows of their own
        self._move("b", row, d[:, SIZE:], rate)
        self._move("Q", row, d[:, :SIZE], rate)
        # what a token is owed as the last and as the last but one of contexts; before a text stand end tokens
        owed, second = np.zeros((len(own) + 1, SIZE), np.float32), d_hat * self.C[1]
        owed[-1] = second[begins].sum(axis=0)
        second[begins] = 0
        owed[1:-2] += d_hat * self.C[0]
        owed[:-3] += second
        self._move("C", np.arange(2), np.stack((np.einsum("ij,ij->j", d_hat, x1), np.einsum("ij,ij->j", d_hat, x2))), rate)
        self._move("R", *_by_row(np.append(own, END), owed), rate)

    def _move(self, name: str, row: np.ndarray, g: np.ndarray, rate: float) -> None:
        """Move rows along the sums of their gradients, each at a rate that falls with what it has moved."""
        to, moved = getattr(self, name), self.sums[name].take(row) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.sums[name][row] = moved
        to[row] += (g * (rate / np.sqrt(moved))[:, None]).reshape(len(row), *to.shape[1:])

    def _normaliser(self, hat: np.ndarray, output: np.ndarray, shifted: bool) -> np.ndarray:
        """The logarithm of the summed exponentials of the scores of these outputs, for each context."""
        out, ones, q = np.empty(len(hat), np.float32), np.ones(len(output), np.float32), output.T
        for at in range(0, len(hat), CACHED):
            scores = hat[at : at + CACHED] @ q
            if shifted:
                top = scores.max(axis=1)
                scores -= top[:, None]
            total = np.log(np.exp(scores, out=scores) @ ones)
            out[at : at + CACHED] = total + top if shifted else total
        return out

    def log_probabilities(self, shape: Shape, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Logarithms of the chance of the first step's outcome and, for words of groups, of the group in its bundle and the word in its group."""
        if len(target) > SLICE:
            cuts = np.linspace(0, len(target), 1 - (-len(target) // SLICE)).astype(int).tolist()
            return np.concatenate([self.log_probabilities(shape, *(x[a:b] for x in (one, two, target))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        if not len(target):
            return np.zeros(0)
        if self.outputs is None:
            self._prepare(shape)
        hat = self.last.take(one, axis=0)
        hat += self.before.take(two, axis=0)
        shifted = math.sqrt(np.einsum("ij,ij->i", hat, hat).max()) * self.longest > PLAIN
        score = lambda h, t: (h * self.outputs.take(t, axis=0)) @ np.ones(SIZE + 1, np.float32)
        out = score(hat, shape.upper(target)).astype(np.float64)
        often = (one < len(self.shares[0])) & (two < len(self.shares[0]))
        few = np.flatnonzero(~often)
        out[few] -= self._normaliser(hat.take(few, axis=0), self.outputs[: shape.middle], shifted)
        often = np.flatnonzero(often)
        out[often] -= self._shared_normaliser(one[often], two[often])
        inner = np.flatnonzero(target >= shape.first)
        group = (target[inner] - shape.first) // shape.group
        order = np.argsort(group.astype(np.uint16) if shape.groups < 1 << 16 else group, kind="stable")  # short numbers are sorted by digits
        inner, group = inner[order], group[order]
        if len(inner):
            hat, word = hat.take(inner, axis=0), target[inner]
            more = score(hat, shape.middle + group) + score(hat, word)
            for key, begin, size, end in ((group // shape.fan, shape.middle, shape.fan, shape.first), (group, shape.first, shape.group, shape.rows)):
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
                for x, y, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), key[cuts[:-1]].tolist(), strict=True):
                    a = begin + k * size
                    more[x:y] -= self._normaliser(hat[x:y], self.outputs[a : min(a + size, end)], shifted)
            out[inner] += more
        return out

    def _prepare(self, shape: Shape) -> None:
        """What scoring needs of all contexts: their vectors by position, and the frequent ones' shares in the outcomes of the first step.

        The exponential of a score is the product of those of its two positions, unless these could leave the range of single precision.
        """
        self.outputs = np.concatenate((self.Q, self.b[:, None]), axis=1)
        self.longest = math.sqrt(np.einsum("ij,ij->i", self.outputs, self.outputs).max())
        one, none = np.ones((len(self.R), 1), np.float32), np.zeros((len(self.R), 1), np.float32)
        self.last = np.concatenate((self.R * self.C[0], one), axis=1)  # the bias is an output's last number
        self.before = np.concatenate((self.R * self.C[1], none), axis=1)
        scores = [x[: shape.first + FREQUENT] @ self.outputs[: shape.middle].T for x in (self.last, self.before)]
        if sum(max(x.max(), -x.min()) for x in scores) > PLAIN:
            scores = [x[:0] for x in scores]
        self.shares = [np.exp(x, out=x) for x in scores]

    def _shared_normaliser(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """_normaliser of the first step for pairs of frequent contexts."""
        last, before = self.shares
        out, ones = np.empty(len(one), np.float32), np.ones(last.shape[1], np.float32)
        for at in range(0, len(one), CACHED):
            share = last.take(one[at : at + CACHED], axis=0)
            share *= before.take(two[at : at + CACHED], axis=0)
            out[at : at + CACHED] = share @ ones
        return np.log(out)


def _by_row(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their gradients."""
    least = at.min()
    near = at - least
    order = np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")  # short numbers are sorted by digits
    at = at[order]
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[heads], np.add.reduceat(g.take(order, axis=0), heads, axis=0)


def _against(h: np.ndarray, other: np.ndarray, owed: np.ndarray, moved: np.ndarray) -> None:
    """Take from owed and moved what noise tokens pull at contexts h and at their own outputs, with odds to within one per cent.

    A number read as a float's exponent and mantissa is nearly an exponential. The odds are
    the quotient of two of opposite halves, whose errors nearly cancel out; large scores are
    cut off where the chance is 0 or 1 in single precision.
    """
    half, one, most = np.float32(0.5 * math.log2(math.e) * 2**23), np.int32(127 << 23), np.float32(60 * 2**23)
    outputs, scale = np.ascontiguousarray(other[:, :SIZE]), np.ascontiguousarray((other * half).T)
    scores, bits, less = (np.empty((min(NEAR, len(h)), len(other)), kind) for kind in (np.float32, np.int32, np.int32))
    for at in range(0, len(h), NEAR):
        own = h[at : at + NEAR]
        x, up, down = (y[: len(own)] for y in (scores, bits, less))
        np.matmul(own, scale, out=x)
        np.clip(x, -most, most, out=x)
        np.copyto(up, x, casting="unsafe")
        np.subtract(one, up, out=down)
        up += one
        up, down = up.view(np.float32), down.view(np.float32)
        down += up
        np.divide(up, down, out=x)  # P(data) of noise
        owed[at : at + NEAR] -= x @ outputs
        moved -= x.T @ own


def lessons(train: DataFrame, coder, n: int) -> DataFrame:
    """(lesson, part, round, n, ids): the packed model ids of all texts, n of them, dealt to lessons by a hash of id and text; n tokens in all."""
    count = max(1, -(-n // LESSON))
    rounds = min(ROUNDS, count)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offs, h, cls in _texts(batch.column(1)):
                packed, ends = _pack(_model_ids(coder.value, h, cls))
                cuts = ends[offs[1:] - 1]
                own = [packed[x:y].tobytes() for x, y in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.binary())], names=["place", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([part], pa.int64()), pa.array([now % rounds], pa.int64()), pa.array([size], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["lesson", "part", "round", "n", "ids"])

        for batch in batches:
            for lesson, ids in zip(batch.column("lesson").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if lesson != now or size >= MOST:
                    if held:
                        yield out()
                    part = part + 1 if lesson == now else 0
                    now, held, size = lesson, [], 0
                held.append(ids)
                size += int(np.count_nonzero(np.frombuffer(ids, np.uint8) < 128))
        if held:
            yield out()

    placed = train.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("place"), "text").mapInArrow(encode, "place long, ids binary")
    dealt = placed.withColumn("lesson", F.pmod(F.col("place"), F.lit(count))).repartition("lesson").sortWithinPartitions("lesson", "place", "ids")
    return keep(dealt.select("lesson", "ids").mapInArrow(joined, "lesson long, part long, round long, n long, ids binary"))


def _round(rows: DataFrame, shape: Shape, noise: np.ndarray, start: np.ndarray, seen: int) -> np.ndarray:
    """Vectors after each of the lessons has learned from start, averaged by their tokens; seen tokens came before."""
    count, size = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not size:
        return start
    shared = rows.sparkSession.sparkContext.broadcast((start, np.log(noise).astype(np.float32)))
    draws = rows.sparkSession.sparkContext.broadcast([np.cumsum(noise[a:b]) for a, b in shape.levels])
    width, short = start.shape[1], 2 * SIZE + 1  # vectors and biases move by small numbers, which travel in half precision

    def learned(ids: np.ndarray) -> np.ndarray:
        start, log_noise = shared.value
        model, rng = Model.of(start), np.random.Generator(np.random.PCG64(11))

        def drawn(level: int) -> np.ndarray:
            (a, b), so_far = shape.levels[level], draws.value[level]
            return a + np.minimum(np.searchsorted(so_far, rng.random(NOISE) * so_far[-1]), b - a - 1)

        for at in range(0, len(ids), STEP):
            own = ids[at - 2 : at + STEP] if at else np.concatenate(([END, END], ids[:STEP]))
            target = own[2:]
            steps = [(None, shape.upper(target), drawn(0))]
            if len(grouped := np.flatnonzero(target >= shape.first)):
                words = target[grouped]
                steps += [(grouped, shape.groups_of(words), drawn(1)), (grouped, words, drawn(2))]
            model.learn(own, steps, log_noise, RATE * max(LEAST, 1 / (1 + (seen + at) / HALF)))
        return model.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, seen = None, 0
        for batch in batches:
            for blob in batch.column(0):
                ids = _unpack(np.frombuffer(blob.as_buffer(), np.uint8))
                own = learned(ids).astype(np.float64)
                own -= shared.value[0]
                own *= len(ids)
                seen += len(ids)
                if moved is None:
                    moved = own
                else:
                    moved += own
        if moved is not None:
            at = np.flatnonzero(moved.any(axis=1)).astype("<i8")
            cuts = np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1) if len(at) else []
            moved /= seen
            columns = [pa.array([int(c[0]) // BLOCK for c in cuts], pa.int64()), pa.array([seen] * len(cuts), pa.int64())]
            columns += [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (cuts, [moved[c, :short].astype("<f2") for c in cuts], [moved[c, short:].astype("<f4") for c in cuts])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "n", "at", "x", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, at, x, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, of = sums.setdefault(block, np.zeros((BLOCK, width))), np.frombuffer(at, "<i8") % BLOCK
                own[of, :short] += np.frombuffer(x, "<f2").reshape(-1, short) * (n / size)
                own[of, short:] += np.frombuffer(more, "<f4").reshape(-1, width - short) * (n / size)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype("<f4").tobytes() for x in sums.values()], pa.binary())], names=["block", "x"])

    # a task holds one model and the changes of another; what is added up is one model, however many lessons there are
    dealt = rows.select("ids").repartition(min(TASKS, count))
    out = dealt.mapInArrow(run, "block long, n long, at binary, x binary, sums binary").repartition("block").mapInArrow(add, "block long, x binary").collect()
    shared.destroy()
    draws.destroy()
    total = np.zeros((-(-len(start) // BLOCK) * BLOCK, width), np.float32)
    for r in out:
        total[r["block"] * BLOCK :][:BLOCK] = np.frombuffer(r["x"], "<f4").reshape(BLOCK, width)
    return start + total[: len(start)]


def train_model(train: DataFrame, coder, class_tokens: np.ndarray, n: int) -> np.ndarray:
    """Flat vectors learned from (doc_id, text) rows of n tokens."""
    shape = coder.value.shape
    uses = np.ones(shape.rows)
    uses[coder.value.ids] += coder.value.counts[np.searchsorted(coder.value.hot, coder.value.words)]
    uses[END] += coder.value.counts[np.searchsorted(coder.value.hot, _END_HASH)]
    uses[1 + shape.vocabulary : shape.bundles_at] += class_tokens
    words = np.arange(shape.first, shape.rows)
    np.add.at(uses, shape.groups_of(words), uses[words])
    np.add.at(uses, shape.upper(words), uses[words])
    noise = np.concatenate([uses[a:b] / max(1.0, uses[a:b].sum()) for a, b in shape.levels])
    flat = Model.start(noise).flat()
    if n:
        dealt = lessons(train, coder, n)
        for k in range(min(ROUNDS, -(-n // LESSON))):
            flat = _round(dealt.where(F.col("round") == k), shape, noise, flat, k * LESSON)
    return flat


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is one end token. Repeated rows count, and are scored, each by
    itself. Texts of any length are counted, learned from and scored whole. Without any
    training row the counts are 0 and the model stays as it started. The same rows get the
    same scores, however they are partitioned. An empty table gives no rows; other columns
    are ignored.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    train = rows.where(~F.col("held_out"))
    counts = keep(count_tokens(train), folder)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(total[0]), int(total[1])
    hot = _hot(counts)
    coder = spark.sparkContext.broadcast(_coder(counts, hot))
    # tokens and distinct tokens of each class, less those with vectors of their own: CLASSES rows
    of_class = np.zeros((2, CLASSES))
    for r in counts.where("cls >= 0").groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        of_class[:, r["cls"]] = r["n"], r["v"]
    own = hot.head(len(coder.value.words))
    np.subtract.at(of_class[0], own["cls"].to_numpy(int), own["n"].to_numpy(float))
    np.subtract.at(of_class[1], own["cls"].to_numpy(int), 1.0)
    room = of_class.sum(axis=0) + 1
    shared = spark.sparkContext.broadcast((train_model(train, coder, of_class[0], n), room))
    base = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, room = shared.value
        model = Model.of(flat)
        log_room, shape = np.log10(room), coder.value.shape
        for batch in batches:
            for a, b, offs, h, cls in _texts(batch.column(3)):
                ids, c = _ids_and_counts(coder.value, h, cls)
                one, two = _contexts(ids)
                hot, other = c >= 0, (ids > shape.vocabulary) & (ids < shape.bundles_at)
                log_c = np.log10(np.maximum(c, 0) + 1.0)
                lm = model.log_probabilities(shape, one, two, ids) / np.log(10)
                lm += np.where(other, log_c - log_room[np.maximum(cls, 0)], 0)
                sums = lambda x: (s := np.concatenate(([0], np.cumsum(x))))[offs[1:]] - s[offs[:-1]]
                owner = np.repeat(np.arange(b - a), np.diff(offs))
                rare = np.flatnonzero(~hot)
                starts = np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=b - a)))).astype(np.int32)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0), own.column(1), own.column(2), pa.array(np.diff(offs).astype(np.int64)), pa.array(sums((c > 0).astype(np.int64)).astype(np.int64)),
                        pa.array(sums(log_c - base)), pa.array(sums(lm)), pa.ListArray.from_arrays(pa.array(starts), pa.array(h[rare].view(np.int64))),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "rare"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = keep(numbered.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lm double, rare array<long>"), folder)
    # tokens outside the broadcast: their counts come by a join, then one sum for each row
    rare = scored.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("tf"))
    met = rare.join(counts.select("token", "n"), "token")
    more = met.groupBy("row").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("more"))
    out = scored.drop("rare").join(more, "row", "left")
    add = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"), (F.col("lm") + add).alias("score"),
    )
