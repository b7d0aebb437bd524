import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from cadenza.llm import lm

from . import fixtures as fx


def sentences(n, seed):
    """Two languages: a word tells much about the next."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = rng.choice("ab")
        out.append(" ".join(f"{p}{min(int(rng.expovariate(0.2)), 400)}" for _ in range(rng.randrange(20, 120))))
    return out


def test_base_score_equals_brute_force_and_model_is_better(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 60)  # most tokens take the join
    texts = [None, "", "UNSEEN word Å", *sentences(600, 1), "rare " * 3]
    docs = fx.documents(spark, texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    end = object()
    toks = [[*fx.words(t), end] for t in texts]
    count = Counter(x for i, t in enumerate(toks) if not held(i) for x in t)
    n, v = sum(count.values()), len(count)
    rows = lm.lm_scores(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(count[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    out = [r for r in rows if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.05 * sum(r.n_tokens for r in out)


def test_probabilities_sum_to_one():
    """Over all that the first step has but bundles, and all words of groups; the last bundle and group are not full."""
    rng = np.random.default_rng(0)
    shape = lm.Shape(40, 300, 64)
    assert (shape.bundles_at, shape.fan, shape.middle, shape.first, shape.rows) == (104, 3, 106, 111, 411)
    model = lm.Model(*(rng.normal(0, 1, s).astype(np.float32) for s in ((shape.rows, lm.SIZE), (shape.rows, lm.SIZE), shape.rows, (2, lm.SIZE))))
    every = np.concatenate((np.arange(shape.bundles_at), np.arange(shape.first, shape.rows)))
    for size in (1, 4):  # with scores so large that they are shifted, too
        large = lm.Model(model.R * size, model.Q, model.b, model.C)
        for one, two in ((0, 0), (5, 400), (103, 1)):
            p = np.exp(large.log_probabilities(shape, np.full(len(every), one), np.full(len(every), two), every))
            assert abs(p.sum() - 1) < 1e-4
    again = lm.Model.of(model.flat())
    assert all(np.array_equal(a, b) for a, b in ((again.R, model.R), (again.Q, model.Q), (again.b, model.b), (again.C, model.C)))


def test_packed_ids_come_back():
    ids = np.concatenate(([0, 127, 128, 16383, 16384, 2097151, 2097152, 5], np.random.default_rng(3).integers(0, 1 << 22, 500)))
    packed, ends = lm._pack(ids)
    assert lm._unpack(packed).tolist() == ids.tolist() and ends[:4].tolist() == [1, 2, 4, 6]
    assert lm._unpack(packed[ends[1] : ends[4]]).tolist() == ids[2:5].tolist() and not len(lm._pack(ids[:0])[0])


def test_vocabulary_grows_with_the_corpus(spark):
    def shape(n):
        counts = spark.createDataFrame([(i * 7 + 1, i % lm.CLASSES, max(1, 80000 // (i + 1))) for i in range(n)] + [(lm._END_HASH, -1, 5)], "token long, cls int, n long")
        return lm._coder(counts, lm._hot(counts)).shape

    assert [shape(n).grouped for n in (500, 2000, 4000)] == [min(n, 80000 // lm.USES) - lm.VOCABULARY for n in (500, 2000, 4000)]


def test_contexts_stop_at_texts():
    (_, _, offs, h, cls), = lm._texts(pa.array(["a b c", None, "d"]))
    ids = np.array([1, 2, 3, 0, 0, 4, 0])
    one, two = lm._contexts(ids)
    assert offs.tolist() == [0, 4, 5, 7] and (cls < 0).tolist() == [False, False, False, True, True, False, True]
    assert one.tolist() == [0, 1, 2, 3, 0, 0, 4] and two.tolist() == [0, 0, 1, 2, 0, 0, 0]


def test_scores_equal_the_learned_tables_however_rows_lie(spark, monkeypatch):
    """Each token's chance by plain loops over the vectors; the same for other partitions, with several lessons and rounds."""
    monkeypatch.setattr(lm, "LESSON", 8_000)
    monkeypatch.setattr(lm, "VOCABULARY", 30)
    monkeypatch.setattr(lm, "GROUP", 8)
    monkeypatch.setattr(lm, "USES", 8)
    texts = [None, "", "UNSEEN word", *sentences(300, 3)]
    docs = fx.documents(spark, texts)
    learned, train = [], lm.train_model

    def caught(*args):
        learned.append((train(*args), args[1].value, args[2]))
        return learned[-1][0]

    monkeypatch.setattr(lm, "train_model", caught)
    first = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    again = {r.doc_id: r.score for r in lm.lm_scores(docs.coalesce(1)).collect()}
    assert all(math.isclose(first[i], again[i], rel_tol=1e-4) for i in first)
    flat, coder, class_tokens = learned[0]
    model, held = lm.Model.of(flat), lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(x for i, t in enumerate(texts) if not held(i) for x in fx.words(t))
    code = lambda w: (lambda t: (int(t[3][0]), int(t[4][0])))(next(lm._texts(pa.array([w]))))
    codes = {w: code(w) for t in texts for w in fx.words(t)}
    own = dict(zip(coder.words.tolist(), coder.ids.tolist()))
    distinct = Counter(codes[w][1] for w in count if codes[w][0] not in own)
    shape = coder.shape
    assert shape.grouped > 20 and distinct
    chance = lambda hat, x, rows: (s := hat @ model.Q.T.astype(float) + model.b)[x] - np.log(np.exp(s[rows]).sum())
    for i in (0, 2, 5, 77, 200):
        ids = [own.get(codes[w][0], 1 + shape.vocabulary + codes[w][1]) for w in fx.words(texts[i])] + [lm.END]
        want, one, two = 0.0, lm.END, lm.END
        for k, x in enumerate(ids):
            hat = (model.R[one] * model.C[0] + model.R[two] * model.C[1]).astype(float)
            if x >= shape.first:
                g = (x - shape.first) // 8
                want += chance(hat, shape.bundles_at + g // shape.fan, range(shape.middle))
                want += chance(hat, shape.middle + g, [shape.middle + y for y in range(shape.groups) if y // shape.fan == g // shape.fan])
                want += chance(hat, x, [y for y in range(shape.first, shape.rows) if (y - shape.first) // 8 == g])
            else:
                want += chance(hat, x, range(shape.middle))
            if shape.vocabulary < x < shape.bundles_at:
                c = x - 1 - shape.vocabulary
                want += math.log((count[fx.words(texts[i])[k]] + 1) / (class_tokens[c] + distinct[c] + 1))
            one, two = x, lm.END if x == lm.END else one
        assert math.isclose(first[i], want / math.log(10), rel_tol=1e-4), i


def test_frequent_tokens_are_bounded_and_never_none(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 100)
    counts = spark.createDataFrame([(int(x), 1, 5) for x in np.random.default_rng(1).integers(0, 2**62, 600) * 2], "token long, cls int, n long")
    assert 70 <= len(lm._hot(counts)) <= 100
    more = counts.unionByName(spark.createDataFrame([(3, 1, 9), (5, 2, 5000)], "token long, cls int, n long"))
    assert lm._hot(more)["n"].tolist()[:2] == [5000, 9] and lm._hot(counts.limit(100)).shape[0] == 100 and lm._hot(counts.limit(0)).empty


def test_empty_and_all_held_out(spark):
    docs = fx.documents(spark, ["a b"], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)])
    (row,) = lm.lm_scores(docs).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0.0 and row.score < 0
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_frequent_contexts_are_normalised_once(monkeypatch):
    """Sums of exponentials over the first step are made token by token for rare contexts only, and come out alike."""
    monkeypatch.setattr(lm, "FREQUENT", 100)
    rng = np.random.default_rng(5)
    shape = lm.Shape(40, 300, 64)
    model = lm.Model(*(rng.normal(0, 0.5, s).astype(np.float32) for s in ((shape.rows, lm.SIZE), (shape.rows, lm.SIZE), shape.rows, (2, lm.SIZE))))
    one, two = (rng.choice(np.append(np.arange(104), np.arange(111, n)), 4000) for n in (211, 220))
    summed, plain = [], lm.Model._normaliser
    monkeypatch.setattr(lm.Model, "_normaliser", lambda self, hat, output, shifted: (len(output) == shape.middle and summed.append(len(hat))) or plain(self, hat, output, shifted))
    got = model.log_probabilities(shape, one, two, np.full(4000, 7))
    hat = (model.R[one] * model.C[0] + model.R[two] * model.C[1]).astype(float)
    scores = hat @ model.Q[: shape.middle].T.astype(float) + model.b[: shape.middle]
    assert np.allclose(got, scores[:, 7] - np.log(np.exp(scores).sum(axis=1)), atol=1e-4)
    assert sum(summed) == (two >= 211).sum() > 50


def test_tokens_are_found_by_their_leading_bits(monkeypatch):
    """However many share them; each as sorting finds it."""
    rng = np.random.default_rng(6)
    for bits in (3, 20):
        monkeypatch.setattr(lm, "LEADING", bits)
        words = np.unique(np.concatenate((rng.integers(0, 1 << 63, 500), rng.integers(0, 1 << 12, 200), [(1 << 63) - 1])))
        leads = np.searchsorted(words, np.arange(1 << bits, dtype=np.int64) << (63 - bits))
        coder = lm.Coder(None, None, None, words, leads, None, None)
        h = np.concatenate((rng.choice(words, 3000), words + 1, [0])).astype(np.uint64) & np.uint64((1 << 63) - 1)
        want = [int(np.searchsorted(words, x)) if x in set(words.tolist()) else -1 for x in h.tolist()]
        assert lm._hot_places(coder, h).tolist() == want
        token = np.unique(h)
        assert (h[lm._places(h, token)] == token).all()


def test_noise_pulls_as_the_logistic_function_says():
    rng = np.random.default_rng(7)
    h, other = rng.normal(0, 1, (1300, lm.SIZE + 1)).astype(np.float32), rng.normal(0, 1, (64, lm.SIZE + 1)).astype(np.float32)
    owed, moved = np.zeros((1300, lm.SIZE), np.float32), np.zeros((64, lm.SIZE + 1), np.float32)
    lm._against(h, other, owed, moved)
    e = 1 / (1 + np.exp(-(h.astype(float) @ other.T)))
    assert np.allclose(owed, -e @ other[:, : lm.SIZE], atol=0.1) and np.allclose(moved, -e.T @ h, atol=1.0)
    lm._against(h * 1000, other, owed, moved)
    assert np.isfinite(owed).all() and np.isfinite(moved).all()
