import random

import numpy as np
from cadenza.llm import near_dup
from cadenza.llm.components import components as connected
from cadenza.llm.store import keep
from cadenza.llm.words import Words, chunks, shingles

import pyarrow as pa
import pytest

from . import fixtures as fx


def test_equals_all_pairs(spark):
    texts = fx.corpus()
    rows = near_dup.near_duplicates(fx.documents(spark, texts)).collect()
    want = fx.components(texts, list(range(len(texts))))
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(fx.shingles(texts[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_dense_family_around_the_threshold(spark, monkeypatch):
    """Copies of one text, most pairs close to the threshold: hubs alone would lose links; small parts and blocks are many."""
    monkeypatch.setattr(near_dup, "PART", 16)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(3)
    base = fx.prose(rng, 150).split(" ")
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = near_dup.near_duplicates(fx.documents(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == fx.components(texts, list(range(len(texts))))


def test_shared_passage_alone_links_nothing(spark):
    rng = random.Random(4)
    passage = fx.prose(rng, 60)
    texts = [f"{fx.prose(rng, 90)} {passage}" for _ in range(40)]
    assert all(r.kept for r in near_dup.near_duplicates(fx.documents(spark, texts)).collect())


@pytest.mark.parametrize("share", [60, 110])
def test_a_passage_of_many_costs_no_pairs(spark, monkeypatch, share):
    """What many share without linking makes no more rows of work than there are documents, at every size."""
    rng = random.Random(5)
    passage = fx.prose(rng, share)
    made = []

    def counted(df, folder=None):
        made.append(out := keep(df, folder))
        return out

    monkeypatch.setattr(near_dup, "keep", counted)
    for n in (100, 400):
        made.clear()
        texts = [f"{fx.prose(rng, 40)} {passage}" for _ in range(n)]
        assert all(r.kept for r in near_dup.near_duplicates(fx.documents(spark, texts)).collect())
        assert max(df.count() for df in made if "part" in df.columns or "tokens" in df.columns) <= 2.5 * n


def test_groups_in_many_places_are_not_broadcast(spark):
    """Spark sizes groups without the places that they are repeated in, so few bytes may be many in a driver."""
    rows = spark.range(100).selectExpr("id AS node", "id % 7 AS hub")
    groups = spark.range(5).selectExpr("id AS hub", "id * 2 AS parts")
    for how, n in (("inner", 72), ("left", 100)):
        met = near_dup._spread(rows, groups, "hub", how)
        assert met.count() == n and {(r.hub, r.parts) for r in met.collect() if r.parts is not None} == {(i, 2 * i) for i in range(5)}
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_ids_of_any_type(spark):
    rng = random.Random(8)
    a, b = fx.prose(rng, 60), fx.prose(rng, 60)
    for ids in ([5 * 10**18, 5 * 10**18 + 1, 2**62, -3], ["x", "abc", "9", ""]):
        docs = fx.documents(spark, [a, a + " tail", b, ""], list(range(4)))
        named = spark.createDataFrame(list(enumerate(ids)), ["doc_id", "own"]).join(docs, "doc_id")
        rows = {r.doc_id: r for r in near_dup.near_duplicates(named, id_col="own").collect()}
        first = min(ids[:2])
        assert {i: rows[i].component_id for i in ids} == {ids[0]: first, ids[1]: first, ids[2]: ids[2], ids[3]: ids[3]}
        assert {i for i in ids if rows[i].kept} == {first, ids[2], ids[3]}
    narrow = docs.withColumn("doc_id", docs.doc_id.cast("int"))
    assert {r.component_id for r in near_dup.near_duplicates(narrow).collect()} == {0, 2, 3}


def test_rows_of_one_id_are_placed_by_their_texts(spark):
    rng = random.Random(9)
    a, b, c = (fx.prose(rng, 60) for _ in range(3))
    docs = fx.documents(spark, [a, b, a, c, c], [1, 2, 2, 2, 2])
    got = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 2), (2, 2)]
    kept = near_dup.distinct_documents(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (2, c)])


def test_union_sketch_lets_links_pass():
    rng = np.random.default_rng(2)
    for n in (20, 60, 70, 400, 3000):
        base = rng.choice(2**62, n, replace=False)
        changed = lambda kept: np.sort(np.concatenate((base[:kept], rng.choice(2**62, n - kept, replace=False))))
        whole, close, far = np.sort(base), changed(n * 9 // 10), changed(n // 4)
        assert near_dup._similar(whole, close, 75) and not near_dup._similar(whole, far, 75)
        assert near_dup._promising(whole[: near_dup.K], close[: near_dup.K], 75) and not near_dup._promising(whole[: near_dup.K], far[: near_dup.K], 75)


def test_null_ids_repeats_and_empty_table(spark):
    rng = random.Random(6)
    a, b = fx.prose(rng, 60), fx.prose(rng, 60)
    docs = fx.documents(spark, [a, a, b, b, None, a], [None, 5, None, None, None, 5])
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == 6
    assert sorted((r.component_id for r in rows), key=str) == [5, 5, 5, None, None, None]
    kept = near_dup.distinct_documents(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == 3 and set(rows) == {(5, a), (None, b), (None, None)}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (202, 200)]
    rows = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {i: 0 for i in range(41)} | {200: 200, 201: 200, 202: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_equal_the_pattern():
    texts = fx.corpus() + ["a\x0bb\x0cc", " nbsp stays", "x" * 300_000]
    for _, _, data, offs in chunks(pa.array(texts), 1000):
        w = Words(data, offs, lower=True)
        h = w.hashes()
        for i in range(w.n_texts):
            own = slice(w.first[i], w.first[i + 1])
            text = bytes(data[offs[i] : offs[i + 1]]).decode()
            want = fx.words(text)
            assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start[own], w.end[own])] == want
            assert len(set(h[own].tolist())) == len(set(want))
            assert len(shingles(h[own])) == len(fx.shingles(text))
    assert np.all(np.diff(shingles(h[:50]).astype(float)) >= 0)
