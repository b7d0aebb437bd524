import random

import corpus_pipeline
from cadenza.llm import queries, secrets

from . import fixtures as fx
from .test_decontam import brute as leaks
from .test_quality import brute as judged
from .test_secrets import brute as found


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(12)
    items = [(k, fx.prose(rng, 30)) for k in range(5)]
    texts = fx.corpus() + [f"{fx.prose(rng, 80)} {items[k][1]} {fx.prose(rng, 30)}" for k in range(5)] + [f"{fx.prose(rng, 70)} token=abcdefgh{k}{k}" for k in range(4)] + ["rep one two " * 90]
    docs = fx.documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, want = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(enumerate(texts))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k == 0:
            want = {i: t for i, t in want.items() if judged(t)["kept"]}
        elif k == 1:
            of = fx.components(list(want.values()), list(want))
            want = {i: t for i, t in want.items() if of[i] == i}
        elif k == 2:
            bad = {d for d, _ in leaks(list(want.items()), items)}
            want = {i: t for i, t in want.items() if i not in bad}
        elif k == 3:
            for i, t in want.items():
                for a, _, b in reversed(found(t)):
                    want[i] = want[i][:a] + secrets.MASK + want[i][b:]
        if k < 4:
            assert now.columns == docs.columns, name
            assert {r.doc_id: r.text for r in now.collect()} == want, name
        now.write.parquet(str(tmp_path / f"stage{k}.parquet"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}.parquet"))
    assert {r.doc_id: r.text for r in now.collect()}.items() <= want.items()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
