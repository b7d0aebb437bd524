import math
from collections import Counter

import duckdb
from cadenza.llm import mixing

from . import fixtures as fx


def test_equals_sql_and_keeps_columns(spark, tmp_path):
    docs = fx.documents(spark, [f"text {i}" for i in range(400)])
    out = mixing.mix(docs).select("row.*", mixing.F.col("copy").alias("k"), mixing.F.round("rate", 6).alias("rate"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter((r[0], r[5], r[6]) for r in con.sql(mixing.SQL).fetchall())
    assert Counter((r.doc_id, r.k, r.rate) for r in out.collect()) == want
    assert set(docs.columns) <= set(out.columns)


def test_weights_and_shuffle(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(6000)], "doc_id long, source string")
    rows = mixing.mix(docs, {"a": 1.0, "b": 3.0, "absent": 5.0}).select("row.source", "row.doc_id", "place").collect()
    n = Counter(r.source for r in rows)
    assert abs(n["b"] / n["a"] - 3) < 0.25 and abs(len(rows) - 6000) < 5 * math.sqrt(6000)
    assert mixing.mix(docs, {"a": 1.0}).select("row.source").distinct().collect()[0][0] == "a"
    ids = [r.doc_id for r in rows]
    assert ids != sorted(ids) and sum(x > y for x, y in zip(ids, ids[1:])) > len(ids) / 3


def test_large_means_and_nulls(spark):
    docs = spark.createDataFrame([(None if i == 3 else i, None if i % 2 else "rare") for i in range(200)] + [(1000 + i, "big") for i in range(2000)], "doc_id long, source string")
    rows = mixing.mix(docs, {"rare": 1.0}).groupBy("row.source").count().collect()
    assert len(rows) == 1 and abs(rows[0]["count"] - 2200) < 250
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {None: 1.0}).select("row.source").distinct().collect()[0][0] is None


def test_quantiles(spark):
    for mean in (0.0, 0.3, 4.0, 16.0):
        us = [0.0, 0.1, 0.5, 0.9, 0.999, 0.9999999]
        rows = spark.createDataFrame([(u,) for u in us], "u double").select("u", mixing.poisson(mixing.F.lit(mean), mixing.F.col("u")).alias("k")).collect()
        for r in rows:
            below, p, k = math.exp(-mean), math.exp(-mean), 0
            while below <= r.u:
                k += 1
                p *= mean / k
                below += p
            assert r.k == k
