import random
from collections import Counter

from cadenza.llm import decontam

from . import fixtures as fx


def brute(docs, items):
    found = set()
    for k, item in items:
        w = fx.words(item)
        size = len(w) - 4
        if size < 1:
            continue
        bag = Counter(tuple(w[i : i + 5]) for i in range(size))
        for d, text in docs:
            v = fx.words(text)
            g = [tuple(v[i : i + 5]) for i in range(len(v) - 4)]
            for a in range(max(1, len(g) - size + 1)) if g else ():
                c = Counter(g[a : a + size])
                if 4 * sum((c & bag).values()) >= 3 * sum((c | bag).values()):
                    found.add((d, k))
                    break
    return found


def case():
    rng = random.Random(9)
    items = [(k, fx.prose(rng, rng.randrange(12, 70))) for k in range(30)] + [(30, None), (31, ""), (32, "three small words"), (33, "five words are just enough"), (34, "again and again and again and again and again and")]
    items.append((35, items[3][1]))
    texts = [None, "", "short", "here five words are just enough to see", items[34][1] * 3]
    for k in range(25):
        w = items[k][1].split(" ")
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "edited"
        texts.append(f"{fx.prose(rng, rng.randrange(0, 80))} {' '.join(w).upper()} {fx.prose(rng, 40)}")
    texts += [items[2][1], " ".join(items[5][1].split(" ")[: len(items[5][1].split(" ")) * 4 // 5]), f"{fx.prose(rng, 20_000)} {items[7][1]} {fx.prose(rng, 20_000)}", texts[6]]
    return texts, items


def test_equals_all_windows(spark):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = fx.documents(spark, texts)
    rows = decontam.contaminated(docs, bench).collect()
    want = brute(list(enumerate(texts)), items)
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and len(want) >= 15
    assert all(r.similarity >= 0.75 and r.bits <= decontam.RADIUS for r in rows)
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_items_in_slices(spark, monkeypatch):
    texts, items = case()
    monkeypatch.setattr(decontam, "SLICE_ITEMS", 7)
    rows = decontam.contaminated(fx.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(list(enumerate(texts)), items)


def test_empty_tables(spark):
    texts, items = case()
    docs, bench = fx.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.clean_documents(docs, bench.limit(0)).count() == len(texts)


def test_ids_of_any_type(spark):
    texts, items = case()
    want = brute(list(enumerate(texts)), items)
    for kind in ("int", "string"):
        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
        out = decontam.contaminated(fx.documents(spark, texts).selectExpr("cast(doc_id as int) as doc_id", "text"), bench)
        assert out.schema["item_id"].dataType == bench.schema["item_id"].dataType and out.schema["doc_id"].dataType.simpleString() == "int"
        assert {(r.doc_id, int(float(r.item_id))) for r in out.collect()} == want
