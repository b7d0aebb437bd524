from collections import Counter

from cadenza.llm import quality

from . import fixtures as fx


def brute(text):
    t = text or ""
    w = fx.words(t, low=False)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup, dup_chars = set(), 0, 0
    for line in t.split("\n"):
        if fx.WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, fx.words(line, low=False)))
            seen.add(line)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup, "dup_line_chars": dup_chars, "n_repeat_words": len(covered)}
    for n in quality.LIMITS:
        before, inside = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in before:
                inside |= set(range(i, i + n))
            before.add(g)
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in inside)
    failed = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    good = dup_chars <= quality.LINE_CHARS_LIMIT * out["word_chars"] and all(out[f"dup_chars_{n}"] <= x * out["word_chars"] for n, x in quality.LIMITS.items())
    return out | {"base_failed": failed, "kept": not failed and good}


def texts():
    block = " ".join(f"rep{i}" for i in range(25))
    line = "the same line of some words stands here"
    return fx.corpus() + [
        f"{block}\n{fx.corpus()[15]}\n{block}", "\n".join([line] * 12), f"{line}\n{fx.corpus()[20]}\n{line}\n\n{line}\r", "# * $ % & | < >" * 30, "a b c " * 40, "x y z x y z", "\n\n\n", " \n \n ",
    ]


def test_counts_and_verdicts(spark):
    all_texts = texts()
    for r in quality.quality_rules(fx.documents(spark, all_texts)).collect():
        want = brute(all_texts[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id


def test_kept_documents_keep_their_columns(spark):
    docs = fx.documents(spark, texts())
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts()) if brute(t)["kept"]}
    assert quality.quality_rules(docs.limit(0)).count() == 0 and quality.kept_documents(docs.limit(0)).count() == 0


def test_repetition_rejects_what_the_base_rules_keep():
    block = " ".join(f"rep{i}" for i in range(40))
    assert brute(f"{block} {block} {' '.join(f'own{i}' for i in range(90))}") | {} and not brute(f"{block} {block} {block} {' '.join(f'own{i}' for i in range(130))}")["kept"]
