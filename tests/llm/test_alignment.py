import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cadenza.llm import alignment
from cadenza.llm.tokens import tokenizer_path

from . import fixtures as fx

ODD = [
    "<|endoftext|> is <s> plain </s> text <0x0A>", "日本語の文 " * 30, "a\x00b\r\n\tc", "  two  spaces  ", "éß€😀" * 40, "▁ a mark", "é ñ", "﻿bom", "x" * 3000,
    "ﬁ ½ Å", "　wide line ", "don't we'll I'M", "12345 6789", "\n\n\n", " ", "‍​", "a b", "a b a b a b",
]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.B_FILE))


def byte_of():
    """The usual printable stand-ins of bytes."""
    bs = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    table, n = {chr(b): b for b in bs}, 0
    for b in range(256):
        if b not in bs:
            table[chr(256 + n)] = b
            n += 1
    return table


def brute(texts):
    """(n_a, n_b, groups, links) of each text: cut where both end, link what ends together."""
    a, b = encoders()
    table = byte_of()
    out = []
    for text in texts:
        if not text:
            out.append(([], [], []))
            continue
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        links = [(p, q) for p, e in zip(ids_a, ends_a) for q, f in zip(ids_b, ends_b) if e == f]
        out.append((groups, links, (len(ids_a), len(ids_b))))
    return out


def expected(texts, ids):
    found = brute(texts)
    counts = Counter(p for _, links, _ in found for p in links)
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    rows = []
    for i, (groups, links, sizes) in zip(ids, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_a, n_b = sizes or (0, 0)
        rows.append((i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(rows, key=str)


def test_alignments_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", *ODD, *(fx.prose(rng, rng.choice([3, 40, 300])) for _ in range(12)), "same text here", "same text here"]
    ids = [*range(len(texts) - 2), None, 0]
    docs = fx.documents(spark, texts, ids)
    got = sorted((tuple(r) for r in alignment.alignments(docs).collect()), key=str)
    assert got == expected(texts, ids)
    assert sum(r[1] > 0 for r in got) > len(texts) - 6
    assert alignment.alignments(docs.limit(0)).count() == 0


def test_rare_pairs_are_joined(spark, monkeypatch):
    rng = random.Random(4)
    texts = [fx.prose(rng, 60, 30) for _ in range(9)]
    docs = fx.documents(spark, texts)
    monkeypatch.setattr(alignment, "MOST_BROADCAST", 5)
    got = sorted((tuple(r) for r in alignment.alignments(docs).collect()), key=str)
    assert got == expected(texts, list(range(9)))


def test_the_faster_encoder_finds_the_same_tokens():
    rng = random.Random(5)
    a, _ = encoders()
    letters = "ab eéß\n\t'sdt日😀.,-_0189AZ  "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    own = alignment.byte_level(tokenizer_path(alignment.A_FILE))
    ids, counts = own.tokens(texts)
    want = [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_details_give_the_groups(spark):
    texts = ["a strange tokenisation, perhaps", None, "日本語 and more", "x"]
    rows = sorted(alignment.align(fx.documents(spark, texts), details=True).collect(), key=lambda r: r.doc_id)
    for row, (groups, links, _) in zip(rows, brute(texts)):
        assert row.a_ids == [i for x, _ in groups for i in x] and row.b_ids == [i for _, y in groups for i in y]
        assert len(row.group_ends) == len(groups) == row.n_groups
        assert sum(row.times) == len(links)
        if groups:
            assert row.group_ends[-1] == len((" " + texts[row.doc_id]).encode())


def test_a_long_text_and_clashing_names(spark):
    rng = random.Random(6)
    text = fx.prose(rng, 60_000)
    docs = spark.createDataFrame([(1, text, 2, 3, [1], "y")], "doc_id long, text string, row int, pair int, times array<int>, best string")
    got = [tuple(r) for r in alignment.alignments(docs).collect()]
    a, b = encoders()
    assert got[0][1:3] == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
    assert got[0][5] <= got[0][4] <= got[0][6]


@pytest.mark.parametrize("seed", range(6))
def test_groups_of_any_cuts(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 400))
    ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size)), size)) for _ in range(2)]
    of = alignment.groups(*ends, size)
    common = np.intersect1d(*ends)
    for e, g in zip(ends, of):
        assert g.tolist() == np.searchsorted(common, e).tolist()
