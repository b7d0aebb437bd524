import os

import numpy as np
import pytest
from cadenza.llm import tokens

from . import fixtures as fx


def test_counts_equal_the_tokenizer(spark):
    texts = fx.corpus() + ["<|endoftext|> is plain text", "日本語 " * 50]
    encode = tokens.encoder(tokens.tokenizer_path()).encode_ordinary
    docs = fx.documents(spark, texts + texts[:3], [*range(len(texts)), None, 0, 0])
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(docs).collect())
    ids = [*range(len(texts)), None, 0, 0]
    assert got == sorted((str(i), len(encode(t or ""))) for i, t in zip(ids, texts + texts[:3]))
    assert tokens.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_of_any_blocks_equals_a_split(spark, tmp_path, block):
    rng = np.random.default_rng(1)
    want, files = set(), []
    for k, ids in enumerate(([], [9], [1, 2, 3], [9, 9, 9], rng.integers(0, 6, 400), [1] * 90 + [9], rng.integers(8, 10, 200))):
        ids = np.asarray(ids, "<u2")
        path = tmp_path / f"{k}.bin"
        path.write_bytes(ids.tobytes())
        files.append((f"file://{path}",))
        cut = np.flatnonzero(ids == 9)
        bounds = [-1, *cut.tolist()]
        want |= {(k, i, b - a - 1, True) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))}
        if len(ids) and (not len(cut) or cut[-1] < len(ids) - 1):
            want.add((k, len(cut), len(ids) - bounds[-1] - 1, False))
    rows = tokens.separator_scan(spark.createDataFrame(files, "file string"), end=9, block_bytes=block).collect()
    assert {(int(os.path.basename(r.file)[:-4]), r.ordinal, r.n_tokens, r.closed) for r in rows} == want and len(rows) == len(want)


def test_a_cut_identifier_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="inside an identifier"):
        tokens.separator_scan(spark.createDataFrame([(f"file://{tmp_path}/x.bin",)], "file string")).collect()
