import hashlib
import random

import pytest
from cadenza.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, tree int, node int, branch string"


def brute(rows):
    """(conv_id, n_turns, turns digest, learned code points and digest), equal turns by role and text."""
    out, of = [], {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in of.items():
        turns.sort()
        told = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(1)
    marks = [*chat.CHAT.controls, "<", "\\", "[", "|im_end|>", "/s>", "<\\", "\\n", "\n", "é", "😀 ", "word ", "<\\\\|im_end|>", "[\\/INST]", "<<s>>"]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (5, 0, "assistant", "<"), (5, 1, "assistant", "/s>"), (6, 0, None, None), (6, None, "assistant", None)]
    for conv in range(10, 60):
        for turn in range(rng.choice([1, 2, 3, 8, 17])):
            rows.append((conv if conv != 20 else None, turn // (1 + (conv == 11)), rng.choice(["user", "assistant", "system", "a\nrole\\n</s>"]), "".join(rng.choice(marks) for _ in range(rng.randrange(30)))))
    rows += rows[10:13] * 2
    rows += [(70, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("tree_rows,part", [(100_000, 1 << 24), (10, 50)])
def test_conversations_are_read_back(spark, monkeypatch, tree_rows, part):
    monkeypatch.setattr(chat, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(chat, "PART_CHARS", part)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    got = chat.chat_digests(table).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_empty_tables_and_long_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.chat_digests(empty).count() == 0
    rows = [(1, 0, "user", "<s>" * 1_000_000), (1, 1, "assistant", "x" * 2_000_000)]
    got = chat.chat_digests(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)).collect()
    assert [tuple(r)[:5] for r in got] == brute(rows)


def test_escapes_leave_no_control_string(spark):
    texts = [t for _, _, _, t in conversations() if t is not None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.CHAT.escape(F.col("t")).alias("e")).collect()
    for r in rows:
        assert not any(c in r.e for c in chat.CHAT.controls) and chat.CHAT.unescape(r.e) == r.t
    with pytest.raises(ValueError):
        chat.Template(controls=("<|im_start|>", "<|im_end|>", "<<SYS>>"))


def trees():
    """Messages of random trees, with unknown parents, rings, missing scores and repeated rows."""
    rng = random.Random(2)
    rows = []
    for tree in range(12):
        n = rng.choice([1, 2, 9, 40])
        for i in range(n):
            parent = None if i == 0 else rng.randrange(max(0, i - 3), i)
            rows.append((tree, f"m{i}", None if parent is None else f"m{parent}", None if rng.random() < 0.2 else round(rng.random(), 1), rng.choice(["user", "assistant"]), f"text {tree} {i}"))
    rows += [(3, "lost", "unknown", 0.9, "user", "an orphan"), (4, "r1", "r2", 1.0, "user", "ring"), (4, "r2", "r1", 1.0, "user", "ring"), (4, "r3", "r2", 1.0, "user", "on a ring")]
    return rows + [rows[0]]


def brute_branches(rows, most):
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        found = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at in path:
                continue
            scores = [own[m][3] for m in path if own[m][3] is not None]
            found.append(((-round(sum(scores) / len(scores), 9) if scores else 9, -len(path), leaf), path[::-1]))
        for k, (_, path) in enumerate(sorted(found)[:most]):
            out[tree, k + 1] = path
    return out


@pytest.mark.parametrize("tree_rows", [100_000, 5])
@pytest.mark.parametrize("most", [1, 3, None])
def test_branches_equal_brute_force(spark, monkeypatch, most, tree_rows):
    monkeypatch.setattr(chat, "TREE_ROWS", tree_rows)
    rows = trees()
    table = spark.createDataFrame(rows, "tree_id long, id string, parent string, score double, role string, text string").repartition(4)
    members = chat.branches(chat.reply_trees(table, "tree_id", "id", "parent", "score"), most)
    got = {}
    for r in sorted(members.collect(), key=lambda r: r.pos):
        got.setdefault((r.tree.of, r.branch), []).append(r.node.id)
    assert got == brute_branches(rows, most)
    made = chat.formatted(members, table.dropDuplicates(), "tree_id", "id").collect()
    text = {(r[0], r[1]): r[5] for r in rows}
    assert len(made) == len(got)
    for r in made:
        assert [r.text[a:b] for _, a, b in chat.CHAT.turns(r.text)] == [text[r.tree, m] for m in got[r.tree, r.branch]]
