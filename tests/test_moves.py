"""Moves that are broken off between any two steps, and recovered."""

from __future__ import annotations

import contextlib

import pytest
from cadenza.sources import moves

MOVES = [("incoming/a.wav", "takes/take-01/audio.wav"), ("incoming/b.mp4", "takes/take-01/angle-a.mp4"), ("incoming/c.mp4", "excluded/c.mp4")]
FILES = {"session.yaml": b"new", "takes/take-01/take.yaml": b"take"}


class Crash(BaseException):
    """Nothing of the library handles this, as nothing handles the end of a process."""


def crash_at(n):
    left = [n]

    def before(step):
        left[0] -= 1
        if left[0] < 0:
            raise Crash(step)

    return before


def begun(root):
    (root / "incoming").mkdir(parents=True)
    for a, _ in MOVES:
        (root / a).write_bytes(a.encode())
    (root / "session.yaml").write_bytes(b"old")
    return state(root)


def state(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


DONE = {b: a.encode() for a, b in MOVES} | FILES


def test_a_crash_between_any_two_steps(tmp_path):
    outcomes = set()
    for n in range(200):
        root = tmp_path / str(n)
        old = begun(root)
        try:
            moves.apply_moves(str(root), MOVES, FILES, crash_at(n))
        except Crash:
            for again in range(n % 4):  # the recovery breaks off too
                with contextlib.suppress(Crash):
                    moves.recover(str(root), crash_at(again))
            moves.recover(str(root))
            assert state(root) in (old, DONE), n
            outcomes.add(state(root) == DONE)
            assert not (root / ".staging").exists() and (state(root) == DONE or not (root / "takes").exists())
            continue
        assert state(root) == DONE
        break
    assert outcomes == {True, False} and n > 15


def test_errors_undo_and_preflight_refuses(tmp_path):
    root = tmp_path / "s"
    old = begun(root)

    def fail(step):
        if step.startswith("name session.yaml"):
            raise OSError("disk")

    with pytest.raises(OSError, match="disk"):
        moves.apply_moves(str(root), MOVES, FILES, fail)
    assert state(root) == old
    (root / "excluded").mkdir()
    (root / "excluded" / "c.mp4").write_bytes(b"there")
    with pytest.raises(ValueError, match="target exists: excluded/c.mp4"):
        moves.apply_moves(str(root), MOVES)
    with pytest.raises(ValueError, match="no source x"):
        moves.apply_moves(str(root), [("x", "y")])
    with pytest.raises(ValueError, match="named twice"):
        moves.apply_moves(str(root), [("incoming/a.wav", "y"), ("incoming/b.mp4", "y")])
    assert moves.recover(str(root)) is None


def test_many_sessions_side_by_side(spark, tmp_path):
    rows = []
    for n in range(4):
        begun(tmp_path / str(n))
        rows += [(str(tmp_path / str(n)), a, b) for a, b in MOVES]
    (tmp_path / "2" / "incoming" / "b.mp4").unlink()
    with pytest.raises(Crash):  # a task that was lost on the way
        moves.apply_moves(str(tmp_path / "3"), MOVES, before=crash_at(5))
    targets = spark.createDataFrame(rows, "root string, source string, target string")
    for _ in range(2):  # and one that is run again
        got = {r.root[-1]: (r.moved, r.error) for r in moves.apply_plans(targets).collect()}
        assert got == {"0": (3, None), "1": (3, None), "2": (0, "no source incoming/b.mp4"), "3": (3, None)}
    assert all((tmp_path / n / b).exists() for n in "013" for _, b in MOVES)
