"""Applying a plan's moves so that a crash at any point leaves either all of them or none.

A journal in the session's folder names every move and holds the configuration files as
they were. Files go to a staging folder first and to their targets then; configuration is
written last, and the journal is marked. Whatever finds a journal later undoes everything
if it is not marked, and only clears up if it is. Each step asks what is there before it
acts, so that a recovery which breaks off itself can be begun again.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

JOURNAL, MARK, STAGING = ".moves.json", ".moves.done", ".staging"


class Folder:
    """Files below a root that any URI of pyarrow.fs names, local paths included; renames must be of the file system's own."""

    def __init__(self, root: str, before: Callable[[str], None] | None = None):
        self.system, self.root = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        self.before = before or (lambda step: None)

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def there(self, path: str) -> bool:
        return self.system.get_file_info(self._at(path)).type != fs.FileType.NotFound

    def read(self, path: str) -> bytes:
        with self.system.open_input_file(self._at(path)) as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        """All or nothing, by a file beside it."""
        self.before(f"write {path}")
        self.system.create_dir(self._at(path).rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(self._at(f"{path}.new")) as f:
            f.write(data)
        self.before(f"name {path}")
        self.system.move(self._at(f"{path}.new"), self._at(path))

    def move(self, source: str, target: str) -> None:
        self.before(f"move {source} {target}")
        self.system.create_dir(self._at(target).rpartition("/")[0], recursive=True)
        self.system.move(self._at(source), self._at(target))

    def remove(self, path: str) -> None:
        if self.there(path):
            self.before(f"remove {path}")
            self.system.delete_file(self._at(path))

    def clear(self, paths: set[str]) -> None:
        """Remove folders that are empty, deepest first."""
        for path in sorted(paths, key=lambda p: -p.count("/")):
            if self.there(path) and not self.system.get_file_info(fs.FileSelector(self._at(path))):
                self.before(f"clear {path}")
                self.system.delete_dir(self._at(path))


def _folders(paths: list[str]) -> set[str]:
    """All folders on the way to paths."""
    return {"/".join(parts[:k]) for p in paths for parts in [p.split("/")] for k in range(1, len(parts))}


def recover(root: str, before: Callable[[str], None] | None = None) -> str | None:
    """'undone' or 'done' where a journal was left in root's folder, None where there is none."""
    folder = Folder(root, before)
    if not folder.there(JOURNAL):
        for path in (MARK, f"{MARK}.new", f"{JOURNAL}.new"):
            folder.remove(path)
        return None
    journal = json.loads(folder.read(JOURNAL))
    done = folder.there(MARK)
    if not done:
        for source, staged, target in reversed(journal["moves"]):
            for at in (target, staged):
                if folder.there(at) and not folder.there(source):
                    folder.move(at, source)
        for path, held in journal["files"]:
            if held is None:
                folder.remove(path)
            else:
                folder.write(path, base64.b64decode(held))
    for path in (MARK, *(p for p, _ in journal["files"])):
        folder.remove(f"{path}.new")
    names = [p for m in journal["moves"] for p in (m if not done else m[:2])] + [p for p, _ in journal["files"]]
    folder.clear((_folders(names) | {STAGING}) - _folders([m[0] for m in journal["moves"]]))
    folder.remove(JOURNAL)  # from here on nothing is left to undo
    folder.remove(MARK)
    return "done" if done else "undone"


def apply_moves(root: str, moves: list[tuple[str, str]], files: dict[str, bytes] | None = None, before: Callable[[str], None] | None = None) -> int:
    """Move files (source, target; below root), then write configuration files; a session's worth of both.

    What an earlier call left is recovered first. A source that is missing, a target that
    exists or is named twice, and a target that is a source are errors, before anything moves. An error on
    the way undoes everything and is raised again; a crash is undone by the next recover.
    """
    recover(root)
    folder, files = Folder(root, before), files or {}
    sources, targets = [a for a, _ in moves], [b for _, b in moves]
    wrong = [f"no source {a}" for a in sources if not folder.there(a)] + [f"target exists: {b}" for b in targets if folder.there(b)]
    wrong += [f"named twice: {p}" for p in sorted({p for p in sources + targets if (sources + targets).count(p) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))
    staged = [(a, f"{STAGING}/{i}", b) for i, (a, b) in enumerate(moves)]
    held = [(p, base64.b64encode(folder.read(p)).decode() if folder.there(p) else None) for p in files]
    folder.write(JOURNAL, json.dumps({"moves": staged, "files": held}).encode())
    try:
        for a, s, _ in staged:
            folder.move(a, s)
        for _, s, b in staged:
            folder.move(s, b)
        for path, data in files.items():
            folder.write(path, data)
        folder.write(MARK, b"done")
    except Exception:
        recover(root)
        raise
    recover(root, before)
    return len(moves)


def apply_plans(targets: DataFrame) -> DataFrame:
    """(root, moved, error) of targets (root, source, target): the plans of many sessions' folders, side by side.

    A session is applied in one task; one whose preflight or moves fail is left as it was and
    tells why. A task that runs again after its executor was lost recovers what it finds
    first: moves that were done already count as done where no source is left.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        root, moves = key[0].as_py(), list(zip(rows["source"].to_pylist(), rows["target"].to_pylist(), strict=True))
        error = None
        try:
            recover(root)
            folder = Folder(root)
            if not all(folder.there(b) and not folder.there(a) for a, b in moves):
                apply_moves(root, moves)
        except (ValueError, OSError) as e:
            error = str(e)
        return pa.table({"root": [root], "moved": [0 if error else len(moves)], "error": pa.array([error], pa.string())})

    return targets.select("root", "source", "target").groupBy("root").applyInArrow(run, "root string, moved long, error string")
