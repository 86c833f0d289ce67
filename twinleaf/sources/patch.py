"""Unified diffs as tables of changed lines.

A patch is read on the driver: it names lines, and each named line is compared with the file on disk.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config import UserError
from ..model import CHANGED_LINES

_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def git_root(folder: str) -> str | None:
    """The nearest folder, from this one upwards, that holds .git (a folder or a file)."""
    here = Path(os.path.realpath(folder))
    return next((str(p) for p in (here, *here.parents) if (p / ".git").exists()), None)


def target_lines(path: str) -> list[str]:
    """A file's lines without their ends; a line end at the file's end gives a last empty line, an empty file none."""
    text = Path(path).read_bytes().decode("utf-8", "surrogateescape")
    return [line.rstrip("\r\n") for line in text.split("\n")] if text else []


def parse(patch: str, folder: str | None = None) -> dict[str, set[int]]:
    """The added lines of each changed file, by canonical path."""
    if not os.path.isfile(patch):
        raise UserError(f"Patch file not found: {patch}")
    if not patch.endswith((".patch", ".diff")):
        raise UserError(f"Unknown patch file type '{patch}', expecting .patch or .diff extension")
    root = git_root(folder or os.getcwd())
    if root is None:
        raise UserError("A patch needs a git repository, and the working folder is in none")
    with open(patch, encoding="utf-8", errors="surrogateescape", newline="") as f:
        rows = f.read().split("\n")
    changed: dict[str, set[int]] = {}
    at, target = 0, None
    while at < len(rows):
        row = rows[at]
        at += 1
        if row.startswith("+++ "):
            target = _target(row[4:].split("\t")[0].rstrip("\r"), root)
            continue
        if not (m := _HUNK.match(row)):
            continue
        old, line, new = int(m[1] or 1), int(m[2]), int(m[3] or 1)
        disk = target_lines(target) if target is not None else []
        while (old > 0 or new > 0) and at < len(rows):
            body = rows[at]
            at += 1
            if body.startswith("\\"):
                continue
            if body.startswith("-"):
                old -= 1
                continue
            if body.startswith("+"):
                if target is not None:
                    if line > len(disk):
                        raise UserError(f"Patch adds line {line} to {target}, but such line does not exist")
                    if disk[line - 1] != body[1:].rstrip("\r"):
                        raise UserError(f"Patch adds line {line} to {target}: '{body[1:]}' does not match actual content '{disk[line - 1]}'")
                    changed.setdefault(target, set()).add(line)
            else:
                old -= 1
            new -= 1
            line += 1
    return changed


def _target(name: str, root: str) -> str | None:
    if name == "/dev/null":
        return None
    if not name.startswith("b/"):
        raise UserError(f"Patch file has an unsupported prefix in '{name}', expecting b/")
    path = os.path.realpath(os.path.join(root, name[2:]))
    if not os.path.isfile(path):
        raise UserError(f"Patched file '{name[2:]}' does not exist on disk")
    return path


def contains_range(changed: dict[str, set[int]], file: str, start: int, end: int) -> bool:
    own = changed.get(file, set())
    return all(line in own for line in range(start, end + 1))


def as_table(spark: SparkSession, changed: dict[str, set[int]]) -> DataFrame:
    return spark.createDataFrame([(f, n) for f, lines in sorted(changed.items()) for n in sorted(lines)], CHANGED_LINES)
