"""The text report of clone groups, made on the driver from groups already found."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from .highlight import Highlighter
from .operators.diff import Range, instance_ranges

_WHITE = " \t\n\r\0\x0b"


@dataclass(frozen=True)
class Instance:
    file: str
    start: int
    end: int
    changed: bool = False


@dataclass(frozen=True)
class Group:
    node_count: int
    instances: tuple[Instance, ...]


@dataclass(frozen=True)
class Row:
    """A printed line: the lines it stands for, its text, what differs in it, and whether it is an alternative."""

    line_nums: tuple[tuple[Instance, int], ...]
    text: str
    ranges: tuple[Range, ...] = ()
    alternative: bool = False


def dedent(lines: Sequence[str]) -> list[str]:
    """lines without the longest run of spaces and tabs that all lines that aren't blank begin with."""
    leads = [line[: len(line) - len(line.lstrip(" \t"))] for line in lines if line.strip(_WHITE)]
    prefix = os.path.commonprefix(leads) if leads else ""
    return [line[len(prefix) :] if line.startswith(prefix) else "" for line in lines]


def snippet(text: str, instance: Instance) -> list[str]:
    return [line.replace("\t", "    ") for line in text.split("\n")[instance.start - 1 : instance.end]]


def content(lines: Sequence[str]) -> list[int]:
    return [k for k, line in enumerate(lines) if line.strip(_WHITE)]


def rows(instances: Sequence[Instance], bodies: Sequence[Sequence[str]]) -> list[Row] | None:
    """The unified rows of dedented bodies; None if they have different numbers of lines that aren't blank."""
    places = [content(b) for b in bodies]
    if len({len(p) for p in places}) > 1:
        return None
    ranges = instance_ranges(bodies)
    number = {k: i for i, k in enumerate(places[0])}
    out = []
    for k, line in enumerate(bodies[0]):
        first = instances[0]
        if k not in number:
            out.append(Row(((first, first.start + k),), ""))
            continue
        variants: dict[str, list[int]] = {}
        for i, p in enumerate(places):
            variants.setdefault(bodies[i][p[number[k]]].strip(_WHITE), []).append(i)
        if len(variants) == 1:
            out.append(Row(((first, first.start + k),), line))
            continue
        for n, have in enumerate(variants.values()):
            own = [(instances[i], instances[i].start + places[i][number[k]]) for i in have]
            i = have[0]
            at = places[i][number[k]]
            out.append(Row(tuple(own), bodies[i][at], tuple(ranges[i][at]) if ranges else (), n > 0))
    return out


class TextReporter:
    def __init__(self, write: Callable[[str], None], highlighter: Highlighter, read: Callable[[str], str], folder: str, editor_url: str | None = None, patch: bool = False):
        self.write, self.paint, self.read, self.folder, self.editor_url, self.patch = write, highlighter, read, folder.replace("\\", "/").rstrip("/"), editor_url, patch

    def relative(self, file: str) -> str:
        file = file.replace("\\", "/")
        return file.removeprefix(self.folder + "/")

    def link(self, text: str, file: str, line: int) -> str:
        if not self.editor_url or not self.paint.enabled:
            return text
        url = self.editor_url.replace("{relFile}", self.relative(file)).replace("{file}", file).replace("{line}", str(line))
        return f"\x1b]8;;{url}\x1b\\{text}\x1b]8;;\x1b\\"

    def report(self, groups: Sequence[Group], seconds: float) -> None:
        if not groups:
            self.write(f"\n No code clones detected, took {seconds:.2f}s \n")
            return
        for k, group in enumerate(groups, 1):
            self.write("")
            self.write("  " + self.paint.dim("─" * 37))
            self.block(k, group)
        self.write("")
        self.write(f"  ✖ {len(groups)} clone groups found ({seconds:.2f}s)")

    def block(self, number: int, group: Group) -> None:
        own = sorted(group.instances, key=lambda i: not i.changed) if self.patch else list(group.instances)
        bodies = [dedent(snippet(self.read(i.file), i)) for i in own]
        title = f"  {self.paint.bold(f'Clone #{number}')}  {group.node_count} nodes · {len(own)} instances"
        if self.patch:
            new = sum(i.changed for i in own)
            title += " · intra-MR duplication" if new == len(own) else f" · {new} new ↔ {len(own) - new} existing"
        if all(b == bodies[0] for b in bodies):
            title += " · exact match"
        self.write(title)
        for i in own:
            self.write("  " + self.link(f"{self.relative(i.file)}:{i.start}-{i.end}", i.file, i.start))
        width = max(3, len(str(max(i.end for i in own))))
        found = rows(own, bodies)
        self.write("")
        if found is not None:
            for row in found:
                self.row(row, width)
            return
        for i, body in zip(own, bodies, strict=True):  # one after another
            self.write("  " + self.relative(i.file))
            for k, line in enumerate(body):
                self.row(Row(((i, i.start + k),), line), width)

    def row(self, row: Row, width: int) -> None:
        plain = ", ".join(str(n) for _, n in row.line_nums)
        label = ", ".join(self.link(str(n), i.file, n) for i, n in row.line_nums)
        text = self.paint.highlight_with_diffs(row.text, row.ranges) if row.alternative else self.paint.highlight(row.text)
        label = self.paint.line_number(" " * (width - len(plain)) + label)
        self.write(f"  {label}  {self.paint.background(text) if row.alternative else text}".rstrip() if not self.paint.enabled else f"  {label}  {self.paint.background(text) if row.alternative else text}")
