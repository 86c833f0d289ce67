"""Syntax trees to subtree rows.

A subtree's digest is made bottom-up from its kind, its scalars and its children's digests, with anonymised
values replaced by a tag, in one walk over the file. Equal digests mean equal trees up to the anonymised values, as if each subtree
had its anonymised values numbered by position, since equal trees number them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..config import AnonymizationSettings
from ..model import SUBTREES


@dataclass(eq=False)
class Node:
    """A node: its parts are (name, value) in a fixed order, a value being a node, a list, a scalar or None."""

    kind: str
    parts: list[tuple[str, Any]]
    start: int = -1
    end: int = -1
    #: Which flag anonymises the node, and which part of it.
    flag: str | None = None
    part: str | None = None
    #: How often each flag's kind occurs in what anonymising takes away (only for a variable named by an expression).
    extra: dict = field(default_factory=dict)


def walk(root: list[Node], settings: AnonymizationSettings) -> Iterator[tuple[Node, int, bytes]]:
    """(node, node count, digest) of every node, children before parents. Works without recursion, so depth is no limit."""
    done: dict[int, tuple[int, bytes, dict[str, int]]] = {}
    stack: list[tuple[Node, bool]] = [(n, False) for n in reversed(root)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(list(children(node))))
            continue
        count, inside = 1, {}
        for c in children(node):
            n, _, own = done[id(c)]
            count += n
            for flag, k in own.items():
                inside[flag] = inside.get(flag, 0) + k
        hidden = node.flag is not None and getattr(settings, node.flag)
        text = [node.kind if not (hidden and node.flag == "names") else "Name"]
        for name, value in node.parts:
            if hidden and name == node.part:
                tags = [f"{flag}{k}" for flag, k in sorted(inside.items()) if k and getattr(settings, flag)] if isinstance(value, Node) else []
                text.append(f"{name}:<{','.join(tags)}>")
            elif value is None:
                text.append("null")
            else:
                text.append(f"{name}:{_shown(value, done)}")
        if node.flag is not None:
            inside[node.flag] = inside.get(node.flag, 0) + 1
        digest = hashlib.md5("|".join(text).encode("utf-8", "surrogatepass")).digest()
        for c in children(node):
            del done[id(c)]
        done[id(node)] = count, digest, inside
        yield node, count, digest


def _shown(value: Any, done: dict) -> str:
    if isinstance(value, Node):
        return done[id(value)][1].hex()
    if isinstance(value, list):
        return "[" + ",".join(_shown(v, done) for v in value if v is not None) + "]"
    return f"{type(value).__name__}={value!r}"


def children(node: Node) -> Iterator[Node]:
    for _, value in node.parts:
        if isinstance(value, Node):
            yield value
        elif isinstance(value, list):
            yield from (v for v in value if isinstance(v, Node))


def rows(root: list[Node], settings: AnonymizationSettings, least: int = 1) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(post_ord, start_line, end_line, node_count, digest) of the nodes that have lines and least nodes."""
    for k, (node, count, digest) in enumerate(walk(root, settings)):
        if count >= least and node.start >= 0 and node.end >= 0:
            yield k, node.start, node.end, count, digest


class ParseError(Exception):
    """Source that the front-end can't read; names the file."""


def extract(files: DataFrame, parse: Callable[[str], list[Node]], settings: AnonymizationSettings, least: int = 1, on_error: str = "fail") -> DataFrame:
    """SUBTREES of files (file, file_ord, text), parsed within their own rows.

    on_error: "fail" ends the job with the file's name, "skip" leaves the file out. A null text has no nodes.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error is 'fail' or 'skip', not {on_error!r}")

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in SUBTREES.split(", ")]
        for batch in batches:
            out = []
            for file, ord_, text in zip(batch["file"], batch["file_ord"], batch["text"], strict=True):
                if text is None:
                    continue
                try:
                    root = parse(text)
                except ParseError as e:
                    if on_error == "skip":
                        continue
                    raise ParseError(f"{file}: {e}") from None
                out += [(file, ord_, *r) for r in rows(root, settings, least)]
            yield pd.DataFrame(out, columns=names)

    return files.select("file", "file_ord", "text").mapInPandas(run, SUBTREES)
