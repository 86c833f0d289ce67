"""Front-end for markup. Pages have few physical lines, so ranges count tokens (tags and texts) instead."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnonymizationSettings
from . import trees

# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list[trees.Node] = []
        self.open: list[trees.Node] = []
        self.token = 0

    def add(self, node: trees.Node) -> None:
        (self.open[-1].parts[-1][1] if self.open else self.root).append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.token += 1
        named = [trees.Node("Attribute", [("name", k), ("value", v)], self.token, self.token, "literals", "value") for k, v in sorted(attrs, key=str)]
        node = trees.Node("Element", [("tag", tag), ("attributes", named), ("children", [])], self.token, self.token)
        self.add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        self.token += 1
        if any(n.parts[0][1] == tag for n in self.open):
            while self.open:
                node = self.open.pop()
                node.end = self.token
                if node.parts[0][1] == tag:
                    break

    def handle_data(self, data: str) -> None:
        if text := re.sub(r"\s+", " ", data).strip():
            self.token += 1
            self.add(trees.Node("Text", [("value", text)], self.token, self.token, "variables", "value"))


def parse(source: str) -> list[trees.Node]:
    """The page's trees; elements left open end with the page."""
    builder = _Builder()
    builder.feed(source)
    builder.close()
    for node in builder.open:
        node.end = builder.token
    return builder.root


def subtrees(pages: DataFrame, settings: AnonymizationSettings = AnonymizationSettings(), least: int = 1) -> DataFrame:
    files = pages.select(F.col("page_id").cast("string").alias("file"), F.col("page_id").cast("long").alias("file_ord"), F.col("html").alias("text"))
    return trees.extract(files, parse, settings, least)
