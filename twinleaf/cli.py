"""The command line: scans sources, reports clone groups; exit code 0 without clones, 1 with, 2 on errors."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .config import UserError
from .highlight import Highlighter
from .model import SUBTREES
from .operators import cache, detect
from .report_text import Group, Instance, TextReporter
from .sources import patch, php, python_code, scan, trees

FRONTENDS = {"php": (".php", php.parse), "python": (".py", python_code.parse)}


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinleaf", description="Finds structural duplicates in source code.")
    p.add_argument("paths", nargs="*", help="files and folders to scan (default: src)")
    p.add_argument("-c", "--config", help="settings file (.toml or .json)")
    p.add_argument("-m", "--min-node-count", help=f"least size of a clone in nodes (default: {settings.DEFAULT_MIN_NODE_COUNT})")
    p.add_argument("--cache-dir", help="folder for cached subtrees")
    p.add_argument("--patch", help="only groups with an instance wholly in the lines that this unified diff adds")
    p.add_argument("--frontend", choices=sorted(FRONTENDS), default="php")
    p.add_argument("--color", action=argparse.BooleanOptionalAction, default=None)
    return p


def shown(path: str, folder: str) -> str:
    """./x for paths below folder and for plain relative ones."""
    path = path.replace("\\", "/")
    if path.startswith(folder + "/"):
        return "./" + path[len(folder) + 1 :]
    return path if path.startswith(("/", "../", "./")) else f"./{path}"


def run(argv: list[str], spark: SparkSession | None = None, out=None, err=None, folder: str | None = None) -> int:
    out, err, folder = out or sys.stdout, err or sys.stderr, folder or os.getcwd()
    say = lambda text: print(text, file=err)
    args = arguments().parse_args(argv[1:] if argv[:1] == ["detect"] else argv)
    try:
        return _detect(args, spark, lambda text: print(text, file=out), say, folder, out)
    except UserError as e:
        say(f"Error: {e}")
        return 2


def _detect(args: argparse.Namespace, spark: SparkSession | None, write, say, folder: str, out) -> int:
    found = settings.resolve(folder, args.config)
    config = found.config
    if found.path:
        say(f"Config: {shown(found.path, folder)}" + (" (auto-detected)" if found.auto_detected else ""))
    cache_dir = args.cache_dir or config.cache_dir or os.path.join(tempfile.gettempdir(), "twinleaf-cache")
    least = settings.parse_min_node_count(args.min_node_count) if args.min_node_count is not None else config.min_node_count or settings.DEFAULT_MIN_NODE_COUNT
    own = [os.path.join(os.path.dirname(found.path), p) if found.path else p for p in config.paths]
    paths = [os.path.join(folder, p) for p in args.paths] or own or [os.path.join(folder, "src")]
    if args.paths and config.paths:
        say("Paths on the command line override those of the config")
    added = None
    if args.patch:
        added = patch.parse(os.path.join(folder, args.patch), folder)
        say(f"Patch: {shown(args.patch, folder)}")
    excludes = [os.path.realpath(os.path.join(os.path.dirname(found.path) if found.path else folder, e)) for e in config.exclude_paths]
    roots = [os.path.realpath(p) for p in paths]
    for e in excludes:
        if not os.path.exists(e):
            raise UserError(f"Excluded path not found: {e}")
        if not any(e == r or e.startswith(r + os.sep) for r in roots):
            say(f"Warning: excluded path {shown(e, folder)} lies in no scanned path")
    suffix, parse = FRONTENDS[args.frontend]
    files = scan.list_files(paths, excludes, suffix)
    if not files:
        raise UserError(f"No {suffix} files found in: {', '.join(shown(p, folder) for p in paths)}")
    say(f"Scanning: {', '.join(shown(p, folder) for p in paths)}")
    if excludes:
        say(f"Excluding: {', '.join(shown(e, folder) for e in excludes)}")
    say(f"Limit: {least} nodes")
    say(f"Cache: {cache_dir}")
    began = time.perf_counter()
    spark = spark or SparkSession.builder.appName("twinleaf").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    groups = find(spark, files, least, config.anonymization, parse, args.frontend, cache_dir, added)
    color = args.color if args.color is not None else bool(getattr(out, "isatty", bool)())
    read = lambda f: Path(f).read_text(encoding="utf-8", errors="surrogateescape")
    TextReporter(write, Highlighter(color), read, folder, config.editor_url, added is not None).report(groups, time.perf_counter() - began)
    return 1 if groups else 0


CACHED = f"{SUBTREES}, content_md5 string, cache_key string".replace("file string, file_ord long, ", "")


def find(spark: SparkSession, files: list[str], least: int, flags: settings.AnonymizationSettings, parse, frontend: str, cache_dir: str | None = None, added: dict[str, set[int]] | None = None) -> list[Group]:
    """The clone groups of files in report order. Files whose content is cached aren't parsed."""
    texts = scan.read_listed(spark, files)
    if cache_dir is None:
        nodes = trees.extract(texts, parse, flags)
    else:
        try:
            os.makedirs(cache_dir, exist_ok=True)
        except OSError as e:
            raise UserError(f"Cache folder can't be made: {cache_dir}") from e
        table = os.path.join(cache_dir, "subtrees")
        kept = cache.read(spark, table, CACHED)
        hits, misses = cache.split(texts, kept, flags, frontend)
        once = misses.dropDuplicates(["content_md5"])
        fresh = trees.extract(once, parse, flags).join(once.select("file", "content_md5", "cache_key"), "file").select(*kept.columns)
        if not misses.isEmpty():
            cache.write(fresh, table)
            spark.catalog.refreshByPath(table)
        stored = cache.read(spark, table, CACHED)
        keyed = hits.unionByName(misses).select("file", "file_ord", "content_md5", "cache_key")
        nodes = keyed.join(stored, ["content_md5", "cache_key"]).select("file", "file_ord", "post_ord", "start_line", "end_line", "node_count", "hash")
    changed = patch.as_table(spark, added) if added is not None else None
    inst = detect.detect(nodes, least, changed)
    rows = detect.as_groups(inst).orderBy(*detect.ordering()).select("node_count", F.col("instances")).collect()
    inside = lambda i: added is not None and patch.contains_range(added, i.file, i.start_line, i.end_line)
    return [Group(r.node_count, tuple(Instance(i.file, i.start_line, i.end_line, inside(i)) for i in r.instances)) for r in rows]


def main() -> None:
    sys.exit(run(sys.argv[1:]))
