"""Settings of a detection run, and where they come from."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

CONFIG_NAMES = ("twinleaf.toml", "twinleaf.json")
DEFAULT_MIN_NODE_COUNT = 50


class UserError(Exception):
    """Something that the user can put right; its text is shown as it is."""


@dataclass(frozen=True)
class AnonymizationSettings:
    variables: bool = True
    literals: bool = False
    names: bool = False
    identifiers: bool = False


@dataclass(frozen=True)
class CloneConfig:
    """Immutable settings; each with_* method returns a changed copy."""

    min_node_count: int | None = None
    cache_dir: str | None = None
    paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    editor_url: str | None = None
    anonymization: AnonymizationSettings = field(default_factory=AnonymizationSettings)

    def with_min_node_count(self, n: int) -> CloneConfig:
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError("Minimum node count must be at least 1")
        return replace(self, min_node_count=n)

    def with_cache_dir(self, folder: str) -> CloneConfig:
        return replace(self, cache_dir=folder)

    def with_paths(self, *paths: str) -> CloneConfig:
        return replace(self, paths=tuple(paths))

    def with_path(self, path: str) -> CloneConfig:
        return replace(self, paths=(*self.paths, path))

    def with_exclude_paths(self, *paths: str) -> CloneConfig:
        return replace(self, exclude_paths=tuple(paths))

    def with_exclude_path(self, path: str) -> CloneConfig:
        return replace(self, exclude_paths=(*self.exclude_paths, path))

    def with_editor_url(self, url: str) -> CloneConfig:
        return replace(self, editor_url=url)

    def with_anonymization(self, **flags: bool) -> CloneConfig:
        return replace(self, anonymization=replace(self.anonymization, **flags))


@dataclass(frozen=True)
class ResolvedConfig:
    config: CloneConfig
    path: str | None = None
    auto_detected: bool = False


def parse_min_node_count(text: str) -> int:
    """A whole number of 1 or more, written without sign, blanks or leading zeros."""
    if not text.isascii() or not text.isdigit() or str(int(text)) != text or int(text) < 1:
        raise UserError(f"Option min-node-count must be a positive integer, got '{text}'")
    return int(text)


def from_mapping(data: object) -> CloneConfig:
    if not isinstance(data, dict):
        raise UserError("a table of settings is expected")
    config = CloneConfig()
    flags = {f.name for f in fields(AnonymizationSettings)}
    for key, value in data.items():
        if key == "min_node_count":
            config = config.with_min_node_count(value)
        elif key in ("paths", "exclude_paths") and isinstance(value, list) and all(isinstance(x, str) for x in value):
            config = replace(config, **{key: tuple(value)})
        elif key in ("cache_dir", "editor_url") and isinstance(value, str):
            config = replace(config, **{key: value})
        elif key == "anonymize" and isinstance(value, dict) and set(value) <= flags and all(isinstance(x, bool) for x in value.values()):
            config = config.with_anonymization(**value)
        else:
            raise UserError(f"setting '{key}' is unknown or has a wrong value")
    return config


def resolve(folder: str, explicit: str | None = None) -> ResolvedConfig:
    """The explicit file, else one of CONFIG_NAMES in folder, else the defaults. A file is data and is never executed."""
    if explicit is not None:
        path = Path(folder, explicit)
        if not path.is_file():
            raise UserError(f"Config file not found: {explicit}")
        if path.suffix not in (".toml", ".json"):
            raise UserError(f"Config file must have a .toml or .json extension: {explicit}")
        return ResolvedConfig(_load(path), str(path))
    for name in CONFIG_NAMES:
        if (path := Path(folder, name)).is_file():
            return ResolvedConfig(_load(path), str(path), True)
    return ResolvedConfig(CloneConfig())


def _load(path: Path) -> CloneConfig:
    try:
        text = path.read_text(encoding="utf-8")
        return from_mapping(json.loads(text) if path.suffix == ".json" else tomllib.loads(text))
    except (ValueError, OSError, UserError) as e:
        raise UserError(f"Failed to load config file {path}: {e}") from e
