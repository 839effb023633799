"""The configuration file of a scan."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

#: The file's name, unless the caller names another.
NAME = ".attestra.toml"
TEMPLATE = """output_format = "text"
fail_on = "error"

[scan]
ignore_patterns = []

[extractors]
enabled = "all"
disabled = []
"""


@dataclass
class Settings:
    ignore_patterns: list[str] = field(default_factory=list)
    threshold: float = 0.0
    output_format: str = "text"
    fail_on: str = "error"
    enabled: list[str] | None = None
    disabled: list[str] = field(default_factory=list)


def find(start: str, name: str = NAME) -> Path | None:
    """The file in ``start`` or the nearest folder above it."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def _checked(path: Path, what: str, value, kind: type | tuple, allowed: tuple = ()):
    if not isinstance(value, kind) or isinstance(value, bool) or (allowed and value not in allowed):
        raise ValueError(f"{path}: {what} cannot be {value!r}")
    return value


def load(path: str | None = None, start: str = ".") -> Settings:
    """The settings of ``path``, else of the nearest file, else the usual ones.  A bad value is an error that names it."""
    found = Path(path) if path else find(start)
    if found is None:
        return Settings()
    if not found.is_file():
        raise FileNotFoundError(found)
    try:
        data = tomllib.loads(found.read_text(encoding="utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ValueError(f"{found}: {e}") from e
    scan, rules = _checked(found, "[scan]", data.get("scan", {}), dict), data.get("extractors", {})
    rules = rules if isinstance(rules, dict) else {}
    threshold = float(_checked(found, "threshold", data.get("threshold", 0.0), (int, float)))
    if not 0 <= threshold <= 1:
        raise ValueError(f"{found}: threshold cannot be {threshold}")
    enabled = rules.get("enabled", "all")
    return Settings(
        _checked(found, "ignore_patterns", scan.get("ignore_patterns", []), list), threshold, _checked(found, "output_format", data.get("output_format", "text"), str, ("text", "json")),
        _checked(found, "fail_on", data.get("fail_on", "error"), str), None if enabled == "all" else _checked(found, "extractors.enabled", enabled, list), _checked(found, "extractors.disabled", rules.get("disabled", []), list))


def init(folder: str, force: bool = False, name: str = NAME) -> Path:
    path = Path(folder, name)
    if path.exists() and not force:
        raise FileExistsError(path)
    path.write_text(TEMPLATE, encoding="utf-8")
    return path
