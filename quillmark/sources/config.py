"""Settings of a vault application from a TOML file, with overrides."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Where a vault and its tables are, and how changes are taken over."""

    vault: str = ""
    home: str = "~/.quillmark"
    embedder: str = "hashed"
    url: str = "http://localhost:11434"
    flush_changes: int = 100
    flush_seconds: float = 30.0

    @property
    def index_dir(self) -> Path:
        return Path(self.home).expanduser() / "index"

    @property
    def spool_dir(self) -> Path:
        return Path(self.home).expanduser() / "spool"


def load(path: str | Path | None = None, **overrides: str | None) -> Settings:
    """Settings from a file (none: the defaults); values are cast to their fields' kinds, unknown keys are an error."""
    found = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    found |= {k: v for k, v in overrides.items() if v is not None}
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Settings)}
    if unknown := sorted(set(found) - set(kinds)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Settings(**{k: kinds[k](v) for k, v in found.items()})


def flush_due(settings: Settings, changes: int, dirty_for: float, force: bool = False) -> bool:
    """Enough changes, or some that have waited long enough."""
    return changes > 0 and (force or changes >= settings.flush_changes or dirty_for >= settings.flush_seconds)
