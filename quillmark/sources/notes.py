"""Notes written back into a vault, and read from it by path."""

from __future__ import annotations

import json
import os
import re
import secrets
from datetime import UTC, datetime
from pathlib import Path


def inside(vault: str | Path, relative: str) -> Path:
    """The path of a note, which must not lead out of the vault."""
    root = Path(vault).resolve()
    found = (root / relative).resolve()
    if not found.is_relative_to(root):
        raise ValueError(f"{relative} leads out of the vault")
    return found


def remember(vault: str | Path, text: str, tags: tuple[str, ...] = (), title: str | None = None) -> str:
    """Write a note to the inbox: a YAML block, then the text. Gives its path in the vault."""
    if not text.strip():
        raise ValueError("a note needs a text")
    now = datetime.now(UTC)
    bare = re.sub("[^0-9a-z]+", "-", (title or " ".join(text.split()[:6])).lower()).strip("-")[:60] or "note"
    name = f"inbox/{now:%Y%m%dT%H%M%S}-{bare}-{secrets.token_hex(3)}.md"
    head = ["---", f"ts: {now:%Y-%m-%dT%H:%M:%SZ}"]
    head += [f"title: {json.dumps(title, ensure_ascii=False)}"] if title else []
    head += ["tags: [" + ", ".join(t.strip().lstrip("#") for t in tags) + "]"] if tags else []
    path = inside(vault, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_suffix(".tmp")
    temp.write_text("\n".join([*head, "---", "", text.strip(), ""]), encoding="utf-8")
    os.replace(temp, path)
    return name


def get(vault: str | Path, relative: str) -> str:
    """A whole note."""
    return inside(vault, relative).read_text(encoding="utf-8")
