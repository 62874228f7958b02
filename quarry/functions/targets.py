"""How targets are written: name, path:line, qualified names, slashed patterns, line ranges, scopes."""

from __future__ import annotations

import os
import re


def target(spec: str) -> tuple[str | None, int | None, str | None]:
    """(path, line, None) for path:line, else (None, None, name)."""
    path, _, line = spec.rpartition(":")
    if path and line.isdigit() and int(line) > 0 and not path.endswith(":"):
        return path, int(line), None
    return None, None, spec


def qualified(name: str) -> tuple[str | None, str]:
    """Qualifier and bare name, split at the last : or dot."""
    m = re.match(r"^(.*?)(?:::|:|\.)([^:.]+)$", name)
    return (m[1], m[2]) if m and m[1] else (None, name)


def pattern(q: str) -> tuple[str, bool]:
    """The pattern and whether it is a regular expression: /x/ is one."""
    return (q[1:-1], True) if len(q) > 2 and q.startswith("/") and q.endswith("/") else (q, False)


def line_range(spec: str) -> tuple[int, int] | None:
    """12-40 or 12."""
    m = re.fullmatch(r"(\d+)(?:-(\d+))?", spec.strip())
    if not m or int(m[1]) == 0 or int(m[2] or m[1]) < int(m[1]):
        return None
    return int(m[1]), int(m[2] or m[1])


def file_scope(spec: str) -> tuple[str, str | None]:
    """path or path:function."""
    path, _, name = spec.rpartition(":")
    return (path, name) if path and re.fullmatch(r"[\w.$]+", name) and not name.isdigit() else (spec, None)


def anchored(path: str, root: str) -> str:
    """A path within a root, lexically normalized; what leads out of it is refused."""
    full = os.path.normpath(os.path.join(root, path))
    if full != os.path.normpath(root) and not full.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"outside of {root}: {path}")
    return os.path.relpath(full, root)
