"""Driver-side settings from ``.env`` files."""

from __future__ import annotations

import os
from collections.abc import MutableMapping


def parse(text: str) -> dict[str, str]:
    """Names and values; comments, ``export`` and quotes around a value don't count."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("#") or "=" not in line:
            continue
        name, _, value = line.removeprefix("export ").partition("=")
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if name.strip():
            out[name.strip()] = value
    return out


def load(paths: list[str], into: MutableMapping[str, str] | None = None, override: bool = False) -> str | None:
    """Take over the first file that exists; what is set already stays unless overridden. Returns its path."""
    into = os.environ if into is None else into
    for path in paths:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                for name, value in parse(file.read()).items():
                    if override or name not in into:
                        into[name] = value
            return path
    return None
