"""Settings of a run: models, worker counts, logging."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass

LEVEL, FILE, LINES = "ARCHLIGHT_LOG_LEVEL", "ARCHLIGHT_LOG_FILE", "ARCHLIGHT_LOG_FORMAT"


@dataclass(frozen=True)
class ModelConfig:
    """A model's name and, if known, the tokens it takes."""

    name: str
    context_window: int | None = None

    def options(self) -> dict[str, int]:
        """What is told to the server: the window only where one is set."""
        return {"num_ctx": self.context_window} if self.context_window else {}


def models(text: str) -> dict[str, str | dict[str, object]]:
    """The ``models`` section of a configuration of nested ``key: value`` lines; comments and blank lines do not count."""
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(bare) - len(bare.lstrip()), bare.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip().strip("\"'")
        stack[-1][1][key.strip("\"'")] = below = {} if not value else int(value) if value.isdigit() else value
        if isinstance(below, dict):
            stack.append((depth, below))
    return out.get("models", {})


def model(section: Mapping[str, object], key: str) -> ModelConfig:
    """A model's settings: its name alone, or a mapping that has one."""
    if key not in section:
        raise KeyError(f"no model {key!r} is configured")
    given = section[key]
    if isinstance(given, str):
        return ModelConfig(given)
    if not isinstance(given, Mapping):
        raise TypeError(f"model {key!r} is neither a name nor a mapping")
    if "name" not in given:
        raise KeyError(f"model {key!r} has no name")
    return ModelConfig(str(given["name"]), given.get("context_window"))


#: Workers of each kind, in the order in which a limit takes from them.
WORKERS = {"analysis": 2, "extraction": 5, "database": 1}


def workers(limit: int | None = None) -> dict[str, int]:
    """Workers under a limit on their sum: kinds give up all but one in turn; each keeps one, so the sum is three at least."""
    out = dict(WORKERS)
    surplus = sum(out.values()) - max(limit, len(out)) if limit and limit > 0 else 0
    for kind in out:
        taken = min(max(surplus, 0), out[kind] - 1)
        out[kind], surplus = out[kind] - taken, surplus - taken
    return out


def configure_logging(level: str | int | None = None, file: str | None = None, console: bool = True) -> logging.Logger:
    """Sets up the package's logger anew: what is not given comes from the environment."""
    out = logging.getLogger("archlight")
    wanted = level if isinstance(level, int) else logging.getLevelName(str(level or os.environ.get(LEVEL, "INFO")).upper())
    out.setLevel(wanted if isinstance(wanted, int) else logging.INFO)
    path = file or os.environ.get(FILE)
    handlers: list[logging.Handler] = [logging.StreamHandler()] * console + ([logging.FileHandler(path, encoding="utf-8")] if path else [])
    if not handlers:
        raise ValueError("neither a console nor a file to log to")
    for old in list(out.handlers):
        out.removeHandler(old)
        old.close()
    for h in handlers:
        h.setFormatter(logging.Formatter(os.environ.get(LINES, "%(asctime)s %(levelname)s %(name)s %(message)s")))
        out.addHandler(h)
    return out
