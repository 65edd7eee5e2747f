"""Configuration of a run: defaults, a YAML file over them, checks. Driver side."""

from __future__ import annotations

import copy
import logging
import os
import sys
from typing import Any

from ..functions.tables import PRUNED

# Defaults, and what is allowed.
DEFAULTS: dict[str, Any] = {
    "project": {"exclude_dirs": PRUNED},
    "output": {"base_dir": "output"},
    "llm": {"base_url": "http://localhost:11434", "model": "", "temperature": 0.2, "timeout": 120, "embed_model": ""},
    "cache": {"enabled": True, "file": ".cache/docs"},
    "rate_limiting": {"enabled": True, "calls_per_minute": 20},
    "parallel": {"enabled": True, "max_workers": 4},
    "logging": {"level": "INFO", "file": "run.log"},
    "security": {"forbidden_paths": ["/etc", "/sys", "/proc"]},
    "readme": {},
}
RULES: dict[str, tuple[type | tuple, Any]] = {
    "logging.level": (str, ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")),
    "llm.temperature": ((int, float), (0, 2)),
    "llm.timeout": ((int, float), (10, 600)),
    "rate_limiting.calls_per_minute": ((int, float), (1, 120)),
    "parallel.max_workers": (int, (1, 32)),
    "cache.file": (str, "filled"),
    "cache.enabled": (bool, None),
    "parallel.enabled": (bool, None),
    "rate_limiting.enabled": (bool, None),
}
# Environment variable suffix to setting.
ENVIRONMENT = {"BASE_URL": "llm.base_url", "MODEL": "llm.model", "TEMPERATURE": "llm.temperature", "TIMEOUT": "llm.timeout", "EMBED_MODEL": "llm.embed_model"}
# Words in a model's name and the least timeout, in seconds.
SLOW_MODELS = [(("20b", "22b", "30b"), 480), (("13b", "14b"), 300)]


def merge(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, dictionary by dictionary; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Config:
    def __init__(self, path: str | None = None, over: dict | None = None):
        read: dict = {}
        if path and os.path.exists(path):
            import yaml

            with open(path, encoding="utf-8") as f:
                read = yaml.safe_load(f) or {}
            if not isinstance(read, dict):
                raise ValueError(f"{path}: not a mapping")
        self.values = merge(merge(DEFAULTS, read), over or {})
        self.unknown = sorted(set(self.values) - set(DEFAULTS))
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))

    def get(self, path: str, default: Any = None) -> Any:
        """A value by its dotted path."""
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def problems(self) -> list[str]:
        """What the rules forbid."""
        out = []
        for path, (kind, allowed) in RULES.items():
            v = self.get(path)
            if not isinstance(v, kind) or isinstance(v, bool) and kind is not bool:
                out.append(f"{path}: {v!r} has the wrong type")
            elif allowed == "filled":
                if not v.strip():
                    out.append(f"{path} is empty")
            elif kind is str and allowed and v.upper() not in allowed:
                out.append(f"{path}: {v!r} is none of {', '.join(allowed)}")
            elif kind is not str and allowed and not allowed[0] <= v <= allowed[1]:
                out.append(f"{path}: {v!r} is not within {allowed[0]} and {allowed[1]}")
        return out

    def with_environment(self, prefix: str = "CODELAKE_", env: dict[str, str] | None = None) -> "Config":
        """Settings from environment variables, and a timeout that suits the model's size."""
        env = dict(os.environ) if env is None else env
        over: dict = {}
        for name, path in ENVIRONMENT.items():
            if prefix + name in env:
                section, key = path.split(".")
                value = env[prefix + name]
                over.setdefault(section, {})[key] = float(value) if key in ("temperature", "timeout") else value
        out = Config(over=merge(self.values, over))
        out.values["llm"]["timeout"] = max(out.get("llm.timeout"), least_timeout(out.get("llm.model")))
        return out


def least_timeout(model: str) -> float:
    """Seconds that a model of this size needs at least; 0 for small ones."""
    return next((s for words, s in SLOW_MODELS if any(w in model.lower() for w in words)), 0)


def setup_logging(config: Config) -> logging.Logger:
    """A logger that writes to standard output and to the configured file."""
    log = logging.getLogger("codelake")
    log.setLevel(config.get("logging.level").upper())
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if config.get("logging.file"):
        handlers.append(logging.FileHandler(config.get("logging.file"), encoding="utf-8", delay=True))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log
