"""Settings: global ones, and those a project may override."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from urllib.parse import urlsplit

PROJECT_FILE = ".quarry.toml"


@dataclass
class Model:
    host: str = "http://localhost"
    port: int = 11434
    embedding_model: str = "nomic-embed-text"
    chat_model: str = "qwen2.5:1.5b"
    parallelism: int = 1
    allow_remote: bool = False


@dataclass
class Search:
    top_k: int = 5
    similarity_threshold: float = 0.5
    rerank: bool = False


@dataclass
class Config:
    model: Model = field(default_factory=Model)
    search: Search = field(default_factory=Search)


#: What a project's file may set: never where code is sent.
OVERRIDABLE = {"model": ("embedding_model", "chat_model"), "search": ("top_k", "similarity_threshold", "rerank")}


def home() -> Path:
    base = os.environ.get("HOME") or os.environ.get("USERPROFILE")
    if not base:
        raise RuntimeError("could not determine the home directory")
    return Path(base, ".quarry")


def validate(section: str, key: str, value: object) -> object:
    """The value in its field's type; raises ValueError for unknown keys and bad values."""
    part = {"model": Model, "search": Search}.get(section)
    known = {f.name: f for f in fields(part)} if part else {}
    if key not in known:
        raise ValueError(f"unknown setting {section}.{key}")
    kind = type(getattr(part(), key))
    if kind is bool:
        if str(value).lower() not in ("true", "false"):
            raise ValueError(f"{section}.{key} must be true or false")
        return str(value).lower() == "true"
    try:
        typed = kind(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{section}.{key} must be a {kind.__name__}") from e
    checks = {
        "port": lambda v: 0 < v < 65536, "parallelism": lambda v: v >= 1, "top_k": lambda v: v >= 1, "similarity_threshold": lambda v: 0 <= v <= 1,
        "host": lambda v: urlsplit(v).scheme in ("http", "https") and bool(urlsplit(v).hostname), "embedding_model": bool, "chat_model": bool,
    }
    if key in checks and not checks[key](typed):
        raise ValueError(f"{value!r} is no valid {section}.{key}")
    return typed


def _apply(config: Config, table: dict, allowed: dict | None = None) -> Config:
    for section, values in table.items():
        for key, value in values.items() if isinstance(values, dict) else ():
            if allowed is None or key in allowed.get(section, ()):
                setattr(getattr(config, section), key, validate(section, key, value))
    return config


def find_project_file(directory: str | Path) -> Path | None:
    """The project's settings: the nearest file in the directory or one above it."""
    here = Path(directory).resolve()
    return next((d / PROJECT_FILE for d in (here, *here.parents) if (d / PROJECT_FILE).is_file()), None)


def load(directory: str | Path | None = None, global_file: Path | None = None) -> Config:
    config = Config()
    path = global_file or home() / "config.toml"
    if path.is_file():
        _apply(config, tomllib.loads(path.read_text()))
    project = find_project_file(directory) if directory else None
    if project:
        _apply(config, tomllib.loads(project.read_text()), OVERRIDABLE)
    return config


def save(config: Config, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    quote = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
    text = "\n".join(f"[{s}]\n" + "".join(f"{f.name} = {quote(getattr(getattr(config, s), f.name))}\n" for f in fields(getattr(config, s))) for s in ("model", "search"))
    path.write_text(text)
    os.chmod(path, 0o600)


def may_send(config: Config) -> tuple[bool, str]:
    """Whether code may go to the configured server, and why not (or a warning)."""
    url = urlsplit(config.model.host)
    local = url.hostname in ("localhost", "127.0.0.1", "::1")
    if not local and not config.model.allow_remote:
        return False, f"{url.hostname} is not this machine and allow_remote is off"
    return True, "" if local or url.scheme == "https" else f"code goes to {url.hostname} unencrypted"
