"""Configuration as plain dataclasses, read from a nested mapping or, where a YAML reader is installed, a file."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


def host_port(text: str) -> tuple[str, int]:
    """'host:port'; the port is needed."""
    host, colon, port = text.rpartition(":")
    if not colon or not port.isdigit():
        raise ValueError(f"expected host:port, got {text!r}")
    return host, int(port)


@dataclass
class Backend:
    id: str
    monitor_all: bool = False
    excluded_chats: list[int] = field(default_factory=list)


@dataclass
class Frontend:
    id: str
    backend: str
    admin: int
    page_len: int = 10
    private_mode: bool = False
    private_whitelist: list[int] = field(default_factory=list)
    redis: str = "localhost:6379"
    no_redis: bool = False
    #: Zone in which times are shown.
    zone: str = "UTC"

    def __post_init__(self) -> None:
        self.private_whitelist = sorted({*self.private_whitelist, self.admin})
        if not self.no_redis:
            host_port(self.redis)


@dataclass
class Config:
    root: str
    backends: list[Backend]
    frontends: list[Frontend]


def build(raw: dict) -> Config:
    """Config of a mapping with root, backends and frontends; ids must differ and each frontend name a backend."""
    backends = [Backend(**b) for b in raw.get("backends", [])]
    frontends = [Frontend(**f) for f in raw.get("frontends", [])]
    for kind, rows in (("backend", backends), ("frontend", frontends)):
        if len({r.id for r in rows}) < len(rows):
            raise ValueError(f"two {kind}s have one id")
    known = {b.id for b in backends}
    for f in frontends:
        if f.backend not in known:
            raise ValueError(f"frontend {f.id} names no backend: {f.backend}")
    return Config(raw["root"], backends, frontends)


def load(path: str) -> Config:
    try:
        import yaml
    except ImportError:
        import json

        return build(json.loads(Path(path).read_text()))
    return build(yaml.safe_load(Path(path).read_text()))
