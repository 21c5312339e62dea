"""Settings: defaults, overridden by ``.env`` files and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Sizes and limits of the pipeline; each may be set as ``LODESTACK_<NAME>``."""

    wiki_base: str = "https://wiki.quillmere.example"
    wiki_token: str = "anonymous"
    wiki_space: str = "OPS"
    parent_size: int = 1400
    parent_overlap: int = 200
    child_size: int = 400
    child_overlap: int = 80
    dense_dim: int = 384
    max_links: int = 10
    max_pages: int = 2000
    list_size: int = 200
    tries: int = 4
    backoff_s: float = 1.5
    timeout_s: float = 40.0
    search_limit: int = 20
    top_k: int = 5
    mmr_lambda: float = 0.7
    rrf_k: int = 2
    rrf_base: int = 0
    recent_limit: int = 20


def read_env_file(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines of a file; comments, blank lines and a missing file give nothing."""
    out: dict[str, str] = {}
    p = Path(path)
    if p.is_file():
        for line in p.read_text().splitlines():
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and key and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("\"'")
    return out


def load_settings(folder: str | Path = ".") -> Settings:
    """``.env``, then ``.env.local``, then the environment, the later winning."""
    env = read_env_file(Path(folder) / ".env") | read_env_file(Path(folder) / ".env.local") | dict(os.environ)
    base = Settings()
    got = {f.name: type(getattr(base, f.name))(env[k]) for f in fields(Settings) if (k := f"LODESTACK_{f.name.upper()}") in env}
    got |= {"wiki_base": (got.get("wiki_base") or base.wiki_base).rstrip("/")}
    return replace(base, **got)


@lru_cache(maxsize=1)
def settings() -> Settings:
    return load_settings()
