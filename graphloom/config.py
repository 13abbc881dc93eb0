"""Settings: an argument given wins over the environment, and that over the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from graphloom.operators.store import repo_name_of


def listed(text: str | None) -> tuple[str, ...]:
    """The parts between commas, trimmed, without empty ones."""
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


@dataclass
class Config:
    repo_path: str
    root: str
    repo_name: str = ""
    dependencies: tuple[str, ...] = field(default_factory=tuple)
    output: str = "table"
    embed_dim: int = 384
    batch: int = 64

    @classmethod
    def load(cls, env: dict[str, str] | None = None, **given) -> Config:
        e = os.environ if env is None else env
        pick = lambda key, name, default: given.get(key) if given.get(key) is not None else e.get(name, default)
        path = pick("repo_path", "GRAPHLOOM_REPO_PATH", ".")
        deps = given.get("dependencies")
        out = cls(
            repo_path=path, root=pick("root", "GRAPHLOOM_ROOT", os.path.join(path, ".graphloom")), repo_name=pick("repo_name", "GRAPHLOOM_REPO_NAME", None) or repo_name_of(os.path.abspath(path)),
            dependencies=tuple(deps) if deps is not None else listed(e.get("GRAPHLOOM_DEPENDENCIES")), output=pick("output", "GRAPHLOOM_OUTPUT", "table"),
            embed_dim=int(pick("embed_dim", "GRAPHLOOM_EMBED_DIM", 384)), batch=int(pick("batch", "GRAPHLOOM_BATCH", 64)),
        )
        if out.output not in ("table", "markdown", "json"):
            raise ValueError(f"no such output: {out.output}")
        return out
