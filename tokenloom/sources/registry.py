"""Named tokenizers and settings, kept on the driver as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

from tokenloom.functions.models import model_type
from tokenloom.functions.tokenizer import Spec, Tokenizer
from tokenloom.plans.tree import FOLDERS, MAX_BYTES


@dataclass(frozen=True)
class Settings:
    folders: tuple[str, ...] = FOLDERS
    max_bytes: int = MAX_BYTES
    check_binary: bool = True
    encoding: str = "utf-8"
    active: str | None = None
    tokenizers: dict[str, str] = field(default_factory=dict)  # name to path

    @staticmethod
    def load(path: str) -> Settings:
        """What is stored at path; what isn't, or can't be read, has its default."""
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return Settings()
        known = {k: found[k] for k in asdict(Settings()) if k in found}
        return Settings(**known | ({"folders": tuple(known["folders"])} if "folders" in known else {}))

    def save(self, path: str) -> None:
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, ensure_ascii=False, indent=2)
        os.replace(path + ".new", path)

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


class Registry:
    """Configurations by name, of which one is active. Bundled ones can't be removed."""

    def __init__(self, bundled: dict[str, str] | None = None):
        self.configs, self.bundled = dict(bundled or {}), frozenset(bundled or {})
        self.active: str | None = next(iter(self.configs), None)

    def register(self, name: str, config: str) -> None:
        if name in self.bundled:
            raise ValueError(f"{name!r} is bundled")
        Tokenizer(config)  # a configuration that can't be compiled isn't taken
        self.configs[name] = config
        self.active = self.active or name

    def remove(self, name: str) -> None:
        if name in self.bundled:
            raise ValueError(f"{name!r} is bundled")
        self.configs.pop(name, None)
        if self.active == name:
            self.active = next(iter(self.configs), None)

    def set_active(self, name: str) -> None:
        if name not in self.configs:
            raise KeyError(name)
        self.active = name

    def config(self, name: str | None = None) -> str:
        return self.configs[name or self.active]

    def describe(self, name: str) -> str:
        return f"{model_type(Spec.parse(self.configs[name]).model)} · {len(Tokenizer(self.configs[name]).vocab()):,} vocab"


def format_bytes(n: int) -> str:
    """Bytes below 1024 whole, above with one decimal and a unit."""
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"


def speed(tokens: int, size: int, seconds: float) -> str:
    """Tokens and bytes a second; nothing for a scan without duration."""
    if seconds <= 0:
        return ""
    rate = tokens / seconds
    short = f"{rate / 1e6:.1f}M" if rate >= 1e6 else f"{rate / 1e3:.1f}K" if rate >= 1e3 else f"{rate:.0f}"
    return f"{short} tokens/s · {format_bytes(int(size / seconds))}/s"
