"""Settings of a run: defaults, then a file, then the environment, then the command line; later ones win."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "CORVANE_"


class ConfigError(ValueError):
    """A setting that can't be read."""


@dataclass(frozen=True)
class Config:
    """Values of a benchmark's protocol."""

    workload: str = "code-retrieval-v1"
    models: tuple[str, ...] = ()
    temperature: float = 0.3
    max_tokens: int = 256
    timeout_seconds: float = 30.0
    retry_max_attempts: int = 3
    seed: int = 42
    warmup_cases: int = 5
    repetitions: int = 1
    output_dir: str = "./results"
    base_url: str = "http://localhost:11434"
    level: str = "INFO"


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        if text.startswith("[") and text.endswith("]"):
            return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
        return text


def _bare(line: str) -> str:
    """A line without its comment; a # within quotes or a word is none."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def parse(lines: Iterable[str]) -> dict[str, object]:
    """Keys with scalars and lists, on one level or in sections, whose names fall away. This is the part of YAML that settings need."""
    out: dict[str, object] = {}
    last = ""
    for number, line in enumerate(lines, 1):
        text = _bare(line)
        item = text.strip()
        if item.startswith("- "):
            held = out.setdefault(last, []) if last else None
            if not isinstance(held, list):
                raise ConfigError(f"line {number}: a list item without a key")
            held.append(_scalar(item[2:]))
        elif ":" in item:
            key, _, value = item.partition(":")
            last = key.strip()
            if value.strip():
                out[last] = _scalar(value)
        elif item:
            raise ConfigError(f"line {number}: neither a key nor a list item")
    return out


def _fit(name: str, kind: str, value: object) -> object:
    try:
        if kind.startswith("tuple"):
            return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(map(str, value))  # type: ignore[arg-type]
        return {"int": int, "float": float, "str": str}[kind](value)  # type: ignore[operator]
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{name}: {value!r} is no {kind}") from e


def load(path: str | None = None, env: Mapping[str, str] | None = None, flags: Mapping[str, object] | None = None) -> Config:
    """Settings from a file (if there is a path), variables that begin with PREFIX, and flags that aren't None. Unknown keys of a file are ignored."""
    env = os.environ if env is None else env
    config = Config()
    from_file = parse(Path(path).read_text(encoding="utf-8").splitlines()) if path else {}
    for f in fields(Config):
        for source in (from_file.get(f.name), env.get(PREFIX + f.name.upper()), (flags or {}).get(f.name)):
            if source is not None:
                config = replace(config, **{f.name: _fit(f.name, str(f.type), source)})
    return config
