"""Settings of experiments: JSON or YAML files that may extend others."""

from __future__ import annotations

import json
from pathlib import Path


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path} needs a YAML reader, which is not installed; use JSON") from e
    return yaml.safe_load(text) or {}


def _merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for key, value in over.items():
        out[key] = _merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | Path, _open: tuple[Path, ...] = ()) -> dict:
    """The settings of a file over those that it extends, one or several, by paths relative to it; a circle is an error."""
    here = Path(path).resolve()
    if here in _open:
        raise ValueError(f"{here} extends itself")
    own = _read(here)
    bases = own.pop("extends", [])
    out: dict = {}
    for base in [bases] if isinstance(bases, str) else bases:
        out = _merged(out, load(here.parent / base, (*_open, here)))
    return _merged(out, own)
