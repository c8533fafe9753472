"""Settings that stay on the driver: dotenv values and data.yaml."""

from __future__ import annotations

import re
from pathlib import Path


def dotenv_value(path: str, name: str) -> str | None:
    """The first `[export ]NAME = value` line's value, without quotes; None where there is none."""
    file = Path(path)
    if not file.is_file():
        return None
    rule = re.compile(rf"\s*(?:export\s+)?{re.escape(name)}\s*=\s*(.*)")
    for line in file.read_text(encoding="utf-8").splitlines():
        if found := rule.match(line):
            return found[1].strip().strip("'\"")
    return None


def look_up(*values: str | None) -> str | None:
    """The first value that is set and not empty."""
    return next((v for v in values if v), None)


class UnsafeData(ValueError):
    """A data.yaml that must not be used."""


def check_data_yaml(path: str) -> dict:
    """The mapping of a data.yaml; one that names a download is refused, since a trainer would run it."""
    file = Path(path)
    if file.is_dir():
        raise UnsafeData(f"{path} is a directory, not a data.yaml")
    try:
        import yaml
    except ImportError as e:
        raise UnsafeData("reading data.yaml needs PyYAML") from e
    try:
        data = yaml.safe_load(file.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise UnsafeData(f"{path} cannot be read: {type(e).__name__}") from None
    if not isinstance(data, dict):
        raise UnsafeData(f"{path} holds no mapping")
    if "download" in data:
        raise UnsafeData(f"{path} has a download key; remove it if you trust the data")
    return data
