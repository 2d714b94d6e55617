"""Dataset specs: loading and eager validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

SOURCES = ("hf", "jsonl", "json")
#: Names of the record formats, with their aliases.
FORMATS = {"alpaca": "alpaca", "chat": "chat", "pair": "pair", "io": "pair", "fields": "pair"}


@dataclass(frozen=True)
class DatasetSpec:
    """One source. ``limit`` of None or 0 means no cap; ``input_field`` is accepted as another name of ``context_field``."""

    name: str
    path: str
    source: str = "jsonl"
    format: str = "alpaca"
    split: str | None = None
    limit: int | None = None
    streaming: bool = False
    prompt_field: str = "inputs"
    response_field: str = "targets"
    context_field: str | None = None

    def __post_init__(self) -> None:
        if self.source not in SOURCES:
            raise ValueError(f"{self.name}: unknown source {self.source!r}")
        if self.format not in FORMATS:
            raise ValueError(f"{self.name}: unknown format {self.format!r}")
        if self.limit is not None and self.limit < 0:
            raise ValueError(f"{self.name}: negative limit")


def spec(entry: dict) -> DatasetSpec:
    entry = {k: v for k, v in entry.items() if v is not None}
    if "input_field" in entry:
        entry.setdefault("context_field", entry.pop("input_field"))
    unknown = set(entry) - {f.name for f in fields(DatasetSpec)}
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    return DatasetSpec(**entry)


def load_catalog(path: str) -> list[DatasetSpec]:
    with open(path, encoding="utf-8") as f:
        return [spec(e) for e in json.load(f)]
