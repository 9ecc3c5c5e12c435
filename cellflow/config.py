"""Parameters of the analysis, in one frozen tree; a YAML file may override them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Names and limits that the operators take by default."""

    cell: str = "cell"
    order: str = "ord"
    gap: int = 8
    window: int = 7
    ledger: int = 21
    ledger_sizes: tuple[int, ...] = (1, 2, 3, 6, 12, 21)
    bands: tuple[tuple[int, int], ...] = ((1, 1), (2, 3), (4, 6), (7, 12), (13, 21))
    min_coverage: float = 0.80
    min_slots: int = 6
    validation_from: date = date(2024, 1, 15)
    test_from: date = date(2024, 1, 22)
    shrink_rows: float = 20.0
    shrink_share: float = 0.80

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """The defaults with the top-level entries of a YAML file; unknown entries are an error."""
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        as_tuple = lambda v: tuple(map(as_tuple, v)) if isinstance(v, list) else v
        return replace(cls(), **{k: as_tuple(v) for k, v in given.items()})


def resolve(path: str | Path, base: str | Path) -> Path:
    """path, taken from base if it is relative."""
    path = Path(path)
    return path if path.is_absolute() else (Path(base) / path).resolve()
