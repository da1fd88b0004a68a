"""What relations must look like where operators meet: columns and their types, and folds that don't overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a type of None is any that can be compared
CONTRACTS: dict[str, dict[str, str | None]] = {
    "design": {"unit": None, "item": None, "y_true": "double"},
    "panel": {"unit": None, "item": None, "y_true": "double", "y_pred": "double"},
    "parts": {"unit": None, "item": None, "y_true": "double", "y_pred": "double", "y_resid": "double"},
    "folds": {"unit": None, "fold": None},
    "spaces": {"f": None, "unit": None, "x": "array<double>"},
    "deltas": {"line": None, "drug": None, "feature": None, "value": "double"},
    "scores": {"sample": None, "score": "double"},
    "embedding": {"unit": None, "vector": "array<double>"},
    "corpus": {"unit": None},
}


def require(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself, if it has the columns of the contract ``name`` in their types; further columns don't matter."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [f"{c} is {kinds.get(c, 'missing')}" for c, kind in CONTRACTS[name].items() if c not in kinds or kind not in (None, kinds[c])]
    if wrong:
        raise ValueError(f"not {name}: {', '.join(wrong)}")
    return df


def require_disjoint(folds: DataFrame) -> DataFrame:
    """``folds`` (unit, fold) itself, if no unit is in two folds."""
    two = require(folds, "folds").groupBy("unit").agg(F.countDistinct("fold").alias("n")).where("n > 1").limit(1).collect()
    if two:
        raise ValueError(f"unit {two[0]['unit']!r} is in {two[0]['n']} folds")
    return folds


class Registry(dict[str, Callable[..., DataFrame]]):
    """Operators by name, whose results are held to one contract."""

    def __init__(self, contract: str):
        super().__init__()
        self.contract = contract

    def register(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self[name] = f
            return f

        return add

    def run(self, name: str, *args: object, **options: object) -> DataFrame:
        if name not in self:
            raise KeyError(f"nothing is called {name!r}; there are {sorted(self)}")
        return require(self[name](*args, **options), self.contract)
