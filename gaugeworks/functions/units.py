"""Bring measured values to one base unit and say why when that is impossible."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.clean import as_column

# Molar concentration units and their factor to nanomolar.
# The micro sign is U+00B5; the Greek letter mu (U+03BC) is a different unit text.
NANOMOLAR_FACTORS = {
    "M": 1e9,
    "mM": 1e6,
    "uM": 1e3,
    "µM": 1e3,
    "nM": 1.0,
    "pM": 1e-3,
    "fM": 1e-6,
}

# Opt-in alias for sources that write the Greek letter.
GREEK_MU_FACTORS = {"μM": 1e3}

# The notes left on a row that has no base-unit value.
NOTE_NO_VALUE = "missing_standard_value"
NOTE_NO_UNIT = "missing_standard_units"
NOTE_UNCONVERTIBLE = "unconvertible_units:"


@dataclass(frozen=True)
class UnitScale:
    """A base unit and the factors that lead to it."""

    base: str = "nM"
    factors: Mapping[str, float] = field(default_factory=lambda: dict(NANOMOLAR_FACTORS))
    trim: bool = True

    def with_aliases(self, extra: Mapping[str, float]) -> UnitScale:
        return UnitScale(self.base, {**self.factors, **extra}, self.trim)

    def _unit(self, unit: Column | str) -> Column:
        unit = as_column(unit)
        return F.trim(unit) if self.trim else unit

    def _factor(self, unit: Column) -> Column:
        # A constant map stays inside code generation and needs no join.
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(self.factors.items())])
        return F.try_element_at(table, unit)

    def base_value(self, value: Column | str, unit: Column | str) -> Column:
        return as_column(value) * self._factor(self._unit(unit))

    def base_unit(self, value: Column | str, unit: Column | str) -> Column:
        value, unit = as_column(value), self._unit(unit)
        return (
            F.when(value.isNull(), unit)
            .when(unit == "", F.lit(None))
            .when(self._factor(unit).isNotNull(), F.lit(self.base))
            .otherwise(unit)
        )

    def note(self, value: Column | str, unit: Column | str) -> Column:
        value, unit = as_column(value), self._unit(unit)
        return (
            F.when(value.isNull(), F.lit(NOTE_NO_VALUE))
            .when(unit.isNull() | (unit == ""), F.lit(NOTE_NO_UNIT))
            .when(self._factor(unit).isNotNull(), F.lit(None))
            .otherwise(F.concat(F.lit(NOTE_UNCONVERTIBLE), unit))
        )


NANOMOLAR = UnitScale()
