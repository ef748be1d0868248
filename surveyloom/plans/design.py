"""What a survey's sample design is made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SurveyDesign:
    """Full-sample weight, balanced replicate weights with Fay's factor, and the key columns.

    ``order`` makes every row order total: ties of a ranked value are split by these columns.
    ``array`` may name a column that holds all weights, the full sample's first, in place of
    ``replicates``. ``school`` may be None where no school is known; school counts are then -1.
    Where ``make`` adds the array to rows that have the columns ``made_from``, operators that read rows
    several times write them once with these few columns in place of the weights.
    """

    weight: str = "w0"
    replicates: tuple[str, ...] = tuple(f"w{r}" for r in range(1, 81))
    fay: float = 0.5
    school: str | None = "sch"
    economy: str = "cnt"
    array: str | None = None
    reps: int = 80
    order: tuple[str, ...] = ("k1", "k2", "k3", "k4", "k5", "w0")
    made_from: tuple[str, ...] = ()
    make: Callable[[DataFrame], DataFrame] | None = None

    @property
    def scale(self) -> float:
        """Factor of the summed squared replicate deviations."""
        return 1.0 / (self.groups * self.fay**2)

    @property
    def groups(self) -> int:
        return self.reps if self.array else len(self.replicates)

    @property
    def weights(self) -> Column:
        """All weights as one array; position 0 is the full sample. A row without the array weighs nothing."""
        if self.array:
            return F.coalesce(F.col(self.array).cast("array<double>"), F.array_repeat(F.lit(0.0), self.reps + 1))
        return F.array(*[F.col(w).cast("double") for w in (self.weight, *self.replicates)])
