"""Analyses by name, what they cost, and runs of several with notice of their progress."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from assaykit.operators import explore, quality, relations, rows, values

#: Name: (function of table and options, cells read of a row (0: all), bytes of state of a distinct value).
ANALYSES: dict[str, tuple[Callable[..., DataFrame], int, int]] = {
    "profile": (lambda d: values.profile(d), 0, 120),
    "frequencies": (lambda d, column, top=None: values.frequencies(d, column, top), 1, 120),
    "lengths": (lambda d, column: values.lengths(d, column), 1, 16),
    "quantiles": (lambda d, column: relations.quantiles(d, column), 1, 24),
    "shape": (lambda d, column: relations.shape(d, column), 1, 24),
    "pearson": (lambda d, columns: relations.pearson(d, columns), 2, 0),
    "crosstab": (lambda d, a, b: relations.crosstab(d, a, b), 2, 150),
    "duplicates": (lambda d, columns=None: rows.duplicate_stats(d, columns), 0, 150),
    "findings": (lambda d: quality.findings(d), 0, 120),
    "number_pairs": (lambda d: explore.number_pairs(d), 0, 0),
}
#: Nanoseconds for a cell and core, and the seconds beyond which a run has to be confirmed.
CELL_NS, CONFIRM_SECONDS = 400.0, 120.0


def register(name: str, make: Callable[..., DataFrame], cells: int = 0, state_bytes: int = 0) -> None:
    """Add an analysis of one's own."""
    if name in ANALYSES:
        raise ValueError(f"there is an analysis {name}")
    ANALYSES[name] = (make, cells, state_bytes)


@dataclass(frozen=True)
class Cost:
    cells: int
    state_bytes: int
    seconds: float

    @property
    def to_confirm(self) -> bool:
        return self.seconds > CONFIRM_SECONDS


def cost(name: str, records: int, columns: int, distinct: int, cores: int = 8) -> Cost:
    """What an analysis of a table of this size reads and holds, and about how long it takes."""
    _, width, state = ANALYSES[name]
    cells = records * (width or columns)
    return Cost(cells, distinct * state, cells * CELL_NS / 1e9 / cores)


def run(df: DataFrame, requests: list[tuple[str, dict]], on_progress: Callable[[str, int, int], None] | None = None, confirm: Callable[[str, Cost], bool] | None = None, sizes: tuple[int, int] | None = None) -> dict[int, DataFrame]:
    """The results by place in the list of requests (name, options).

    ``on_progress`` gets the name, the place and how many there are, as each plan is ready; ``confirm`` is asked before an
    analysis whose cost on a table of ``sizes`` (records, distinct values) is too long, which it may refuse.
    """
    out: dict[int, DataFrame] = {}
    for i, (name, options) in enumerate(requests):
        if sizes and confirm:
            price = cost(name, sizes[0], len(df.columns), sizes[1])
            if price.to_confirm and not confirm(name, price):
                continue
        out[i] = ANALYSES[name][0](df, **options)
        if on_progress:
            on_progress(name, i + 1, len(requests))
    return out


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The table with a count of the rows that pass, told by the observation once a job over it has ended."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("records")), seen


def for_each_record(df: DataFrame, on_records: Callable[[list], None], batch: int = 1000) -> None:
    """Call ``on_records`` with lists of up to ``batch`` rows, in the executors, partition by partition."""

    def part(rows_of) -> None:
        held: list = []
        for r in rows_of:
            held.append(r)
            if len(held) == batch:
                on_records(held)
                held = []
        if held:
            on_records(held)

    df.foreachPartition(part)
