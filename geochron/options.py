"""Engine options: operators that take ``options`` use what their own arguments leave open from here."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    #: Name of the index that mutations and reads mean when they name none.
    default_index: str = "default"
    #: Side of a grid cell, in coordinate units; None: as the data say (joins), 1 (stored tables).
    cell_size: float | None = None
    #: Seconds of a bucket of a space-time index.
    bucket_size: float = 86400.0
    #: Of ordered neighbours: planar degrees, or great-circle kilometres between points.
    distance_function: str = "pythagorean"
    #: Rows of one file of a stored index.
    target_rows_per_file: int = 1_000_000

    def set(self, **values: object) -> Options:
        if unknown := sorted(set(values) - {f.name for f in fields(self)}):
            raise ValueError(f"unknown options: {unknown}")
        if (d := values.get("distance_function", self.distance_function)) not in ("pythagorean", "haversine"):
            raise ValueError(f"distance_function {d!r}")
        if bad := sorted(k for k in ("cell_size", "bucket_size", "target_rows_per_file") if values.get(k) is not None and not values[k] > 0):
            raise ValueError(f"not positive: {bad}")
        return replace(self, **values)
