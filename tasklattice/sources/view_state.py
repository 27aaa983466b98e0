"""The saved state of a tree view: explicit folds, bookmarks and order."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Orders and directions are kept by number.
N_ORDERS = 8
DIRECTIONS = (0, 1)


@dataclass
class ViewState:
    """What a state file holds.  A missing or damaged file gives the defaults; unknown ids do nothing."""

    expanded: dict[str, bool] = field(default_factory=dict)
    bookmarks: list[str] = field(default_factory=list)
    sort_field: int | None = None
    sort_direction: int | None = None

    @classmethod
    def load(cls, path: str) -> ViewState:
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
            state = cls({str(k): bool(v) for k, v in (raw.get("expanded") or {}).items()}, [str(x) for x in raw.get("bookmarks") or ()])
            by, way = raw.get("sort_field"), raw.get("sort_direction")
        except (OSError, ValueError, AttributeError, TypeError):
            return cls()
        if by in range(N_ORDERS) and way in DIRECTIONS:
            state.sort_field, state.sort_direction = by, way
        return state

    def save(self, path: str) -> None:
        raw = {"version": 1, "expanded": self.expanded}
        raw |= {k: v for k, v in (("bookmarks", self.bookmarks), ("sort_field", self.sort_field), ("sort_direction", self.sort_direction)) if v not in (None, [])}
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(raw, f, indent=2)
        os.replace(f"{path}.tmp", path)

    def apply(self, rows: DataFrame, default: bool = False) -> DataFrame:
        """``rows`` (id, ...) with ``expanded`` and ``bookmarked``."""
        spark = rows.sparkSession
        known = spark.createDataFrame(sorted(self.expanded.items()), "id string, _expanded boolean")
        marks = spark.createDataFrame([(x,) for x in sorted(set(self.bookmarks))], "id string").withColumn("_marked", F.lit(True))
        out = rows.join(known, "id", "left").join(marks, "id", "left")
        return out.withColumns({"expanded": F.coalesce("_expanded", F.lit(default)), "bookmarked": F.coalesce("_marked", F.lit(False))}).drop("_expanded", "_marked")
