"""Temporal splits with strict cold and warm pools, and their invariants."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import nearest_index, values_at


@dataclass
class Split:
    """History before a cut-off and a window from it on, to an optional end."""

    name: str
    inter: DataFrame
    start: int
    end: int | None = None

    @cached_property
    def train(self) -> DataFrame:
        return self.inter.where(F.col("ts_ms") < self.start)

    @cached_property
    def window(self) -> DataFrame:
        rows = self.inter.where(F.col("ts_ms") >= self.start)
        return rows if self.end is None else rows.where(F.col("ts_ms") < self.end)

    @cached_property
    def train_items(self) -> DataFrame:
        return self.train.select("item").distinct()

    @cached_property
    def train_users(self) -> DataFrame:
        return self.train.select("uid").distinct()

    @cached_property
    def cold_items(self) -> DataFrame:
        return self.window.select("item").distinct().join(self.train_items, "item", "left_anti")

    @cached_property
    def cold_rows(self) -> DataFrame:
        return self.window.join(self.train_items, "item", "left_anti").join(self.train_users, "uid", "left_semi")

    @cached_property
    def warm_rows(self) -> DataFrame:
        return self.window.join(self.train_items, "item", "left_semi").join(self.train_users, "uid", "left_semi")

    @cached_property
    def positives(self) -> DataFrame:
        return self.cold_rows.select("uid", "item").distinct()


def cutoffs(inter: DataFrame, dev: float, final: float) -> tuple[int, int]:
    n = inter.count()
    return tuple(values_at(inter, "ts_ms", [nearest_index(n, p) for p in (dev, final)], n))


def violations(dev: Split, final: Split, titles: DataFrame) -> DataFrame:
    """(check, violations): every count must be 0."""

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    out = []
    for s in (dev, final):
        late = F.lit(False) if s.end is None else F.col("ts_ms") >= s.end
        out += [
            one(f"{s.name}_cold_in_train", s.cold_items.join(s.train_items, "item", "left_semi")),
            one(f"{s.name}_cold_without_title", s.cold_items.join(titles, "item", "left_anti")),
            one(f"{s.name}_train_late", s.train.where(F.col("ts_ms") >= s.start)),
            one(f"{s.name}_cold_rows_outside_window", s.cold_rows.where((F.col("ts_ms") < s.start) | late)),
            one(f"{s.name}_cold_rows_without_history", s.cold_rows.join(s.train_users, "uid", "left_anti")),
            one(f"{s.name}_cold_rows_outside_pool", s.cold_rows.join(s.cold_items, "item", "left_anti")),
        ]
    out.append(one("dev_train_not_in_final_train", dev.train.select("uid", "item", "ts_ms").exceptAll(final.train.select("uid", "item", "ts_ms"))))
    total = out[0]
    for df in out[1:]:
        total = total.unionAll(df)
    return total


def assert_clean(found: DataFrame) -> None:
    bad = found.where("violations > 0").collect()
    if bad:
        raise ValueError(f"violated: {bad}")
