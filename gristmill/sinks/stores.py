"""Artefacts of runs, definitions by name, and an inbox that is merged."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.strings import cell


def write_run(folder: str, spec: dict, tables: dict[str, DataFrame]) -> None:
    """A run's artefacts under a folder that all machines see: its definition as one row of JSON and each table as files of its own, written by the executors."""
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(spec, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/spec.json")
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}") if name.endswith(".csv") else writer.json(f"{folder}/{name}")


class Definitions:
    """Small definitions by name, a JSON file each; a file is whole or absent."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def _file(self, name: str) -> Path:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", name):
            raise ValueError(f"not a name for a definition: {name!r}")
        return self.folder / f"{name}.json"

    def save(self, name: str, value: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        handle, part = tempfile.mkstemp(dir=self.folder, suffix=".part")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=1, sort_keys=True, allow_nan=False)
        os.replace(part, self._file(name))

    def load(self, name: str) -> dict:
        return json.loads(self._file(name).read_text(encoding="utf-8"))

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def delete(self, name: str) -> None:
        self._file(name).unlink(missing_ok=True)


def merged(inbox: DataFrame, arrivals: DataFrame, tombstones: DataFrame, key: str = "id", at: str = "seen") -> DataFrame:
    """An inbox after arrivals: of each key the newest row, an old one's status kept, and keys with a tombstone left out. One shuffle by key."""
    both = inbox.withColumn("__new", F.lit(0)).unionByName(arrivals.withColumn("__new", F.lit(1)).withColumn("status", F.lit("new")))
    w = Window.partitionBy(key)
    rows = both.withColumn("__status", F.min_by("status", "__new").over(w)).withColumn("__place", F.row_number().over(w.orderBy(F.col(at).desc(), F.col("__new").desc())))
    kept = rows.where("__place = 1").withColumn("status", F.col("__status")).drop("__new", "__place", "__status")
    return kept.join(tombstones.select(key).distinct(), key, "left_anti")


def pruned(inbox: DataFrame, before: str, statuses: tuple[str, ...] = ("rejected",), key: str = "id", at: str = "seen") -> tuple[DataFrame, DataFrame]:
    """The inbox without old rows of some statuses, and their tombstones, so that they aren't taken in again."""
    old = F.coalesce((F.col(at) < F.lit(before).cast("timestamp")) & F.col("status").isin(*statuses), F.lit(False))
    return inbox.where(~old), inbox.where(old).select(key, at, "status")


def table_lines(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``no, line``: a Markdown table of rows; a report holds few."""
    body = rows.select(F.row_number().over(Window.orderBy(order)).alias("no"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in columns)), F.lit(" |")).alias("line"))
    top = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + " --- |" * len(columns))], "no int, line string")
    return top.unionByName(body)


def thinned(series: DataFrame, order: str, value: str, most: int = 400) -> DataFrame:
    """At most ``most`` points of a series for a chart: its ends, and the least and greatest value of equal stretches between them, so that no spike is lost."""
    w = Window.orderBy(order)  # one series
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = series.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    stretches = max(1, (most - 2) // 2)
    part = F.floor((F.col("__i") - 1) * stretches / (F.col("__n") - 2))
    rows = rows.withColumn("__part", F.when((F.col("__i") > 0) & (F.col("__i") < F.col("__n") - 1), part))
    by = Window.partitionBy("__part")
    low = F.min(F.struct(value, "__i")).over(by).getField("__i")
    high = -F.max(F.struct(F.col(value), (-F.col("__i")).alias("i"))).over(by).getField("i")
    rows = rows.withColumn("__low", low).withColumn("__high", high)
    return rows.where("__n <= " + str(most) + " or __part is null or __i = __low or __i = __high").drop("__i", "__n", "__part", "__low", "__high")

