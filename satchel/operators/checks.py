"""Format rules over rows, and the notes that readers make: data, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written_counting


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold, in order; a rule that gives null doesn't hold."""
    names = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def checked(rows: DataFrame, rules: dict[str, Column], mode: str = "quarantine", name: str = "checked") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, bad rows with broken, how many rows break each rule). One pass: rows are written with the rules they break, and
    counted while they are. mode `fail`: the first bad row ends the job with the rules it breaks."""
    if mode not in ("quarantine", "fail"):
        raise ValueError(f"unknown mode {mode}")
    marked = rows.withColumn("broken", broken_rules(rules))
    if mode == "fail":
        bad = F.raise_error(F.concat(F.lit("broken rules: "), F.array_join("broken", ", ")))
        marked = marked.withColumn("broken", F.when(F.size("broken") > 0, bad.cast("array<string>")).otherwise(F.col("broken")))
    places = {f"n{i}": rule for i, rule in enumerate(rules)}
    out, seen = written_counting(marked, name, **{k: f"array_contains(broken, '{rule}')" for k, rule in places.items()})
    return out.where("size(broken) = 0").drop("broken"), out.where("size(broken) > 0"), {rule: seen[k] for k, rule in places.items()}


class Notes:
    """What readers found odd, as rows (file, item_id, code, detail): each step adds those of its own written table, so that nothing is
    read or computed a second time."""

    SCHEMA = "file string, item_id string, code string, detail string"

    def __init__(self):
        self._parts: list[DataFrame] = []

    def add(self, rows: DataFrame, code: Column | str, detail: Column | str | None = None, item: Column | None = None) -> None:
        """The rows of a written table for which code, a column or text, isn't null. rows: file."""
        code = F.lit(code) if isinstance(code, str) else code
        detail = F.lit(detail) if isinstance(detail, str) else F.lit(None).cast("string") if detail is None else detail
        item = F.lit(None) if item is None else item
        self._parts.append(rows.select(F.col("file"), item.cast("string").alias("item_id"), code.alias("code"), detail.cast("string").alias("detail")).where("code is not null"))

    def rows(self, spark) -> DataFrame:
        out = spark.createDataFrame([], self.SCHEMA)
        for part in self._parts:
            out = out.unionByName(part)
        return out
