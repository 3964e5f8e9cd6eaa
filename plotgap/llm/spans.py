"""Places of pattern matches as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotgap.llm.base import let


def matches(text: Column, pattern: str) -> Column:
    """Array of (value, start), leftmost first and not overlapping; start in code points. Matches must not be empty."""
    def placed(parts: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        none = F.array().cast("array<struct<value:string,start:int>>")

        def step(a: Column, i: Column) -> Column:
            value, at = F.get(a["m"], i), a["at"] + F.length(F.get(parts, i))
            return F.struct((at + F.length(value)).alias("at"), a["m"].alias("m"),
                            F.concat(a["out"], F.array(F.struct(value.alias("value"), at.alias("start")))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), found.alias("m"), none.alias("out"))
        walked = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 2), start, step)["out"]
        return F.when(F.size(parts) < 2, none).otherwise(walked)

    return let(F.split(text, pattern, -1), placed)


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted ``spans`` (start, end, value) replaced by its value; overlaps only extend the cut."""
    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                         F.when(s["start"] >= a["at"], s["value"]).otherwise(F.lit("")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rebuilt)
