"""Reports: a histogram as metrics text, and a table as a Markdown board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.tables import numbered

LIMITS = [1 << i for i in range(18)]  # microseconds, each twice the one before


def exposition(samples: DataFrame, value: Column, name: str) -> DataFrame:
    """``(place, line)``: running counts up to each limit, all, their number and their sum; nulls are not observed.  One pass, one row a line."""
    counted = samples.select(value.cast("long").alias("v")).filter("v is not null").agg(F.array(*(F.count_if(F.col("v") <= n) for n in LIMITS)).alias("upto"), F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("total"))
    line = lambda *parts: F.concat(F.lit(name), *parts)
    bucket = lambda le, n: line(F.lit(f'_bucket{{le="{le}"}} '), n.cast("string"))
    lines = [*(bucket(x, F.get("upto", F.lit(i))) for i, x in enumerate(LIMITS)), bucket("+Inf", F.col("n")), line(F.lit("_count "), F.col("n").cast("string")), line(F.lit("_sum "), F.col("total").cast("string"))]
    return counted.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def board(results: DataFrame, *order) -> DataFrame:
    """``(place, line)`` of a Markdown table: its head, then the rows in the given order, which must be total; bars in a text are escaped, nulls are empty."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\|", r"\\|"), F.lit("")) for c in results.columns]
    body = numbered(results, "_at", *order).select((F.col("_at") + 1).cast("long").alias("place"), row(cells).alias("line"))
    names = ("| " + " | ".join(results.columns) + " |", "|" + "-|" * len(results.columns))
    return results.sparkSession.createDataFrame(list(enumerate(names)), "place long, line string").unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of a report as one text file, in order; what was there is replaced."""
    lines.repartitionByRange(1, "place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)
