"""Report pages as rows of HTML: tables of any length and bars, escaped, made and written by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters with a meaning of their own, the ampersand first.
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}


def escaped(t: Column) -> Column:
    """Text as it has to stand in a page; null is empty."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ESCAPES.items(), F.coalesce(t.cast("string"), F.lit("")))


def bar(value: Column, most: Column, width: int = 200) -> Column:
    """A bar as wide as its share of the largest value, at most ``width`` pixels; nothing for null."""
    share = F.when(most > 0, F.round(value * width / most)).otherwise(0).cast("int")
    return F.concat(F.lit('<div class="bar" style="width:'), F.coalesce(share, F.lit(0)).cast("string"), F.lit('px"></div>'))


def section(name: str, df: DataFrame, order: list[Column], bars: str | None = None) -> DataFrame:
    """part, place, html: a head, a line for each row of df in ``order``, a foot; with ``bars`` each row has a bar of that column. Rows are placed by
    one number for each; all of them come, however many there are."""
    from leakloom.operators.ranking import numbered

    cells = [F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in df.columns]
    if bars:
        most = df.agg(F.max(bars).alias("__most"))
        rows = df.join(F.broadcast(most))  # one row
        cells.append(F.concat(F.lit("<td>"), bar(F.col(bars), F.col("__most")), F.lit("</td>")))
    else:
        rows = df
    line = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    body = numbered(rows.withColumn("__one", F.lit(0)), ["__one"], order, "__n").select((F.col("__n") + 1).cast("long").alias("place"), line.alias("html"))
    heads = "".join(f"<th>{c}</th>" for c in [*df.columns, *([""] if bars else [])])
    ends = df.sparkSession.createDataFrame([(0, f"<h2>{name}</h2><table><tr>{heads}</tr>"), (2**62, "</table>")], "place long, html string")
    return ends.unionByName(body).select(F.lit(name).alias("part"), "place", "html")


def page(title: str, sections: list[DataFrame]) -> DataFrame:
    """part_no, part, place, html: all lines of a page, in the order of part_no and place."""
    spark = sections[0].sparkSession
    style = ".bar{background:#4a6fa5;height:.8em}td,th{text-align:left;padding:.2em .6em}"
    head = spark.createDataFrame([("", 0, f"<!doctype html><meta charset=utf-8><title>{title}</title><style>{style}</style><h1>{title}</h1>")], "part string, place long, html string")
    parts = [head, *sections]
    return reduce(lambda a, b: a.unionByName(b), (p.withColumn("part_no", F.lit(i)) for i, p in enumerate(parts))).select("part_no", "part", "place", "html")


def write(lines: DataFrame, path: str) -> None:
    """The page as text files whose names are in its order: one for a short page."""
    lines.orderBy("part_no", "place").select("html").write.mode("overwrite").text(path)
