"""Large files whose rows depend on rows before them, read by Spark's own splits.

A file is cut at a separator wherever the engine splits it, so one file is many tasks' work. What a row needs from all rows
before it in the file (running numbers, the last key seen) comes in two steps: a window within each split, and one over the
totals of the splits, which are as few as the splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, block (where its split begins), row (its order there) and value: what stands between separators."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def carried(rows: DataFrame, sums: list[str] | None = None, lasts: list[str] | None = None) -> DataFrame:
    """rows (file, block, row and others) with ``<name>_before``: the sum over all rows before in the file of each column in
    ``sums``, and the last value that is not null of each in ``lasts``."""
    sums, lasts = sums or [], lasts or []
    total = rows.groupBy("file", "block").agg(*(F.sum(c).alias(f"_{c}") for c in sums), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row"))).alias(f"_{c}") for c in lasts))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("file", "block", *(F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in sums), *(F.last(f"_{c}", ignorenulls=True).over(over).alias(f"_{c}") for c in lasts))
    own = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums} | {f"{c}_before": F.last(c, ignorenulls=True).over(own) for c in lasts})
    both = here.join(total, ["file", "block"])
    return both.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in sums} | {f"{c}_before": F.coalesce(f"{c}_before", f"_{c}") for c in lasts}).drop(*(f"_{c}" for c in (*sums, *lasts)))


#: Entries that stand for a split once entries are numbered over the whole file.
CHUNK = 1 << 16
_STRING = r'"(?:[^"\\]|\\.)*"'


def _unquoted(raw: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), 0)


def nested_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, keys (an array of three) and value of every number in an object of objects of objects of whole numbers, which
    may be one object of any size. Cuts are at commas; those inside of strings are told by the number of quotes before them, and a number's outer keys
    are the last ones opened before it. Null values and empty objects give no row."""
    cut = pieces(spark, path, ",")
    # a backslash and what it escapes are in one piece, as no comma is escaped
    cut = cut.withColumn("quotes", F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', "")))
    cut = carried(cut, sums=["quotes"]).withColumn("begins", (F.col("quotes_before") % 2 == 0).cast("int"))
    cut = carried(cut.drop("quotes", "quotes_before"), sums=["begins"]).withColumn("entry", F.col("begins_before") + F.col("begins"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), ",")
    rows = cut.groupBy("file", "entry").agg(text.alias("text"))
    bare = F.regexp_replace("text", _STRING, '""')
    opened, closed = F.length(F.regexp_replace(bare, "[^{]", "")), F.length(F.regexp_replace(bare, "[^}]", ""))
    names = F.regexp_extract_all("text", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1)
    number = F.regexp_extract(bare, r":\s*(-?\d+)\s*[}\s]*$", 1)
    rows = rows.select("file", F.floor(F.col("entry") / CHUNK).alias("block"), F.col("entry").alias("row"), (opened - closed).alias("depth"), F.startswith(F.ltrim(bare), F.lit("{")).cast("int").alias("outer"), names.alias("names"), F.when(number != "", number.cast("long")).alias("number"))
    rows = carried(rows, sums=["depth"]).withColumn("level", F.col("depth_before") + F.col("outer"))
    # the first name of a piece is that of its level, each further one is a level deeper
    at = lambda k: F.when((k >= F.col("level")) & (k - F.col("level") < F.size("names")), F.get("names", (k - F.col("level")).cast("int")))
    rows = carried(rows.select("file", "block", "row", "number", *(_unquoted(at(F.lit(k))).alias(f"k{k}") for k in (1, 2, 3))), lasts=["k1", "k2"])
    outer = [F.coalesce(f"k{k}", f"k{k}_before") for k in (1, 2)]
    return rows.where("number is not null and k3 is not null").select("file", F.array(*outer, F.col("k3")).alias("keys"), F.col("number").alias("value"))
