"""Carts and quotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.functions.scalars import strip


ATTRIBUTES = ("description", "mrp", "dealer_price", "gst_rate", "ref_no", "fig_no", "fig_name")


def number_or(*choices: Column) -> Column:
    """The first that is a number other than 0, as it is."""
    return F.coalesce(*[F.when((c != 0) & ~F.isnan(c), c) for c in (x.try_cast("double") for x in choices)])


def cart_lines(events: DataFrame) -> DataFrame:
    """cart_id, part_no and the line that a cart's events leave: qty, price, gst, description, ref_no, fig_no, fig_name.

    An event adds its delta; at 0 or less the line goes and a later event starts
    it anew with its own attributes. A delta under 0 on no line does nothing. The
    price is mrp, else the dealer's, else 120; an empty description is GENUINE SPARE PART.
    events(cart_id, part_no, seq, delta, and any of ATTRIBUTES).
    """
    of = Window.partitionBy("cart_id", "part_no").orderBy("seq")
    run = F.sum("delta").over(of)
    # The quantity is the running sum reflected at 0; a line starts after the last event that left none.
    own = events.withColumn("__run", run).withColumn("__low", F.least(F.min("__run").over(of.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    own = own.withColumn("qty", F.col("__run") - F.col("__low"))
    after = F.max(F.when(F.col("qty") <= 0, F.col("seq"))).over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    given = F.struct(*[(F.col(c) if c in events.columns else F.lit(None)).cast("string").alias(c) for c in ATTRIBUTES])
    first = F.min_by(given, F.when(F.col("__end").isNull() | (F.col("seq") > F.col("__end")), F.col("seq")))
    lines = own.withColumn("__end", after).groupBy("cart_id", "part_no").agg(F.max_by("qty", "seq").alias("qty"), first.alias("a")).filter("qty > 0")
    empty = lambda c: F.coalesce(strip(F.col(f"a.{c}")), F.lit(""))
    description = F.when(F.coalesce("a.description", F.lit("")) == "", "GENUINE SPARE PART").otherwise(F.col("a.description"))
    return lines.select(
        "cart_id", "part_no", description.alias("description"), empty("ref_no").alias("ref_no"), empty("fig_no").alias("fig_no"), empty("fig_name").alias("fig_name"), "qty",
        number_or(F.col("a.mrp"), F.col("a.dealer_price"), F.lit(120.0)).alias("price"), number_or(F.col("a.gst_rate"), F.lit(28.0)).alias("gst"),
    )


def cart_totals(lines: DataFrame) -> DataFrame:
    line = F.col("qty") * F.col("price")
    tax = line * F.col("gst") / 100
    return lines.groupBy("cart_id").agg(F.sum("qty").alias("qty"), F.round(F.sum(line), 4).alias("subtotal"), F.round(F.sum(tax), 4).alias("gst_total"), F.round(F.sum(line + tax), 4).alias("grand_total"))


def quotation_lines(lines: DataFrame) -> DataFrame:
    """The columns of a quotation as text, of lines as of `cart_lines`."""
    total = F.col("qty") * F.col("price") * (1 + F.col("gst") / 100)
    rate = F.when(F.col("gst") == F.floor("gst"), F.col("gst").cast("long").cast("string")).otherwise(F.col("gst").cast("string"))
    return lines.select(
        "cart_id", F.col("ref_no").alias("Ref No"), F.col("part_no").cast("string").alias("Part No"), F.col("description").alias("Description"),
        F.concat(F.lit("FIG. "), "fig_no", F.lit(" - "), "fig_name").alias("Figure"), F.col("qty").cast("string").alias("Qty"),
        F.format_string("%.2f", "price").alias("Unit MRP"), F.concat(rate, F.lit("%")).alias("GST %"), F.format_string("%.2f", total).alias("Total Amount"),
    )


def write_quotation(lines: DataFrame, path: str) -> None:
    quotation_lines(lines).write.option("header", True).option("quoteAll", True).mode("overwrite").csv(path)
