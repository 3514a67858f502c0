"""Links that join what the tolerance join joins, by cells of rows, whatever is unknown.

Amounts fall into cells on a logarithmic scale and dates into cells of the window's length, so that rows alike in what is unknown and of one
cell (and supplier, where it is known) always match: such a class is one node. Two classes are linked if any two of their rows match; that is
seen from the rows that are farthest to each side, so what is joined grows with the classes, and rows are shuffled once.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import stored

#: What tells the class of a row: the supplier, the cells of amount and date, what of both is unknown, and the amount itself where only equal ones match.
CLASS = ["supplier_tax_id", "undated", "k", "b", "x"]


def _cells(tolerance: float, days: int):
    """The reach of an amount on the logarithmic scale, the width of its cells, and the cell of a column there or of a day."""
    reach = -math.log(1 - tolerance)
    width = reach * 0.999999  # rows of one cell surely match
    return reach, width, lambda c: F.floor(c / F.lit(width)), lambda c: F.floor(c / F.lit(days))


def classed(rows: DataFrame, tolerance: float, days: int, strict_supplier: bool = False) -> DataFrame:
    """rows with the columns of CLASS: rows of one class are linked. amount above 0.

    Without a supplier and with ``strict_supplier`` nothing matches, so only rows alike in amount and date are of one class.
    """
    _, _, at_amount, at_day = _cells(tolerance, days)
    alone = F.col("supplier_tax_id").isNull() & F.lit(strict_supplier)
    date = F.unix_date("issue_date").cast("long")
    return rows.withColumns({"undated": F.col("issue_date").isNull(), "k": at_amount(F.log("amount")), "b": F.coalesce(F.when(alone, date).otherwise(at_day(date)), F.lit(0)), "x": F.when(alone, F.col("amount"))})


def _farthest(rows: DataFrame) -> DataFrame:
    """The rows of each class that say whether one beside it matches: (CLASS, node, sk, sb, amount, date). rows: as of classed.

    sk, sb: towards which side of the class's cell, in amount and date. node: the smallest id of the class. Towards both sides, those are the
    extreme amounts of each day (a cell has as many days as the window at most) that no later, or earlier, day passes.
    """
    rows = rows.select("id", "amount", F.unix_date("issue_date").alias("date"), *CLASS).repartition("supplier_tax_id", "k", "b")  # all of a class, so what follows needs no other shuffle
    end = lambda sk, sb, amount, date: F.struct(F.lit(sk).alias("sk"), F.lit(sb).alias("sb"), amount.alias("amount"), date.alias("date"))
    some, none = F.min("amount"), F.lit(None).cast("int")
    # Of one cell in amount or in date, rows match in that; the other decides alone.
    ends = [end(0, 0, some, none), end(1, 0, F.max("amount"), none), end(-1, 0, F.min("amount"), none), end(0, 1, some, F.max("date")), end(0, -1, some, F.min("date"))]
    found = rows.groupBy(*CLASS).agg(F.min("id").alias("node"), F.array(*ends).alias("ends")).select(*CLASS, "node", F.explode("ends").alias("e")).select(*CLASS, "node", "e.*")
    day = rows.filter("not undated").groupBy(*CLASS, "date").agg(F.min("id").alias("id"), F.array(F.struct(F.lit(1).alias("sk"), F.max("amount").alias("amount")), F.struct(F.lit(-1).alias("sk"), F.min("amount").alias("amount"))).alias("both"))
    day = day.withColumn("node", F.min("id").over(Window.partitionBy(*CLASS)))
    day = day.select(*CLASS, "node", F.explode("both").alias("x_"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sb"), "date").select(*CLASS, "node", "x_.sk", "sb", "x_.amount", "date")
    farther = Window.partitionBy(*CLASS, "sk", "sb").orderBy(F.col("date") * -F.col("sb")).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.col("amount") * F.col("sk")).over(farther)
    return found.filter("sb = 0 or not undated").unionByName(day.withColumn("best", best).filter("best is null or amount * sk > best").drop("best"))


def _relation(a: DataFrame, b: DataFrame, supplier: bool, dated: bool, tolerance: float, days: int) -> DataFrame:
    """(src, dst) of the classes of a and b that match. Dated, both have a day; else amounts alone decide (and the supplier, where both have one)."""
    reach, _, at_amount, _ = _cells(tolerance, days)
    if not dated:
        a, b = a.filter("sb = 0").withColumn("b", F.lit(0).cast("long")), b.filter("sb = 0").withColumn("b", F.lit(0).cast("long"))
    log = F.log("amount")
    # Of the cells that the row may reach on the side that it is farthest to.
    met = F.when(F.col("sk") == 0, F.array("k")).when(F.col("sk") == 1, F.filter(F.sequence("k", F.greatest("k", at_amount(log + reach))), lambda k: k > F.col("k")))
    met = met.otherwise(F.filter(F.sequence(F.least("k", at_amount(log - reach)), "k"), lambda k: k < F.col("k")))
    left = a.select("node", "amount", "date", F.explode(met).alias("k"), (F.col("b") + F.col("sb")).alias("b"), (-F.col("sk")).alias("sk"), (-F.col("sb")).alias("sb"), *["supplier_tax_id"] * supplier)
    right = b.select(F.col("node").alias("dst"), F.col("amount").alias("r_amount"), F.col("date").alias("r_date"), "k", "b", "sk", "sb", *["supplier_tax_id"] * supplier)
    pairs = left.join(right, ["k", "b", "sk", "sb", *["supplier_tax_id"] * supplier]).filter("node <> dst")
    near = (F.col("sk") == 0) | (F.abs(F.col("amount") - F.col("r_amount")) / F.greatest("amount", "r_amount") <= tolerance)
    near = near & ((F.col("sb") == 0) | (F.abs(F.col("date") - F.col("r_date")) <= days))
    return pairs.filter(near).select(F.least("node", "dst").alias("src"), F.greatest("node", "dst").alias("dst"))


def class_links(rows: DataFrame, tolerance: float, days: int, strict_supplier: bool = False) -> tuple[DataFrame, DataFrame]:
    """The classes (CLASS, node, their smallest id), and (src, dst) between the nodes of classes of which any two rows match. rows: as of classed."""
    far = stored(_farthest(rows))
    has = lambda undated, named: far.filter(F.col("undated") == undated).filter(F.col("supplier_tax_id").isNotNull() if named else F.col("supplier_tax_id").isNull())
    full, undated, unnamed, bare = has(False, True), has(True, True), has(False, False), has(True, False)
    # Where nothing is unknown, those relations have no rows on one side.
    relations = [(full, full, True, True), (undated, undated, True, False), (full, undated, True, False)]
    if not strict_supplier:
        relations += [(unnamed, unnamed, False, True), (full, unnamed, False, True), (undated, unnamed, False, False), (far, bare, False, False)]
    found = None
    for a, b, supplier, dated in relations:
        some = _relation(a, b, supplier, dated, tolerance, days)
        found = some if found is None else found.unionByName(some)
    return far.filter("sk = 0 and sb = 0").select(*CLASS, "node"), found.distinct()


def tolerance_links(nodes: DataFrame, tolerance: float, days: int, strict_supplier: bool = False) -> DataFrame:
    """(src, dst) that join all nodes whose amounts, dates and suppliers match, each unknown date or supplier matching any.

    nodes: id, amount (above 0), issue_date, supplier_tax_id. With ``strict_supplier`` only known suppliers match. Every node has a link to
    the first of its class, and classes a bounded number, so hot amounts and many unknown values stay linear.
    """
    rows = classed(nodes, tolerance, days, strict_supplier)
    classes, found = class_links(rows, tolerance, days, strict_supplier)
    return members(rows, classes.withColumnRenamed("node", "dst")).select(F.col("id").alias("src"), "dst").filter("src <> dst").unionByName(found)


def members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (as of classed) with what is known of their classes."""
    named = classes.withColumnsRenamed({c: f"__{c}" for c in CLASS})
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) if c in ("supplier_tax_id", "x") else F.col(c) == F.col(f"__{c}") for c in CLASS])
    return rows.join(named, same).drop(*[f"__{c}" for c in CLASS])
