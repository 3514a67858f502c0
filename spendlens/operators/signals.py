"""Anomaly signals over a decision table: emergency awards, timing, dominance, repeated amounts and bursts.

Input columns: ada, issue_date (date), year, month, decision_type, subject, amount, supplier_tax_id, supplier_name.
Thresholds are parameters; their defaults are the published rules'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.classify import is_emergency
from ..functions.numbers import is_non_round
from .durable import stored
from .rolling import daily, over_days

EMERGENCY_SHARE, EMERGENCY_AMOUNT = 0.15, 60_000
YEAR_END_FROM, YEAR_END_DAYS, REST_DAYS, YEAR_END_TIMES, LEAST_YEAR = 22, 10, 355, 3.0, 3000
QUIET_DAY_AMOUNT, MONTH_TIMES = 5_000, 2.5
SHARE_CRITICAL, SHARE_PERSISTENT, LEAST_YEARS = 0.70, 0.50, 2
BODY_SHARE, LEAST_COPIES, BURST_AWARDS, BURST_DAYS, LEAST_SUPPLIERS = 0.40, 2, 3, 30, 3
#: Fixed value: a body's name in a subject.
BODY = r"(?U)(ΕΠΙΤΡΟΠ[ΗΣ\w\s]{0,40}?(?:ΣΥΝΤΗΡ|ΑΝΑΘΕΣ|ΕΚΤΕΛ|ΔΙΑΧΕΙΡ|ΑΞΙΟΛΟΓ)[Α-Ωα-ω\s]{0,30})"


def procurement_only(d: DataFrame) -> DataFrame:
    return d.filter(F.col("decision_type").isin(*V.PROCUREMENT_TYPES))


def emergency_rate(d: DataFrame, share: float = EMERGENCY_SHARE, samples: int = 3) -> DataFrame:
    """Years in which so large a share of procurement decisions is an emergency, with the first subjects."""
    p = procurement_only(d).withColumn("__e", is_emergency(F.col("subject")))
    # The first subjects by date and id, kept bounded in every partial aggregate by a window limit.
    w = Window.partitionBy("year").orderBy("issue_date", "ada", "subject")
    sample = p.filter("__e").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= samples)
    sample = sample.groupBy("year").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "subject"))), lambda x: x["subject"]).alias("samples"))
    rate = p.groupBy("year").agg(F.count("*").alias("procurements"), F.count_if("__e").alias("emergencies"))
    return rate.withColumn("share", F.col("emergencies") / F.col("procurements")).filter(F.col("share") >= share).join(sample, "year", "left")


def emergency_high_value(d: DataFrame, amount: float = EMERGENCY_AMOUNT) -> DataFrame:
    """Emergency awards above an amount."""
    return procurement_only(d).filter(is_emergency(F.col("subject")) & (F.col("amount") > amount)).select("ada", "issue_date", "amount", "supplier_name", "subject")


def emergency_overall(d: DataFrame) -> DataFrame:
    """Emergency decisions among all procurement decisions."""
    return procurement_only(d).agg(F.count("*").alias("procurements"), F.count_if(is_emergency(F.col("subject"))).alias("emergencies")).withColumn("share", F.try_divide("emergencies", "procurements"))


def year_end_rush(d: DataFrame, times: float = YEAR_END_TIMES, least: int = LEAST_YEAR) -> DataFrame:
    """Years whose last ten days of December have so many times the daily decisions of the rest."""
    late = (F.month("issue_date") == 12) & (F.dayofmonth("issue_date") >= YEAR_END_FROM)
    y = d.filter("issue_date is not null").groupBy("year").agg(F.count("*").alias("decisions"), F.count_if(late).alias("late")).filter(F.col("decisions") >= least)
    y = y.withColumns({"late_rate": F.col("late") / YEAR_END_DAYS, "base_rate": (F.col("decisions") - F.col("late")) / REST_DAYS})
    return y.withColumn("times", F.try_divide("late_rate", "base_rate")).filter(F.col("times") >= times)


def weekend_awards(d: DataFrame, amount: float = QUIET_DAY_AMOUNT, top: int = 20) -> DataFrame:
    """The largest decisions dated Saturday or Sunday."""
    found = d.filter((F.weekday("issue_date") >= 5) & (F.col("amount") >= amount))
    return found.orderBy(F.desc("amount"), "ada").limit(top).select("ada", "issue_date", F.weekday("issue_date").alias("weekday"), "amount", "decision_type")


def holiday_awards(d: DataFrame, amount: float = QUIET_DAY_AMOUNT, top: int = 10) -> DataFrame:
    """The largest decisions dated on a public holiday with a fixed date."""
    found = d.filter(F.date_format("issue_date", "MM-dd").isin(*V.HOLIDAYS) & (F.col("amount") >= amount))
    return found.orderBy(F.desc("amount"), "ada").limit(top).select("ada", "issue_date", "amount", "decision_type")


def monthly_spike(d: DataFrame, times: float = MONTH_TIMES) -> DataFrame:
    """Months with so many times the mean count of that year's months."""
    m = d.filter("issue_date is not null").groupBy("year", "month").agg(F.count("*").alias("decisions"))
    m = m.withColumn("mean", F.avg("decisions").over(Window.partitionBy("year")))
    return m.withColumn("times", F.col("decisions") / F.col("mean")).filter(F.col("times") >= times)


def yearly_shares(d: DataFrame, entity: str = "supplier_tax_id") -> DataFrame:
    """(year, entity, total, awards, year_total, share) of procurement spend."""
    p = procurement_only(d).filter(F.col(entity).isNotNull() & (F.col("amount") > 0))
    s = p.groupBy("year", F.col(entity).alias("entity")).agg(F.sum("amount").alias("total"), F.count("*").alias("awards"))
    s = s.withColumn("year_total", F.sum("total").over(Window.partitionBy("year")))
    return s.withColumn("share", F.col("total") / F.col("year_total"))


def supplier_share(d: DataFrame, share: float = SHARE_CRITICAL, entity: str = "supplier_tax_id") -> DataFrame:
    """Suppliers with so large a share of a year's procurement spend."""
    return yearly_shares(d, entity).filter(F.col("share") >= share)


def persistent_share(d: DataFrame, share: float = SHARE_PERSISTENT, years: int = LEAST_YEARS, entity: str = "supplier_tax_id") -> DataFrame:
    """Runs of consecutive years in which a supplier keeps so large a share."""
    s = yearly_shares(d, entity).filter(F.col("share") >= share)
    s = s.withColumn("island", F.col("year") - F.row_number().over(Window.partitionBy("entity").orderBy("year")))
    run = s.groupBy("entity", "island").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("years"), F.avg("share").alias("avg_share"), F.sum("total").alias("total"))
    return run.filter(F.col("years") >= years).drop("island")


def committee_capture(d: DataFrame, share: float = BODY_SHARE) -> DataFrame:
    """Bodies named in so large a share of procurement subjects."""
    p = procurement_only(d).withColumn("body", F.substring(F.regexp_replace(F.trim(F.regexp_extract("subject", BODY, 1)), r"\s+", " "), 1, 60))
    b = p.groupBy("body").agg(F.count("*").alias("awards")).withColumn("total_awards", F.sum("awards").over(Window.partitionBy()))
    return b.filter("body <> ''").withColumn("share", F.col("awards") / F.col("total_awards")).filter(F.col("share") >= share)


def _priced(d: DataFrame) -> DataFrame:
    return procurement_only(d).filter((F.col("amount") > 0) & is_non_round(F.col("amount")) & F.col("supplier_tax_id").isNotNull())


def copies_of_amounts(d: DataFrame, copies: int = LEAST_COPIES) -> DataFrame:
    """How often the same amount, no multiple of 100, went to the same supplier, where it did again: numbers only, so that a task holds a small row for each."""
    return _priced(d).groupBy("supplier_tax_id", "amount").agg(F.count("ada").alias("occurrences")).filter(F.col("occurrences") >= copies)


def copied_amounts(d: DataFrame, copies: int = LEAST_COPIES, dates: int = 5) -> DataFrame:
    """The same amount, no multiple of 100, to the same supplier again, with its first dates."""
    p = _priced(d)
    g = p.groupBy("supplier_tax_id", "amount").agg(F.count("ada").alias("occurrences"), F.min("supplier_name").alias("supplier_name")).filter(F.col("occurrences") >= copies)
    # A fixed monthly fee has very many dates: only the first of them are gathered.
    first = Window.partitionBy("supplier_tax_id", "amount").orderBy("issue_date")
    some = p.filter("issue_date is not null").select("supplier_tax_id", "amount", "issue_date").withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= dates)
    some = some.groupBy("supplier_tax_id", "amount").agg(F.array_sort(F.collect_list("issue_date")).alias("dates"))
    return g.join(some, ["supplier_tax_id", "amount"], "left").withColumn("dates", F.coalesce("dates", F.array().cast("array<date>")))


def award_burst(d: DataFrame, awards: int = BURST_AWARDS, days: int = BURST_DAYS) -> DataFrame:
    """Of each supplier the first award with so many direct awards from it on within so many days."""
    a = d.filter(F.col("decision_type").isin(*V.DIRECT_AWARD_TYPES) & F.col("supplier_tax_id").isNotNull() & F.col("issue_date").isNotNull())
    a = daily(a, ["supplier_tax_id"], {"n": F.count("*"), "amount": F.sum("amount")})
    a = over_days(a, ["supplier_tax_id"], 0, days, {"awards_in_window": F.sum("n"), "window_end": F.max("day"), "total_amount": F.sum("amount")})
    first = F.struct("day", "awards_in_window", "window_end", "total_amount")
    f = a.filter(F.col("awards_in_window") >= awards).groupBy("supplier_tax_id").agg(F.min(first).alias("f"))
    return f.select("supplier_tax_id", F.date_from_unix_date("f.day").alias("window_start"), F.date_from_unix_date("f.window_end").alias("window_end"), "f.awards_in_window", "f.total_amount")


def standard_prices(d: DataFrame, suppliers: int = LEAST_SUPPLIERS) -> DataFrame:
    """The same amount, no multiple of 100, to several suppliers."""
    g = _priced(d).groupBy("amount").agg(F.count_distinct("supplier_tax_id").alias("distinct_suppliers"), F.count("ada").alias("occurrences"))
    return g.filter(F.col("distinct_suppliers") >= suppliers)


def _findings(df: DataFrame, tenet: str, rule: str, entity: Column, period: Column, metric: Column, threshold: float) -> DataFrame:
    return df.select(F.lit(tenet).alias("tenet"), F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), period.cast("string").alias("period"), metric.cast("double").alias("metric"), F.lit(float(threshold)).alias("threshold"))


def _t5(d: DataFrame) -> DataFrame:
    none = F.lit(None)
    a = _findings(emergency_rate(d), "T5", "emergency_rate", none, F.col("year"), F.col("share"), EMERGENCY_SHARE)
    return a.unionByName(_findings(emergency_high_value(d), "T5", "emergency_high_value", F.col("ada"), F.col("issue_date"), F.col("amount"), EMERGENCY_AMOUNT))


def _t6(d: DataFrame) -> DataFrame:
    none = F.lit(None)
    parts = (
        _findings(year_end_rush(d), "T6", "year_end", none, F.col("year"), F.col("times"), YEAR_END_TIMES),
        _findings(weekend_awards(d), "T6", "weekend", F.col("ada"), F.col("issue_date"), F.col("amount"), QUIET_DAY_AMOUNT),
        _findings(holiday_awards(d), "T6", "holiday", F.col("ada"), F.col("issue_date"), F.col("amount"), QUIET_DAY_AMOUNT),
        _findings(monthly_spike(d), "T6", "monthly_spike", none, F.concat_ws("-", "year", "month"), F.col("times"), MONTH_TIMES),
    )
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def _t8(d: DataFrame) -> DataFrame:
    a = _findings(supplier_share(d), "T8", "supplier_share", F.col("entity"), F.col("year"), F.col("share"), SHARE_CRITICAL)
    return a.unionByName(_findings(persistent_share(d), "T8", "persistent_share", F.col("entity"), F.concat_ws("-", "first_year", "last_year"), F.col("avg_share"), SHARE_PERSISTENT))


#: Detectors by name; each takes decisions and returns (tenet, rule, entity, period, metric, threshold).
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "T5": _t5,
    "T6": _t6,
    "T8": _t8,
    "T9A": lambda d: _findings(committee_capture(d), "T9A", "committee_capture", F.col("body"), F.lit(None), F.col("share"), BODY_SHARE),
    "T9B": lambda d: _findings(copies_of_amounts(d), "T9B", "copied_amount", F.col("supplier_tax_id"), F.lit(None), F.col("occurrences"), LEAST_COPIES),
    "T9C": lambda d: _findings(award_burst(d), "T9C", "award_burst", F.col("supplier_tax_id"), F.col("window_start"), F.col("awards_in_window"), BURST_AWARDS),
    "T9D": lambda d: _findings(standard_prices(d), "T9D", "standard_price", F.col("amount"), F.lit(None), F.col("distinct_suppliers"), LEAST_SUPPLIERS),
}


#: What each detector reads.
READS = {
    "T5": ("ada", "issue_date", "year", "decision_type", "subject", "amount", "supplier_name"),
    "T6": ("ada", "issue_date", "year", "month", "decision_type", "amount"),
    "T8": ("year", "decision_type", "amount", "supplier_tax_id"),
    "T9A": ("decision_type", "subject"),
    "T9B": ("ada", "decision_type", "amount", "supplier_tax_id"),
    "T9C": ("issue_date", "decision_type", "amount", "supplier_tax_id"),
    "T9D": ("ada", "decision_type", "amount", "supplier_tax_id"),
}


def detect(d: DataFrame, tenets: list[str] | None = None) -> DataFrame:
    """The findings of the named detectors (all by default) in one table; decisions are worked out once for all of them."""
    names = list(DETECTORS) if tenets is None else tenets
    if unknown := [n for n in names if n not in DETECTORS]:
        raise ValueError(f"unknown detectors: {', '.join(unknown)}")
    d = stored(d.select(*sorted({c for n in names for c in READS[n]})))
    found = DETECTORS[names[0]](d)
    for n in names[1:]:
        found = found.unionByName(DETECTORS[n](d))
    return found
