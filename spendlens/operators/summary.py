"""Summaries of decisions, procurements, contracts and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.classify import confidence, should_hydrate
from ..functions.numbers import ratio

MONTH_WARNING, LOW_COVERAGE = 10_000_000, 0.5
CAPPED, PAGE = 490, 500
BANDS = ((0, "<1k"), (1_000, "1k-10k"), (10_000, "10k-20k"), (20_000, "20k-30k"), (30_000, "30k-140k"), (140_000, ">140k"))


def monthly_summary(d: DataFrame, procurement: Column) -> DataFrame:
    """Eleven measures of each (year, month) of decisions d (with detail_enriched); ``procurement``: which of them count as procurement.

    Missing counts are decisions less procurements that have the field. One pass over d, aggregated before its only shuffle.
    """
    d = d.withColumn("__p", F.coalesce(procurement, F.lit(False)))
    bought = lambda c: F.when(F.col("__p"), F.col(c))
    m = d.groupBy("year", "month").agg(
        F.count_distinct("ada").alias("distinct_adas"), F.count("*").alias("rows"), F.count_if("detail_enriched").alias("detail_enriched_decision_count"), F.coalesce(F.sum(bought("amount")), F.lit(0.0)).alias("amount_total"),
        F.count_distinct(bought("supplier_key")).alias("supplier_count"), F.count(bought("amount")).alias("amount_known_count"), F.count(bought("supplier_key")).alias("supplier_known_count"),
    )
    return m.select(
        "year", "month", F.when(F.col("distinct_adas") > 0, F.col("distinct_adas")).otherwise(F.col("rows")).alias("decision_count"), "amount_total", "supplier_count",
        "amount_known_count", (F.col("rows") - F.col("amount_known_count")).alias("amount_missing_count"), "supplier_known_count", (F.col("rows") - F.col("supplier_known_count")).alias("supplier_missing_count"),
        "detail_enriched_decision_count", (F.col("rows") - F.col("detail_enriched_decision_count")).alias("search_only_decision_count"),
    )


def quality_warnings(m: DataFrame, amount: float = MONTH_WARNING, coverage: float = LOW_COVERAGE) -> DataFrame:
    """(year, month, warning, value) of a monthly summary: sums too large, no supplier, few amounts."""
    has = F.col("decision_count") > 0
    share = F.try_divide("amount_known_count", "decision_count")
    kinds = F.array(
        F.when(F.col("amount_total") > amount, F.struct(F.lit("amount_total").alias("warning"), F.col("amount_total").alias("value"))),
        F.when(has & (F.col("supplier_count") == 0), F.struct(F.lit("no_supplier").alias("warning"), F.lit(0.0).alias("value"))),
        F.when(has & (share < coverage), F.struct(F.lit("low_amount_coverage").alias("warning"), share.alias("value"))),
    )
    return m.select("year", "month", F.explode(F.array_compact(kinds)).alias("w")).select("year", "month", "w.*")


def month_activity(d: DataFrame) -> DataFrame:
    return d.groupBy("year", "month").agg(F.count_distinct("ada").alias("decisions"), F.count_distinct("supplier_key").alias("suppliers"), F.sum("amount").alias("total_amount"))


def cards(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("rows"), F.count_distinct("supplier_key").alias("suppliers"), F.sum("amount").alias("total_amount"), F.max("amount").alias("max_amount"))


def executive(m: DataFrame, members: DataFrame, made: DataFrame) -> DataFrame:
    """Totals, years, and spend before and after linking, in one row."""
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  one row each
    a = one(m.agg(F.sum("decision_count").alias("decisions"), F.min("year").alias("first_year"), F.max("year").alias("last_year")))
    b = one(members.agg(F.sum("amount").alias("raw_spend"), F.count("*").alias("procurements")))
    c = one(made.agg(F.sum("amount").alias("clean_spend"), F.count("*").alias("contracts")))
    return a.join(b, "__one").join(c, "__one").drop("__one")


def yearly_rollup(m: DataFrame) -> DataFrame:
    """A monthly summary by year; supplier_months adds up the months' suppliers and is no distinct count."""
    return m.groupBy("year").agg(F.sum("decision_count").alias("decisions"), F.sum("amount_total").alias("amount_total"), F.sum("supplier_count").alias("supplier_months"), F.sum("amount_known_count").alias("amount_known"))


def month_coverage(m: DataFrame) -> DataFrame:
    """Amounts known, of each month's decisions."""
    return m.select("year", "month", "amount_known_count", "decision_count", F.try_divide(F.col("amount_known_count") * 100, "decision_count").alias("pct"))


def type_breakdown(d: DataFrame) -> DataFrame:
    return d.groupBy("decision_type").agg(F.count("*").alias("decisions"), F.sum("amount").alias("spend"))


def stage_breakdown(d: DataFrame) -> DataFrame:
    return d.groupBy("procurement_stage").agg(F.count("*").alias("decisions"))


def coverage_metrics(d: DataFrame) -> DataFrame:
    """Shares of decisions with an amount, a tax id and a detail record, in per cent."""
    pct = lambda c: F.try_divide(F.count_if(c) * 100, F.count("*"))
    return d.agg(F.count("*").alias("decisions"), pct(F.col("amount").isNotNull()).alias("pct_amount"), pct(F.col("supplier_tax_id").isNotNull()).alias("pct_tax_id"), F.count_if("detail_enriched").alias("enriched"), F.count_if(~F.col("detail_enriched")).alias("search_only"))


def structuring_bands(d: DataFrame) -> DataFrame:
    """Direct awards by band of their amount, with each band's share of them in per cent."""
    a = d.filter(F.col("decision_type").isin(*V.DIRECT_AWARD_TYPES) & (F.col("amount") > 0))
    band = F.coalesce(*[F.when(F.col("amount") >= low, F.lit(name)) for low, name in reversed(BANDS)])
    g = a.groupBy(band.alias("band")).agg(F.count("*").alias("awards"))
    return g.withColumn("pct", F.col("awards") * 100 / F.sum("awards").over(Window.partitionBy()))


def structuring_suppliers(d: DataFrame, below: float = 30_000, least: int = 2, top: int = 20) -> DataFrame:
    """Suppliers with several direct awards below an amount, most first."""
    a = d.filter(F.col("decision_type").isin(*V.DIRECT_AWARD_TYPES) & (F.col("amount") > 0) & (F.col("amount") < below) & F.col("supplier_tax_id").isNotNull())
    g = a.groupBy("supplier_tax_id").agg(F.count("*").alias("awards"), F.sum("amount").alias("total"), F.max("amount").alias("largest")).filter(F.col("awards") >= least)
    return g.orderBy(F.desc("awards"), "supplier_tax_id").limit(top)


def suppliers_known_and_missing(d: DataFrame) -> DataFrame:
    """Of each named supplier its decisions, known amount and decisions without one."""
    return d.filter("supplier_name is not null").groupBy("supplier_name").agg(F.count("*").alias("decisions"), F.sum("amount").alias("known_amount"), F.count_if(F.col("amount").isNull()).alias("missing_amount_rows"))


def theme_summary(d: DataFrame, theme: Column) -> DataFrame:
    return d.groupBy(theme.alias("theme")).agg(F.count("*").alias("decisions"))


def direct_totals(d: DataFrame) -> DataFrame:
    return d.filter(F.col("decision_type").isin(*V.DIRECT_AWARD_TYPES)).agg(F.count("*").alias("decisions"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("spend"))


def before_and_after(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(field, before, after): how many rows have each field."""
    side = lambda df, n: df.agg(*[F.count(f).alias(f) for f in fields]).select(F.expr("stack({}, {}) as (field, {})".format(len(fields), ", ".join(f"'{f}', {f}" for f in fields), n)))
    return side(before, "before").join(side(after, "after"), "field")


def outcome_counts(d: DataFrame, outcome: str) -> DataFrame:
    """Outcomes of each month, and of all (year and month null)."""
    return d.rollup("year", "month").agg(F.count("*").alias("attempts"), F.count_if(F.col(outcome) == "hydrated").alias("hydrated"), F.count_if(F.col(outcome) == "failed").alias("failed"), F.count_if(F.col(outcome) == "skipped").alias("skipped")).filter("year is null or month is not null")


def refetch_gains(before: DataFrame, after: DataFrame, top: int = 10) -> DataFrame:
    """Months by what a second fetch added."""
    n = lambda df, name: df.groupBy("year", "month").agg(F.count_distinct("ada").alias(name))
    j = n(after, "after").join(n(before, "before"), ["year", "month"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return j.withColumn("gain", F.col("after") - F.col("before")).orderBy(F.desc("gain"), "year", "month").limit(top)


def status_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("lookup_status").agg(F.count("*").alias("suppliers"))


def capped_months(d: DataFrame, capped: int = CAPPED, page: int = PAGE) -> DataFrame:
    """Months with so many distinct decisions that a search may have been cut off; exact: as many as a full page."""
    m = d.groupBy("org", "year", "month").agg(F.count_distinct("ada").alias("decisions")).filter(F.col("decisions") >= capped)
    return m.withColumn("exact", F.col("decisions") == page)


def monthly_coverage(index: DataFrame, hydrated: DataFrame, failures: DataFrame, audits: DataFrame) -> DataFrame:
    """Of each month of the index or the audits: decisions indexed and hydrated, what was found in them, failures and a rating.

    index: org_uid, year, month, decision_type, subject; hydrated: year, month, amount, supplier_name; failures: year, month;
    audits: year, month, exact_500_flag, pagination_complete (a month without one counts as not capped and complete).
    """
    key = ["year", "month"]
    i = index.groupBy("org_uid", *key).agg(F.count("*").alias("indexed_decisions"), F.count_if(should_hydrate(F.col("decision_type"), F.col("subject"))).alias("procurement_rows"))
    h = hydrated.groupBy(*key).agg(F.count("*").alias("hydrated_decisions"), F.count("amount").alias("rows_with_amount"), F.count("supplier_name").alias("rows_with_supplier"))
    f = failures.groupBy(*key).agg(F.count("*").alias("failed_hydrations"))
    m = i.join(audits, key, "full").join(h, key, "left").join(f, key, "left")
    m = m.fillna(0, ["indexed_decisions", "procurement_rows", "hydrated_decisions", "rows_with_amount", "rows_with_supplier", "failed_hydrations"])
    m = m.withColumns({"exact_500_flag": F.coalesce("exact_500_flag", F.lit(False)), "pagination_complete": F.coalesce("pagination_complete", F.lit(True))})
    pct = lambda a, b: F.coalesce(F.round(ratio(F.col(a) * 100, F.col(b)), 2), F.lit(0.0))
    m = m.withColumns({"hydration_pct": pct("hydrated_decisions", "indexed_decisions"), "amount_extraction_pct": pct("rows_with_amount", "hydrated_decisions"), "supplier_extraction_pct": pct("rows_with_supplier", "hydrated_decisions")})
    return m.withColumn("confidence_rating", confidence(F.col("pagination_complete"), F.col("exact_500_flag"), F.col("hydration_pct"), F.col("amount_extraction_pct"), F.col("supplier_extraction_pct")))


def evidence(d: DataFrame) -> DataFrame:
    """(rule, ada): the largest decision, the largest payment, one of the most frequent supplier, and one example of each source of amounts."""
    order = lambda c: F.struct(F.col(c), F.col("ada"))
    paid = F.col("decision_type").isin("Expenditure approval", "Payment finalization", "Payment warrant")
    w = d.groupBy("supplier_name").agg(F.count("*").alias("n"), F.min("ada").alias("ada")).filter("supplier_name is not null")
    a = d.agg(F.max_by("ada", F.when(F.col("amount").isNotNull(), order("amount"))).alias("largest"), F.max_by("ada", F.when(paid & F.col("amount").isNotNull(), order("amount"))).alias("largest_payment"), F.min(F.when(F.contains("amount_source", F.lit("extraFieldValues")), F.col("ada"))).alias("nested_source"), F.min(F.when(F.contains("amount_source", F.lit("subject")), F.col("ada"))).alias("subject_source"))
    b = w.agg(F.max_by("ada", F.struct("n", "supplier_name")).alias("ada")).select(F.lit("repeated_supplier").alias("rule"), "ada")
    rules = ("largest", "largest_payment", "nested_source", "subject_source")
    return a.select(F.expr("stack(4, {}) as (rule, ada)".format(", ".join(f"'{r}', {r}" for r in rules)))).unionByName(b)
