"""Rules that are described in documents only: concentration, splitting, outliers, missing registrations and the like.

Input as for signals; cpv is a category code, signer a person, org an organisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import bound, canonical_text
from .durable import stored
from .rolling import daily, over_days, quantiles
from .signals import procurement_only


def rolling_share(d: DataFrame, years: int = 3, share: float = 0.5) -> DataFrame:
    """Suppliers with so large a share of an org's awards over the last years, for each year."""
    y = procurement_only(d).groupBy("org", "supplier_tax_id", "year").agg(F.sum("amount").alias("a"))
    own = Window.partitionBy("org", "supplier_tax_id").orderBy("year").rangeBetween(1 - years, 0)
    total = y.groupBy("org", "year").agg(F.sum("a").alias("t"))
    total = total.withColumn("org_total", F.sum("t").over(Window.partitionBy("org").orderBy("year").rangeBetween(1 - years, 0)))
    r = y.withColumn("total", F.sum("a").over(own)).join(total.select("org", "year", "org_total"), ["org", "year"])
    return r.filter("supplier_tax_id is not null").withColumn("share", F.try_divide("total", "org_total")).filter(F.col("share") >= share).select("org", "supplier_tax_id", "year", "total", "share")


def split_awards(d: DataFrame, limit: float, days: int = 90, *by: str) -> DataFrame:
    """Awards each below a limit that together pass it within so many days, to one supplier (and org, category ...)."""
    keys = list(by) or ["org", "supplier_tax_id"]
    a = procurement_only(d).filter((F.col("amount") < limit) & F.col("supplier_tax_id").isNotNull() & F.col("issue_date").isNotNull())
    sums = daily(a, keys, {"window_total": F.sum("amount"), "window_awards": F.count("*")})
    sums = over_days(sums, keys, -days, 0, {"window_total": F.sum("window_total"), "window_awards": F.sum("window_awards")})
    sums = sums.filter((F.col("window_total") > limit) & (F.col("window_awards") > 1))
    # Back to the awards of those days; a key may be null, as in a window.
    j = a.withColumn("day", F.unix_date("issue_date")).join(sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("day").alias("__day"), "window_total", "window_awards"), [F.col("day") == F.col("__day"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]])
    return j.select(*keys, "ada", "issue_date", "amount", "window_total", "window_awards")


def outlier_organisations(d: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Orgs whose mean procurement amount is so many standard deviations above the orgs' mean."""
    o = procurement_only(d).groupBy("org").agg(F.avg("amount").alias("mean_amount"))
    w = Window.partitionBy()  # one row an org
    o = o.withColumns({"peer_mean": F.avg("mean_amount").over(w), "peer_std": F.stddev_samp("mean_amount").over(w)})
    return o.withColumn("sigmas", F.try_divide(F.col("mean_amount") - F.col("peer_mean"), "peer_std")).filter(F.col("sigmas") > sigmas)


def amended_contracts(awards: DataFrame, amendments: DataFrame, times: float = 1.5) -> DataFrame:
    """Awards that amendments (ada, amount) bring to so many times their amount."""
    more = amendments.groupBy("ada").agg(F.sum("amount").alias("added"))
    j = awards.join(more, "ada").withColumn("times", F.try_divide(F.col("amount") + F.col("added"), "amount"))
    return j.filter(F.col("times") > times).select("ada", "amount", "added", "times")


def emergency_spend(d: DataFrame, emergency, share: float = 0.2) -> DataFrame:
    """Years with so large a share of spend in emergencies."""
    y = procurement_only(d).groupBy("year").agg(F.sum("amount").alias("spend"), F.coalesce(F.sum(F.when(emergency, F.col("amount"))), F.lit(0.0)).alias("emergency_spend"))
    return y.withColumn("share", F.try_divide("emergency_spend", "spend")).filter(F.col("share") > share)


def year_end_spend(d: DataFrame, months: tuple[int, ...] = (11, 12), share: float = 0.25) -> DataFrame:
    """Org years with so large a share of spend in the last months."""
    y = procurement_only(d).groupBy("org", "year").agg(F.sum("amount").alias("spend"), F.coalesce(F.sum(F.when(F.col("month").isin(*months), F.col("amount"))), F.lit(0.0)).alias("late_spend"))
    return y.withColumn("share", F.try_divide("late_spend", "spend")).filter(F.col("share") > share)


def december_rush(d: DataFrame, first_day: int = 22, share: float = 0.3) -> DataFrame:
    """Org years with so large a share of spend in the last ten days of December."""
    late = (F.month("issue_date") == 12) & (F.dayofmonth("issue_date") >= first_day)
    y = procurement_only(d).groupBy("org", "year").agg(F.sum("amount").alias("spend"), F.coalesce(F.sum(F.when(late, F.col("amount"))), F.lit(0.0)).alias("late_spend"))
    return y.withColumn("share", F.try_divide("late_spend", "spend")).filter(F.col("share") > share)


def election_rush(d: DataFrame, elections: list[str], months: int = 3, times: float = 2.0) -> DataFrame:
    """Orgs whose awards a day in the months before an election are so many times those of all their other days.

    elections: dates; their number is small, each adds two conditional sums to one aggregation.
    """
    day = F.col("issue_date").cast("date")
    a = procurement_only(d).filter("issue_date is not null")
    begins = {e: F.add_months(F.lit(e).cast("date"), -months) for e in elections}
    inside = {e: (day >= b) & (day < F.lit(e).cast("date")) for e, b in begins.items()}
    sums = [F.count_if(inside[e]).alias(f"n{i}") for i, e in enumerate(elections)]
    o = a.groupBy("org").agg(F.count("*").alias("awards"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(e).cast("date").alias("election"), F.col(f"n{i}").alias("before"), F.datediff(F.lit(e).cast("date"), b).alias("days")) for i, (e, b) in enumerate(begins.items())]))
    o = o.select("org", "awards", (F.datediff("last_day", "first_day") + 1).alias("span"), each.alias("e")).select("org", "awards", "span", "e.*")
    base = F.try_divide(F.col("awards") - F.col("before"), F.col("span") - F.col("days"))
    return o.withColumn("times", F.try_divide(F.col("before") / F.col("days"), base)).filter(F.col("times") > times).select("org", "election", "before", "times")


def captured_categories(d: DataFrame, prefix: int = 8, share: float = 0.6, years: int = 3) -> DataFrame:
    """Runs of so many years in which one supplier has so large a share of an org's spend in a category, all of it by direct award."""
    a = procurement_only(d).withColumn("category", F.substring("cpv", 1, prefix))
    own = a.groupBy("org", "category", "supplier_tax_id", "year").agg(F.sum("amount").alias("own"), F.count_if(~F.col("decision_type").isin(*V.DIRECT_AWARD_TYPES)).alias("open_awards"))
    s = own.withColumn("total", F.sum("own").over(Window.partitionBy("org", "category", "year")))  # a row a supplier
    s = s.filter(F.col("supplier_tax_id").isNotNull() & (F.col("open_awards") == 0)).withColumn("share", F.try_divide("own", "total")).filter(F.col("share") > share)
    key = ["org", "category", "supplier_tax_id"]
    s = s.withColumn("island", F.col("year") - F.row_number().over(Window.partitionBy(*key).orderBy("year")))
    run = s.groupBy(*key, "island").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("years"), F.avg("share").alias("avg_share"))
    return run.filter(F.col("years") >= years).drop("island")


def orphan_payments(d: DataFrame, contracts: DataFrame, key: str = "contract_number") -> DataFrame:
    """Payments that name a contract number which the contracts do not have; payments without a number are none of them."""
    paid = d.filter(F.col("decision_type").isin(*V.PAYMENT_TYPES) & (F.trim(F.col(key)) != ""))
    return paid.join(contracts.select(key).distinct(), key, "left_anti")


def registry_red_flags(awards: DataFrame, registry: DataFrame, activity_words: DataFrame | None = None, months: int = 6) -> DataFrame:
    """Of each award to a supplier that the registry knows: registered after it, capital below it, not active, registered less than so many months before the first award, and no activity that its subject names.

    registry: supplier_tax_id, registration_date, share_capital, is_active, primary_activity_code. activity_words: code, word; a code
    without words flags nothing. Unknown values flag nothing.
    """
    a = awards.withColumn("first_award", F.min("issue_date").over(Window.partitionBy("supplier_tax_id")))
    j = a.join(registry, "supplier_tax_id")
    words = None if activity_words is None else activity_words.groupBy(F.col("code").alias("primary_activity_code")).agg(F.collect_set(canonical_text(F.col("word"))).alias("__words"))
    j = j.withColumn("__words", F.lit(None).cast("array<string>")) if words is None else j.join(words, "primary_activity_code", "left")
    subject = F.concat(F.lit(" "), canonical_text(F.col("subject")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.withColumns({
        "flag_registered_after": flag(F.col("registration_date") > F.col("issue_date")),
        "flag_undercapitalised": flag(F.col("share_capital") < F.col("amount")),
        "flag_inactive": flag(~F.col("is_active")),
        "flag_new_company": flag((F.col("registration_date") <= F.col("first_award")) & (F.add_months("registration_date", months) > F.col("first_award"))),
        "flag_other_activity": flag(~F.exists("__words", lambda w: F.contains(subject, F.concat(F.lit(" "), w)))),
    }).drop("__words", "first_award")


#: Letters of a name's word from which on one of them may differ.
LEAST_LETTERS = 4


def _name_keys(name: Column) -> Column:
    """array<struct<rest, near, word>>: of a name's words, in any order, each in turn: the others, and the word whole and without each of its letters."""

    def turn(words: Column, i: Column) -> Column:
        word, rest = F.get(words, i), F.array_join(F.concat(F.slice(words, 1, i), F.slice(words, i + 2, F.size(words))), " ")
        less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda j: F.concat(F.substring(word, F.lit(1), j - 1), F.substring(word, j + 1, F.length(word))))
        near = F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= LEAST_LETTERS, less).otherwise(F.array().cast("array<string>"))))
        return F.transform(near, lambda x: F.struct(rest.alias("rest"), x.alias("near"), word.alias("word")))

    words = F.array_sort(F.filter(F.split(canonical_text(name), " "), lambda w: w != ""))
    return bound(words, lambda ws: F.when(F.size(ws) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: turn(ws, i)))))


def signer_links(d: DataFrame, persons: DataFrame) -> DataFrame:
    """(ada, supplier_tax_id, person): decisions signed by someone named like a person (supplier_tax_id, person) of the supplier.

    Names are alike if their words are, in any order, but for one letter (added, left out or another) of one word of LEAST_LETTERS or more.
    Names meet by all words but one and what is left of that one without a letter, once for each different name of a supplier.
    """
    key = ["supplier_tax_id", "rest", "near"]
    of = lambda rows, name: rows.filter(F.col("supplier_tax_id").isNotNull() & F.col(name).isNotNull()).select("supplier_tax_id", name).distinct().withColumn("k", F.explode(_name_keys(F.col(name)))).select("supplier_tax_id", name, "k.rest", "k.near", F.col("k.word").alias(f"{name}_word"))
    met = of(d, "signer").join(of(persons, "person"), key)
    long = F.least(F.length("signer_word"), F.length("person_word")) >= LEAST_LETTERS
    alike = (F.col("signer_word") == F.col("person_word")) | (long & (F.levenshtein("signer_word", "person_word", 1) == 1))
    pairs = met.filter(alike).select("supplier_tax_id", "signer", "person").distinct()
    return d.join(pairs, ["supplier_tax_id", "signer"]).select("ada", "supplier_tax_id", "person")


def absent_from(d: DataFrame, register: DataFrame, key: str, least: float = 140_000) -> DataFrame:
    """Awards of such an amount that a register does not know."""
    return procurement_only(d).filter(F.col("amount") >= least).join(register.select(key).distinct(), key, "left_anti")


def price_outliers(d: DataFrame, times: float = 2.0, by: tuple[str, ...] = ("cpv", "year")) -> DataFrame:
    """Awards so many times the median of their category and year."""
    p = stored(procurement_only(d).select("ada", *by, "amount"))  # read three times, worked out once
    m = stored(quantiles(p, list(by), "amount", {"median_amount": 0.5}))  # a row a group; its size is known when it meets the awards
    j = p.join(m, list(by)).withColumn("times", F.try_divide("amount", "median_amount"))
    return j.filter(F.col("times") > times).select("ada", *by, "amount", "median_amount", "times")


def signer_concentration(d: DataFrame) -> DataFrame:
    """Share of an org's procurement that each signer signs."""
    s = procurement_only(d).filter("signer is not null").groupBy("org", "signer").agg(F.count("*").alias("decisions"), F.sum("amount").alias("spend"))
    return s.withColumn("share", F.col("decisions") / F.sum("decisions").over(Window.partitionBy("org")))


def leading_digits(d: DataFrame) -> DataFrame:
    """First digits of amounts from 1 on, their share and the share that Benford's law expects."""
    digit = F.substring(F.floor("amount").cast("string"), 1, 1).cast("int")
    g = d.filter("amount >= 1").groupBy(digit.alias("digit")).agg(F.count("*").alias("decisions"))
    return g.withColumns({"share": F.col("decisions") / F.sum("decisions").over(Window.partitionBy()), "expected": F.log10(1 + 1 / F.col("digit"))})


def below_threshold(d: DataFrame, threshold: float, band: float = 0.1) -> DataFrame:
    """Procurement in the band just below a threshold, against all below it."""
    p = procurement_only(d).filter((F.col("amount") > 0) & (F.col("amount") < threshold))
    return p.agg(F.count_if(F.col("amount") >= threshold * (1 - band)).alias("in_band"), F.count("*").alias("below")).withColumn("share", F.try_divide("in_band", "below"))


def repeated_subjects(d: DataFrame, least: int = 3, years: int = 2) -> DataFrame:
    """The same supplier and canonical subject again and again over years."""
    g = procurement_only(d).filter("supplier_tax_id is not null").groupBy("supplier_tax_id", canonical_text(F.col("subject")).alias("subject_key"))
    return g.agg(F.count("*").alias("awards"), F.count_distinct("year").alias("years"), F.sum("amount").alias("total")).filter((F.col("awards") >= least) & (F.col("years") >= years))


def late_publications(d: DataFrame, days: int = 15) -> DataFrame:
    """Of each org the decisions published more than so many days after their issue."""
    return d.filter("delay is not null").groupBy("org").agg(F.count("*").alias("decisions"), F.count_if(F.col("delay") > days).alias("late")).withColumn("pct", F.try_divide(F.col("late") * 100, "decisions"))


def per_capita(d: DataFrame, population: DataFrame) -> DataFrame:
    """Procurement spend of each org for each inhabitant. population: org, inhabitants."""
    s = procurement_only(d).groupBy("org").agg(F.sum("amount").alias("spend"))
    return s.join(population, "org").withColumn("per_capita", F.try_divide("spend", "inhabitants"))


def theme_matrix(d: DataFrame, theme) -> DataFrame:
    """Decisions of each org by theme."""
    return d.groupBy("org").pivot("theme", [n for n, _ in V.THEMES] + ["other"]).count().fillna(0) if theme is None else theme_matrix(d.withColumn("theme", theme), None)
