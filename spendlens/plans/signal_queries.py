"""Signals over the order lines. Thresholds fit these tables: with the published ones some rules find nothing here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as S
from .registry import query
from .views import D, P, decisions

EMERGENCY = "regexp_matches(lower(subject), 'διαπραγμάτευσ|αδυναμία ανταγωνισμ|αδυναμια ανταγωνισμ|μοναδικός προμηθευτ|μοναδικος προμηθευτ')"
SHARES = f"""{D}, {P}, s AS (SELECT year, org AS entity, sum(amount) AS total, count(*) AS awards FROM p WHERE amount > 0 GROUP BY ALL),
t AS (SELECT *, sum(total) OVER (PARTITION BY year) AS year_total, total / sum(total) OVER (PARTITION BY year) AS share FROM s)"""


@query("sig_t8a_supplier_share", f"WITH {SHARES} SELECT year, entity, round(total, 2) AS total, awards, round(year_total, 2) AS year_total, round(share, 6) AS share FROM t WHERE share >= 0.05")
def supplier_share(spark, sf_dir):
    s = S.supplier_share(decisions(spark, sf_dir), 0.05, "org")
    return s.select("year", "entity", F.round("total", 2).alias("total"), "awards", F.round("year_total", 2).alias("year_total"), F.round("share", 6).alias("share"))


@query("sig_t8b_persistent_share", f"WITH {SHARES}, i AS (SELECT *, year - row_number() OVER (PARTITION BY entity ORDER BY year) AS island FROM t WHERE share >= 0.04) SELECT entity, min(year) AS first_year, max(year) AS last_year, count(*) AS years, round(avg(share), 6) AS avg_share, round(sum(total), 2) AS total FROM i GROUP BY entity, island HAVING count(*) >= 2")
def persistent_share(spark, sf_dir):
    s = S.persistent_share(decisions(spark, sf_dir), 0.04, 2, "org")
    return s.select("entity", "first_year", "last_year", "years", F.round("avg_share", 6).alias("avg_share"), F.round("total", 2).alias("total"))


@query("sig_t5a_emergency_rate", f"""WITH {D}, {P}, r AS (SELECT year, count(*) AS procurements, count(*) FILTER ({EMERGENCY}) AS emergencies FROM p GROUP BY year),
s AS (SELECT year, list(subject ORDER BY n) AS samples FROM (SELECT year, subject, row_number() OVER (PARTITION BY year ORDER BY issue_date, ada, subject) AS n FROM p WHERE {EMERGENCY}) WHERE n <= 3 GROUP BY year)
SELECT r.year, procurements, emergencies, emergencies / procurements AS share, array_to_string(samples, ' | ') AS samples FROM r LEFT JOIN s USING (year) WHERE emergencies / procurements >= 0.15""")
def emergency_rate(spark, sf_dir):
    return S.emergency_rate(decisions(spark, sf_dir)).withColumn("samples", F.array_join("samples", " | "))


@query("sig_t5b_emergency_high_value", f"WITH {D}, {P} SELECT ada, issue_date, amount, supplier_name, subject FROM p WHERE {EMERGENCY} AND amount > 60000")
def emergency_high_value(spark, sf_dir):
    return S.emergency_high_value(decisions(spark, sf_dir))


@query("sig_t5s_emergency_overall", f"WITH {D}, {P} SELECT count(*) AS procurements, count(*) FILTER ({EMERGENCY}) AS emergencies, count(*) FILTER ({EMERGENCY}) / count(*) AS share FROM p")
def emergency_overall(spark, sf_dir):
    return S.emergency_overall(decisions(spark, sf_dir))


@query("sig_t6a_year_end", f"""WITH {D}, y AS (SELECT year, count(*) AS decisions, count(*) FILTER (month = 12 AND day(issue_date) >= 22) AS late FROM d GROUP BY year HAVING count(*) >= 300)
SELECT year, decisions, late, late / 10 AS late_rate, (decisions - late) / 355 AS base_rate, (late / 10) / ((decisions - late) / 355) AS times FROM y WHERE (late / 10) / ((decisions - late) / 355) >= 0.9""")
def year_end(spark, sf_dir):
    return S.year_end_rush(decisions(spark, sf_dir), 0.9, 300)


@query("sig_t6b_weekend", f"WITH {D} SELECT ada, issue_date, CAST(isodow(issue_date) - 1 AS INT) AS weekday, amount, decision_type FROM d WHERE isodow(issue_date) >= 6 AND amount >= 5000 ORDER BY amount DESC, ada LIMIT 20")
def weekend(spark, sf_dir):
    return S.weekend_awards(decisions(spark, sf_dir))


@query("sig_t6c_holiday", f"WITH {D} SELECT ada, issue_date, amount, decision_type FROM d WHERE strftime(issue_date, '%m-%d') IN ('01-01', '01-06', '03-25', '05-01', '08-15', '10-28', '12-25', '12-26') AND amount >= 5000 ORDER BY amount DESC, ada LIMIT 10")
def holiday(spark, sf_dir):
    return S.holiday_awards(decisions(spark, sf_dir))


@query("sig_t6d_monthly_spike", f"WITH {D}, m AS (SELECT year, month, count(*) AS decisions FROM d GROUP BY ALL), a AS (SELECT *, avg(decisions) OVER (PARTITION BY year) AS mean FROM m) SELECT year, month, decisions, round(mean, 6) AS mean, round(decisions / mean, 6) AS times FROM a WHERE decisions / mean >= 1.05")
def monthly_spike(spark, sf_dir):
    return S.monthly_spike(decisions(spark, sf_dir), 1.05).withColumns({"mean": F.round("mean", 6), "times": F.round("times", 6)})


@query("sig_t9a_committee", f"""WITH {D}, {P}, b AS (SELECT substr(regexp_replace(trim(regexp_extract(subject, '(ΕΠΙΤΡΟΠ[ΗΣ\\p{{L}}\\p{{N}}_\\s]{{0,40}}?(?:ΣΥΝΤΗΡ|ΑΝΑΘΕΣ|ΕΚΤΕΛ|ΔΙΑΧΕΙΡ|ΑΞΙΟΛΟΓ)[Α-Ωα-ω\\s]{{0,30}})', 1)), '\\s+', ' ', 'g'), 1, 60) AS body FROM p),
c AS (SELECT body, count(*) AS awards, sum(count(*)) OVER ()::BIGINT AS total_awards FROM b GROUP BY body) SELECT body, awards, total_awards, awards / total_awards AS share FROM c WHERE body <> '' AND awards / total_awards >= 0.1""")
def committee(spark, sf_dir):
    return S.committee_capture(decisions(spark, sf_dir), 0.1)


PRICED = f"{D}, {P}, q AS (SELECT * FROM p WHERE amount > 0 AND amount % 100 <> 0 AND supplier_tax_id IS NOT NULL)"


@query("sig_t9b_copied_amounts", f"WITH {PRICED} SELECT supplier_tax_id, amount, count(ada) AS occurrences, min(supplier_name) AS supplier_name, array_to_string(list_slice(list(CAST(issue_date AS VARCHAR) ORDER BY issue_date), 1, 5), ',') AS dates FROM q GROUP BY supplier_tax_id, amount HAVING count(ada) >= 2")
def copied(spark, sf_dir):
    d = S.copied_amounts(decisions(spark, sf_dir))
    return d.withColumn("dates", F.array_join(F.transform("dates", lambda x: x.cast("string")), ","))


@query("sig_t9c_award_burst", f"""WITH {D}, a AS (SELECT * FROM d WHERE decision_type = 'Procurement assignment' AND supplier_tax_id IS NOT NULL),
w AS (SELECT supplier_tax_id, issue_date, count(*) OVER x AS n, max(issue_date) OVER x AS e, sum(amount) OVER x AS t FROM a WINDOW x AS (PARTITION BY supplier_tax_id ORDER BY issue_date RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAYS FOLLOWING)),
f AS (SELECT *, row_number() OVER (PARTITION BY supplier_tax_id ORDER BY issue_date) AS k FROM w WHERE n >= 3) SELECT supplier_tax_id, issue_date AS window_start, CAST(e AS DATE) AS window_end, n AS awards_in_window, round(t, 2) AS total_amount FROM f WHERE k = 1""")
def burst(spark, sf_dir):
    return S.award_burst(decisions(spark, sf_dir)).withColumn("total_amount", F.round("total_amount", 2))


@query("sig_t9d_standard_prices", f"WITH {D.replace('l_extendedprice AS amount', 'round(l_extendedprice / 10) + 0.5 AS amount')}, {P}, q AS (SELECT * FROM p WHERE amount > 0 AND amount % 100 <> 0 AND supplier_tax_id IS NOT NULL) SELECT amount, count(DISTINCT supplier_tax_id) AS distinct_suppliers, count(ada) AS occurrences FROM q GROUP BY amount HAVING count(DISTINCT supplier_tax_id) >= 3")
def standard(spark, sf_dir):
    return S.standard_prices(decisions(spark, sf_dir).withColumn("amount", F.round(F.col("amount") / 10) + 0.5))


@query("sig_registry_findings", f"""WITH {PRICED}, w AS (SELECT ada, issue_date, amount FROM d WHERE isodow(issue_date) >= 6 AND amount >= 5000 ORDER BY amount DESC, ada LIMIT 20),
h AS (SELECT ada, issue_date, amount FROM d WHERE strftime(issue_date, '%m-%d') IN ('01-01', '01-06', '03-25', '05-01', '08-15', '10-28', '12-25', '12-26') AND amount >= 5000 ORDER BY amount DESC, ada LIMIT 10),
y AS (SELECT year, count(*) AS n, count(*) FILTER (month = 12 AND day(issue_date) >= 22) AS l FROM d GROUP BY year HAVING count(*) >= 3000), m AS (SELECT year, month, count(*) AS n, avg(count(*)) OVER (PARTITION BY year) AS a FROM d GROUP BY year, month)
SELECT 'T9B' AS tenet, 'copied_amount' AS rule, supplier_tax_id AS entity, CAST(NULL AS VARCHAR) AS period, CAST(count(ada) AS DOUBLE) AS metric, 2.0::DOUBLE AS threshold FROM q GROUP BY supplier_tax_id, amount HAVING count(ada) >= 2
UNION ALL SELECT 'T6', 'weekend', ada, CAST(issue_date AS VARCHAR), amount, 5000.0 FROM w UNION ALL SELECT 'T6', 'holiday', ada, CAST(issue_date AS VARCHAR), amount, 5000.0 FROM h
UNION ALL SELECT 'T6', 'year_end', NULL, CAST(year AS VARCHAR), round((l / 10) / ((n - l) / 355), 6), 3.0 FROM y WHERE (l / 10) / ((n - l) / 355) >= 3
UNION ALL SELECT 'T6', 'monthly_spike', NULL, year || '-' || month, round(n / a, 6), 2.5 FROM m WHERE n / a >= 2.5""")
def findings(spark, sf_dir):
    return S.detect(decisions(spark, sf_dir), ["T9B", "T6"]).withColumn("metric", F.round("metric", 6))
