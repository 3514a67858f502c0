"""Linking queries over orders, and records built from order lines and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json_fields as J
from ..functions import vocabulary as V
from ..functions.classify import is_recurring
from ..operators import linking as L
from ..operators import normalize, summary
from ..operators.durable import shared_dir, spread, stored
from ..sources import exports as X
from .registry import query
from .views import D, O, decisions, orders

#: Pairs that match: near in amount and date, of one supplier, left once.
PAIRS = f"""{O}, e AS (SELECT a.id AS src, b.id AS dst FROM o a JOIN o b ON a.id < b.id AND a.supplier_tax_id = b.supplier_tax_id AND abs(a.amount - b.amount) / greatest(a.amount, b.amount) <= 0.02 AND abs(a.issue_date - b.issue_date) <= 180)"""
COMPONENTS = f"{PAIRS.replace('WITH ', '')}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r(id, c) AS (SELECT id, id FROM o UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.id AND r.c < b.dst), g AS (SELECT id, min(c) AS component FROM r GROUP BY id)"


def members(spark, sf_dir):
    return stored(L.contract_members(orders(spark, sf_dir)))


#: Orders with their amounts and days as they are, some without date or supplier.
PARTIAL = f"""{O}, c AS (SELECT id, amount, CASE WHEN id % 11 > 0 THEN issue_date END AS issue_date, CASE WHEN id % 13 > 0 THEN supplier_tax_id END AS supplier_tax_id FROM o)"""


def partial(spark, sf_dir):
    o = orders(spark, sf_dir).withColumns({"issue_date": F.when(F.col("id") % 11 > 0, F.col("issue_date")), "supplier_tax_id": F.when(F.col("id") % 13 > 0, F.col("supplier_tax_id"))})
    return o.select("id", "amount", "issue_date", "supplier_tax_id")


@query("join4_tolerance_pairs", f"""WITH {PARTIAL}, f AS (SELECT amount, issue_date, supplier_tax_id, min(id) AS id FROM c WHERE amount > 0 GROUP BY ALL),
k AS (SELECT *, CAST(floor(ln(amount) / -ln(1 - 0.02) * 0.999999) AS BIGINT) AS k FROM f), n AS (SELECT *, unnest([k - 1, k, k + 1]) AS j FROM k)
SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, 'pair' AS kind FROM k a JOIN n b ON a.k = b.j AND a.id < b.id AND abs(a.amount - b.amount) / greatest(a.amount, b.amount) <= 0.02
 AND coalesce(a.supplier_tax_id = b.supplier_tax_id, true) AND coalesce(abs(a.issue_date - b.issue_date) <= 180, true)
UNION ALL SELECT c.id, f.id, 'member' FROM c JOIN f ON c.amount = f.amount AND c.issue_date IS NOT DISTINCT FROM f.issue_date AND c.supplier_tax_id IS NOT DISTINCT FROM f.supplier_tax_id WHERE c.id <> f.id""")
def tolerance_pairs(spark, sf_dir):
    return L.tolerance_classes(partial(spark, sf_dir))


@query("join7_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM g")
def components(spark, sf_dir):
    return members(spark, sf_dir).select("id", "component")


CONTRACTS = f"""{COMPONENTS}, m AS (SELECT o.*, component, CASE decision_type WHEN 'ΚΑΤΑΚΥΡΩΣΗ' THEN 10 WHEN 'ΣΥΜΒΑΣΗ' THEN 9 WHEN 'ΑΝΑΛΗΨΗ ΥΠΟΧΡΕΩΣΗΣ' THEN 6 WHEN 'ΕΓΚΡΙΣΗ ΔΑΠΑΝΗΣ' THEN 4 ELSE 8 END AS authority FROM o JOIN g USING (id)),
n AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY authority DESC, issue_date, id) AS k FROM m), s AS (SELECT component, count(*) AS stage_count, array_to_string(list_sort(list_distinct(list(decision_type))), '|') AS stages_seen, array_to_string(list(ada ORDER BY id), '|') AS all_adas FROM m GROUP BY 1),
c AS (SELECT n.component, 'contract:' || substr(sha1(printf('%.2f', amount) || '|' || strftime(issue_date, '%Y-%m') || '|' || supplier_key), 1, 12) AS contract_id, amount, issue_date, ada, decision_type, supplier_key, stage_count, stages_seen, all_adas FROM n JOIN s USING (component) WHERE k = 1)"""


@query("agg4_contracts", f"WITH RECURSIVE {CONTRACTS} SELECT contract_id, amount, issue_date, ada, decision_type, supplier_key, stage_count, stages_seen, all_adas FROM c")
def contracts(spark, sf_dir):
    c = L.contracts(members(spark, sf_dir))
    return c.select("contract_id", "amount", "issue_date", "ada", "decision_type", "supplier_key", "stage_count", F.array_join("stages_seen", "|").alias("stages_seen"), F.array_join("all_adas", "|").alias("all_adas"))


@query("agg5_lifecycle", f"WITH RECURSIVE {CONTRACTS} SELECT m.ada, contract_id, m.decision_type, m.amount, m.issue_date FROM m JOIN c USING (component)")
def lifecycle(spark, sf_dir):
    m = members(spark, sf_dir)
    return L.lifecycle(m, L.contracts(m))


@query("agg7_savings", f"WITH RECURSIVE {CONTRACTS} SELECT round((SELECT sum(amount) FROM o), 2) AS raw_spend, round(sum(amount), 2) AS clean_spend, count(*) AS contracts, count(*) FILTER (stage_count > 1) AS multi_stage, round(((SELECT sum(amount) FROM o) - sum(amount)) * 100 / (SELECT sum(amount) FROM o), 6) AS removed_pct FROM c")
def savings(spark, sf_dir):
    m = members(spark, sf_dir)
    return L.savings(m, L.contracts(m)).withColumns({"raw_spend": F.round("raw_spend", 2), "clean_spend": F.round("clean_spend", 2), "removed_pct": F.round("removed_pct", 6)})


@query("agg12_executive", f"WITH RECURSIVE {CONTRACTS}, y AS (SELECT count(DISTINCT ada) AS n, min(year(issue_date)) AS a, max(year(issue_date)) AS z FROM o) SELECT n AS decisions, CAST(a AS INT) AS first_year, CAST(z AS INT) AS last_year, round((SELECT sum(amount) FROM o), 2) AS raw_spend, (SELECT count(*) FROM o) AS procurements, round(sum(amount), 2) AS clean_spend, count(*) AS contracts FROM c, y GROUP BY ALL")
def executive(spark, sf_dir):
    m = members(spark, sf_dir)
    months = summary.monthly_summary(m.withColumns({"year": F.year("issue_date"), "month": F.month("issue_date"), "detail_enriched": F.lit(False)}), F.lit(True))
    return summary.executive(months, m, L.contracts(m)).withColumns({"raw_spend": F.round("raw_spend", 2), "clean_spend": F.round("clean_spend", 2)})


@query("agg6_contracts_without_amount", f"WITH {O} SELECT id, 'contract:' || substr(sha1(ada), 1, 12) AS contract_id, 0.0::DOUBLE AS amount, ada, decision_type, 1 AS stage_count FROM o WHERE id % 5 = 0")
def contracts_without_amount(spark, sf_dir):
    """A fifth of the decisions have no amount, or none above 0: each of them is a contract of its own, with amount 0."""
    o = orders(spark, sf_dir).withColumn("amount", F.when(F.col("id") % 5 > 0, F.col("amount")).when(F.col("id") % 2 == 0, F.lit(0.0)))
    c = L.contracts(L.contract_members(o)).filter("amount = 0")
    return c.select(F.col("component").alias("id"), "contract_id", "amount", "ada", "decision_type", F.col("stage_count").cast("int").alias("stage_count"))


@query("ord9_largest_contracts", f"WITH RECURSIVE {CONTRACTS} SELECT contract_id, amount, ada, stage_count FROM c ORDER BY amount DESC, ada LIMIT 20")
def largest_contracts(spark, sf_dir):
    return L.contracts(members(spark, sf_dir)).orderBy(F.desc("amount"), "ada").limit(20).select("contract_id", "amount", "ada", "stage_count")


@query("join9_revocations", f"WITH {O}, r AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'O-' || (id // 2) END AS t FROM o), b AS (SELECT t, arg_max(ada, id) AS revoked_by FROM r WHERE t IS NOT NULL GROUP BY t) SELECT o.id, revoked_by FROM o LEFT JOIN b ON o.ada = b.t")
def revocations(spark, sf_dir):
    d = orders(spark, sf_dir).withColumn("revokes_ada", F.when(F.col("id") % 5 == 0, F.concat(F.lit("o-"), F.floor(F.col("id") / 2).cast("string"))))
    return L.revocations(d, F.col("id")).select("id", "revoked_by")


def titled(spark, sf_dir):
    """Order lines as decisions of linked records: the line's place in its order of columns is the id."""
    d = decisions(spark, sf_dir)
    key = F.xxhash64("ada", "issue_date", "amount", "subject", "supplier_name", "org", "signer", "quantity")
    return d.select(key.alias("id"), "ada", "amount", "issue_date", F.col("subject").alias("title"), "decision_type", "decision_type_raw", F.concat(F.lit("tax:"), "supplier_tax_id").alias("supplier_key")).dropDuplicates(["id"])


@query("join5_duplicate_pairs")
def duplicate_pairs(spark, sf_dir):
    # Cents of whole thousands here, so that amounts meet.
    return L.duplicate_pairs(titled(spark, sf_dir).withColumn("amount", F.round(F.col("amount"), -3)))


@query("join6_lifecycle_pairs")
def lifecycle_pairs(spark, sf_dir):
    return L.lifecycle_pairs(titled(spark, sf_dir).withColumn("amount", F.round(F.col("amount"), -3)))


def groups(spark, sf_dir):
    return L.grouped(stored(titled(spark, sf_dir).withColumn("amount", F.round(F.col("amount"), -3))))


@query("agg30_group_summary")
def group_summary(spark, sf_dir):
    return L.group_summary(groups(spark, sf_dir))


@query("agg29_top_events")
def top_events(spark, sf_dir):
    g = groups(spark, sf_dir)
    tags = F.when(is_recurring(F.col("title")), F.array(F.lit("recurring service"))).otherwise(F.array().cast("array<string>"))
    return L.top_events(g.withColumns({"tags": tags, "is_revocation": F.contains("title", F.lit("ανάκληση"))}))


def records(spark, sf_dir):
    """Orders as raw export records with the shapes that sources use, and detail records of every second one."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    european = F.translate(F.format_number("o_totalprice", 2), ".,", ",.")
    k, tax = F.col("o_orderkey") % 4, F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    ada = F.concat(F.lit("O-"), F.col("o_orderkey").cast("string"))
    text = lambda s: F.to_json(s)
    plain = text(F.struct(ada.alias("ada"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("issueDate"), F.lit("Δ.1").alias("decisionTypeUid"), F.concat(F.lit("Αρ. 123456 "), "o_orderpriority").alias("subject"), european.alias("amountWithVAT"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("supplierName"), F.concat(F.lit("EL"), tax).alias("supplierAFM")))
    pairs = text(F.struct(ada.alias("ada"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("decisionDate"), F.lit("Β.2.1").alias("decisionTypeUid"), F.col("o_orderpriority").alias("title"), F.array(F.struct(F.lit("Ποσό δαπάνης").alias("label"), european.alias("value")), F.struct(F.lit("Επωνυμία αναδόχου").alias("label"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("value")), F.struct(F.lit("ΑΦΜ αναδόχου").alias("label"), tax.alias("value"))).alias("extraFieldValues")))
    nested = text(F.struct(ada.alias("ada"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("issueDate"), F.lit("Δ.2.2").alias("decisionTypeUid"), F.col("o_orderpriority").alias("subject"), F.struct(F.struct(F.lit("999").alias("amount")).alias("subject"), F.struct(F.col("o_totalprice").alias("amount"), F.lit("EUR").alias("currency")).alias("awardAmount"), F.array(F.struct(tax.alias("afm"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"))).alias("contractor")).alias("extraFieldValues")))
    bare = text(F.struct(ada.alias("ada"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("issueDate"), F.lit("Γ.2").alias("decisionTypeUid"), F.concat(F.lit("Θέμα 2.000.000 "), "o_orderpriority").alias("subject")))
    record = F.when(k == 0, plain).when(k == 1, pairs).when(k == 2, nested).otherwise(bare)
    detail = F.when(F.col("o_orderkey") % 8 == 3, text(F.struct(F.struct(ada.alias("ada"), european.alias("amountWithVAT"), F.struct(F.lit("Ann").alias("firstName"), F.lit("Lee").alias("lastName")).alias("signerName"), F.lit("Unit 7").alias("unitName")).alias("decision"))))
    return o.select(F.lit("org").alias("org"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), ada.alias("ada"), record.alias("record"), detail.alias("detail"))


@query("prj1_normalize_decisions", """WITH k AS (SELECT *, o_orderkey % 4 AS k, o_orderkey % 8 = 3 AS det FROM orders) SELECT 'O-' || o_orderkey AS ada, CAST(o_orderdate AS DATE) AS issue_date, CASE k WHEN 0 THEN 'Procurement assignment' WHEN 1 THEN 'Expenditure approval' WHEN 2 THEN 'Contract award' ELSE 'Personnel change' END AS decision_type,
CASE k WHEN 0 THEN 'Αρ. 123456 ' WHEN 3 THEN 'Θέμα 2.000.000 ' ELSE '' END || o_orderpriority AS subject, CASE WHEN k < 3 OR det THEN o_totalprice END AS amount,
CASE k WHEN 0 THEN 'search_export:amountWithVAT' WHEN 1 THEN 'search_export:extraFieldValues[0].extraFieldValues[Ποσό δαπάνης]' WHEN 2 THEN 'search_export:extraFieldValues.awardAmount.amount' ELSE CASE WHEN det THEN 'detail:amountWithVAT' END END AS amount_source,
CASE WHEN k < 3 THEN 'Customer ' || o_custkey END AS supplier_name, CASE WHEN k < 3 THEN lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS supplier_tax_id, CASE WHEN det THEN 'Ann Lee' END AS signer, CASE WHEN det THEN 'Unit 7' END AS unit, det AS detail_enriched FROM k""")
def normalize_decisions(spark, sf_dir):
    r = records(spark, sf_dir)
    details = r.filter("detail is not null").select("org", "year", "month", "ada", X.unwrap_detail(F.col("detail")).alias("detail"))
    d = normalize.normalize_decisions(r.drop("detail"), details)
    return d.select("ada", "issue_date", "decision_type", "subject", "amount", "amount_source", "supplier_name", "supplier_tax_id", "signer", "unit", "detail_enriched")


@query("jsn5_any_amounts", "SELECT 'O-' || o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN o_totalprice END AS amount FROM orders")
def any_amounts(spark, sf_dir):
    return records(spark, sf_dir).select(F.col("ada").alias("id"), J.any_amounts(J.sought(F.col("record"))).alias("amount"))


@query("jsn7_supplier_in_context", "SELECT 'O-' || o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'Customer ' || o_custkey END AS supplier_name, CASE WHEN o_orderkey % 4 IN (0, 2) THEN lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS supplier_tax_id FROM orders")
def supplier_in_context(spark, sf_dir):
    return records(spark, sf_dir).select(F.col("ada").alias("id"), J.supplier_fields_in_context(J.sought(F.col("record"))).alias("s")).select("id", "s.*")


@query("jsn3_deep_records", """SELECT o_orderkey, o_totalprice AS amount, 'search[1].batch.page[0].content.act.extraFieldValues.parts[0].award.amountWithVAT' AS path, o_totalprice AS any_amount, 'Customer ' || o_custkey AS supplier_name, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS supplier_tax_id, 'Ann Lee' AS signer, 'Unit ' || (o_custkey % 5) || ', Desk 2' AS unit FROM orders""")
def deep_records(spark, sf_dir):
    """Records whose amount, supplier and unit lie eight and more levels down."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    customer, tax = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    named = lambda c: F.struct(F.struct(F.struct(c.alias("displayName")).alias("title")).alias("label"))  # noqa: E731  a name three levels down
    unit = F.struct(F.array(named(F.concat(F.lit("Unit "), (F.col("o_custkey") % 5).cast("string"))), named(F.lit("Desk 2"))).alias("name"))
    award = F.struct(F.lit("77").alias("protocol"), F.col("o_totalprice").cast("string").alias("amountWithVAT"), F.struct(tax.alias("afm"), named(customer).alias("name")).alias("contractor"))
    act = F.struct(F.struct(F.lit("5").alias("amount")).alias("subject"), F.struct(F.lit("Ann").alias("firstName"), F.lit("Lee").alias("lastName")).alias("signer"), unit.alias("unitName"), F.struct(F.array(F.struct(award.alias("award"))).alias("parts")).alias("extraFieldValues"))
    page = F.struct(F.array(F.struct(F.struct(act.alias("act")).alias("content"))).alias("page"))
    text = F.concat(F.lit('{"search": ["first", '), F.to_json(F.struct(page.alias("batch"))), F.lit("]}"))
    r = o.select("o_orderkey", J.sought(text).alias("v"))
    r = r.select("o_orderkey", J.amounts(F.col("v")).alias("a"), J.any_amounts(F.col("v")).alias("any_amount"), J.supplier_fields_in_context(F.col("v")).alias("s"), J.labelled_text(F.col("v"), V.SIGNER_KEYS, V.SIGNER_LABELS).alias("signer"), J.labelled_text(F.col("v"), V.UNIT_KEYS, V.UNIT_LABELS).alias("unit"))
    return r.select("o_orderkey", "a.amount", "a.path", "any_amount", "s.*", "signer", "unit")


@query("jsn8_typed_fields", """SELECT 'O-' || o_orderkey AS ada, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN round(o_totalprice + 2.5, 2) WHEN 2 THEN o_totalprice ELSE NULL END AS amount, CASE WHEN o_orderkey % 4 < 2 THEN 'Customer ' || o_custkey END AS supplier_name, CASE WHEN o_orderkey % 4 < 2 THEN lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS supplier_tax_id FROM orders""")
def typed_fields(spark, sf_dir):
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    k, tax = F.col("o_orderkey") % 4, F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    who = F.struct(tax.alias("afm"), F.concat(F.lit("Customer,,"), F.col("o_custkey").cast("string")).alias("name"))
    award = F.to_json(F.struct(F.lit("Δ.1").alias("decisionTypeId"), F.struct(F.struct(F.col("o_totalprice").alias("amount")).alias("awardAmount"), F.array(who).alias("person")).alias("extraFieldValues")))
    paid = F.to_json(F.struct(F.lit("Β.2.1").alias("decisionTypeId"), F.struct(F.array(F.struct(F.struct(F.col("o_totalprice").cast("string").alias("amount")).alias("expenseAmount"), who.alias("sponsorAFMName")), F.struct(F.struct(F.lit("2,5").alias("amount")).alias("expenseAmount"), who.alias("sponsorAFMName"))).alias("sponsor")).alias("extraFieldValues")))
    warrant = F.to_json(F.struct(F.lit("Β.1.3").alias("decisionTypeId"), F.struct(F.struct(F.col("o_totalprice").alias("amount")).alias("amountWithVAT")).alias("extraFieldValues")))
    other = F.to_json(F.struct(F.lit("Γ.3.4").alias("decisionTypeId"), F.struct(F.lit("1.234,56").alias("contractAmount")).alias("extraFieldValues")))
    details = o.select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("ada"), F.when(k == 0, award).when(k == 1, paid).when(k == 2, warrant).otherwise(other).alias("detail"))
    return normalize.typed_patches(details).withColumn("amount", F.round("amount", 2))


@query("jsn9_budget_source", "SELECT 'O-' || o_orderkey AS id, 'Budget ' || (o_custkey % 7) AS budget_source FROM orders")
def budget_source(spark, sf_dir):
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    b = F.concat(F.lit("Budget "), (F.col("o_custkey") % 7).cast("string"))
    r = o.select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("ada"), F.to_json(F.struct(F.lit("x").alias("subject"), F.struct(b.alias("fundingSource")).alias("extraFieldValues"))).alias("record"))
    return r.select(F.col("ada").alias("id"), J.labelled_text(J.sought(F.col("record")), V.BUDGET_KEYS, V.BUDGET_LABELS).alias("budget_source"))


@query("jsn10_id_lists", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_custkey || ',7' ELSE o_custkey || ',9' END AS ids FROM orders")
def id_lists(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"k": F.col("o_orderkey") % 3, "c": F.col("o_custkey").cast("string")})
    text = F.when(F.col("k") == 0, F.col("c")).when(F.col("k") == 1, F.concat(F.lit("["), "c", F.lit(', "7"]'))).otherwise(F.concat(F.lit('[{"uid": "'), "c", F.lit('"}, {"id": 9}]')))
    return o.select("o_orderkey", F.array_join(J.id_list(text), ",").alias("ids"))


@query("jsn12_registry", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS supplier_tax_id, s_name AS legal_name, s_nationkey % 2 = 0 AS is_active, DATE '2001-02-03' + CAST(s_suppkey AS INT) AS registration_date, s_acctbal AS share_capital, 'open' AS primary_activity_code, 'Ann Lee' AS board_members FROM supplier")
def registry_records(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    activity = lambda code, end: F.struct(F.struct(F.lit(code).alias("id"), F.lit("x").alias("descr")).alias("activity"), F.lit("Κύρια").alias("type"), F.lit(end).cast("string").alias("dtTo"))
    person = lambda a, b, end: F.struct(F.lit(a).alias("firstName"), F.lit(b).alias("lastName"), F.lit(end).cast("string").alias("dtTo"))
    r = F.to_json(F.struct(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("afm"), F.col("s_name").alias("coNameEl"), F.struct((F.col("s_nationkey") % 2 == 0).alias("isActive")).alias("status"), F.date_add(F.lit("2001-02-03").cast("date"), F.col("s_suppkey").cast("int")).cast("string").alias("incorporationDate"), F.array(activity("closed", "2010-01-01"), activity("open", None)).alias("activities"), F.array(F.struct(F.col("s_acctbal").cast("string").alias("capitalStock"))).alias("capital"), F.array(person("Bob", "Ray", "2011-01-01"), person("Ann", "Lee", None)).alias("persons")))
    c = J.registry_fields(r)
    return s.select(*[c[n].alias(n) for n in ("supplier_tax_id", "legal_name", "is_active", "registration_date", "share_capital", "primary_activity_code", "board_members")])


@query("src1_read_exports", "SELECT 'org' AS org, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS decisions, count(DISTINCT o_orderkey) AS adas FROM orders WHERE year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199606 AND 199905 GROUP BY ALL")
def read_exports(spark, sf_dir):
    """Export envelopes of about 250 decisions, whatever a month has, written below their months, and the decisions read back."""
    folder = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}"
    r = records(spark, sf_dir)
    pages = r.groupBy("year", "month").agg(F.ceil(F.count("*") / 250).alias("pages"))  # 250 a page on average, so that hardly any has over 500
    r = r.join(pages, ["year", "month"]).withColumn("page", F.pmod(F.xxhash64("ada"), F.col("pages")))
    envelope = F.concat(F.lit('{"decisionResultList": ['), F.array_join(F.collect_list("record"), ", "), F.lit("]}"))
    pages = r.groupBy(F.col("org").alias("organization_uid"), "year", "month", "page").agg(envelope.alias("value")).drop("page")
    pages.repartition("year", "month").write.option("maxRecordsPerFile", 1).partitionBy("organization_uid", "year", "month").text(folder)
    e = X.month_range(X.read_exports(spark, folder, "*.txt"), "1996-06:1999-05")
    return e.groupBy("org", "year", "month").agg(F.count("*").alias("decisions"), F.count_distinct("ada").alias("adas"))


@query("snk1_write_by_org", f"WITH {D} SELECT org, count(*) AS decisions, round(sum(amount), 2) AS amount, count(supplier_tax_id) AS with_tax_id FROM d GROUP BY org")
def write_by_org(spark, sf_dir):
    """Decisions written by organisation as CSV, and read back with a schema."""
    folder = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    X.write_by_org(decisions(spark, sf_dir).select("org", "ada", "subject", "amount", "supplier_tax_id"), folder, "csv")
    d = X.read_table(spark, folder, "ada string, subject string, amount double, supplier_tax_id string, org string")
    return d.groupBy("org").agg(F.count("*").alias("decisions"), F.round(F.sum("amount"), 2).alias("amount"), F.count("supplier_tax_id").alias("with_tax_id"))


@query("src7_search_hits", "SELECT CAST(event_id AS VARCHAR) AS ada, event_type AS decision_type, 'u' || user_id AS organization FROM events")
def search_hits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hits = e.select(F.col("event_id").alias("ada"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("decisionTypeUid"), F.col("event_type").alias("decisionTypeId"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("organizationLabel"))
    return X.search_hits(hits)


@query("src8_event_delays", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, round(epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00') / 86400000000, 6) AS delay FROM events")
def event_delays(spark, sf_dir):
    from ..functions.dates import delay_days

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", J.as_map(F.col("props"))["k"].cast("int").alias("k"), F.round(delay_days(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")), 6).alias("delay"))
