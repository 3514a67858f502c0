"""Linked records, index rows and supplier normalisation from raw records, and the readers and writers around them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.dates import delay_days
from ..operators import digest as G
from ..operators import entities as E
from ..operators import records as R
from ..operators.durable import shared_dir
from ..sources import exports as X
from .link_queries import contracts, records
from .registry import query
from .rule_queries import CLUSTERS
from .table_queries import keyed, r2
from .views import D, K, decisions

RECORDS = """r AS (SELECT *, o_orderkey % 4 AS k, 'O-' || o_orderkey AS ada, 'Customer ' || o_custkey AS customer, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS tax,
  CASE o_orderkey % 4 WHEN 0 THEN 'Αρ. 123456 ' WHEN 3 THEN 'Θέμα 2.000.000 ' ELSE '' END || o_orderpriority AS subject, CASE o_orderkey % 4 WHEN 0 THEN 'Δ.1' WHEN 1 THEN 'Β.2.1' WHEN 2 THEN 'Δ.2.2' ELSE 'Γ.2' END AS code FROM orders)"""


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("prj2_linked_records", f"""WITH {RECORDS} SELECT ada, subject, CAST(o_orderdate AS DATE) AS issue_date, code AS decision_type_raw, CASE k WHEN 0 THEN 'Procurement assignment' WHEN 1 THEN 'Expenditure approval' WHEN 2 THEN 'Contract award' ELSE 'Personnel change' END AS decision_type, CASE WHEN k < 3 THEN o_totalprice END AS amount,
CASE WHEN k IN (0, 2) THEN customer END AS supplier_name, CASE WHEN k IN (0, 2) THEN tax END AS supplier_tax_id, CASE WHEN k IN (0, 2) THEN 'tax:' || tax END AS supplier_key, CASE WHEN k IN (0, 2) THEN 'vendor' ELSE 'unknown' END AS supplier_type, CASE WHEN k IN (0, 2) THEN 1.0::DOUBLE ELSE 0.0 END AS normalization_confidence,
'org' AS organization_id, false AS missing_subject, false AS is_revocation, 'decision:' || substr(sha1('org|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || ada), 1, 12) AS canonical_id FROM r""")
def linked_records(spark, sf_dir):
    return R.linked_records(records(spark, sf_dir)).select("ada", "subject", "issue_date", "decision_type_raw", "decision_type", "amount", "supplier_name", "supplier_tax_id", "supplier_key", "supplier_type", "normalization_confidence", "organization_id", "missing_subject", "is_revocation", "canonical_id")


@query("prj3_index_rows", f"""WITH {RECORDS} SELECT ada, 'org' AS org_uid, CASE k WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') END AS issue_date, code AS decision_type, CASE WHEN k <> 1 THEN subject END AS subject, 'https://diavgeia.gov.gr/opendata/decisions/' || ada AS url, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month FROM r""")
def index_rows(spark, sf_dir):
    return X.index_rows(records(spark, sf_dir))


@query("prj4_supplier_normalization", f"WITH {D} SELECT supplier_name, supplier_tax_id, upper(replace(supplier_name, '#', ' ')) AS supplier_canonical, 'vendor' AS supplier_type, CASE WHEN supplier_tax_id IS NULL THEN 0.9::DOUBLE ELSE 1.0 END AS normalization_confidence, count(*) AS decisions FROM d GROUP BY ALL")
def supplier_normalization(spark, sf_dir):
    cols = ("supplier_name", "supplier_tax_id", "supplier_canonical", "supplier_type", "normalization_confidence")
    return E.with_supplier_normalization(decisions(spark, sf_dir)).groupBy(*cols).agg(F.count("*").alias("decisions"))


@query("idn2_readable_keys", f"WITH {D} SELECT CASE WHEN supplier_tax_id IS NOT NULL THEN 'tax:' || supplier_tax_id ELSE 'name:' || lower(replace(supplier_name, '#', ' ')) END AS supplier_key, count(*) AS decisions FROM d GROUP BY 1")
def readable_keys(spark, sf_dir):
    key = ids.readable_supplier_key(F.col("supplier_name"), F.col("supplier_tax_id"))
    return decisions(spark, sf_dir).groupBy(key.alias("supplier_key")).agg(F.count("*").alias("decisions"))


@query("src4_first_months", f"WITH {D}, m AS (SELECT org, year, month, row_number() OVER (PARTITION BY org ORDER BY year, month) AS k FROM (SELECT DISTINCT org, year, month FROM d)) SELECT org, year, month, count(*) AS decisions FROM d JOIN m USING (org, year, month) WHERE k <= 3 GROUP BY ALL")
def first_months(spark, sf_dir):
    return X.first_months(decisions(spark, sf_dir), 3).groupBy("org", "year", "month").agg(F.count("*").alias("decisions"))


@query("src6_cached_months", f"WITH {D} SELECT DISTINCT org, year, month FROM d")
def cached_months(spark, sf_dir):
    path = folder(spark, "months")
    decisions(spark, sf_dir).select("org", "year", "month", "ada").repartition("year", "month").write.partitionBy("year", "month").parquet(path)
    return X.cached_months(spark.read.parquet(path))


@query("src3_read_details", "SELECT 'org' AS org, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CASE WHEN o_orderkey % 16 = 3 THEN 'O-' || o_orderkey ELSE 'F-' || o_orderkey END AS ada, CAST(o_totalprice AS VARCHAR) AS amount FROM orders")
def read_details(spark, sf_dir):
    """Detail records, one a file, wrapped and not, most without an id of their own: those have that of their file."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    record = F.to_json(F.struct(F.when(F.col("o_orderkey") % 16 == 3, F.concat(F.lit("O-"), key)).alias("ada"), F.col("o_totalprice").cast("string").alias("amount")))
    text = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit('{"decision": '), record, F.lit("}"))).otherwise(record)
    path = folder(spark, "details")
    X.write_details(o.select(F.lit("org").alias("org"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.concat(F.lit("F-"), key).alias("name"), text.alias("detail")), path)
    d = X.read_details(spark, path)
    return d.select("org", "year", "month", "ada", F.get_json_object("detail", "$.amount").alias("amount"))


@query("snk3_checked_write", f"WITH {D}, u AS (SELECT org, ada, min(amount) AS amount FROM d GROUP BY org, ada) SELECT org, count(*) AS decisions, round(sum(amount), 2) AS amount FROM u GROUP BY org")
def checked_write(spark, sf_dir):
    """One row for each decision, written with its checks, and read back; a second write with repeated ids is refused and leaves the first."""
    path, d = folder(spark, "checked"), decisions(spark, sf_dir).select("org", "ada", "amount")
    one = d.groupBy("org", "ada").agg(F.min("amount").alias("amount"))
    X.write_checked(one.withColumn("key", F.concat_ws("|", "org", "ada")), path, "key", ("amount",), ("org",))
    try:
        X.write_checked(one.unionByName(one).withColumn("key", F.concat_ws("|", "org", "ada")), path, "key", ("amount",), ("org",))
    except ValueError:
        back = spark.read.schema("ada string, amount double, key string, org string").parquet(path)
        return back.groupBy("org").agg(F.count("*").alias("decisions"), F.round(F.sum("amount"), 2).alias("amount"))
    raise AssertionError("repeated ids were written")


@query("src10_read_either", f"WITH {D} SELECT 'csv' AS kind, ada, amount FROM d UNION ALL SELECT 'parquet', ada, amount FROM d WHERE month = 1")
def read_either(spark, sf_dir):
    """CSV where there is one, else Parquet, else nothing."""
    base, d = folder(spark, "either"), decisions(spark, sf_dir).select("ada", "amount", "month")
    d.drop("month").write.option("header", True).csv(f"{base}/one.csv")
    d.filter("month = 1").drop("month").write.parquet(f"{base}/two.parquet")
    one, two, none = (X.read_either(spark, f"{base}/{n}", "ada string, amount double").withColumn("kind", F.lit(k)) for n, k in (("one", "csv"), ("two", "parquet"), ("three", "none")))
    return one.unionByName(two).unionByName(none).select("kind", "ada", "amount")


@query("snk2_fixed_columns", f"WITH {CLUSTERS} SELECT cluster_id, canonical_name, decision_count, total_amount FROM c")
def fixed_columns(spark, sf_dir):
    """Clusters written with their columns in the published order, arrays joined, and read back."""
    path = folder(spark, "clusters")
    c = r2(E.clusters(E.suppliers(keyed(spark, sf_dir))), "total_amount")
    X.write_columns(c, path, "supplier_clusters")
    kinds = {"decision_count": "bigint", "total_amount": "double"}
    back = X.read_table(spark, path, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in X.TABLE_COLUMNS["supplier_clusters"]))
    return back.select("cluster_id", "canonical_name", "decision_count", "total_amount")


@query("snk4_quarantine", f"WITH {D} SELECT CASE WHEN supplier_tax_id IS NOT NULL AND publish_ts IS NOT NULL THEN 'good' ELSE 'malformed' END AS place, count(*) AS decisions, round(sum(amount), 2) AS amount FROM d GROUP BY 1")
def quarantine(spark, sf_dir):
    path = folder(spark, "split")
    X.write_split(decisions(spark, sf_dir).select("ada", "amount", "supplier_tax_id", "publish_ts"), "supplier_tax_id is not null and publish_ts is not null", f"{path}/good", f"{path}/malformed")
    read = lambda n: spark.read.schema("ada string, amount double").json(f"{path}/{n}").groupBy(F.lit(n).alias("place")).agg(F.count("*").alias("decisions"), F.round(F.sum("amount"), 2).alias("amount"))
    return read("good").unionByName(read("malformed"))


@query("snk5_union_of_periods", f"WITH {D} SELECT ada, amount, NULL::VARCHAR AS unit, signer FROM d WHERE month = 1 UNION ALL SELECT ada, amount, unit, NULL FROM d WHERE month = 2")
def union_of_periods(spark, sf_dir):
    """Months with different columns, written as JSON lines with the columns of all and read back."""
    d, path = decisions(spark, sf_dir), folder(spark, "union")
    X.union_of(d.filter("month = 1").select("ada", "amount", "signer"), d.filter("month = 2").select("ada", "amount", "unit")).write.json(path)
    return spark.read.schema("ada string, amount double, unit string, signer string").json(path)


@query("snk6_cluster_documents", f"WITH {CLUSTERS} SELECT cluster_id, canonical_name, decision_count, total_amount FROM c")
def cluster_documents(spark, sf_dir):
    path = folder(spark, "dossiers")
    X.write_documents(r2(E.clusters(E.suppliers(keyed(spark, sf_dir))), "total_amount"), path, "cluster_id")
    return spark.read.schema("cluster_id string, canonical_name string, decision_count bigint, total_amount double").json(path)


@query("snk7_monthly_artefacts", f"""WITH {D}, y AS (SELECT *, epoch_us(publish_ts - issue_ts) / 86400000000 AS delay_days FROM d), u AS (SELECT *, row_number() OVER (PARTITION BY org, year, month, ada ORDER BY delay_days DESC NULLS LAST) AS k FROM y), l AS (SELECT *, row_number() OVER (PARTITION BY org, year, month ORDER BY delay_days DESC NULLS LAST, ada) AS n FROM u WHERE k = 1),
c AS (SELECT org, year, month, decision_type_raw, count(*) AS mentions FROM y GROUP BY ALL)
SELECT 'raw_month' AS artefact, org, year, month, NULL::VARCHAR AS name, count(*) AS value FROM y GROUP BY ALL UNION ALL SELECT 'outliers', org, year, month, ada, n FROM l WHERE n <= 10 UNION ALL SELECT 'unmapped_codes', org, year, month, decision_type_raw, mentions FROM c WHERE decision_type_raw IN ('Β.1.3', 'Δ.2.3')""")
def monthly_artefacts(spark, sf_dir):
    """A month's decisions, its longest delays and its codes without a label, written by organisation and month and read back."""
    from pyspark.sql.window import Window

    d = decisions(spark, sf_dir).withColumn("delay_days", delay_days(F.col("issue_ts"), F.col("publish_ts"))).select("org", "year", "month", "ada", "decision_type_raw", "delay_days")
    labels = spark.createDataFrame([("Δ.1", "a"), ("Δ.2.2", "b"), ("Β.2.1", "c"), ("Δ.2.3", "")], "code string, label string")
    path = folder(spark, "artefacts")
    X.write_monthly_artefacts(d, labels, path, by=("year", "month"))
    raw, outliers, codes = (spark.read.parquet(f"{path}/{n}") for n in ("raw_month", "outliers", "unmapped_codes"))
    month = ["org", "year", "month"]
    nth = F.row_number().over(Window.partitionBy(*month).orderBy(F.desc_nulls_last("delay_days"), "ada"))
    out = raw.groupBy(*month).agg(F.count("*").alias("value")).select(F.lit("raw_month").alias("artefact"), *month, F.lit(None).cast("string").alias("name"), "value")
    out = out.unionByName(outliers.select(F.lit("outliers").alias("artefact"), *month, F.col("ada").alias("name"), nth.cast("long").alias("value")))
    return out.unionByName(codes.select(F.lit("unmapped_codes").alias("artefact"), *month, F.col("code").alias("name"), F.col("mentions").alias("value")))


def digested(spark, sf_dir):
    """The digest of all orders as records: one in five comes twice, the second time with nothing but a protocol number, and one in sixteen has a leaflet beside it without date and type."""
    r = records(spark, sf_dir)
    key = F.substring("ada", 3, 20).cast("long")
    again = r.filter(key % 5 == 0).select("org", "ada", F.to_json(F.struct("ada", F.concat(F.lit("P"), key.cast("string")).alias("protocolNumber"))).alias("record"))
    leaflet = r.filter(key % 16 == 5).select("org", F.concat(F.lit("X"), "ada").alias("ada"), F.to_json(F.struct(F.lit("leaflet").alias("subject"))).alias("record"))
    exports = r.select("org", "ada", "record").unionByName(again).unionByName(leaflet)
    details = r.filter("detail is not null").select("org", "ada", X.unwrap_detail(F.col("detail")).alias("record"))
    return G.digest(exports, details, folder(spark, "digest"))


@query("g2_digest_decisions", f"""WITH {RECORDS} SELECT ada, subject, CAST(o_orderdate AS DATE) AS issue_date, code AS decision_type_raw, CASE WHEN k < 3 OR o_orderkey % 8 = 3 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 8 = 3 THEN 'Ann Lee' END AS signer, CASE WHEN o_orderkey % 5 = 0 THEN 'P' || o_orderkey END AS protocol_number,
CASE WHEN k IN (0, 2) THEN 'tax:' || tax END AS supplier_key, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS duplicates, o_orderkey % 8 = 3 AS enriched FROM r""")
def digest_decisions(spark, sf_dir):
    """Decisions that the digest's checks let through."""
    d = digested(spark, sf_dir).decisions
    return d.select("ada", "subject", "issue_date", "decision_type_raw", "amount", "signer", "protocol_number", "supplier_key", F.col("duplicates").cast("int").alias("duplicates"), "enriched")


@query("g2_digest_stages", """WITH s AS (SELECT count(*) AS n, count_if(o_orderkey % 5 = 0) AS twice, count_if(o_orderkey % 16 = 5) AS leaflets, count_if(o_orderkey % 4 < 3) AS priced, count_if(o_orderkey % 8 = 3) AS detailed, count_if(o_orderkey % 8 = 3 AND o_orderkey % 5 = 0) AS detailed_twice FROM orders)
SELECT 'found' AS stage, n + twice + leaflets AS decisions, priced AS amounts FROM s UNION ALL SELECT 'enriched', n + twice + leaflets, priced + detailed + detailed_twice FROM s UNION ALL SELECT 'unique', n + leaflets, NULL FROM s UNION ALL SELECT 'malformed', leaflets, NULL FROM s UNION ALL SELECT 'decisions', n, NULL FROM s""")
def digest_stages(spark, sf_dir):
    """What each stage counted while it was written."""
    m = digested(spark, sf_dir).metrics
    rows = [(s, m[s]["rows"], m[s].get("amounts")) for s in ("found", "enriched", "unique", "malformed", "decisions")]
    return spark.createDataFrame(rows, "stage string, decisions long, amounts long")


@query("g2_top_events")
def digest_events(spark, sf_dir):
    """From raw records to the largest purchases; tested against plain Python."""
    return digested(spark, sf_dir).events()
