"""The driver's tables in the shape of decisions, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order priorities as decision types: (priority, code, label, label with authority).
TYPES = (
    ("1-URGENT", "Δ.1", "Procurement assignment", "ΑΝΑΘΕΣΗ ΕΡΓΩΝ / ΠΡΟΜΗΘΕΙΩΝ / ΥΠΗΡΕΣΙΩΝ / ΜΕΛΕΤΩΝ"),
    ("2-HIGH", "Δ.2.2", "Contract award", "ΚΑΤΑΚΥΡΩΣΗ"),
    ("3-MEDIUM", "Β.1.3", "Payment warrant", "ΑΝΑΛΗΨΗ ΥΠΟΧΡΕΩΣΗΣ"),
    ("4-NOT SPECIFIED", "Β.2.1", "Expenditure approval", "ΕΓΚΡΙΣΗ ΔΑΠΑΝΗΣ"),
    ("5-LOW", "Δ.2.3", "Contract signing", "ΣΥΜΒΑΣΗ"),
)
#: What subjects say, by return flag and line status.
PHRASES = (
    ("A", "O", "διαπραγμάτευση χωρίς δημοσίευση"),
    ("N", "O", "προμήθεια υλικών, προϋπολογισμός μελέτης 1.234,56 ευρώ"),
    ("N", "F", "ανάθεση υπηρεσίας καθαρισμού"),
    ("R", "O", "ανάκληση απόφασης ΑΒΓΔ-123 και ΑΒΓΔ-456"),
    ("R", "F", "ΕΠΙΤΡΟΠΗ ΔΙΑΧΕΙΡΙ έργου"),
    ("A", "F", "invoice payment"),
)


def _case(col: str, pairs) -> F.Column:
    return F.coalesce(*[F.when(F.col(col) == k, F.lit(v)) for k, v in pairs])


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as decisions: the supplier's nation is the organisation, and every seventh line has no tax id."""
    read = lambda t, *cols: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*cols)
    li = read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority")
    s = read("supplier", F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    n = read("nation", "n_nationkey", "n_name")
    p = read("part", F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    j = li.join(o, "l_orderkey").join(s, "l_suppkey").join(n, "n_nationkey").join(p, "l_partkey")
    phrase = F.coalesce(*[F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), F.lit(t)) for a, b, t in PHRASES])
    day = F.col("l_shipdate").cast("date")
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ada"), F.col("n_name").alias("org"), day.alias("issue_date"), F.year(day).alias("year"), F.month(day).alias("month"),
        _case("o_orderpriority", [(t[0], t[1]) for t in TYPES]).alias("decision_type_raw"), _case("o_orderpriority", [(t[0], t[2]) for t in TYPES]).alias("decision_type"),
        F.concat_ws(" ", "p_name", phrase).alias("subject"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_linenumber") != 7, F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("supplier_tax_id"),
        F.col("s_name").alias("supplier_name"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 40).cast("string")).alias("signer"), F.col("p_brand").alias("unit"), F.col("p_type").alias("cpv"), F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "A").alias("detail_enriched"), F.col("o_orderdate").cast("timestamp").alias("issue_ts"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("timestamp")).alias("publish_ts"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions with unique ids: the customer's nation is the supplier."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    tax = F.lpad(F.col("c_nationkey").cast("string"), 9, "0")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("ada"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("issue_date"),
        _case("o_orderpriority", [(t[0], t[1]) for t in TYPES]).alias("decision_type_raw"), _case("o_orderpriority", [(t[0], t[3]) for t in TYPES]).alias("decision_type"), F.col("o_orderpriority").alias("subject"),
        tax.alias("supplier_tax_id"), F.concat(F.lit("tax:"), tax).alias("supplier_key"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("supplier_name"),
    )


def _sql_case(col: str, pairs) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " END"


D = f"""d AS (
  SELECT l_orderkey || '-' || l_linenumber AS ada, n_name AS org, CAST(l_shipdate AS DATE) AS issue_date, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
    {_sql_case("o_orderpriority", [(t[0], t[1]) for t in TYPES])} AS decision_type_raw, {_sql_case("o_orderpriority", [(t[0], t[2]) for t in TYPES])} AS decision_type,
    p_name || ' ' || CASE {" ".join(f"WHEN l_returnflag = '{a}' AND l_linestatus = '{b}' THEN '{t}'" for a, b, t in PHRASES)} END AS subject,
    l_extendedprice AS amount, CASE WHEN l_linenumber <> 7 THEN lpad(CAST(l_suppkey AS VARCHAR), 9, '0') END AS supplier_tax_id, s_name AS supplier_name,
    'Clerk ' || (o_custkey % 40) AS signer, p_brand AS unit, p_type AS cpv, l_quantity AS quantity, l_returnflag = 'A' AS detail_enriched, o_orderdate AS issue_ts, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS publish_ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
#: The procurement decisions among them.
P = "p AS (SELECT * FROM d WHERE decision_type IN ('Procurement assignment', 'Contract award'))"
#: With the supplier's key.
K = """k AS (SELECT *, CASE WHEN supplier_tax_id IS NOT NULL THEN 'tax:' || supplier_tax_id ELSE 'name:' || substr(sha1(upper(replace(lower(supplier_name), '#', ' '))), 1, 12) END AS supplier_key,
  upper(replace(lower(supplier_name), '#', ' ')) AS supplier_name_normalized FROM d)"""
#: Of those, what counts as procurement: no revocation and no amount above 10 million.
KP = "kp AS (SELECT * FROM k WHERE NOT contains(subject, 'ανάκληση') AND amount <= 10000000)"
O = f"""o AS (
  SELECT o_orderkey AS id, 'O-' || o_orderkey AS ada, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS issue_date, {_sql_case("o_orderpriority", [(t[0], t[3]) for t in TYPES])} AS decision_type,
    lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS supplier_tax_id, 'tax:' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS supplier_key, 'Nation ' || c_nationkey AS supplier_name, o_orderpriority AS subject
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def canonical(x: str) -> str:
    """Canonical text in SQL."""
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^0-9a-zα-ω]+', ' ', 'g'))"
