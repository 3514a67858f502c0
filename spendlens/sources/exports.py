"""Reading raw exports and tables, and writing the results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.ids import detail_url
from ..functions.json_fields import as_list, as_map
from ..operators.durable import spread

#: The envelopes and wrappers in which records come.
ENVELOPES = ("decisionResultList", "decisions", "diavgeia_decisions")
WRAPPERS = ("decision", "decisionResult", "data")
DECISIONS = "org string, year int, month int, procurement_stage string, ada string, issue_date string, decision_type string, subject string, url string, amount double, amount_source string, supplier_name string, supplier_tax_id string, signer string, unit string"
SUPPLIERS = "supplier_key string, supplier_name_normalized string, supplier_tax_id string, first_seen string, last_seen string, decision_count bigint, total_amount double"


def unwrap_envelope(text):
    """The decisions of an export as array<string>: a list, one of the known envelopes, or decisionResults.decision(s), one or many; only objects count."""
    m = as_map(text)
    inner = as_map(m["decisionResults"])
    many = lambda x: F.when(F.startswith(x, F.lit("[")), as_list(x)).when(F.startswith(x, F.lit("{")), F.array(x))
    found = F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("[")), as_list(text)), *[F.when(F.startswith(m[k], F.lit("[")), as_list(m[k])) for k in ENVELOPES], many(inner["decision"]), many(inner["decisions"]))
    return F.filter(found, lambda x: F.startswith(x, F.lit("{")))


def unwrap_detail(text):
    """A detail record without the wrapper around it."""
    m = as_map(text)
    return F.coalesce(*[F.when(F.startswith(m[k], F.lit("{")), m[k]) for k in WRAPPERS], text)


def read_exports(spark: SparkSession, root: str, files: str = "search_export.json") -> DataFrame:
    """(org, year, month, ada, record): one row for each decision of all organisations' monthly exports below ``root``.

    Layout: organization_uid=<o>/year=<y>/month=<m>/search_export.json; organisation and months are partition columns, so filters on them prune files.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", files).option("basePath", root).text(f"{root}/organization_uid=*/year=*/month=*/")
    rows = raw.select(F.col("organization_uid").cast("string").alias("org"), F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), F.posexplode(unwrap_envelope(F.col("value"))).alias("pos", "record"))
    return rows.withColumn("ada", as_map(F.col("record"))["ada"])


def read_details(spark: SparkSession, root: str) -> DataFrame:
    """(org, year, month, ada, detail) of the detail records beside the exports; a record without an id has that of its file's name."""
    # The months' folders are listed, not files one by one: with a pattern of files each of them would be a path of its own to list.
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("basePath", root).text(f"{root}/organization_uid=*/year=*/month=*/decisions")
    file = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.json$", 1)
    rows = raw.select(F.col("organization_uid").cast("string").alias("org"), F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), unwrap_detail(F.col("value")).alias("detail"), file.alias("file"))
    return rows.withColumn("ada", F.coalesce(F.nullif(as_map(F.col("detail"))["ada"], F.lit("")), F.col("file"))).drop("file")


def write_details(details: DataFrame, root: str) -> None:
    """Detail records (org, year, month, name, detail), one a file below organization_uid=/year=/month=/decisions, written where they are; for folders that pyarrow reaches."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        made, n = set(), 0
        for batch in batches:
            for org, year, month, name, detail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{base}/organization_uid={quote(org, safe='')}/year={year}/month={month}/decisions"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/{quote(name, safe='')}.json") as f:
                    f.write(detail.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    spread(details.select("org", "year", "month", "name", "detail"), "name").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def first_months(df: DataFrame, n: int) -> DataFrame:
    """The rows of the first n months of each organisation."""
    months = df.select("org", "year", "month").distinct()
    kept = months.withColumn("__n", F.row_number().over(Window.partitionBy("org").orderBy("year", "month"))).filter(F.col("__n") <= n).drop("__n")
    return df.join(kept, ["org", "year", "month"], "left_semi")


def month_range(df: DataFrame, months: str) -> DataFrame:
    """The rows of `YYYY-MM` or `YYYY-MM:YYYY-MM`; a filter on year and month, so that it reaches the partitions."""
    first, _, last = months.partition(":")
    number = lambda m: int(m[:4]) * 100 + int(m[5:7])
    return df.filter((F.col("year") * 100 + F.col("month")).between(number(first), number(last or first)))


def cached_months(df: DataFrame) -> DataFrame:
    """(org, year, month) that are there."""
    return df.select("org", "year", "month").distinct()


def read_flat_details(spark: SparkSession, root: str) -> DataFrame:
    """(org, ada, detail) of a layout org=<o>/ada=<ADA>.json."""
    raw = spark.read.option("wholetext", True).option("basePath", root).text(f"{root}/org=*/*.json")
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(?:ada=)?(.*)\.json$", 1)
    return raw.select(F.col("org").cast("string").alias("org"), name.alias("ada"), unwrap_detail(F.col("value")).alias("detail"))


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "csv") -> DataFrame:
    """A normalised table; CSV with quotes doubled and line ends inside, and always a schema, since tax ids begin with zeros."""
    if kind == "csv":
        return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')
    return spark.read.schema(schema).parquet(path) if kind == "parquet" else spark.read.json(path, schema=schema)


def read_either(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """base.csv, else base.parquet, else an empty table of that schema; asked of the file system that holds them."""
    jvm = spark.sparkContext._jvm
    for kind in ("csv", "parquet"):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}.{kind}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return read_table(spark, f"{base}.{kind}", schema, kind)
    return spark.createDataFrame([], schema)


def search_hits(hits: DataFrame) -> DataFrame:
    """API hits (JSON lines) as flat records: names that differ between sources are one column; those that none has are left out."""
    names = {"ada": ("ada",), "subject": ("subject", "title"), "issue_date": ("issueDate", "issue_date"), "decision_type": ("decisionTypeUid", "decisionTypeId", "decisionType"), "organization": ("organizationLabel", "organizationUid", "organizationId"), "url": ("documentUrl", "url"), "protocol": ("protocolNumber",), "submitted": ("submissionTimestamp",), "published": ("publishTimestamp",)}
    there = {n: [F.col(k).cast("string") for k in keys if k in hits.columns] for n, keys in names.items()}
    return hits.select(*[F.coalesce(*cols).alias(n) for n, cols in there.items() if cols])


def index_rows(exports: DataFrame) -> DataFrame:
    """A light index of exports: (ada, org_uid, issue_date, decision_type, subject, url, year, month)."""
    r = as_map(F.col("record"))
    return exports.select("ada", F.col("org").alias("org_uid"), r["issueDate"].alias("issue_date"), F.coalesce(r["decisionTypeUid"], r["decisionTypeId"]).alias("decision_type"), r["subject"].alias("subject"), detail_url(F.col("ada"), r["documentUrl"]).alias("url"), "year", "month")


def write_by_org(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table below org=<o>; organisations that are not in it keep their files."""
    flat = df if kind == "parquet" else df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])
    flat.write.option("partitionOverwriteMode", "dynamic").partitionBy("org").mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


#: The columns of published tables, in order.
TABLE_COLUMNS = {
    "supplier_clusters": ("cluster_id", "canonical_name", "supplier_tax_id", "member_keys", "decision_count", "total_amount", "first_seen", "last_seen"),
    "contracts": ("contract_id", "amount", "issue_date", "ada", "decision_type", "subject", "supplier_key", "supplier_tax_id", "supplier_name_raw", "stage_count", "stages_seen", "all_adas"),
    "lifecycle": ("ada", "contract_id", "decision_type", "amount", "issue_date"),
}


def write_columns(df: DataFrame, path: str, table: str, kind: str = "csv") -> None:
    """A published table with its columns in their fixed order; those that are not there are null, arrays are joined by bars."""
    kinds = dict(df.dtypes)
    column = lambda c: F.lit(None).cast("string").alias(c) if c not in kinds else F.array_join(c, "|").alias(c) if kinds[c].startswith("array<string") else F.col(c)
    df.select(*[column(c) for c in TABLE_COLUMNS[table]]).write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def monthly_artefacts(d: DataFrame, labels: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Of each (org, year, month): raw_month, its decisions; outliers, those with the longest delays, each decision once; unmapped_codes, type codes without a label among its five most frequent ones.

    d: org, year, month, ada, decision_type_raw, delay_days ...; labels: code, label.
    """
    month = ["org", "year", "month"]
    once = d.withColumn("__n", F.row_number().over(Window.partitionBy(*month, "ada").orderBy(F.desc_nulls_last("delay_days")))).filter("__n = 1")
    late = once.withColumn("__n", F.row_number().over(Window.partitionBy(*month).orderBy(F.desc_nulls_last("delay_days"), "ada"))).filter(F.col("__n") <= top).drop("__n")
    codes = d.filter("decision_type_raw is not null").groupBy(*month, F.col("decision_type_raw").alias("code")).agg(F.count("*").alias("mentions"))
    codes = codes.withColumn("__n", F.row_number().over(Window.partitionBy(*month).orderBy(F.desc("mentions"), "code"))).filter("__n <= 5").drop("__n")
    return {"raw_month": d, "outliers": late, "unmapped_codes": codes.join(labels.filter("label <> ''").select("code"), "code", "left_anti")}


def write_monthly_artefacts(d: DataFrame, labels: DataFrame, path: str, top: int = 10, by: tuple[str, ...] = ("org", "year", "month")) -> None:
    """The artefacts as tables below ``path``, each partitioned by organisation and month (or ``by``); those that are not in ``d`` keep theirs."""
    for name, df in monthly_artefacts(d, labels, top).items():
        df.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")


def write_split(df: DataFrame, good: F.Column | str, path: str, quarantine: str) -> None:
    """Rows that meet a condition to one place, the others to another."""
    condition = F.expr(good) if isinstance(good, str) else good
    condition = F.coalesce(condition, F.lit(False))
    df.filter(condition).write.mode("overwrite").json(path)
    df.filter(~condition).write.mode("overwrite").json(quarantine)


def write_checked(df: DataFrame, path: str, key: str = "ada", required: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> dict[str, int]:
    """``df`` as Parquet at ``path`` if every key is there once and no required column is null; else an error, and what was there stays.

    The checks are metrics of the write itself (rows, repeated, missing), which goes to a folder beside ``path`` and is moved there only if they
    hold. Keys that are null are not compared. Returns the metrics.
    """
    same = Window.partitionBy(key, F.when(F.col(key).isNull(), F.xxhash64(F.to_json(F.struct(*df.columns)))))
    observed = Observation()
    counted = df.withColumn("__n", F.when(F.col(key).isNotNull(), F.count("*").over(same)))
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    repeated = F.col("__n") > 1
    checked = counted.observe(observed, F.count(F.lit(1)).alias("rows"), F.count_if(repeated).alias("repeated"), F.count_if(lacks).alias("missing"), F.min(F.when(repeated, F.col(key).cast("string"))).alias("example")).drop("__n")
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    draft, target, old = hadoop(f"{path}.draft-{uuid.uuid4().hex}"), hadoop(path), hadoop(f"{path}.old-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    checked.write.partitionBy(*by).parquet(draft.toString())
    found = observed.get
    if found["repeated"] or found["missing"]:
        fs.delete(draft, True)
        raise ValueError(f"{path} not written: {found['repeated']} rows with a repeated {key} (such as {found['example']}), {found['missing']} without {', '.join(required)}")
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(draft, target):
        fs.rename(old, target)
        raise OSError(f"{path}: the new table could not be moved to its place")
    fs.delete(old, True)
    return {k: found[k] for k in ("rows", "repeated", "missing")}


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """JSON documents below key=<value>, written by all cores: a small table of many keys is as many files as keys. Tasks move their files to their place."""
    spread(df, key).write.partitionBy(key).mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def union_of(*tables: DataFrame) -> DataFrame:
    """Rows of all tables with the columns of all; null where a table has none."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first
