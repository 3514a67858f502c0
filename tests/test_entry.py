import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from spendlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_import_the_training_data_operators():
    top = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(top, "spendlens")):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"^\s*(from|import)\s.*\bllm\b", open(os.path.join(folder, f), encoding="utf-8").read(), re.M)


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return float(f"{float(value):.9g}") if hasattr(value, "as_tuple") else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


FAST = [n for n in registry.oracle_sql() if n.split("_")[0] in {"sig", "set2", "set3", "agg2", "agg3", "agg7", "agg26", "join4", "prj1", "prj2", "jsn3", "cls10", "ord8", "doc", "num1", "dat2", "idn1", "jsn8", "src1", "cls12"}]


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    answer = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(plain(r[names.index(c)])) for c in cols) for r in answer.fetchall())
    assert sorted(tuple(str(plain(r[c])) for c in cols) for r in df.collect()) == want


def test_decisions_do_not_depend_on_the_plan(spark, duck):
    """Amounts and suppliers stay with their decision where nothing is broadcast and partitions are many and small."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        test_query_agrees_with_sql(spark, duck, "prj1_normalize_decisions")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("gone", [("spendlens/llm", "tests/llm"), ("spendlens/llm", "tests/llm", "corpus_pipeline.py")])
def test_missing_training_data_operators_are_left_out(tmp_path, gone):
    """On a copy of the library without their folders the other queries are there, SQL too."""
    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(top, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n.startswith((".", "__pycache__")) or os.path.relpath(os.path.join(d, n), top) in gone])
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True).stdout
    names, sql = (set(line.split()[1:]) for line in said.strip().splitlines()[-2:])
    assert names == set(registry.queries()) and sql == set(registry.oracle_sql())
