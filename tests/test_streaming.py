import datetime

from spendlens.streaming import monthly


def rows(spark, *given):
    return spark.createDataFrame([(a, "o", datetime.datetime.fromisoformat(d), x, "k") for a, d, x in given], monthly.DECISIONS).coalesce(1)


def run(df, tmp_path, name):
    q = monthly.start(df, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    q.awaitTermination(120)


def test_ids_are_taken_once_over_several_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    for batch in ((("a", "2024-01-01", 1.0), ("a", "2024-01-01", 2.0)), (("a", "2024-01-02", 3.0), ("b", "2024-01-03", 4.0))):
        rows(spark, *batch).write.mode("append").parquet(str(folder))
        run(monthly.first_rows(monthly.read_new_files(spark, str(folder))), tmp_path, "first")
    got = spark.read.parquet(str(tmp_path / "first")).collect()
    assert sorted(r.ada for r in got) == ["a", "b"]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    rows(spark, ("a", "2024-01-01", 1.0), ("b", "2024-01-02", 2.0)).write.parquet(str(folder))
    rows(spark, ("z", "2024-12-01", 5.0)).write.mode("append").parquet(str(folder))
    run(monthly.month_totals(monthly.read_new_files(spark, str(folder), files_a_batch=1)), tmp_path, "totals")
    got = spark.read.parquet(str(tmp_path / "totals")).collect()
    assert [(r.decisions, r.amount) for r in got] == [(2, 3.0)]


def months(spark, *given):
    return spark.createDataFrame([(a, 2024, m, x) for a, m, x in given], "ada string, year int, month int, amount double").coalesce(1)


def test_a_month_that_is_fetched_again_a_year_later_is_merged(spark, tmp_path):
    """Existing rows win, additions are kept however late they are, repeated batches add nothing, rows without a key all stay."""
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def fetch(*given):
        months(spark, *given).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("ada string, year int, month int, amount double").parquet(folder)
        monthly.merge_months(stream, out, mark).awaitTermination(120)
        return sorted((r.ada or "", r.month, r.amount) for r in spark.read.parquet(out).collect())

    first = fetch(("a", 1, 1.0), ("b", 1, 2.0), ("b", 1, 1.5), (None, 1, 9.0))
    assert first == [("", 1, 9.0), ("a", 1, 1.0), ("b", 1, 1.5)]
    fetch(("c", 12, 3.0))
    again = fetch(("a", 1, 100.0), ("d", 1, 4.0), ("d", 2, 5.0))
    assert again == sorted([*first, ("c", 12, 3.0), ("d", 1, 4.0), ("d", 2, 5.0)])
