import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from spendlens.operators import components, entities, linking, normalize, signals
from spendlens.sources import exports

ROW = "id long, ada string, amount double, issue_date date, decision_type string, subject string, supplier_key string, supplier_tax_id string, supplier_name string"


def rows(spark, *given):
    """(amount, date, type, tax id) to decisions."""
    made = [(i, f"A{i}", a, datetime.date.fromisoformat(d) if d else None, t, "s", f"tax:{x}" if x else None, x, "n") for i, (a, d, t, x) in enumerate(given)]
    return spark.createDataFrame(made, ROW)


def linked(spark, *given):
    m = linking.contract_members(rows(spark, *given))
    return m, linking.contracts(m)


def test_stages_become_one_contract(spark):
    m, c = linked(spark, (9.5e6, "2019-11-01", "ΕΓΚΡΙΣΗ ΔΑΠΑΝΗΣ", "1"), (9.5e6, "2019-12-03", "ΚΑΤΑΚΥΡΩΣΗ", "1"), (9.5e6, "2020-01-15", "ΣΥΜΒΑΣΗ", "1"))
    got = c.collect()
    assert len(got) == 1 and got[0].decision_type == "ΚΑΤΑΚΥΡΩΣΗ" and got[0].stage_count == 3 and got[0].all_adas == ["A0", "A1", "A2"]
    s = linking.savings(m, c).first()
    assert (s.raw_spend, s.clean_spend, s.multi_stage) == (28.5e6, 9.5e6, 1)


@pytest.mark.parametrize(("a", "b"), [((100e3, "2022-01-01", "x", "1"), (200e3, "2022-01-01", "x", "1")), ((100e3, "2022-01-01", "x", "1"), (100e3, "2022-01-01", "x", "2")), ((100e3, "2022-01-01", "x", "1"), (100e3, "2024-06-01", "x", "1"))])
def test_what_differs_stays_apart(spark, a, b):
    assert linked(spark, a, b)[1].count() == 2


def test_unknown_dates_and_suppliers_match_any(spark):
    assert linked(spark, (100.0, None, "x", "1"), (101.0, "2020-01-01", "x", None), (102.5, "2020-03-01", "x", "2"), (None, "2020-01-01", "x", "1"))[1].count() == 2


def test_tolerance_is_inclusive_and_one_sided_of_the_larger(spark):
    assert linked(spark, (98.0, "2020-01-01", "x", "1"), (100.0, "2020-06-29", "x", "1"))[1].count() == 1
    assert linked(spark, (97.9, "2020-01-01", "x", "1"), (100.0, "2020-01-01", "x", "1"))[1].count() == 2


def test_pairs_agree_with_a_loop(spark):
    import random

    r = random.Random(4)
    given = [(round(r.uniform(90, 130), 1), f"2020-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" if r.random() < 0.9 else None, "x", r.choice(["1", "2", None])) for _ in range(120)]
    group = list(range(len(given)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (a, d, _, x) in enumerate(given):
        for j, (b, e, _, y) in enumerate(given[:i]):
            near = abs(a - b) / max(a, b) <= 0.02 and (not d or not e or abs((datetime.date.fromisoformat(d) - datetime.date.fromisoformat(e)).days) <= 180)
            if near and (x is None or y is None or x == y):
                p, q = find(i), find(j)
                group[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in linking.contract_members(rows(spark, *given)).collect()}
    assert got == {i: find(i) for i in range(len(given))}


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 200)] + [(300, 300), (None, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 200)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_four_stages_are_one_purchase(spark):
    given = [("Γ1", "Δ.2.3", "Σύμβαση καθαρισμού"), ("Γ2", "Β.1.1", "Ανάληψη υποχρέωσης καθαρισμού"), ("Γ3", None, "Τιμολόγιο καθαρισμού"), ("Γ4", "Β.2.1", "Πληρωμή καθαρισμού")]
    d = spark.createDataFrame([(i, a, 5000.0, datetime.date(2024, 3, 1 + i), t, None, c, "tax:123456789") for i, (a, c, t) in enumerate(given)], "id long, ada string, amount double, issue_date date, title string, decision_type string, decision_type_raw string, supplier_key string")
    got = linking.grouped(d).collect()
    assert {g.group for g in got} == {0} and {g.group_size for g in got} == {4} and {g.canonical_ada for g in got} == {"Γ1"} and all(g.is_purchase for g in got)


def test_revocations_point_back(spark):
    d = spark.createDataFrame([(1, "ΑΒΓΔ-1", None), (2, "ΑΒΓΔ-2", "αβγδ-1"), (3, "ΑΒΓΔ-3", "ΑΒΓΔ-1"), (4, "ΑΒΓΔ-4", "ΖΖΖΖ-9")], "id long, ada string, revokes_ada string")
    assert {r.ada: r.revoked_by for r in linking.revocations(d, F.col("id")).collect()} == {"ΑΒΓΔ-1": "ΑΒΓΔ-3", "ΑΒΓΔ-2": None, "ΑΒΓΔ-3": None, "ΑΒΓΔ-4": None}


def test_clusters(spark):
    s = spark.createDataFrame([("tax:1", "ALPHA", "EL123456789", 1, 10.0), ("tax:2", "ALPHA LONG", "123456789", 2, 20.0), ("name:a", "BETA", None, 1, 5.0), ("name:b", "BETA", None, 1, 6.0), ("name:c", None, None, 1, 7.0)], "supplier_key string, supplier_name_normalized string, supplier_tax_id string, decision_count long, total_amount double")
    d = s.withColumns({"first_seen": F.lit(None).cast("date"), "last_seen": F.lit(None).cast("date")})
    got = {tuple(r.member_keys): (r.canonical_name, r.supplier_tax_id, r.total_amount) for r in entities.clusters(d).collect()}
    assert got == {("tax:1", "tax:2"): ("ALPHA LONG", "123456789", 30.0), ("name:a", "name:b"): ("BETA", None, 11.0), ("name:c",): (None, None, 7.0)}


def test_registry_flags(spark):
    day = datetime.date
    s = spark.createDataFrame([(k, f"tax:{k}", 200_000.0, day(2020, 6, 1)) for k in "abcde"], "supplier_tax_id string, supplier_key string, total_amount double, first_seen date")
    r = spark.createDataFrame([("a", "found", True, "5000", day(2010, 1, 1)), ("b", "not_found", False, "0", day(2020, 1, 1)), ("c", "found", False, "20000", day(2020, 1, 1)), ("d", "found", True, "20000", day(2020, 7, 1))], "supplier_tax_id string, lookup_status string, is_active boolean, share_capital string, registration_date date")
    got = {x.supplier_tax_id: (x.flag_no_record, x.flag_inactive, x.flag_low_capital, x.flag_recently_registered) for x in entities.enrich(s, r).collect()}
    assert got == {"a": (False, False, True, False), "b": (True, False, False, False), "c": (False, True, False, True), "d": (False, False, False, False), "e": (True, False, False, False)}


def award(spark, *given):
    """(day, amount, tax id) to direct awards."""
    made = [(f"A{i}", d, d.year, d.month, "Procurement assignment", "s", a, x, "n") for i, (d, a, x) in enumerate((datetime.date.fromisoformat(d), a, x) for d, a, x in given)]
    return spark.createDataFrame(made, "ada string, issue_date date, year int, month int, decision_type string, subject string, amount double, supplier_tax_id string, supplier_name string")


def test_burst_is_the_first_window_and_inclusive(spark):
    d = award(spark, ("2020-01-01", 1.0, "a"), ("2020-01-31", 2.0, "a"), ("2020-01-31", 3.0, "a"), ("2020-02-01", 4.0, "a"), ("2020-01-01", 1.0, "b"), ("2020-02-01", 1.0, "b"), ("2020-02-02", 1.0, "b"))
    got = signals.award_burst(d).collect()
    assert [(g.supplier_tax_id, str(g.window_start), g.awards_in_window, g.total_amount) for g in got] == [("a", "2020-01-01", 3, 6.0)]


def test_shares_and_islands(spark):
    d = award(spark, ("2018-01-01", 60.0, "a"), ("2018-01-01", 40.0, "b"), ("2019-01-01", 50.0, "a"), ("2019-01-01", 50.0, "b"), ("2021-01-01", 90.0, "a"), ("2021-01-01", 10.0, "b"))
    assert [(g.entity, g.year) for g in signals.supplier_share(d).collect()] == [("a", 2021)]
    assert [(g.entity, g.first_year, g.last_year) for g in signals.persistent_share(d).collect()] == [("a", 2018, 2019)]


def test_amounts_round_and_not(spark):
    d = award(spark, ("2020-01-01", 150.0, "a"), ("2020-02-01", 150.0, "a"), ("2020-01-01", 200.0, "b"), ("2020-02-01", 200.0, "b"), ("2020-01-01", 150.0, "b"), ("2020-01-01", 150.0, "c"))
    assert [(g.supplier_tax_id, g.amount) for g in signals.copied_amounts(d).collect()] == [("a", 150.0)]
    assert [(g.amount, g.distinct_suppliers) for g in signals.standard_prices(d).collect()] == [(150.0, 3)]


def test_detectors_by_name(spark):
    assert signals.detect(award(spark, ("2020-01-04", 9000.0, "a"))).filter("rule = 'weekend'").count() == 1
    with pytest.raises(ValueError, match="T99"):
        signals.detect(award(spark), ["T99"])


def test_richest_duplicate(spark):
    d = spark.createDataFrame([("A", 1, None, "x"), ("A", 2, 5.0, None), (None, 3, 1.0, "y"), (None, 4, 1.0, "y")], "ada string, id long, amount double, unit string")
    score = F.col("amount").isNotNull().cast("int") * 2 + F.col("unit").isNotNull().cast("int")
    got = sorted((str(r.ada), r.amount, r.unit, r.duplicates) for r in normalize.keep_richest(d, score, ["id"]).collect())
    assert got == [("A", 5.0, "x", 2), ("None", 1.0, "y", 1), ("None", 1.0, "y", 1)]


def test_unique_keys(spark):
    d = spark.createDataFrame([("A",), ("A",), (None,), (None,)], "ada string")
    with pytest.raises(ValueError, match="A"):
        normalize.assert_unique(d)
    assert normalize.assert_unique(d.filter("ada is null")).count() == 2


def test_one_month_from_files(spark, tmp_path):
    month = tmp_path / "organization_uid=6166" / "year=2026" / "month=4"
    os.makedirs(month / "decisions")
    hits = [{"ada": "ΑΑΑ1-ΒΒΒ", "issueDate": "01/04/2026 00:00:00", "decisionTypeUid": "Δ.1", "subject": "Ανάθεση 123456789"}, {"ada": "ΑΑΑ2-ΒΒΒ", "issueDate": "2026-04-02", "decisionTypeUid": "Γ.2", "subject": "Μισθοδοσία"}, "junk"]
    (month / "search_export.json").write_text(json.dumps({"decisionResultList": hits}, ensure_ascii=False))
    detail = {"decision": {"subject": "Ανάθεση", "amountWithVAT": "1.234,56", "extraFieldValues": [{"label": "Ανάδοχος", "value": "ALPHA"}, {"label": "ΑΦΜ", "value": "EL123456789"}], "signerName": {"firstName": "Ann", "lastName": "Lee"}}}
    (month / "decisions" / "ΑΑΑ1-ΒΒΒ.json").write_text(json.dumps(detail, ensure_ascii=False))
    e, d = exports.read_exports(spark, str(tmp_path)), exports.read_details(spark, str(tmp_path))
    got = {r.ada: r for r in normalize.normalize_decisions(e, d).collect()}
    one, two = got["ΑΑΑ1-ΒΒΒ"], got["ΑΑΑ2-ΒΒΒ"]
    assert len(got) == 2 and (one.amount, one.amount_source, one.supplier_name, one.supplier_tax_id, one.signer) == (1234.56, "detail:amountWithVAT", "ALPHA", "123456789", "Ann Lee")
    assert (one.org, one.year, one.month, str(one.issue_date), one.decision_type, one.detail_enriched) == ("6166", 2026, 4, "2026-04-01", "Procurement assignment", True)
    assert two.amount is None and two.supplier_tax_id is None and not two.detail_enriched


@pytest.mark.parametrize(("text", "n"), [('[{"a": 1}, 2, {"b": 2}]', 2), ('{"decisions": [{"a": 1}]}', 1), ('{"decisionResults": {"decision": {"a": 1}}}', 1), ('{"decisionResults": {"decisions": [{"a": 1}, {"b": 1}]}}', 2), ("{}", None)])
def test_envelopes(spark, text, n):
    got = spark.createDataFrame([(text,)], "v string").select(exports.unwrap_envelope(F.col("v"))).first()[0]
    assert (len(got) if got is not None else None) == n


def test_details_are_listed_by_folder(spark, tmp_path):
    """Folders of months are the paths that are listed, however many files there are, and files are written by several tasks."""
    rows = [("org", 2024, m, f"F-{i}", '{"decision": {"amount": "%d"}}' % i) for m in (1, 2) for i in range(m * 40, m * 40 + 40)]
    exports.write_details(spark.createDataFrame(rows, "org string, year int, month int, name string, detail string").coalesce(1), f"file://{tmp_path}")
    (tmp_path / "organization_uid=org/year=2024/month=1/decisions/notes.txt").write_text("no detail")
    d = exports.read_details(spark, str(tmp_path))
    assert {(r.month, r.ada, r.detail) for r in d.collect()} == {(m, n, t[13:-1].replace(" ", "")) for _, _, m, n, t in rows}
    leaf = d._jdf.queryExecution().analyzed().collectLeaves().head()
    assert leaf.relation().location().rootPaths().size() == 2



def test_a_checked_write_leaves_the_old_table_where_a_check_fails(spark, tmp_path):
    import os

    from spendlens.sources import exports

    path = str(tmp_path / "decisions")
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), (None, 3.0)], "ada string, amount double")
    assert exports.write_checked(good, path) == {"rows": 4, "repeated": 0, "missing": 0}
    for bad, words in ((good.unionByName(good), "4 rows with a repeated ada (such as a)"), (good.withColumn("amount", F.when(F.col("ada") == "a", F.col("amount"))), "3 without amount")):
        with pytest.raises(ValueError) as said:
            exports.write_checked(bad, path, required=("amount",))
        assert words in str(said.value)
        assert spark.read.parquet(path).count() == 4 and os.listdir(tmp_path) == ["decisions"]
    exports.write_checked(good.filter("ada = 'a'"), path)
    assert spark.read.parquet(path).count() == 1 and os.listdir(tmp_path) == ["decisions"]


def test_richest_rows_are_aggregates(spark):
    from spendlens.operators import normalize

    d = spark.createDataFrame([("k", 1, "x", None, 5), ("k", 9, None, "y", 4), ("k", 9, "z", None, 6), (None, 1, "p", None, 1), (None, 1, "p", None, 1)], "ada string, s int, a string, b string, o int")
    found = normalize.keep_richest(d, F.col("s"), ["o"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("k", 9, "z", "y", 4, 3), (None, 1, "p", None, 1, 1), (None, 1, "p", None, 1, 1)], key=str)
    assert "partial_min_by" in found._jdf.queryExecution().executedPlan().toString()


def test_signers_named_otherwise(spark):
    from spendlens.operators import rules

    d = spark.createDataFrame([("1", "ΓΕΩΡΓΙΟΣ ΠΑΠΑΔΟΠΟΥΛΟΣ"), ("2", "Παπαδόπουλος, Γεώργιος"), ("3", "ΠΑΠΑΔΟΠΟΛΟΣ ΓΕΩΡΓΙΟΣ"), ("4", "ΑΠΑΔΟΠΟΥΛΟΣ ΓΕΩΡΓΙΟΣ"), ("5", "ΠΑΠΑΔΟΠΟΛΟΣ ΓΕΟΡΓΙΟΣ"), ("6", "Α ΠΑΠΑΔΟΠΟΥΛΟΣ"), ("7", None), ("8", ""), ("9", "ΠΑΠΑΔΟΠΟΥΛΟΣ ΓΕΩΡΓΙΟΣ ΠΕΤΡΟΥ")], "ada string, signer string").withColumn("supplier_tax_id", F.lit("s"))
    people = spark.createDataFrame([("s", "ΠΑΠΑΔΟΠΟΥΛΟΣ ΓΕΩΡΓΙΟΣ"), ("s", "Β ΠΑΠΑΔΟΠΟΥΛΟΣ"), ("t", "ΠΕΤΡΟΥ"), ("s", None)], "supplier_tax_id string, person string")
    assert sorted((r.ada, r.person) for r in rules.signer_links(d, people).collect()) == [(str(i), "ΠΑΠΑΔΟΠΟΥΛΟΣ ΓΕΩΡΓΙΟΣ") for i in (1, 2, 3, 4)]


def told(spark, d):
    """``d`` and a counter of the rows of it that are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return d.mapInArrow(count, d.schema), seen


def test_detectors_work_decisions_out_once(spark):
    d, seen = told(spark, award(spark, ("2020-01-04", 9150.5, "a"), ("2020-01-05", 9150.5, "a"), ("2020-12-25", 9000.0, "b")))
    found = signals.detect(d, ["T9B", "T6"])
    assert sorted((x.rule, x.metric) for x in found.collect()) == [("copied_amount", 2.0), ("holiday", 9000.0), ("weekend", 9150.5), ("weekend", 9150.5)]
    assert seen.value == 3
    assert "Window" not in signals.detect(award(spark, ("2020-01-04", 9150.5, "a")), ["T9B"])._jdf.queryExecution().optimizedPlan().toString()


def test_detectors_read_what_is_named(spark):
    assert set(signals.READS) == set(signals.DETECTORS)
    assert signals.detect(award(spark, ("2020-01-04", 9000.0, "a"))).count() > 0


def test_price_outliers_work_decisions_out_once(spark):
    from spendlens.operators import rules

    d, seen = told(spark, award(spark, ("2020-01-01", 10.0, "a"), ("2020-02-01", 12.0, "a"), ("2020-03-01", 90.0, "b")).withColumn("cpv", F.lit("x")))
    assert [(x.ada, x.median_amount, x.times) for x in rules.price_outliers(d).collect()] == [("A2", 12.0, 7.5)]
    assert seen.value == 3


def test_procurements_of_clusters_are_read_once(spark):
    """By key, by tax id and by both, in two clusters of one tax id, rows alike once."""
    c = spark.createDataFrame([("c1", ["k1", "k2"], "1"), ("c2", ["k3"], None), ("c3", ["k4"], "1")], "cluster_id string, member_keys array<string>, supplier_tax_id string")
    p = [("a", "k1", "1"), ("a", "k1", "1"), ("b", "k3", None), ("c", None, "1"), ("d", "k9", "9"), ("e", "k3", "1"), ("f", None, None)]
    d, seen = told(spark, spark.createDataFrame(p, "ada string, supplier_key string, supplier_tax_id string"))
    got = entities.cluster_procurements(c, d).collect()
    assert sorted((x.ada, x.cluster_id) for x in got) == [("a", "c1"), ("a", "c3"), ("b", "c2"), ("c", "c1"), ("c", "c3"), ("e", "c1"), ("e", "c2"), ("e", "c3")]
    assert seen.value == len(p)


def test_documents_are_written_by_several_tasks(spark, tmp_path):
    """A small table in one partition, as small results of a shuffle are: its documents are not all written by one task."""
    from spendlens.sources import exports

    df = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") * 2).alias("n")).coalesce(1)
    exports.write_documents(df, str(tmp_path / "d"), "key")
    files = list((tmp_path / "d").glob("key=*/part-*.json"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 2
    assert {(r.key, r.n) for r in spark.read.schema("n long, key string").json(str(tmp_path / "d")).collect()} == {(f"k{i}", 2 * i) for i in range(60)}
