import datetime

import pytest
from pyspark.sql import functions as F

from spendlens.functions import classify, dates, ids, json_fields, numbers, text


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_canonical_text(spark):
    assert column(spark, ["Προμήθεια  ΥΛΙΚΏΝ, αρ. 12/β", None, "--", "Ça cœur É"], text.canonical_text) == ["προμηθεια υλικων αρ 12 β", "", "", "ca c ur e"]


def test_names(spark):
    assert column(spark, ["Τεχνική Α.Ε.", "ΑΛΦΑ και ΒΗΤΑ Ο.Ε.", None, "Α.Ε."], text.canonical_supplier_name) == ["ΤΕΧΝΙΚΗ", "ΑΛΦΑ ΒΗΤΑ", None, "Α.Ε."]
    assert column(spark, ["Lee,,Ann", " , ", None], text.clean_person_name) == ["Lee Ann", None, None]


@pytest.mark.parametrize(("written", "amount"), [("1.234,56", 1234.56), ("€ 1 234,5", 1234.5), ("1.234", 1234.0), ("12.5", 12.5), ("-1.000.000", -1e6), ("abc", None), ("", None), (None, None)])
def test_parse_amount(spark, written, amount):
    assert column(spark, [written], numbers.parse_amount) == [amount]


def test_budget_needs_a_mark(spark):
    assert column(spark, ["Αρ. 123.456 απόφαση", "Προϋπολογισμού 1.234,56 € και 12,00", "μελέτης 99.000.000,00", None], numbers.budget_in_subject) == [None, 1234.56, None, None]


def test_mixed_dates(spark):
    day = datetime.date(2020, 1, 15)
    assert column(spark, ["2020-01-15", "15/01/2020", "15/01/2020 10:11:12", "2020-01-15T00:00:00", "1579046400000", "1579046400", "soon", None], dates.mixed_date) == [day] * 6 + [None, None]


def test_tax_ids(spark):
    given = ["123456789", "EL123456789", "AB EL123456789 x 1", "ΑΦΜ 123456789", "1234567890", "12 123456789", None]
    assert column(spark, given, ids.normalize_tax_id) == ["123456789"] * 4 + [None, None, None]
    assert column(spark, given[2:3], lambda c: ids.normalize_tax_id(c, False)) == [None]


def test_references(spark):
    assert column(spark, ["βλ. 6ΓΔ7ΩΛΒ–ΑΒΓ και 6γδ7ωλβ-αβγ, ΑΒΓΔ-12"], ids.referenced_adas) == [["6ΓΔ7ΩΛΒ-ΑΒΓ"]]


def test_noise_and_awards(spark):
    keep = lambda c: classify.is_procurement(F.lit(None).cast("string"), c, F.lit(None).cast("double"), F.lit(None).cast("string"))
    given = ["Μισθοδοσία Ιανουαρίου", "Χορήγηση άδειας", "Ανάθεση προμήθειας", "Κατακύρωση διαγωνισμού προμήθειας", "Ακύρωση ανάθεσης", "Θέμα"]
    assert column(spark, given, keep) == [False, False, True, True, False, False]


def test_stage_order(spark):
    assert column(spark, ["κατακύρωση και έγκριση", "Έγκριση όρων", "ακύρωση", "άλλο", None], classify.procurement_stage) == ["award", "approval", "cancellation", "other", "other"]


def test_detail_scores(spark):
    score = lambda c: classify.detail_score(F.lit("Δ.1"), c, F.lit(True), F.lit(True))
    assert column(spark, ["Ανάθεση υπηρεσίας", "μισθοδοσία", "x"], score) == [3, -10, 1]


@pytest.mark.parametrize(("args", "rating"), [((True, False, 80, 50, 50), "green"), ((True, True, 80, 50, 50), "red"), ((False, False, 80, 50, 50), "red"), ((True, False, 10, 50, 50), "red"), ((True, False, 60, 50, 50), "yellow"), ((True, False, 80, 30, 50), "yellow")])
def test_confidence(spark, args, rating):
    assert spark.range(1).select(classify.confidence(*[F.lit(a) for a in args])).first()[0] == rating


def test_supplier_kinds(spark):
    given = ["Σχολική Επιτροπή Α", "Δ.Ο.Υ. Λαμίας", "ΕΦΚΑ", "Δήμος Λαμιέων", "Δήμος Άλλων", "Υπουργείο Χ", "ΑΛΦΑ ΑΕ", None]
    kinds = ["school_committee", "vendor", "social_security", "municipality_internal", "public_authority", "public_authority", "vendor", "unknown"]
    got = column(spark, given, lambda c: classify.supplier_type(c, F.lit(None).cast("string")))
    assert got[:1] + got[2:] == kinds[:1] + kinds[2:]


def test_amount_paths(spark):
    docs = {
        "a": '{"subject": "999.999,00", "extraFieldValues": [{"label": "Ποσό", "value": "1.234,56"}]}',
        "b": '{"awardAmount": {"amount": 7, "currency": "EUR"}, "amount": "8"}',
        "c": '{"subject": {"amount": 5}, "url": {"amount": 6}}',
        "d": '{"amount": true, "list": [{"x": 1}, {"netAmount": "2,5"}]}',
        "e": "not json",
        "f": None,
    }
    df = spark.createDataFrame(list(docs.items()), "id string, j string")
    got = {r.id: tuple(r.a) for r in df.select("id", json_fields.amounts(json_fields.values(F.col("j"))).alias("a")).filter("a is not null").collect()}
    assert got == {"a": (1234.56, "extraFieldValues[0].extraFieldValues[Ποσό]"), "b": (7.0, "awardAmount.amount"), "d": (2.5, "list[1].netAmount")}


def test_supplier_from_different_nodes(spark):
    docs = {"a": '{"person": {"afm": "123456789"}, "deep": {"contractor": {"name": "ALPHA"}}}', "b": '{"extraFieldValues": [{"label": "Ανάδοχος", "value": "BETA"}, {"label": "ΑΦΜ", "value": "EL987654321"}], "amountWithVAT": "5"}'}
    df = spark.createDataFrame(list(docs.items()), "id string, j string")
    got = {r.id: tuple(r.s) for r in df.select("id", json_fields.supplier_fields(json_fields.values(F.col("j"))).alias("s")).collect()}
    assert got == {"a": ("ALPHA", "123456789"), "b": ("BETA", "987654321")}


def test_a_large_record_is_searched_in_linear_time(spark):
    """5,000 values in one record, and four times as many, nested and in lists; the times of the search itself, without Spark's start."""
    import json
    import time

    from pyspark.sql import functions as F

    from spendlens.functions import record_values

    def record(n):
        items = [{"code": f"c{i}", "note": {"text": f"line {i}", "tags": ["a", "b"]}} for i in range(n)]
        return json.dumps({"ada": "X", "items": items, "extraFieldValues": {"award": {"amountWithVAT": "1.234,56"}, "contractor": [{"name": {"label": "ACME"}, "afm": "EL123456789"}]}})

    took = {}
    for n in (1_000, 4_000):
        began = time.perf_counter()
        assert len(list(record_values.walked(record(n)))) > 5 * n
        took[n] = time.perf_counter() - began
    assert took[1_000] < 1 and took[4_000] < 10 * took[1_000]
    df = spark.createDataFrame([(1, record(1_000))], "id int, j string").select(json_fields.values(F.col("j")).alias("v"))
    got = df.select(json_fields.amounts(F.col("v")).alias("a"), json_fields.any_amounts(F.col("v")).alias("b"), json_fields.supplier_fields(F.col("v")).alias("s")).first()
    assert (tuple(got.a), got.b, tuple(got.s)) == ((1234.56, "extraFieldValues.award.amountWithVAT"), 1234.56, ("ACME", "123456789"))


def test_values_of_odd_records(spark):
    """Text inside text, numbers of three decimals, unreadable text, nulls, deep nesting, names in lists."""
    from pyspark.sql import functions as F

    from spendlens.functions import record_values

    rows = [
        (1, '{"a": "{\\"amount\\": 12.345}"}', 12.345), (2, '{"amount": "12.345"}', 12345.0), (3, "{broken", None), (4, None, None), (5, "", None), (6, '["x", {"amount": 7}]', 7.0),
        (7, '{"l": [' * 60 + '{"amount": 5}' + "]}" * 60, 5.0), (8, "[" * 100_000, None), (9, '{"amount": null, "x": {"label": "Ποσό", "value": "3,5"}}', 3.5),
    ]
    df = spark.createDataFrame(rows, "id int, j string, want double")
    got = df.select("id", "want", json_fields.amounts(json_fields.values(F.col("j")))["amount"].alias("got")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.want) for r in got]
    named = {"plain ": "plain", '{"name": {"label": "x"}}': "x", '["a", {"firstName": "Ann", "lastName": "Lee"}, ["b", "", null]]': "a, Ann Lee, b", "{broken": None, "[broken": "[broken", '{"code": 1}': None, "": None}
    assert {t: record_values.named(t) for t in named} == named
    said = spark.createDataFrame([(t,) for t in named], "t string").select("t", json_fields.named_text(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in said} == named


def test_searches_find_the_same_in_what_they_may_count(spark):
    """Of a deep record few values are kept, and every search finds in them what it finds in all."""
    import json
    import random

    from spendlens.functions import record_values
    from spendlens.functions import vocabulary as V

    r = random.Random(5)
    keys = [*V.LABEL_KEYS, *V.VALUE_KEYS, *V.AMOUNT_KEYS[:3], *V.SUBJECT_KEYS[:2], "supplierName", "contractor", "afm", "supplierAFM", "signer", "signedByWhom", "unitName", "τμήμα", "fundingSource", "extraFieldValues", "organization", "a", "b", "c"]
    says = ["Ποσό", "Επωνυμία αναδόχου", "ΑΦΜ αναδόχου", "Υπογραφή", "Μονάδα", "Funding source", "x"]

    def value(depth):
        kind = r.random()
        if depth and kind < 0.5:
            return {k: value(depth - 1) for k in r.sample(keys, r.randint(1, 5))}
        if depth and kind < 0.65:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        return r.choice([*says, "1.234,56", "12 ευρώ", "EL123456789", "987654321", 5, 7.25, None, True, ""])

    texts = [json.dumps({k: value(5) for k in r.sample(keys, 6)}) for _ in range(300)] + [json.dumps([value(4), value(4)]) for _ in range(50)] + [json.dumps({"label": "Ποσό", "value": "5"}), "", "7", None]
    every, kept = (sum(len(list(record_values.walked(t, all_))) for t in texts) for all_ in (True, False))
    assert kept < every
    deep = json.dumps(dict(a={"b": [{"c": i, "d": {"e": "f"}} for i in range(50)], "amount": "5"}))
    assert [x[3] for x in record_values.walked(deep, False)] == ["a", "a.amount"]
    J = json_fields
    found = lambda v: [J.amounts(v), J.any_amounts(v), J.supplier_fields(v), J.supplier_fields_in_context(v), *[J.labelled_text(v, k, w) for k, w in ((V.SIGNER_KEYS, V.SIGNER_LABELS), (V.UNIT_KEYS, V.UNIT_LABELS), (V.BUDGET_KEYS, V.BUDGET_LABELS))], J.named_first(J.as_map(F.col("j")), v, ("a", "b", "amount"))]
    df = spark.createDataFrame([(t,) for t in texts], "j string").select("j", J.values(F.col("j")).alias("v"), J.sought(F.col("j")).alias("s"))
    rows = df.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(found(F.col("v")))]).alias("all"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(found(F.col("s")))]).alias("few")).collect()
    assert all(x["all"] == x.few for x in rows)
    assert all(any(x[i] is not None for x in (y["all"] for y in rows)) for i in range(8)) and len(rows) == len(texts)


def test_records_of_one_file_are_searched_by_all_cores(spark):
    from spendlens.plans.link_queries import deep_records

    assert deep_records(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_words_share_their_beginnings(spark):
    """A pattern tries each letter once, and finds what the words one by one find."""
    import re

    from spendlens.functions import vocabulary as V
    from spendlens.functions.text import any_word, contains_any

    assert any_word(("ab", "ac", "abd", "x.")) == r"(?:a(?:b|c)|x\.)" and any_word((" ab", " ac")) == r"\ a(?:b|c)"
    words = (*V.NOT_PROCUREMENT, *V.PERSONNEL_PHRASES)
    phrases = [f" {w}" for w in words]
    texts = [f"x{p[:-1]} y" for p in phrases] + [f"x{p}z" for p in phrases] + [f"x{p[1:]}" for p in phrases] + ["", " ", "x"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(contains_any(F.col("t"), phrases).alias("c")).collect()]
    assert got == [any(p in t for p in phrases) for t in texts] and any(got) and not all(got)
    assert len(re.findall("ανακληση", any_word(tuple(phrases)))) <= 1 and any_word(tuple(phrases)).startswith(r"\ (?:")
