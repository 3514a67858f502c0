"""Links against brute force."""

import datetime
import random
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.functions import classify, text
from spendlens.operators import linking, near_amounts, similar
from spendlens.operators.components import connected_components
from spendlens.plans.link_queries import tolerance_pairs
from spendlens.plans.views import orders


def test_all_pairs_of_repeated_rows(spark):
    day = lambda n: n if n is None else datetime.date(2020, 1, 1) + datetime.timedelta(n)
    kinds = [(100.0, 0, "a"), (101.0, 90, "a"), (101.0, 300, "a"), (100.0, 0, None), (99.0, None, "a"), (100.0, 0, "b"), (0.0, 0, "a")]
    rows = [(i, kinds[i % 7][0], day(kinds[i % 7][1]), kinds[i % 7][2]) for i in range(21)]
    df = spark.createDataFrame(rows, "id long, amount double, issue_date date, supplier_tax_id string")
    for strict in (False, True):
        want = []
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[1] > 0 and b[1] > 0 and abs(a[1] - b[1]) / max(a[1], b[1]) <= 0.02:
                    supplier = a[3] == b[3] if a[3] and b[3] else not strict
                    dates = abs((a[2] - b[2]).days) <= 180 if a[2] and b[2] else True
                    want += [(a[0], b[0])] * (supplier and dates)
        got = expanded(linking.tolerance_classes(df, strict_supplier=strict).collect())
        if strict:  # members without a supplier do not match each other
            got = {(i, j) for i, j in got if rows[i][3] and rows[j][3]}
        assert sorted(got) == want


def test_tolerance_query_has_every_pair_of_orders(spark):
    """Orders that differ by less than a thousand, or by days of one month, are pairs of their own, not members of a rounded class."""
    sf = "/root/testdata/sf0.001"
    o = [(r.id, r.amount, r.issue_date, r.supplier_tax_id) for r in orders(spark, sf).select("id", "amount", "issue_date", "supplier_tax_id").collect()]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in combinations(o, 2) if a[3] == b[3] and abs(a[1] - b[1]) / max(a[1], b[1]) <= 0.02 and abs((a[2] - b[2]).days) <= 180}
    got = {(r.src, r.dst) for r in tolerance_pairs(spark, sf).collect()}
    assert want and want <= got


@pytest.mark.parametrize("strict", [False, True])
def test_components_with_unknown_dates_and_suppliers(spark, strict):
    """Members of contracts against comparing all rows with all, at cells' edges and diagonals; links stay linear where a third is unknown."""
    from spendlens.operators.near_amounts import tolerance_links

    for seed in range(3):
        r = random.Random(seed)
        day = lambda: datetime.date(2020, 1, 1) + datetime.timedelta(r.choice([r.randint(0, 900), 180, 360, 0]))
        rows = [(i, r.choice([100.0, 100.0 / 0.98, 98.0, round(100 * 1.013 ** r.randint(0, 130), 2), 0.0, None]), day() if r.random() < 0.8 else None, r.choice("abcdefgh") if r.random() < 0.85 else None) for i in range(160 if seed else 60)]
        df = spark.createDataFrame(rows, "id long, amount double, issue_date date, supplier_tax_id string")
        group = {row[0]: row[0] for row in rows}
        pairs = []
        for a, b in combinations(rows, 2):
            if a[1] and b[1] and abs(a[1] - b[1]) / max(a[1], b[1]) <= 0.02:
                supplier = a[3] == b[3] if a[3] and b[3] else not strict or (a[1:] == b[1:])
                pairs += [(a[0], b[0])] * (supplier and (not a[2] or not b[2] or abs((a[2] - b[2]).days) <= 180))
        while True:
            before = dict(group)
            for i, j in pairs:
                group[i] = group[j] = min(group[i], group[j])
            if before == group:
                break
        got = {x.id: x.component for x in linking.contract_members(df, strict_supplier=strict).collect()}
        assert got == group
    hot = spark.range(3_000).select("id", (F.lit(100.0) + F.col("id") / 10_000).alias("amount"), F.when(F.col("id") % 3 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int"))).alias("issue_date"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("supplier_tax_id"))
    assert tolerance_links(hot, 0.02, 180).count() < 40 * 3_000


def fixture_of_decisions(seed):
    r = random.Random(seed)
    words = "προμήθεια υλικών ανάθεση υπηρεσίας καθαρισμού σύμβαση τιμολόγιο ένταλμα πληρωμή έργο οδοποιίας δήμος μελέτη".split()
    types = [("Δ.1", "Procurement assignment"), ("Δ.2.2", "Contract award"), ("Β.1.3", "Payment warrant"), ("Β.2.1", "Expenditure approval"), ("Γ.2", "Other")]
    rows = []
    for i in range(140):
        raw, label = r.choice(types)
        title = " ".join(r.choice(words) for _ in range(r.randint(0, 6)))
        if rows and r.random() < 0.5:
            title = r.choice(rows)[4] + r.choice(["", " α", " νέα"])
        rows.append((i, f"A-{i}", r.choice([100.0, 250.5, 999.99, None]), datetime.date(2020, r.randint(1, 2), r.randint(1, 28)) if r.random() < 0.95 else None, title, raw, label, r.choice(["tax:1", "tax:2", None])))
    return rows


def expanded(pairs):
    """All pairs of rows that pairs of firsts and their members speak of."""
    first = {x.src: x.dst for x in pairs if x.kind != "pair"}
    inner = {x.dst for x in pairs if x.kind == "member"}
    members = {}
    for i, j in first.items():
        members.setdefault(j, [j]).append(i)
    of = lambda i: members.get(i, [i])
    found = {tuple(sorted((a, b))) for x in pairs if x.kind == "pair" for a in of(x.src) for b in of(x.dst)}
    return found | {tuple(sorted(p)) for i in inner for p in combinations(members[i], 2)}


def plain_links(seen):
    """Pairs of ids that are the same decision twice, and pairs that belong to one purchase, by comparing all rows (id to row with role, bought, canon, tokens) with all."""
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    cents = lambda x: None if x.amount is None else round(x.amount * 100)
    # A ratio may depend on the order: rows are compared as the firsts of those alike with them, the smaller id left.
    firsts = {}
    of_title, of_purchase = lambda x: (x.issue_date, cents(x), x.canon), lambda x: (x.supplier_key, x.issue_date.month, cents(x), x.role, x.canon, "purchase")
    for x in (seen[i] for i in sorted(seen) if seen[i].issue_date):
        firsts.setdefault(of_title(x), x)
        if x.bought:
            firsts.setdefault(of_purchase(x), x)
    alike_by = lambda a, b, key: ratio(*(x.canon for x in sorted((firsts[key(a)], firsts[key(b)]), key=lambda x: x.id)))
    twice, linked = set(), set()
    for i, j in combinations(sorted(seen), 2):
        a, b = seen[i], seen[j]
        if a.issue_date is None or b.issue_date is None:
            continue
        if a.issue_date == b.issue_date and cents(a) is not None and cents(a) == cents(b) and alike_by(a, b, of_title) >= linking.DUPLICATE_SIMILARITY:
            twice.add((i, j))
        if a.bought and b.bought and a.supplier_key == b.supplier_key and a.issue_date.month == b.issue_date.month:
            alike = alike_by(a, b, of_purchase)
            same, other = cents(a) is not None and cents(a) == cents(b), a.role is not None and b.role is not None and a.role != b.role
            days = abs((a.issue_date - b.issue_date).days)
            shared, union = len(set(a.tokens) & set(b.tokens)), len(set(a.tokens) | set(b.tokens))
            overlap = shared / union if a.tokens and b.tokens else 0.0
            if same and days <= 90 and (other or overlap >= 0.18 or alike >= 0.35) or a.supplier_key and other and days <= 45 and (overlap >= 0.12 or alike >= 0.25):
                linked.add((i, j))
    return twice, linked


@pytest.mark.parametrize("large", [similar.LARGE, 3])
def test_duplicates_groups_and_events_against_plain_python(spark, monkeypatch, large):
    """Pairs, groups, their summary and the largest purchases of a fixture, by comparing all decisions with all; in small blocks and in large ones."""
    monkeypatch.setattr(similar, "LARGE", large)
    rows = fixture_of_decisions(3)
    rows += [(500 + i, f"B-{i}", *r[2:]) for i, r in enumerate(rows[:30] * 2)]
    d = spark.createDataFrame(rows, "id long, ada string, amount double, issue_date date, title string, decision_type_raw string, decision_type string, supplier_key string")
    role = classify.lifecycle_role(F.col("decision_type_raw"), F.col("title"), F.col("decision_type"))
    bought = classify.is_lifecycle_decision(F.col("decision_type_raw"), F.col("title"), F.col("decision_type"), F.col("supplier_key"))
    seen = {x.id: x for x in d.select("*", role.alias("role"), bought.alias("bought"), text.canonical_text(F.col("title")).alias("canon"), text.text_tokens(F.col("title")).alias("tokens")).collect()}
    twice, linked = plain_links(seen)
    assert expanded(linking.duplicate_pairs(d).collect()) == twice and twice
    assert expanded(linking.lifecycle_pairs(d).collect()) == linked and linked
    group = {i: i for i in seen}
    for i, j in sorted(twice | linked) * 140:
        group[i] = group[j] = min(group[i], group[j])
    g = linking.grouped(d)
    got = g.collect()
    assert {x.id: x.group for x in got} == group
    size = Counter(group.values())
    buying = {group[i] for i in seen if seen[i].bought}
    summary = linking.group_summary(g).first()
    assert (summary.groups, summary.lifecycle_groups, summary.grouped_decisions) == (len(size), sum(size[k] > 1 for k in buying), sum(n for n in size.values() if n > 1))
    assert summary.procurement_events == len({x.canonical_id for x in got if x.group in buying})
    events = {}
    for x in got:
        if x.group in buying and x.amount is not None and "ματαίωση" not in x.title:
            events.setdefault(x.canonical_id, []).append(x)
    best = {k: min(v, key=lambda x: (-x.amount, not x.is_canonical, str(x.issue_date or ""), x.ada)) for k, v in events.items()}
    top = linking.top_events(g.withColumns({"tags": F.array().cast("array<string>"), "is_revocation": F.lit(False)}), 10).collect()
    assert sorted((x.amount for x in best.values()), reverse=True)[:10] == [x.amount for x in top]
    assert all((x.ada, x.decisions, x.related_adas) == (best[x.canonical_id].ada, len(events[x.canonical_id]), sorted(y.ada for y in events[x.canonical_id])) for x in top)


def hot_block(n):
    """One date and amount: payments that differ in a number, far ones, two of another kind, and chains of small steps."""
    titles = [f"πληρωμή τιμολογίου {i:06d} προμηθευτή" for i in range(n)]
    titles += [f"{chr(945 + i % 24) * (3 + i % 40)} {chr(97 + i % 26) * (5 + i // 26)}" for i in range(n // 10)]
    titles += ["μελέτη οδοποιίας δήμου", "μελέτη οδοποιίας δήμων"]
    return titles + ["abcdefghij" * 2 + "z" * i for i in range(0, 12, 2)]


def test_links_join_what_pairs_join_in_a_large_block(spark):
    """Title links and pairs of one block against comparing all with all."""
    titles = sorted(set(hot_block(120)))
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(i, j) for i, j in combinations(range(len(titles)), 2) if ratio(titles[i], titles[j]) >= 0.82}
    nodes = spark.createDataFrame(list(enumerate(titles)), "id long, title string").withColumns({"letters": similar.letters(F.col("title")), "block": F.lit(1)})
    got = similar.title_pairs(nodes, ["block"], 0.82, linking.title_ratio).collect()
    assert {(x.src, x.dst) for x in got} == want and len(got) == len(want)
    links = similar.title_links(nodes, ["block"], 0.82, linking.title_ratio)
    assert links.count() < len(want) / 10
    group = {i: i for i in range(len(titles))}
    for _ in range(len(titles)):
        before = dict(group)
        for i, j in want:
            group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    found = {x.node: x.component for x in connected_components(links).collect()}
    assert {i: found.get(i, i) for i in group} == group


def test_ratios_are_told_early(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.randint(0, 30)))
    texts = [(word(), word()) for _ in range(300)] + [("ab" * 120, "ba" * 130), ("", "a"), (None, "a"), ("a", "a")]
    rows = [(i, a, b, x) for i, (a, b) in enumerate(texts) for x in (0.0, 0.25, 0.35, 0.5, 0.82, 1.0, None)]
    df = spark.createDataFrame(rows, "i long, a string, b string, x double").withColumn("got", linking.title_reaches("a", "b", F.col("x")))
    for row in df.collect():
        want = bool(row.a and row.b and row.x is not None and SequenceMatcher(None, row.a, row.b).ratio() >= row.x)
        assert row.got == want, row


def test_contract_components_work_on_the_firsts_only(spark, monkeypatch):
    """Rows alike in amount, date and supplier take their first's component; they are no edges of the component search."""
    seen = []
    monkeypatch.setattr(linking, "connected_components", lambda edges: seen.append(edges) or connected_components(edges))
    day = datetime.date(2024, 1, 1)
    rows = [(i, 100.0 + i % 2, day, None if i % 3 else "t") for i in range(600)] + [(1000, 900.0, None, None), (1001, 900.0, None, None), (1002, None, day, "t"), (1003, 0.0, day, "t")]
    got = {x.id: x.component for x in linking.contract_members(spark.createDataFrame(rows, "id long, amount double, issue_date date, supplier_tax_id string")).collect()}
    assert got == {**{i: 0 for i in range(600)}, 1000: 1000, 1001: 1000, 1002: 1002, 1003: 1003}
    assert {n for e in seen[0].collect() for n in (e.src, e.dst)} <= set(range(6))


def test_numbered_letters_bound_the_ratio():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(1, 20))) for _ in range(2))
        shared = len(set(similar.numbered_letters(a)) & set(similar.numbered_letters(b)))
        assert SequenceMatcher(None, a, b).ratio() <= 2 * shared / (len(a) + len(b)) + 1e-12


@pytest.mark.parametrize("large, whole", [(64, 16), (3, 1)])
def test_pairs_of_dense_blocks_are_not_spread_by_letters(spark, monkeypatch, large, whole):
    """Blocks of over LARGE titles make no posts up to WHOLE times that; beyond it posts find the same pairs, and no pair twice."""
    titles = sorted(set(hot_block(90)))
    monkeypatch.setattr(similar, "LARGE", large)
    monkeypatch.setattr(similar, "WHOLE", whole, raising=False)
    posted, prefix = [], similar._prefix
    monkeypatch.setattr(similar, "_prefix", lambda *x: posted.append(1) or prefix(*x))
    want = {(i, j) for i, j in combinations(range(len(titles)), 2) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.82}
    nodes = spark.createDataFrame(list(enumerate(titles)), "id long, title string").withColumns({"letters": similar.letters(F.col("title")), "block": F.lit(1)})
    got = similar.title_pairs(nodes, ["block"], 0.82, linking.title_ratio).collect()
    assert {(x.src, x.dst) for x in got} == want and len(got) == len(want) and want
    assert bool(posted) == (large == 3)


def test_what_titles_say_is_worked_out_once(spark, monkeypatch):
    """Rows of few titles ask the texts' functions once a title, and pairs of them are compared once in a worker."""
    seen = []
    monkeypatch.setattr(linking, "reaches", lambda a, b, least: bool(seen.append((a, b, least))))
    linking._meets.cache_clear()
    pairs = pd.DataFrame([("μια δαπανη", "αλλο ποσο", 0.25, 0.12)] * 50 + [("μια δαπανη", "αλλο ποσο", 0.35, 0.18), ("αλλη δαπανη", "μια δαπανη", 0.25, 0.12), ("α", None, 0.25, 0.12), ("α", "α", None, None)])
    assert linking._reached(*(pairs[c] for c in pairs)).tolist() == [False] * 51 + [True, False, False]
    assert seen == [("μια δαπανη", "αλλο ποσο", 0.25), ("μια δαπανη", "αλλο ποσο", 0.35)]
    linking._meets.cache_clear()
    d = spark.range(500).select((F.col("id") % 3).cast("string").alias("title"), F.lit("x").alias("decision_type_raw"), F.lit(None).cast("string").alias("decision_type"), F.when(F.col("id") % 2 == 0, "k").alias("supplier_key"))
    plan = linking.read_texts(d)._jdf.queryExecution().optimizedPlan().toString()
    assert linking.read_texts(d).count() == 500 and "translate" not in plan  # canonical texts come from their own file


def test_groups_are_summed_up_without_windows(spark):
    """A group of most decisions is not gathered in one task, and lists only of the largest purchases."""
    rows = [(i, f"A-{i}", 100.0, datetime.date(2020, 1, 1), "αγορά", "Δ.1", None, "k") for i in range(300)] + [(900, "A-900", 7.0, None, "άλλο", "Γ.2", None, None)]
    d = spark.createDataFrame(rows, "id long, ada string, amount double, issue_date date, title string, decision_type_raw string, decision_type string, supplier_key string")
    g = linking.grouped(d)
    assert "Window" not in g._jdf.queryExecution().optimizedPlan().toString()
    assert {(x.group, x.group_size, x.canonical_ada) for x in g.collect()} == {(0, 300, "A-0"), (900, 1, "A-900")}
    top = linking.top_events(g.withColumns({"tags": F.array().cast("array<string>"), "is_revocation": F.lit(False)}), 3).collect()
    assert [(x.amount, x.decisions, len(x.related_adas)) for x in top] == [(100.0, 300, 300)]


def test_classes_of_a_dense_cell_are_linked_by_their_ends_only(spark):
    """Rows of few cells: links between classes do not grow with the rows, and components are those of all pairs."""
    rows = spark.range(4_000).select("id", (F.lit(100.0) + F.col("id") % 40 / 10).alias("amount"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 400).cast("int")).alias("issue_date"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("supplier_tax_id"))
    classes, links = near_amounts.class_links(near_amounts.classed(rows, 0.02, 180), 0.02, 180)
    assert classes.count() <= 24 and links.count() <= 48
    assert sorted(x.component for x in linking.contract_members(rows).select("component").distinct().collect()) == [0, 1]


def test_titles_of_duplicates_are_read_once(spark, monkeypatch):
    """Pairs of rows that share titles: the canonical text is not worked out for each row."""
    asked, told = [], linking._told
    monkeypatch.setattr(linking, "_told", lambda d, texts, made: asked.append((texts, list(made))) or told(d, texts, made))
    d = spark.range(40).select("id", F.lit(5.0).alias("amount"), F.lit("2020-01-01").cast("date").alias("issue_date"), F.when(F.col("id") % 2 == 0, "Αγορά υλικών").when(F.col("id") % 3 == 0, "αγορά υλικού").alias("title"))
    got = linking.duplicate_pairs(d).collect()
    assert asked == [(["title"], ["canon"])]
    assert Counter(x.kind for x in got) == {"member": 25, "pair": 1}
