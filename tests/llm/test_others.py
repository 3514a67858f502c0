"""Nearest neighbours, url filters and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from spendlens.llm import ann, url_filter

from .conftest import SCHEMA, prose


def test_neighbours_against_all(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 16)) * r.uniform(0.5, 2, size=(3000, 1))
    v[100:160] = v[100]  # more copies than are returned
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (20, v[20].tolist())]
    got = {}
    for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert sorted(got) == list(range(0, 3000, 20))
    recall = []
    for q, near in got.items():
        score = v @ v[q]
        score[q] = -np.inf
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21)) and len({n[1] for n in near}) == 20 and q not in [n[1] for n in near]
        assert all(s == pytest.approx(score[i], abs=1e-9) for _, i, s in near)
        assert near == sorted(near, key=lambda n: (-n[2], n[1]))
        recall.append(np.mean([s >= np.sort(score)[-20] - 1e-9 for _, _, s in near]))
    assert np.mean(recall) >= 0.9
    assert [i for _, i, _ in got[100]][:1] == sorted(i for _, i, s in got[100] if s == pytest.approx(got[100][0][2]))[:1]


@pytest.mark.parametrize("structured", [True, False])
def test_recall_on_ten_thousand(spark, monkeypatch, structured):
    """Clustered vectors need few candidates; vectors without structure as many as it takes. Recall is 0.9 or more for both."""
    r = np.random.default_rng(5)
    n = 10_000
    v = r.normal(size=(n, 24))
    if structured:
        v = r.normal(size=(200, 24))[np.arange(n) % 200] + 0.15 * v
    asked = []
    measure = ann.candidates_needed
    monkeypatch.setattr(ann, "candidates_needed", lambda *a: asked.append(measure(*a)) or asked[-1])
    got = {}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for x in ann.nearest(df).collect():
        got.setdefault(x.query_id, []).append(x.score)
    score = v[::20] @ v.T
    score[np.arange(len(score)), np.arange(0, n, 20)] = -np.inf
    least = np.sort(score, axis=1)[:, -20]
    assert np.mean([np.mean(np.array(got[20 * k]) >= least[k] - 1e-9) for k in range(len(least))]) >= 0.9
    assert all(len(s) == 20 for s in got.values()) and (asked[0] <= 1_500) == structured


def test_odd_vectors(spark):
    """Other dimensions are apart, the least of vectors with one id takes part, names may clash, copies tie, and tables may have nothing to compare."""
    r = np.random.default_rng(6)
    flat = [(i, r.normal(size=3 + i % 2).tolist()) for i in range(60)] + [(0, [9.0, 9.0, 9.0]), (100, [1.0] * 5)]
    df = spark.createDataFrame(flat, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as score", "4 as tree")
    used = {}
    for i, x in flat:
        used[i] = min(used.get(i, x), x)
    want = []
    for q, x in used.items():
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in used.items() if i != q and len(x) == len(y))[:20]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    assert sorted((x.query_id, x.rank, x.vec_id) for x in ann.nearest(df).collect()) == sorted(want)
    same = spark.createDataFrame([(i, [0.1, 0.2, 0.3]) for i in range(50)], "vec_id long, embedding array<float>")
    assert [x.vec_id for x in sorted(ann.nearest(same).filter("query_id = 20").collect())] == [i for i in range(21) if i != 20]
    none = spark.createDataFrame([(0, [0.0]), (20, None), (None, [1.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(none).collect() == [] and ann.nearest(none.filter("vec_id > 99")).collect() == []


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((x.rank, x.vec_id, x.score) for x in ann.nearest(few).collect()) == [(1, 1, 0.5), (2, 2, 0.5)]
    assert ann.nearest(few.filter("vec_id > 5")).collect() == []


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:n], rest[n:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, v = max(fits, default=(0, None, "allow"))
    return host, path, rule, v


def test_url_filter(spark):
    r = random.Random(1)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "COM", "net", "x.net", "example.net", "org", "a.b.org", "orgx", "", "com.", ".com", "é.com", "user@x.com", "x.com:80"]
    paths = ["", "/", "/en/", "/en/7", "/en/71", "/en", "/de/8", "/de/", "/de/80/x", "/es/1", "/EN/", "?en/", "#/en/", "/en/?x=/de/", "/x/en/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "HTTPS://", "://") for h in hosts for p in paths] + [None, "", "com/en/", "http:/com/en/", "x://y://com/en/", "http://com/en/\n1"] + [r.choice(hosts) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'clash' as host", "1 as rule")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(df).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.filter("page_id < 0")).collect() == []


def test_url_rules_are_the_contracts(spark):
    fixed = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    df = spark.createDataFrame([(i, f"http://a.{h}{p}x") for i, (h, p) in enumerate(fixed)], "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.filter_urls(df).collect()}
    assert got == {i: (h + p, v) for i, ((h, p), v) in enumerate(fixed.items())}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = [f"k{i}" for i in range(0, 20_000, 7)][:1500]
    cascade = url_filter.Cascade(listed, keys, 20_000)
    assert len(cascade.levels) > 2
    got = {r.key for r in keys.filter(cascade.has(keys["key"])).collect()}
    assert got == set(listed)


def test_pipeline_stages(spark, tmp_path):
    base = prose(1, 200)
    rows = [(i, prose(i + 10, 120), ["en", "de"][i % 2], f"s{i % 2}", 1) for i in range(40)]
    rows += [(100, base, "en", "s0", 1), (101, base.replace(" ", "  "), "en", "s1", 1), (102, base + " tail", "de", "s0", 1), (103, None, "en", "s0", None), (104, "1234 !", "en", "s0", 6)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "bpe":
            assert after.columns == docs.columns
        kept[name] = [r.doc_id for r in after.collect()]
        docs = after
    assert set(kept["language_id"]) == {r[0] for r in rows} - {103, 104}
    assert set(kept["language_id"]) - set(kept["exact_dedup"]) == {100}  # the longer one stays
    assert set(kept["exact_dedup"]) - set(kept["near_dedup"]) <= {102} and len(kept["near_dedup"]) == len(set(kept["near_dedup"]))
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(kept["mixing"].count(i) for i in kept["mixing"]) <= 3
    assert sorted(kept["bpe"]) == sorted(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["bpe"])
