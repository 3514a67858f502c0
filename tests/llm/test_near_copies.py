"""Near copies against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from spendlens.llm import near_copies, simhash

from .conftest import SCHEMA, prose


def shingles(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted(((i, least[g]) for (i, _), g in zip(rows, group, strict=True)), key=str)


def changed(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def texts(seed):
    """Copies with 0 to 12 words changed of texts of any length, a passage in many texts, and a chain of copies."""
    r = random.Random(seed)
    out = [None, "", "  ", "one", "ONE", "one two", "one two three four five", "One two  three four five"]
    for k in range(12):
        base = prose(seed * 100 + k, r.choice([6, 20, 60, 200, 600]))
        out += [changed(r, base, r.randint(0, max(1, len(base.split()) // 16))) for _ in range(6)]
    hot = prose(seed, 120)
    out += [changed(r, hot, r.randint(0, 5)) for _ in range(60)]
    out += [f"{hot} {prose(1000 + i, r.randint(10, 200))}" for i in range(60)]
    step = hot
    for i in range(10):
        step = changed(r, step, 2)
        out.append(step)
    r.shuffle(out)
    return out


@pytest.mark.parametrize("short, rounds, by_chance", [(near_copies.SHORT_LIST, near_copies.ROUNDS, near_copies.BY_CHANCE), (2, 1, near_copies.BY_CHANCE), (4, 2, 0.001)])
def test_near_copies_against_brute_force(spark, monkeypatch, short, rounds, by_chance):
    """Short and long lists, and tuples of two and of three bytes."""
    monkeypatch.setattr(near_copies, "SHORT_LIST", short)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "BY_CHANCE", by_chance)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts(1))]
    rows += [rows[5], (None, rows[9][1])]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == brute(rows)


@pytest.mark.parametrize("k", [2, 3])
def test_pairs_at_the_threshold_meet(k):
    """Of pairs of just 0.8 and more, large and small, at least 99 of 100 share a tuple of bytes and pass the tally."""
    r, at, met, pairs = random.Random(k), near_copies.positions(k), 0, 0
    for n in (6, 8, 15, 30, 60, 300, 1000):
        for _ in range(150):
            apart = n // 10  # n - apart shared of n + apart: 0.8 or more
            h = np.array([r.getrandbits(64) for _ in range(n + apart)], np.uint64)
            a, b = near_copies.wide_print(h[:n]), near_copies.wide_print(h[apart:])
            tuples = at if n < near_copies.FEW_SHINGLES else at[: len(at) // 2]
            bits = np.bitwise_count(a[:16] ^ b[:16]).sum()
            met += (a[tuples] == b[tuples]).all(axis=1).any() and (a == b).sum() >= near_copies.MIN_BYTES and bits <= near_copies.MAX_APART
            pairs += 1
    assert met >= 0.99 * pairs


def test_pipeline_stage_drops_copies_of_four_fifths(spark, tmp_path):
    base = prose(7, 100)
    half, less = base.split(), base.split()
    half[10] = half[40] = "other"  # 86 of 106 shingles shared
    less[10] = less[40] = less[70] = "other"  # 81 of 111
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate([base.split(), half, less])] + [(9, prose(8, 100), "en", "s", 1)]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(x.doc_id for x in stage(spark, spark.createDataFrame(rows[:2] + rows[3:], SCHEMA), str(tmp_path)).collect()) == [0, 9]
    assert sorted(x.doc_id for x in stage(spark, spark.createDataFrame([rows[0], *rows[2:]], SCHEMA), str(tmp_path)).collect()) == [0, 2, 9]


def test_representatives_on_hard_rows(hard, none):
    rows, df = hard
    got = simhash.representatives(df, verified=True)
    assert got.columns == df.columns
    kept = [x.doc_id for x in got.collect()]
    assert kept.count(None) == 2 and {i for i in kept if i is not None} == {c for _, c in brute([r[:2] for r in rows]) if c is not None} and len(kept) == len(set(kept)) + 1
    assert simhash.representatives(none, verified=True).collect() == []


def test_sketches_of_posts_rule_out_no_pair():
    """Folded sketches of any two widths differ in no more parities than the sets differ in members; pairs at the threshold pass, far ones do not."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    sets = []
    for n in (1, 6, 30, 120, 500, 3_000, 40_000):
        a = draw(n)
        sets += [a, np.concatenate([a[: n - n // 9], draw(n // 9)]), np.concatenate([a[: n // 2], draw(n - n // 2)])]
    sketches = [near_copies._folded(near_copies._wide_sketch(s)) for s in sets]
    assert max(map(len, sketches)) == near_copies.MOST_SKETCH and len(set(map(len, sketches))) > 2
    words = np.zeros(len(sets), np.int64)
    x = near_copies._Lists([words, words, np.array([len(s) for s in sets]), words, words, words, np.array(sketches, object)])
    a, b = np.triu_indices(len(sets), 1)
    kept = x.sift(a, b)
    for i, j, k in zip(a, b, kept):
        shared, both = len(np.intersect1d(sets[i], sets[j])), len(np.union1d(sets[i], sets[j]))
        assert k or shared * 5 < both * 4
    assert not kept[[(i, j) in {(9, 11), (12, 14)} for i, j in zip(a.tolist(), b.tolist())]].any()


def test_posts_of_lists_with_more_pairs_come_again_once(spark, monkeypatch):
    """A group of near copies, some of them near to few: after the first meeting one more finds every pair that is left."""
    met, meet = [], near_copies._meet
    monkeypatch.setattr(near_copies, "_meet", lambda posts, salt, whole, size: met.append(whole) or meet(posts, salt, whole, size))
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(i, changed(r, " ".join(base), r.randrange(5))) for i in range(80)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == brute(rows) and met == [False, True]


def test_sketches_rule_out_most_pairs_just_below_the_threshold():
    """Sets of 146 shingles with 40 that only one has (0.76) pass for nearly none, those with 32 (0.80) all: else members of a large group that are near no other would be tested with most of it."""
    rng, kept = np.random.default_rng(3), {}
    for apart in (32, 40):
        sets = []
        for _ in range(300):
            h = rng.integers(0, 2**63, 146 + apart // 2).astype(np.uint64)
            sets += [h[:146], h[apart // 2 :]]
        words = np.zeros(600, np.int64)
        sketches = [near_copies._folded(near_copies._wide_sketch(s)) for s in sets]
        x = near_copies._Lists([words, words, np.full(600, 146), words, words, words, np.array(sketches, object)])
        kept[apart] = x.sift(np.arange(0, 600, 2), np.arange(1, 600, 2)).mean()
    assert kept[32] == 1 and kept[40] < 0.05, kept
