"""The whole pipeline against a plain Python version."""

import hashlib
import math
import random
import re

import numpy as np
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from spendlens.llm import bpe, exact_dedup, mixing

from .conftest import SCHEMA, prose
from .test_near_copies import brute, changed

WHITE = re.compile("[\x20\x09-\x0d]")


def documents(seed):
    """Copies with other white space, near copies on both sides of the threshold, texts without letters, empty ones and long ones, in sources of very different size."""
    r = random.Random(seed)
    texts = [None, "", " \n", "123 456", "!?"]
    for k in range(25):
        base = prose(seed * 50 + k, r.choice([3, 12, 60, 250]))
        texts += [base, base.replace(" ", "\n"), base + " "] if r.random() < 0.4 else [base]
        texts += [changed(r, base, r.choice([1, 2, 9])) for _ in range(r.randint(0, 3))]
    texts.append(prose(seed + 900, 5000))
    r.shuffle(texts)
    return [(i * 7 % 1013, t, r.choice(["en", "fr"]), r.choice(["big", "big", "big", "small", None]), len(t or "")) for i, t in enumerate(texts)]


def half_up(x):
    return math.floor(x + 0.5)


def plain_mix(rows):
    """doc_ids in training order."""
    words = {d: len((t or "").encode().split()) for d, t, _, _, _ in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(words[r[0]] for r in rows if r[3] == s) for s in sources}
    weight, slope = ({s: v[i % 3] for i, s in enumerate(sources)} for v in ((1, 2, 3), (0.5, 0.0, -0.5)))
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        for s in over or set(open_):
            target[s] = 3.0 * total[s] if over else share[s]
            open_.discard(s)
            left -= target[s] if over else 0
    out = []
    for s in sources:
        done = 0
        for d in sorted((r[0] for r in rows if r[3] == s), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
            passes = math.floor(target[s] / total[s])
            taken = passes * words[d] + max(0, min(words[d], half_up(target[s] - passes * total[s]) - done))
            if taken and taken * 2 >= words[d]:
                for copy in range(half_up(taken / words[d])):
                    u, k = min(1.0, (done + copy * total[s] + words[d] / 2) / target[s]), slope[s]
                    out.append((u if k == 0 else (k - 1 + math.sqrt((1 - k) ** 2 + 4 * k * u)) / (2 * k), d, copy))
            done += words[d]
    return [d for _, d, _ in sorted(out)]


def plain_pipeline(rows):
    rows = [r for r in rows if regex.search(r"\p{L}", r[1] or "")]
    best = {}
    for r in rows:
        key = WHITE.sub("", r[1])
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0]))
    rows = list(best.values())
    rows = [r for r, (d, least) in zip(sorted(rows, key=lambda r: str((r[0], 0))), sorted(brute([x[:2] for x in rows]), key=lambda x: str((x[0], 0))), strict=True) if r[0] == d == least]
    return rows, plain_mix(rows)


def test_pipeline_against_plain_python(spark, tmp_path):
    rows = documents(4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    kept, order = plain_pipeline(rows)
    assert len(kept) < len({r[1] for r in rows}) and max(map(order.count, order)) > 1
    text, tokenizer = {r[0]: r[1] for r in rows}, Tokenizer.from_file(bpe.default_tokenizer())
    want = []
    for d in order:
        ids = tokenizer.encode(text[d], add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in got) == sorted(want)
    assert [x.doc_id for x in mixing.mixed(spark.createDataFrame(kept, SCHEMA)).collect()] == order


def test_repeated_rows_are_mixed_as_often_as_they_are_there(spark):
    rows = [(1, "a b c d", "en", "s", 7)] * 3 + [(2, "e f", "en", "t", 3)]
    got = [x.doc_id for x in mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got.count(2) == 3 and got.count(1) in (2, 3)


def test_rows_with_maps_null_ids_and_clashing_names(spark):
    """Maps are no hash of Spark's; rows that differ in one only are different rows, and those without an id are spread."""
    rows = [(i if i % 2 else None, f"a b c {i // 4}", "en", "s", {"k": i // 2}, i % 3, "x", i) for i in range(40)] * 2
    schema = "doc_id long, text string, lang string, source string, tags map<string, int>, __s int, row string, hash int"
    docs = spark.createDataFrame(rows, schema)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 80 and sum(r.kept for r in got) == 10 and {r.group_size for r in got} == {8}
    assert all((r.keep_id, r.kept) in ((4 * (r.hash // 4) + 1, r.doc_id == r.keep_id), (r.keep_id, False)) for r in got)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4 * i + 1 for i in range(10)]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    drawn = sorted(r.hash for r in out.collect())
    assert drawn == sorted([r[7] for r in rows])  # one source: each row as often as it is there
    assert mixing.mix(mixing.sized(docs)).filter("taken = size").count() == 80
