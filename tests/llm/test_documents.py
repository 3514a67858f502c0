"""Operators on documents against brute force, on hard rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from spendlens.llm import bpe, exact_dedup, language_id, mixing, pretokens, secrets_scan, simhash, suffix_dedup, token_files, wavelet

from .conftest import SCHEMA, prose

WHITE = re.compile("[\x20\x09-\x0d]")


def same(got, want):
    assert Counter(got) == Counter(want)


# SimHash


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_triples_cover_every_four_positions():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20 and all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_simhash(hard):
    rows, df = hard
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, g in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    got = simhash.near_duplicates(df).collect()
    same([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, roots, strict=True)])


@pytest.mark.parametrize("long", [simhash.LONG_LIST, 20])
def test_links_reach_all_near_fingerprints(spark, monkeypatch, long):
    monkeypatch.setattr(simhash, "LONG_LIST", long)
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(50)}
    for center in list(prints)[:3]:
        for _ in range(60):
            p = center
            for _ in range(r.randint(1, 7)):
                p ^= 1 << r.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from spendlens.operators.components import connected_components

    found = connected_components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")))
    got = {r.node: r.component for r in found.collect()}
    roots = brute_components(prints)
    partition = {}
    for s, g in zip(signed, roots, strict=True):
        partition.setdefault(g, set()).add(s)
    mine = {}
    for s in signed:
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, partition.values())) == sorted(map(sorted, mine.values()))


def test_members_of_long_lists_link_by_midpoints(spark):
    r = random.Random(2)
    center = r.getrandbits(62)
    prints = sorted({center ^ sum(1 << b for b in r.sample(range(62), r.randint(0, 5))) for _ in range(40)})
    got = simhash._midpoint_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert all((x.src ^ x.dst).bit_count() <= 4 for x in got)
    joined = brute_components(prints)
    group = {p: p for p in prints}
    for _ in prints:
        for x in got:
            group[x.src] = group[x.dst] = min(group[x.src], group[x.dst])
    assert len(set(group.values())) == len(set(joined))


def test_near_copies_leave_one(hard):
    rows, df = hard
    kept = [r.doc_id for r in simhash.representatives(df).collect()]
    assert kept.count(0) == 1 and 1 not in kept and 3 not in kept and 10 in kept and kept.count(None) == 2


# Exact dedup


def test_exact_dedup(hard):
    rows, df = hard
    groups = {}
    for r in rows:
        groups.setdefault(WHITE.sub("", r[1] or ""), []).append(r)
    key = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    want = []
    for text, members in groups.items():
        order = sorted(members, key=key)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(r[0], order[0][0], len(members), i == 0, sha) for i, r in enumerate(order)]
    same([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.digest(df).collect()], want)
    same([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df.select("doc_id", "text", "kept")).collect()], want)
    assert exact_dedup.deduplicated(df).count() == len(groups)


# Language ID


def test_language_id(spark):
    french, english, german = ("le la de un et les des que qui dans", "the of and to in is that it for was", "der die und das ist nicht ein von mit sich")
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(words.split()) + r.choice(["", "a", "on"]) for _ in range(30)), lang, "s", 1) for i, (words, lang) in enumerate([(french, "fr"), (english, "en"), (german, "de")] * 60)]
    rows += [(900, None, "en", None, None), (901, "", "fr", None, None), (902, "123 !?", None, None, None), (None, "the of and it", None, None, None), (903, "и в не на", None, None, None)]
    got = language_id.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert {g.doc_id: g.lang_pred for g in got}[900] == "und" and {g.doc_id: g.lang_pred for g in got}[902] == "und"
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    truth = {i: lang for i, _, lang, _, _ in rows}
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 900]
    assert np.mean([g.lang_pred == truth[g.doc_id] for g in held]) > 0.95
    assert {g.doc_id for g in language_id.recognised(spark.createDataFrame(rows, SCHEMA)).collect()}.isdisjoint({900, 901, 902})


def test_every_language_is_drawn_whatever_its_rows():
    counts = {f"l{k}": 4 * 10**8 + k for k in range(200)} | {"small": 3, "huge": 10**15}
    each, below = language_id.limits(counts)
    assert set(below) == set(counts) and each >= language_id.LEAST_ROWS
    for k, n in counts.items():
        expected = n * (below[k] + (1 << 63)) / 2**64
        assert expected >= min(n, 3.9 * each) and below[k] < 1 << 63
        assert expected <= 4.1 * each or n <= 4 * each


def test_many_languages_are_learned(spark):
    r = random.Random(7)
    words = {f"q{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(160)}
    rows = [(k * 20 + i, " ".join(r.choice(w) for _ in range(40)), lang, "s", 1) for k, (lang, w) in enumerate(words.items()) for i in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert {x for m in model.members.values() for x in m} == set(words)


def naive_features(text):
    """Shares of hashed bigrams and trigrams, counted one by one."""
    b = [c if c >= 128 or chr(c).isalpha() else 32 for c in (" " + text.lower() + " ").encode()]
    cells = [0] * language_id.FEATURES
    for i in range(len(b) - 1):
        cells[((b[i] << 8 | b[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    for i in range(len(b) - 2):
        cells[(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) + (1 << 24)) * 0x85EBCA6B & 0xFFFFFFFF) >> 20] += 1
    return [(c / max(1, sum(cells))) ** 0.5 for c in cells]


def test_language_id_against_plain_python(spark):
    """The query's predictions are those of the fitted machines asked one by one: family by the largest margin, then a vote of pairs."""
    vocab = {"fr": "le la de un et les", "es": "el la de un y los", "en": "the of and to in is", "de": "der die und das ist nicht"}
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(vocab[lang].split()) + r.choice(["", "a", "o"]) for _ in range(12)), lang, "s", 1) for i in range(40) for lang in [r.choice(sorted(vocab))]]
    df = spark.createDataFrame(rows + [(99, "12 3", "en", "s", 1), (98, None, "fr", "s", 1)], SCHEMA)
    model = language_id.fit(df)
    for got in language_id.identify(df, model).collect():
        if got.text is None or not any(c.isalpha() for c in got.text):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        x = naive_features(got.text)
        assert np.allclose(x, language_id.features(got.text))
        margin = lambda m: sum(a * b for a, b in zip(m.w.tolist(), x)) + m.b
        family = max(model.families, key=lambda f: margin(model.families[f]))
        votes = Counter({k: 0 for k in model.members[family]})
        total = Counter()
        for (a, b), m in model.pairs.items():
            if a in votes and b in votes:
                votes[a if margin(m) >= 0 else b] += 1
                total[a] += margin(m)
                total[b] -= margin(m)
        assert got.lang_pred == max(votes, key=lambda k: (votes[k], total[k]))


def test_language_id_without_labels(hard, spark):
    _, df = hard
    assert {r.lang_pred for r in language_id.digest(df.selectExpr("doc_id", "text", "cast(null as string) as lang", "score")).collect()} == {"und"}


# Token files and BPE


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe(hard, tokenizer):
    rows, df = hard
    want = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df).collect()], want)


def test_pretokens_and_merges_on_odd_texts(tokenizer):
    import public_tokenizers
    import regex

    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'D", "é", "ß", "1", "23", "!", "?!", "<|endoftext|>", "\t", "\xa0", "漢", "😀", " 's", "''", "don't", "_", "\u3000", "the", "aaaa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    block = pretokens.pretokenize(texts)
    words, pattern = block.words(), regex.compile(public_tokenizers.PATTERN)
    for k, t in enumerate(texts):
        assert [words[i].decode() for i in block.places[block.bounds[k] : block.bounds[k + 1]]] == pattern.findall(t)
    vocab = bpe.vocabulary(bpe.default_tokenizer())
    for lexicon in ([], [w for w in words if len(w) > 1]):
        got = bpe.Encoder(vocab, bpe.Transducer.compile(lexicon, vocab)).encode(texts)
        assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_transducer_shares_and_numbers(tmp_path):
    vocab = bpe.vocabulary(bpe.default_tokenizer())
    words = sorted({f"{a}{b}{c}".encode() for a in ("", "re", "un") for b in ("do", "make", "tie") for c in ("", "s", "ing")})
    (tmp_path / "lexicon").write_bytes(bpe.Transducer.compile(words, vocab).dump())
    t = bpe.Transducer.load(str(tmp_path / "lexicon"))
    data = np.frombuffer(b"".join([*words, b"red", b"zzz"]), np.uint8)
    ends = np.cumsum([len(w) for w in [*words, b"red", b"zzz"]])
    assert t.number(data, np.r_[0, ends[:-1]], ends).tolist() == [*range(len(words)), -1, -1]
    assert len(t.a["final"]) - 1 < 25  # endings are shared


def test_token_files(hard, tokenizer, tmp_path):
    rows, df = hard
    got = token_files.digest(df).collect()
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(r[0], len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for r in rows for ids in [tokenizer.encode(r[1] or "", add_special_tokens=False).ids]])
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in ordered] == np.r_[0, np.cumsum([r.n_tokens for r in ordered])[:-1]].tolist()


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for size, top in ((1, 1), (1, 9), (1500, 300), (4097, 60_000), (600, 70_000)):
        ids = r.integers(0, top, size)
        m = wavelet.WaveletMatrix.frombytes(wavelet.WaveletMatrix.build(np.array([7]), np.array([True]), np.array([size]), ids).tobytes())
        places = np.random.default_rng(size).integers(0, size, 50) if size else np.empty(0, np.int64)
        assert (m.access(places) == ids[places]).all()
        assert (m.tokens() == ids).all() and all(m[i] == ids[i] for i in range(0, size, 97))
        for t in {int(ids[0]), int(ids[-1]), top}:
            at = np.flatnonzero(ids == t)
            assert m.count(t) == len(at) and [m.find(t, k) for k in range(len(at))] == at.tolist()
            assert m.count(t, size // 3, size // 2) == ((at >= size // 3) & (at < size // 2)).sum()
        with pytest.raises(IndexError):
            m[size]


# Secrets


def test_base_spans(spark):
    r = random.Random(6)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", ": ", "=", ' = "', "abc123", "x", "AKIA", "ABCDEFGHIJ123456", "0123456789abcdef", "deadbeef", " ", "é", "😀", "\n", "'", "_-./+"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, "", "a" * 30_000]
    got = {x.doc_id: x for x in secrets_scan.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assign = re.compile(secrets_scan.ASSIGN, re.A)
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 1, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 3, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = [k for _, k, _ in spans]
        listed = ",".join(f"{secrets_scan.KINDS[k - 1]}:{s}:{e}" for s, k, e in sorted(spans))
        x = got[i]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(kinds.count(k) for k in (1, 2, 3))
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(x.spans.split(","))


def test_random_tokens_are_found_and_words_are_not(spark):
    import string

    r = random.Random(9)
    secrets = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(30)]
    plain = ["aaaaaaaaaaaaaaaaaaaa1111111111111111", "abcabcabcabcabcabcabcabc123123123123", "version_1_version_2_version_3_version_4", "internationalisation"]
    rows = [(i, f"see {s} there") for i, s in enumerate(secrets + plain * 10)]
    got = {x.doc_id: x.spans for x in secrets_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i, s in got.items() if "random" in s]
    assert sum(i < 30 for i in found) >= 26 and not [i for i in found if i >= 30]
    assert got[found[0]] == "random:4:44"


def test_secrets_on_hard_rows(hard):
    rows, df = hard
    assert secrets_scan.find_secrets(df).count() == len(rows) and secrets_scan.digest(df).count() == len(rows)


# Suffix dedup


def removed(texts):
    seen = {}
    for n, t in enumerate(texts):
        for i in range(len(t) - 399):
            seen.setdefault(t[i : i + 400], []).append((n, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for n, i in places:
                gone[n][i : i + 400] = True
    return gone


@pytest.mark.parametrize("group_rows, few", [(suffix_dedup.GROUP_ROWS, suffix_dedup.FEW), (3, 2), (1, 1)])
def test_suffix_dedup(spark, monkeypatch, group_rows, few):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    r = random.Random(5)
    base = [prose(k, 300) for k in range(10)]
    texts = [None, "", "short", "z" * 399, "z" * 400, "z" * 900, "ab" * 450, "é" * 600]
    for _ in range(50):
        t = "".join(r.choice(base)[r.randint(0, 500) :][: r.randint(50, 900)] for _ in range(r.randint(1, 4)))
        texts.append(t * 2 if r.random() < 0.3 else t)
    for k in range(40):
        t = list(base[k % 3])
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += texts[-1:]
    ids = [*range(len(texts) - 1), len(texts) - 2]  # the last row is there twice
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, t, gone in zip(ids, raw, removed(raw), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = suffix_dedup.digest(df).collect()
    same([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got], want)
    whole = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    assert all(x.text == whole[x.doc_id] if not x.n_removed else hashlib.sha256(x.text.encode()).hexdigest() == x.kept_sha256 or "\ufffd" in x.text for x in got)


def test_suffix_dedup_across_pieces(spark, monkeypatch):
    from spendlens.llm.suffix_dedup import _pieces
    import pyarrow as pa

    t = prose(4, 200_000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([t])], ["d", "h", "text"])
    pieces = [p for block in _pieces(iter([batch])) for p in block]
    assert len(pieces) > 1 and all(t[p[2] : p[2] + len(p[3])].encode() == p[3] for p in pieces)
    starts = sorted((p[2], p[2] + len(p[3]) - 399) for p in pieces)
    assert starts[0][0] == 0 and starts[-1][1] == len(t) - 399 and all(a[1] == b[0] for a, b in zip(starts, starts[1:]))


def test_deep_shallow_order():
    r = random.Random(5)
    for _ in range(150):
        strings = [b"x" * r.choice([0, 33, 40]) + bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 40))]
        assert [strings[i] for i in suffix_dedup.deep_shallow_order(strings)] == sorted(strings)


# Mixing


def test_mixing(hard):
    rows, df = hard
    got = mixing.digest(df).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    source = {(r[0], size(r[1])): r[3] for r in rows if r[0] is not None}
    same([(g.doc_id, g.size) for g in got], [(r[0], size(r[1])) for r in rows])
    taken = {}
    for g in got:
        assert 0 <= g.taken <= 3 * g.size and (g.position is None) == (g.taken == 0)
        if g.doc_id is not None:
            assert g.target == pytest.approx(target[source[g.doc_id, g.size]])
        taken[g.target] = taken.get(g.target, 0) + g.taken
    assert all(abs(t - n) <= 1 for t, n in taken.items())
    same(got, mixing.digest(df.repartition(3)).collect())


def test_due_inverts_the_demand(spark):
    df = spark.createDataFrame([(100.0, s, t) for s in (-1.0, -0.5, 0.0, 0.5, 1.0) for t in (0.0, 0.2, 0.7, 1.0)], "target double, slope double, t double")
    from pyspark.sql import functions as F

    demand = F.col("target") * (F.col("t") + F.col("slope") * (F.col("t") * F.col("t") - F.col("t")))
    assert all(r.due == pytest.approx(r.t, abs=1e-6) for r in df.withColumn("due", mixing.due(demand)).collect())


# Empty tables


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.representatives, language_id.digest, language_id.recognised, exact_dedup.digest, exact_dedup.deduplicated, token_files.digest, secrets_scan.digest, suffix_dedup.digest, bpe.digest, mixing.digest, mixing.mixed])
def test_empty_table(none, operator):
    assert operator(none).collect() == []
