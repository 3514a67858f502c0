"""Spelling variants, language-model scores and token alignment against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spendlens.llm import alignment, ngrams, spellings

from .conftest import SCHEMA, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(got, want):
    assert Counter(got) == Counter(want)


# Spelling variants


def brute_words(rows):
    n = Counter()
    for i, t, *_ in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = m.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


def brute_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, some in near.items():
        if some and n[best := min(some, key=lambda v: (-n[v], v))] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n]


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_hard_rows(hard):
    rows, df = hard
    same([tuple(r) for r in spellings.variants(df).select(*COLUMNS).collect()], brute_variants(brute_words(rows)))


@pytest.mark.parametrize("cell", [spellings.CELL_VECTORS, 6])
def test_variants_in_one_cell_and_in_many(spark, cell):
    """Chains of forms, anagrams, words of a few letters in every order, doubled letters, long words, letters beyond a-z."""
    import itertools

    words = {"colour": 40, "color": 9, "colr": 5, "colors": 4, "Straße": 8, "strase": 4, "éclairs": 6, "eclairs": 3, "àaaaaa": 3, "aaaaaa": 7, "aaaaa": 3, "aaaaaaa": 14, "tables": 5, "stable": 5, "bleats": 5, "tablet": 4, "rare": 90, "seldom": 2}
    words |= {"".join(p): 3 + len(set(p[:3])) for p in itertools.product("ab", repeat=6)}
    long = "ab" * 60
    words |= {long: 8, long[:50] + "c" + long[51:]: 4, long[:70] + long[71:]: 3, long + "q": 3, "x" + long: 3, "a" * 63: 3, "a" * 64: 7, "a" * 65: 3, "a" * 66: 3, "a" * 64 + "b": 3}
    rows = [(1, " ".join(w for w, k in words.items() for _ in range(k))), (2, "x1color2 colour-colour_color"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    n = brute_words(rows)
    assert len(n) > 80
    same([tuple(r) for r in spellings.variants(df, cell=cell).select(*COLUMNS).collect()], brute_variants(n))


def test_cells_hold_every_near_vector():
    r = np.random.default_rng(3)
    texts = sorted({"".join(sorted(r.choice(list("abcdeàü"), n))) for n in r.integers(5, 9, 900)})
    cells = spellings.Cells(texts[::2], 0.5, 20)
    assert len({c for length in (5, 6, 7, 8) for c in cells.near(length, spellings.counts([t for t in texts if len(t) == length]), 0, 0)[1]}) > 10
    vectors = spellings.counts(texts)
    home = {t: cells.near(len(t), vectors[i : i + 1], 0, 0)[1] for i, t in enumerate(texts)}
    assert all(len(h) == 1 for h in home.values())
    for i, a in enumerate(texts):
        same_length, longer = (set(cells.near(len(a) + more, vectors[i : i + 1], 1, 1 - more)[1]) for more in (0, 1))
        for j, b in enumerate(texts):
            apart = vectors[j] - vectors[i]
            up, down = np.maximum(apart, 0).sum(), np.maximum(-apart, 0).sum()
            if (up, down) == (1, 1):
                assert home[b][0] in same_length
            elif (up, down) == (1, 0):
                assert home[b][0] in longer
    tree = spellings.Tree(vectors, 4)
    for up, down in ((1, 1), (1, 0)):
        apart = vectors[None] - vectors[:, None]
        want = np.argwhere((np.maximum(apart, 0).sum(2) == up) & (np.maximum(-apart, 0).sum(2) == down))
        same(zip(*(x.tolist() for x in tree.search(vectors, up, down)), strict=True), map(tuple, want.tolist()))


def test_variants_of_nothing(none, spark):
    assert spellings.variants(none).collect() == []
    assert spellings.variants(spark.createDataFrame([(1, "a bb 12 ccccc")], "doc_id long, text string")).collect() == []


# Language-model scores


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + ["\n"]


def brute_discounts(counts):
    n = [sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)]
    if not all(n[:3]):
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3))
    return found if all(0 <= d <= i for i, d in enumerate(found, 1)) else (0.5, 1.0, 1.5)


class Brute:
    def __init__(self, texts):
        some = [tokens(t) for t in texts]
        self.one = Counter(w for t in some for w in t)
        self.two = Counter(p for t in some for p in zip(["\t", *t[:-1]], t, strict=True))
        self.behind = Counter(b for _, b in self.two)
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.high, self.low = brute_discounts(self.two), brute_discounts(self.behind)
        self.total, self.left = Counter(), defaultdict(float)
        for (a, _), n in self.two.items():
            self.total[a] += n
            self.left[a] += self.less(n, self.high)
        self.rest = sum(self.less(n, self.low) for n in self.behind.values()) / len(self.two) if self.two else 1.0

    @staticmethod
    def less(n, d):
        return d[min(n, 3) - 1] if n else 0.0

    def own(self, w):
        n = self.behind[w]
        return max(n - self.less(n, self.low), 0) / max(1, len(self.two)) + self.rest / (self.v + 1)

    def p(self, a, b):
        if not self.total[a]:
            return self.own(b)
        n = self.two[a, b]
        return max(n - self.less(n, self.high), 0) / self.total[a] + self.left[a] / self.total[a] * self.own(b)

    def row(self, i, text):
        t = tokens(text)
        base = sum(math.log10((self.one[w] + 1) / (self.n + self.v + 1)) for w in t)
        score = sum(math.log10(self.p(a, b)) for a, b in zip(["\t", *t[:-1]], t, strict=True))
        return (i, held(i), len(t), sum(w in self.one for w in t), self.n, f"{base:.6f}", f"{score:.6f}")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def scored(df, **options):
    model = ngrams.build(df, **options)
    return model, [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}", f"{r.score:.6f}") for r in ngrams.score(df, model, **options).collect()]


@pytest.mark.parametrize("shard_tokens", [ngrams.SHARD_TOKENS, 3_000])
def test_scores(hard, monkeypatch, shard_tokens):
    """In one shard and in many, with hot words dealt out by the pair."""
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", shard_tokens)
    rows, df = hard
    more = [(700 + i, "the same the " * 900 + prose(60 + i, 30)) for i in range(3)]
    rows, df = [r[:2] for r in rows] + more, df.select("doc_id", "text").unionByName(df.sparkSession.createDataFrame(more, "doc_id long, text string"))
    brute = Brute([r[1] for r in rows if not held(r[0])])
    model, got = scored(df)
    assert (model.shards > 10) == (shard_tokens == 3_000) == (len(model.hot) > 0)
    same(got, [brute.row(r[0], r[1]) for r in rows])


def test_probabilities_of_all_words_add_up_to_one(spark):
    texts = [prose(i, 300, lexicon=60) for i in range(20)]
    model = ngrams.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert model.high != ngrams.FALLBACK
    brute = Brute([t for i, t in enumerate(texts) if not held(i)])
    words = sorted(brute.one)
    hashes = np.array([ngrams.END if w == "\n" else ngrams.hashed_words([w])[0][0] for w in [*words, "unheard"]], np.int64)
    order = np.argsort(hashes)
    places = model.places(hashes[order])
    assert places.tolist() == sorted(places) or (hashes[-1] in hashes[order] and (places == len(words)).sum() == 1)
    by_place = np.argsort(places)
    count, own = np.empty(len(hashes), np.int64), np.empty(len(hashes))
    count[order[by_place]] = model.at(places[by_place], "counts")
    own[order[by_place]] = model.own(model.at(places[by_place], "behind"))
    assert own.sum() == pytest.approx(1) and count.tolist() == [*(brute.one[w] for w in words), 0]
    for before in (words[3], words[7], "\t", "unheard"):
        first = ngrams.START if before == "\t" else hashes[-1] if before == "unheard" else hashes[words.index(before)]
        p = ngrams.probabilities(model, 0, np.full(len(hashes), first), hashes, own)
        assert p.sum() == pytest.approx(1)
        assert p == pytest.approx([brute.p(before, w) for w in [*words, "unheard"]])


def test_held_out_text_scores_worse_and_counts_are_of_all_training_rows(spark):
    df = spark.createDataFrame([(i, prose(i % 3, 200)) for i in range(60)] + [(100 + i, prose(50 + i, 200)) for i in range(40)], "doc_id long, text string")
    _, got = scored(df)
    assert {r[4] for r in got} == {sum(r[2] for r in got if not r[1])}


def test_pairs_that_occur_often_are_counted_whole(spark):
    df = spark.createDataFrame([(i, "a b " * 400 + f"w{i}") for i in range(5)], "doc_id long, text string")
    brute = Brute(["a b " * 400 + f"w{i}" for i in range(5) if not held(i)])
    same(scored(df)[1], [brute.row(i, "a b " * 400 + f"w{i}") for i in range(5)])


def test_scores_without_training_rows(none, spark):
    from pyspark.sql import functions as F

    assert scored(none)[1] == []
    df = spark.createDataFrame([(2, "one two")], "doc_id long, text string")
    model, got = scored(df, out=F.lit(True))
    assert (model.tokens, model.words) == (0, 0) and got == [(2, True, 3, 0, 0, "0.000000", "0.000000")]


def test_arrays_pack_and_unpack():
    arrays = [np.array([], np.int64), np.arange(5), np.array([-1, 1 << 62, 7])]
    assert all((a == b).all() for a, b in zip(arrays, ngrams.unpack(ngrams.pack(*arrays)), strict=True))


# Token alignment


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor

    a = Tokenizer.from_file(alignment.bpe.default_tokenizer())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.default_pieces())


def brute_alignment(text, libraries):
    a, b = libraries
    if not text:
        return [], [], [], []
    raw, byte = f" {text}".encode(), {c: i for i, c in enumerate(alignment.bpe.byte_letters())}
    found, ids = a.encode(f" {text}", add_special_tokens=False), b.encode(text)
    ids_a = found.ids
    says_a = [bytes(byte[c] for c in t) for t in found.tokens]
    says_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids)]
    if b"".join(says_a) != raw or b"".join(says_b) != raw:
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(t) for t in says_a]), np.cumsum([len(t) for t in says_b])
    links, groups, i, j, part = [], [], 0, 0, ([], [])
    while i < len(says_a) and j < len(ids):
        links.append((ids_a[i], ids[j]))
        end_a, end_b = ends_a[i], ends_b[j]
        if end_a <= end_b:
            part[0].append(str(ids_a[i]))
            i += 1
        if end_b <= end_a:
            part[1].append(str(ids[j]))
            j += 1
        if end_a == end_b:
            groups.append(f"{','.join(part[0])}|{','.join(part[1])}")
            part = ([], [])
    return ids_a, ids, links, groups


def brute_rows(texts, libraries):
    found = [brute_alignment(t, libraries) for t in texts]
    count = Counter(x for f in found for x in f[2])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, x, g in found]


ODD = ["a  b\t c\n<s> </s> <|endoftext|> <0x41>", "▁x", "é́ ﬁ 漢字 😀​", " ", "  two", "x" * 3000, "\x00\x01", "tail \n"]


@pytest.mark.parametrize("bucket", [alignment.BUCKET_KEYS, 50])
def test_alignment(spark, hard, libraries, monkeypatch, bucket):
    monkeypatch.setattr(alignment, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(alignment, "FAN", 2)
    rows, df = hard
    texts = [r[1] for r in rows] + ODD
    ids = [r[0] for r in rows] + list(range(900, 900 + len(ODD)))
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(list(zip(ids[len(rows) :], ODD, strict=True)), "doc_id long, text string")).repartition(5)
    got = alignment.digest(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same([tuple(r) for r in got.collect()], [(i, *r) for i, r in zip(ids, brute_rows(texts, libraries), strict=True)])


def test_alignment_with_clashing_columns_and_of_nothing(hard, none, spark):
    rows, df = hard
    assert alignment.align(df.selectExpr("*", "'x' as a", "'y' as b", "'z' as n_a")).count() == len(rows)
    assert alignment.digest(none).collect() == []
    empty = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    same([tuple(r) for r in alignment.digest(empty).collect()], [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)])


def test_perfect_hash_is_minimal_and_keys_are_verified():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 48, 20_000))
    buckets = 7
    of = alignment._bucket(keys.astype(np.uint64), buckets)
    made = [alignment.build_bucket(keys[of == b]) for b in range(buckets)]
    found = alignment.PerfectHash([m[0] for m in made])
    at = found(keys)
    assert found.n == len(keys) and (np.sort(at) == np.arange(len(keys))).all()
    assert (np.concatenate([m[1] for m in made])[at] == keys.astype(np.uint64)).all()
    assert alignment.PerfectHash([])(keys[:3]).tolist() == [-1, -1, -1]


def test_scores_with_clashing_columns(hard):
    rows, df = hard
    some = df.selectExpr("*", "1 as row", "'x' as held_out", "'y' as base", "map('k', 1) as extra")
    assert ngrams.score(some, ngrams.build(some)).count() == len(rows)


def test_schema_of_documents_is_enough(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha", "en", "s", 3)], SCHEMA)
    assert alignment.digest(df).count() == ngrams.digest(df).count() == 1 and spellings.digest(df).count() == 0
