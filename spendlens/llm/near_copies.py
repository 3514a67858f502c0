"""SimHash near-dedup at a Jaccard similarity of word shingles: the operator's general form, with wide fingerprints.

A pair counts if its sets of ``WORDS``-word shingles share ``SHARE`` or more. At
a similarity of 0.8 about 15 of 100 SimHash bits differ and about 27 of 100 bytes
match, so a 64-bit fingerprint promises no match; here fingerprints have
``WIDTH`` bytes. They are posted under tuples of positional bytes: pairs of bytes,
and longer tuples where the texts are so many that lists of pairs would be long
(``tuple_bytes``), always as many tuples (``tuple_count``) that a pair at the
threshold meets in one with a probability of 0.99 or more, twice as many for
texts of few shingles, whose bytes match less often.

Members of a list are compared by the fingerprint's first 128 bits; pairs that
stay are tallied over all WIDTH positional bytes, those with ``MIN_BYTES`` or more
matches and no more than ``MOST_APART`` differing bits stay, and they are verified on
the whole sets, after sketches as wide as the sets are large have ruled out most
of the rest. So no pair below the threshold is linked, and the share of those above
that is missed is under one in a hundred at 0.8 and falls quickly above
(measured in the tests).

Only components are asked for, so a list full of near copies does not make all
its pairs: each member goes to the first, in one order of all nodes, that may be
near it, the same one in most lists, and where lists are long one list in
``TURNS`` is enough for that. Lists with more pairs come again with all their
pairs, but only pairs of different components that their sketches do not rule out
count then, and these are few; a post comes again once at most (once more for each
of ``ROUNDS`` over 1, with another order).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.components import connected_components

from .common import KeyFilter, cut, small_batches
from .shingles import SEED, bit_sums, shingle_hashes

WORDS = 5
SHARE = (4, 5)
#: Bytes of a fingerprint; what a pair at the threshold surely has (of 34 matching bytes and 155 differing bits on average, 19 of them among the first 128).
WIDTH = 128
MIN_BYTES, MAX_APART, MOST_APART = 10, 40, 240
#: The share of bytes that match at the threshold, the share of pairs there that may meet in no tuple, and members of a list by chance.
BYTE_MATCH, MISSED, BY_CHANCE = 0.2687, 0.008, 1_000
#: Texts of fewer shingles are posted twice as often.
FEW_SHINGLES = 32
#: Lists up to SHORT_LIST are compared with array operations over many lists.
SHORT_LIST = 16
#: Rounds in which lists give one pair a member, before those that are left give all; at first longer lists do so under every TURNS-th tuple.
ROUNDS, TURNS = 1, 8
#: Parities of a sketch for each hash; bytes of it that a post of the later rounds carries at most, and pairs whose sketches are compared at once.
SPARE, MOST_SKETCH, PAIRS = 4, 128, 1 << 17
#: Members of a long list that are compared with all others at once.
ROWS = 64


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; none for a text without words."""
    return np.unique(shingle_hashes(text, WORDS))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def tuple_bytes(texts: int) -> int:
    """Bytes of a tuple, so that a list has BY_CHANCE members or fewer by chance."""
    k = 2
    while texts > BY_CHANCE * 256**k:
        k += 1
    return k


def tuple_count(k: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - BYTE_MATCH**k))


@functools.cache
def positions(k: int) -> np.ndarray:
    """(tuples, k) byte positions: random orders of all positions cut into tuples, twice tuple_count(k) of them."""
    order, each = np.random.default_rng(29), WIDTH // k
    wanted = 2 * tuple_count(k)
    return np.concatenate([order.permutation(WIDTH)[: each * k].reshape(each, k) for _ in range(-(-wanted // each))])[:wanted]


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of WIDTH bytes of a set of shingle hashes."""
    return np.packbits(bit_sums(hashes, WIDTH) * 2 > len(hashes), bitorder="little")


def _wide_sketch(hashes: np.ndarray) -> bytes:
    """A sketch of SPARE times as many parities as there are hashes at least: with few of them, hashes that only one set has would cancel each other out."""
    bits = 1 << max(7, (SPARE * len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many parities two wide sketches differ; the longer one is folded to the other's length."""
    x, y = (np.frombuffer(z, np.uint8) for z in (a, b))
    x, y = (z.reshape(-1, min(len(x), len(y))) for z in (x, y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x) ^ np.bitwise_xor.reduce(y)).sum())


def _posted(docs: DataFrame) -> DataFrame:
    """(id, th, node, n, print, sketch) of every row of (id, th, text); node: a hash of the set of shingles, n: its size."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = [shingle_set(t.as_py()) for t in b.column(2)]
                nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_print(s).tobytes() for s in sets], pa.binary()), pa.array([_wide_sketch(s) for s in sets], pa.binary())],
                    ["id", "th", "node", "n", "print", "sketch"],
                )

    return small_batches(docs).mapInArrow(post, "id long, th long, node long, n long, print binary, sketch binary")


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _folded(sketch: bytes) -> bytes:
    """The sketch, folded to MOST_SKETCH bytes if it is longer: its parities still differ no more often than the sets do."""
    return sketch if len(sketch) <= MOST_SKETCH else np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, MOST_SKETCH)).tobytes()


def _posts(nodes: DataFrame, texts: int, sketched: bool = False) -> DataFrame:
    """(key, node, n, p, q, comp): every node (node, n, print, comp) under its tuples of positional bytes; p and q: the first 128 bits of its fingerprint.

    sketched: with sk, the node's sketch, folded.
    """
    k = tuple_bytes(texts)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = positions(k)
        for b in batches:
            node, n, found, comp = b.column(0).to_numpy(), b.column(1).to_numpy(), _prints(b.column(2)), b.column(3).to_numpy()
            head = np.ascontiguousarray(found[:, :16]).view(np.int64)
            sketches = pa.array([_folded(s) for s in b.column(4).to_pylist()], pa.binary()) if sketched else None
            for rows, tuples in ((np.arange(len(n)), slice(0, len(at) // 2)), (np.flatnonzero(n < FEW_SHINGLES), slice(len(at) // 2, None))):
                if not len(rows):
                    continue
                key = np.tile(np.arange(len(at))[tuples], (len(rows), 1))
                for c in range(k):
                    key = key << 8 | found[rows][:, at[tuples, c]]
                again = np.repeat(rows, key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(node[again]), pa.array(n[again]), pa.array(head[again, 0]), pa.array(head[again, 1]), pa.array(comp[again]), *([sketches.take(pa.array(again))] if sketched else [])], names)

    names = ["key", "node", "n", "p", "q", "comp", *(["sk"] if sketched else [])]
    return small_batches(nodes.select("node", "n", "print", "comp", *(["sketch"] if sketched else []))).mapInArrow(post, "key long, node long, n long, p long, q long, comp long" + ", sk binary" * sketched)


class _Lists:
    """Rows (key, node, n, p, q, comp), in later rounds with sk too, of whole lists, sorted by key."""

    def __init__(self, columns: list[np.ndarray]):
        self.key, self.node, self.n, p, q, self.comp = columns[:6]
        self.p, self.q = p.view(np.uint64), q.view(np.uint64)
        self.sketch = columns[6] if len(columns) > 6 else None
        self.width = None if self.sketch is None else np.fromiter(map(len, self.sketch), np.int64, len(self.sketch))
        self.folds: dict[int, np.ndarray] = {}

    def _fold(self, width: int) -> np.ndarray:
        """The sketches of so many bytes or more, folded to them, as 64-bit words."""
        if width not in self.folds:
            out = np.zeros((len(self.node), width), np.uint8)
            for w in np.unique(self.width[self.width >= width]).tolist():
                rows = np.flatnonzero(self.width == w)
                out[rows] = np.bitwise_xor.reduce(np.frombuffer(b"".join(self.sketch[rows]), np.uint8).reshape(-1, w // width, width), axis=1)
            self.folds[width] = out.view(np.uint64)
        return self.folds[width]

    def sift(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows the sketches do not rule out: of sets this similar at most (t - s) / (t + s) of both sizes is apart."""
        keep = np.ones(len(a), bool)
        if self.sketch is None:
            return keep
        (s, t), width = SHARE, np.minimum(self.width[a], self.width[b])
        for w in np.unique(width).tolist():
            fold, of = self._fold(w), np.flatnonzero(width == w)
            for at in range(0, len(of), PAIRS):
                i = of[at : at + PAIRS]
                apart = np.bitwise_count(fold[a[i]] ^ fold[b[i]]).sum(axis=1, dtype=np.int64)
                keep[i] = apart * (t + s) <= (self.n[a[i]] + self.n[b[i]]) * (t - s)
        return keep

    def may(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows sizes, the first 128 bits and their components do not rule out."""
        x, y = SHARE
        n, m = self.n[a], self.n[b]
        apart = np.bitwise_count(self.p[a] ^ self.p[b]) + np.bitwise_count(self.q[a] ^ self.q[b])
        return (np.minimum(n, m) * y >= np.maximum(n, m) * x) & (apart <= MAX_APART) & (self.comp[a] != self.comp[b])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[_Lists]:
    """Rows sorted by key to runs of whole lists; a list may run over several batches."""
    held: list[list[np.ndarray]] = []  # the last key's rows so far, and smaller keys before them
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or (held and held[-1][0][-1] != columns[0][0]):
            held.append([c[:last] for c in columns])
            yield _Lists([np.concatenate(c) for c in zip(*held, strict=True)])
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield _Lists([np.concatenate(c) for c in zip(*held, strict=True)])


def _rank(node: np.ndarray, salt: int) -> np.ndarray:
    """An order of all nodes, the same in every list."""
    h = (node.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _short_pairs(x: _Lists, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs that may be near in all short lists, those whose rows are marked."""
    found = [(np.empty(0, np.int64),) * 2]
    for d in range(1, SHORT_LIST):
        same = np.flatnonzero((x.key[d:] == x.key[:-d]) & short[d:])
        if not len(same):
            break
        same = same[x.may(same, same + d)]
        same = same[x.sift(same, same + d)]
        found.append((same, same + d))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _star(x: _Lists, rank: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one long list a..b: each member that is not the first of its like, with the first that may be near it."""
    left = order = a + np.argsort(rank[a:b])
    ones, others = [], []
    for at in range(0, b - a, ROWS):
        first = order[at : at + ROWS]
        left = left[rank[left] > rank[first[0]]]
        if not len(left):
            break
        near = x.may(first[:, None], left[None, :]) & (rank[first][:, None] < rank[left][None, :])
        hit = near.any(axis=0)
        ones.append(first[near.argmax(axis=0)[hit]])
        others.append(left[hit])
        left = left[~hit]
    return np.concatenate(ones), np.concatenate(others)


def _outsiders(x: _Lists, rank: np.ndarray, a: int, b: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of one long list a..b whose members mostly are of one component: the others with the first (or, if ``whole``, with all) that may be near them, and whether there are more."""
    values, of, sizes = np.unique(x.comp[a:b], return_inverse=True, return_counts=True)
    rows, outside = np.arange(a, b), a + np.flatnonzero(of != np.argmax(sizes))
    for at in range(0, len(outside) if len(values) > 1 else 0, ROWS):
        one = outside[at : at + ROWS]
        near = x.may(one[:, None], rows[None, :])
        i, j = np.nonzero(near)
        near[i, j] = x.sift(one[i], rows[j])
        if whole:
            i, j = np.nonzero(near)
            yield one[i], rows[j], False
        else:
            first = np.where(near, rank[rows][None, :], np.iinfo(np.uint64).max).argmin(axis=1)
            hit = near.any(axis=1)
            yield one[hit], rows[first[hit]], bool((near.sum(axis=1) > 1).any())


def _meet(posts: DataFrame, salt: int, whole: bool, size: int) -> DataFrame:
    """(a, b, more) pairs to test; rows (key, key, true) name the lists that may have more pairs. whole: all pairs, else one a member; size: bytes of a tuple."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[pairs[0], keys]), pa.array(np.r_[pairs[1], keys]), pa.array(np.arange(pairs.shape[1] + len(keys)) >= pairs.shape[1])], ["a", "b", "more"])

        for x in _lists(batches):
            rank = _rank(x.node, salt)
            bounds = np.flatnonzero(np.r_[True, x.key[1:] != x.key[:-1], True])
            sizes = np.diff(bounds)
            one, other = _short_pairs(x, np.repeat(sizes <= SHORT_LIST, sizes))
            many = np.empty(0, np.int64)  # lists that may have more pairs
            if not whole and len(one):
                # Of each member's pairs with earlier ones that with the earliest; lists that lose pairs by that come again.
                early, late = np.where(rank[one] < rank[other], one, other), np.where(rank[one] < rank[other], other, one)
                order = np.lexsort((rank[early], late))
                kept = order[np.r_[True, late[order][1:] != late[order][:-1]]]
                lost = np.ones(len(one), bool)
                lost[kept] = False
                many, one, other = np.unique(x.key[one[lost]]), early[kept], late[kept]
            yield out(x.node[one], x.node[other], many)
            for i in np.flatnonzero(sizes > SHORT_LIST).tolist():
                a, b = int(bounds[i]), int(bounds[i + 1])
                if whole or salt:
                    for one, other, several in _outsiders(x, rank, a, b, whole):
                        yield out(x.node[one], x.node[other], x.key[a : a + several])
                elif int(x.key[a] >> 8 * size) % TURNS == 0:
                    one, other = _star(x, rank, a, b)
                    if len(one):
                        yield out(x.node[one], x.node[other], x.key[a : a + (len(one) > 1)])
                else:
                    yield out(one[:0], one[:0], x.key[a : a + 1])

    dealt = posts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a long, b long, more boolean")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst) of the ``pairs`` (a, b) whose sets are similar enough."""
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    marks = nodes.join(ends(pairs), "node", "left_semi")
    side = lambda df, end, **names: df.select(F.col("node").alias(end), *[F.col(c).alias(n) for n, c in names.items()])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, t = SHARE
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = _prints(batch.column(6)), _prints(batch.column(7))
            keep = ((x == y).sum(axis=1) >= MIN_BYTES) & (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= MOST_APART)
            for i in np.flatnonzero(keep).tolist():
                # Of sets this similar at most (t - s) / (t + s) of both sizes is apart.
                keep[i] = _apart(batch.column(4)[i].as_py(), batch.column(5)[i].as_py()) * (t + s) <= sizes[i] * (t - s)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sketched = pairs.join(side(marks, "a", m="n", x="sketch", u="print"), "a").join(side(marks, "b", n="n", y="sketch", v="print"), "b")
    pairs = cut(small_batches(sketched.select("a", "b", "m", "n", "x", "y", "u", "v")).mapInArrow(sift, "a long, b long"))
    wanted = cut(ends(pairs))
    texts = cut(nodes.join(wanted, "node", "left_semi").select("th").distinct())
    filtered = KeyFilter(texts, "th", texts.count())
    some = filtered.flag(docs.select("th", "text"), "th", "__may").filter("__may").select("text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py())
                lists = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s)], pa.uint64()).view(pa.int64()), lists], ["node", "hashes"])

    sets = small_batches(some).mapInArrow(hashes, "node long, hashes array<long>").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = cut(sets)
    both = pairs.join(side(sets, "a", x="hashes"), "a").join(side(sets, "b", y="hashes"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, t = SHARE
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared * t >= (len(x) + len(y) - shared) * s)
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])

    return cut(small_batches(both.select("a", "b", "x", "y")).mapInArrow(test, "src long, dst long"))


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of similar nodes, that join every similar pair that meets in the index."""
    texts = nodes.count()
    own = F.col("node").alias("comp")
    posts, found = _posts(nodes.select("node", "n", "print", own), texts), None
    for salt in range(ROUNDS + 1):
        met = cut(_meet(posts, salt, salt == ROUNDS, tuple_bytes(texts)))
        links = _verified(docs, nodes, cut(met.filter("not more").select("a", "b").distinct()))
        found = links if found is None else found.unionByName(links)
        more = cut(met.filter("more").select(F.xxhash64("a").alias("hash")).distinct())
        n = more.count()
        if salt == ROUNDS or not n:
            return found
        # Every node comes again with its component, but only posts that may be in a list with more pairs are shuffled.
        label = connected_components(found).withColumnRenamed("node", "of")
        labelled = nodes.join(label, F.col("node") == F.col("of"), "left").select("node", "n", "print", "sketch", F.coalesce("component", "node").alias("comp"))
        posts = KeyFilter(more, "hash", n).flag(_posts(labelled, texts, sketched=True).withColumn("hash", F.xxhash64("key")), "hash", "__may").filter("__may").drop("hash", "__may")


def near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) of every row; component_id: the smallest id among all rows reachable by pairs of SHARE or more.

    Texts of fewer than WORDS words are one shingle, texts without words are alike. Null ids count for no minimum; repeated
    rows each come back; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    posted = cut(_posted(rows))
    # Equal sets are one node; one of its texts serves for all.
    nodes = cut(posted.groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("th", "n", "print", "sketch")]))
    found = connected_components(_links(rows, nodes.drop("least"))).withColumnRenamed("node", "of")
    member = cut(nodes.select("node", "least").join(found, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("component", "node").alias("root")))
    least = cut(member.groupBy("root").agg(F.min("least").alias("component_id")))  # stored, so that the rows of a large component can be split in the join
    label = member.join(least, "root").select("node", "component_id")
    return posted.select("id", "node").join(label, "node").select(F.col("id").alias("doc_id"), "component_id")
