"""Cross-tokenizer alignment: which token ids of two tokenizers overlap, counted over the corpus through a minimal perfect hash.

Both tokenizers cut the same bytes, so one sweep over the byte offsets where
their tokens end finds all links (pairs of overlapping occurrences) and groups
(cut where both end). The distinct id pairs of the corpus get a minimal perfect
hash: in buckets, each built by one task, level by level, a key staying at the
level where it meets no other. A pair's number is then an index of a dense count
vector: every task counts its documents into one, the vectors are summed in a
tree, piece by piece, and a second pass aligns the documents again and looks
each link's pair up. The key at the index found is compared, so a pair that is
not there is never taken for another. What workers look up (keys and counts) is
mapped into memory from a file; its size is bounded by the vocabularies' product
and in practice by the pairs that text makes, not by the corpus.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, pretokens, token_files
from .common import cut, shared_dir, small_batches, stored
from .pretokens import gather

BUCKET_KEYS = 1 << 18
GAMMA, LEVELS = 2, 64
#: Counts in a piece of the dense vectors, tasks that make one each at most, and vectors that one task of the tree sums.
PIECE, COUNT_TASKS, FAN = 1 << 16, 4096, 32
#: Bytes of ids that are aligned at once; a longer document is so by itself.
PART_BYTES = 1 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Plain(token_files.LibraryEncoder):
    """The library's encoder to which the strings of special tokens are plain text."""

    def _cut(self, text: str) -> list[str | int]:
        return [text] if text else []


class Pair:
    """Two tokenizers: a byte-level BPE (A) and a sentencepiece model (B), and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = _Plain(a), SentencePieceProcessor(model_file=b)
        vocab = self.a.vocab
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        pieces = [piece(i) for i in range(self.b.get_piece_size())]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.bytes = {"a": (vocab.piece_bytes, vocab.piece_starts, vocab.piece_sizes), "b": (np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)}

    def sizes(self, side: str) -> np.ndarray:
        return self.bytes[side][2]

    def says(self, side: str, ids: np.ndarray) -> bytes:
        flat, starts, sizes = self.bytes[side]
        return gather(flat, starts[ids], sizes[ids]).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both for each text; none where either's bytes are not the text's with a blank before it."""
        there = [i for i, t in enumerate(texts) if t]
        out = [(np.empty(0, np.int64),) * 2] * len(texts)
        spaced = [f" {texts[i]}" for i in there]
        for i, text, a, b in zip(there, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in there], num_threads=1), strict=True):
            raw, b = text.encode(), np.array(b, np.int64)
            if self.says("a", a) == raw and self.says("b", b) == raw:
                out[i] = (a, b)
        return out


@functools.lru_cache(maxsize=1)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def _token(last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the token in which each byte lies; last: which bytes a token ends with."""
    return np.cumsum(last, dtype=np.int64)[at] - last[at]


class Aligned:
    """The links and groups of some documents. a, b: the ids of all of them; a_bounds, b_bounds: where each document's begin, and the end."""

    def __init__(self, tokenizers: Pair, a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray):
        self.a, self.b, self.a_bounds, self.b_bounds = a, b, a_bounds, b_bounds
        # Both say the same bytes in each document, so offsets run on from one document to the next.
        self.a_ends, self.b_ends = (np.cumsum(tokenizers.sizes(side)[ids]) for side, ids in (("a", a), ("b", b)))
        # Which bytes a token ends with, and how many tokens ended before each byte: the token that a byte lies in.
        size = int(self.a_ends[-1]) if len(self.a_ends) else 0
        self.a_last, self.b_last = np.zeros(size, bool), np.zeros(size, bool)
        self.a_last[self.a_ends - 1] = self.b_last[self.b_ends - 1] = True
        # Each stretch between neighbouring ends, of either, lies in one token of A and one of B: it is their link.
        last = np.flatnonzero(self.a_last | self.b_last)
        self.link_a, self.link_b = _token(self.a_last, last), _token(self.b_last, last)

    def pairs(self) -> np.ndarray:
        """The id pair of each link as one number."""
        return self.a[self.link_a] << 32 | self.b[self.link_b]

    def links_by_document(self, values: np.ndarray) -> np.ndarray:
        """The sum of values of links over each document."""
        return np.diff(np.r_[0, np.cumsum(values)][np.searchsorted(self.link_a, self.a_bounds)])

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """How many groups each document has, and what they are: ``a1,a2|b1;a3|b2,b3``."""
        both = self.a_last & self.b_last
        in_a, in_b = _token(both, self.a_ends - 1), _token(both, self.b_ends - 1)
        n = int(np.count_nonzero(both))
        n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        at = np.r_[0, np.cumsum(2 * (n_a + n_b))]  # every id has a mark behind it
        flat, starts, sizes = _numbers(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)
        comma, bar, semicolon = len(starts) - 3, len(starts) - 2, len(starts) - 1
        said = np.empty(int(at[-1]), np.int64)
        for ids, group, first, begins, n, last in ((self.a, in_a, first_a, at[:-1], n_a, bar), (self.b, in_b, first_b, at[:-1] + 2 * n_a, n_b, semicolon)):
            turn = np.arange(len(ids)) - first[group]
            place = begins[group] + 2 * turn
            said[place], said[place + 1] = ids, np.where(turn == n[group] - 1, last, comma)
        text = gather(flat, starts[said], sizes[said]).tobytes()
        group_bounds = np.searchsorted(first_a, self.a_bounds)  # documents begin with a group
        ends = np.r_[0, np.cumsum(sizes[said])][at[group_bounds]].tolist()
        return np.diff(group_bounds), [text[s : max(s, e - 1)] for s, e in zip(ends[:-1], ends[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def _number_table(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    said = [*(str(i).encode() for i in range(n)), b",", b"|", b";"]
    sizes = np.fromiter(map(len, said), np.int64, len(said))
    return np.frombuffer(b"".join(said), np.uint8), np.cumsum(sizes) - sizes, sizes


def _numbers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digits of the numbers below a power of two from ``n`` on, then of the marks."""
    return _number_table(1 << max(8, int(n).bit_length()))


def _mixed(keys: np.ndarray, turn: int) -> np.ndarray:
    h = (keys + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys, LEVELS) % np.uint64(buckets)).astype(np.int64)


def build_bucket(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bits of each level of a minimal perfect hash of distinct keys, and the keys in the order of their numbers."""
    levels, order, left = [], [], keys.astype(np.uint64)
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys of a minimal perfect hash must be distinct")
        size = -(-GAMMA * len(left) // 64) * 64
        place = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        stays = alone[place]
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        order.append(left[stays][np.argsort(place[stays])])
        left = left[~stays]
    return levels, np.concatenate(order) if order else left


class PerfectHash:
    """A minimal perfect hash in buckets: numbers 0 to n - 1 for n keys; what is no key may get any number."""

    def __init__(self, buckets: list[list[np.ndarray]]):
        self.depth = max(map(len, buckets), default=0)
        self.base, self.size = np.zeros((len(buckets), self.depth), np.int64), np.zeros((len(buckets), self.depth), np.uint64)
        words, at = [], 0
        for i, levels in enumerate(buckets):
            for j, bits in enumerate(levels):
                self.base[i, j], self.size[i, j] = at, len(bits) * 64
                words.append(bits)
                at += len(bits)
        self.words = np.concatenate([*words, np.empty(0, np.uint64)])
        set_ = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(set_) - set_
        self.n = int(set_.sum())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it is surely none."""
        keys = keys.astype(np.uint64)
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        bucket = _bucket(keys, len(self.base)) if len(self.base) else left[:0]
        if not len(self.base):
            return found
        for level in range(self.depth):
            size = self.size[bucket[left], level]
            left, size = left[size > 0], size[size > 0]
            place = _mixed(keys[left], level) % size
            word = self.base[bucket[left], level] + (place >> np.uint64(6)).astype(np.int64)
            bit = place & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return found


def tokens(docs: DataFrame, text: str = "text", id_col: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, a, b) of every row: the ids of both tokenizers as little-endian unsigned 32-bit integers, 16-bit where the vocabulary allows."""
    paths = (a or bpe.default_tokenizer(), b or default_pieces())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*paths)
        for ids, texts in pretokens.blocks(bpe._rows(batches)):
            found = both.encode(texts)
            packed = [[x.astype(_kind(both, side)).tobytes() for x in xs] for side, xs in zip("ab", zip(*found, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "a", "b"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, a binary, b binary")


def _kind(both: Pair, side: str) -> str:
    return "<u2" if len(both.sizes(side)) <= 1 << 16 else "<u4"


def _aligned(both: Pair, batch: pa.RecordBatch) -> Aligned:
    parts = []
    for side in "ab":
        column, kind = batch.column(batch.schema.get_field_index(side)), _kind(both, side)
        raw = [x.as_py() for x in column]
        parts += [np.frombuffer(b"".join(raw), kind).astype(np.int64), np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)] // np.dtype(kind).itemsize]
    return Aligned(both, *parts)


def _parts(both: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Documents of about PART_BYTES of ids, aligned; what the encoder remembers is not needed any more and given back."""
    both.a._forget()
    for batch in batches:
        sizes = sum(np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)) for c in (batch.column(batch.schema.get_field_index(x)) for x in "ab"))
        cut_at = np.flatnonzero(np.diff(np.cumsum(sizes) // PART_BYTES)) + 1
        edges = [0, *cut_at.tolist(), batch.num_rows]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(s, e - s)
            yield part, _aligned(both, part)


def distinct_pairs(rows: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(key) of every id pair that is linked anywhere, each once; a task says a pair once."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, known = pair(*paths), np.empty(0, np.uint64)
        there = bpe.Lookup(known)
        for _, aligned in _parts(both, batches):
            pairs = aligned.pairs().astype(np.uint64)
            new = np.unique(pairs[there(pairs) < 0] if len(known) else pairs)
            if len(new):
                known = np.concatenate([known, new])
                there = bpe.Lookup(known)
        known = known.view(np.int64)
        for i in range(0, len(known), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(known[i : i + 65_536])], ["key"])

    return small_batches(rows).mapInArrow(seen, "key long").distinct()


def build_hash(keys: DataFrame, folder: str) -> int:
    """A minimal perfect hash of distinct keys, one row a bucket written to ``folder``; how many keys there are."""
    n = keys.count()
    buckets = max(1, -(-n // BUCKET_KEYS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(b.column(0).to_numpy().astype(np.uint64), buckets)), b.column(0)], ["bucket", "key"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            levels, order = build_bucket(np.concatenate(held))
            return pa.RecordBatch.from_pydict({"buckets": [buckets], "bucket": [now], "levels": [[x.tobytes() for x in levels]], "keys": [order.tobytes()]}, schema=pa.schema({"buckets": pa.int64(), "bucket": pa.int64(), "levels": pa.list_(pa.binary()), "keys": pa.binary()}))

        for b in batches:
            of, values = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]).tolist()
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if held and of[s] != now:
                    yield close()
                    held = []
                now = int(of[s])
                held.append(values[s:e])
        if held:
            yield close()

    dealt = keys.mapInArrow(deal, "bucket long, key long").repartition("bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(build, "buckets long, bucket long, levels array<binary>, keys binary").write.parquet(folder)
    return n


def _mapped(array: np.ndarray) -> np.ndarray:
    """The array as a mapped file of this worker's, so that its pages can leave memory; the file goes with the worker."""
    if not len(array):
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, array.dtype, "r")


def _read(folder: str) -> list[dict]:
    store, base = token_files._store(folder)
    return pq.read_table(base, filesystem=store).to_pylist()


@functools.lru_cache(maxsize=2)
def _hash(folder: str) -> tuple[PerfectHash, np.ndarray]:
    """The hash in a folder, and its keys by their numbers."""
    rows = sorted(_read(folder), key=lambda r: r["bucket"])
    levels: list[list[np.ndarray]] = [[] for _ in range(rows[0]["buckets"] if rows else 0)]
    for r in rows:
        levels[r["bucket"]] = [np.frombuffer(x, np.uint64) for x in r["levels"]]
    return PerfectHash(levels), _mapped(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in rows)]))


def numbers(folder: str, keys: np.ndarray) -> np.ndarray:
    """The verified number of each key: that of the key that stands there; -1 where it is another."""
    hash_, there = _hash(folder)
    found = hash_(keys)
    return np.where((found >= 0) & (there[found] == keys.astype(np.uint64)), found, -1) if len(there) else found


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, slot, counts) sorted by piece and slot to one row for each, the vectors added."""
    now, total = None, None
    done = lambda: pa.RecordBatch.from_pydict({"piece": [now[0]], "slot": [now[1]], "counts": [total.tobytes()]}, schema=pa.schema({"piece": pa.int64(), "slot": pa.int64(), "counts": pa.binary()}))
    for b in batches:
        for piece, slot, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (piece, slot):
                if now:
                    yield done()
                now, total = (piece, slot), np.zeros(len(counts) // 8, np.int64)
            total += np.frombuffer(counts, np.int64)
    if now:
        yield done()


VECTORS = "piece long, slot long, counts binary"


def count_pairs(rows: DataFrame, paths: tuple[str, str], hashed: str, n: int) -> DataFrame:
    """(piece, slot, counts): the links of each pair by its number, in pieces of PIECE counts; pieces without links are left out.

    Every task counts into one vector; vectors are summed FAN at a time until one is left.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, total, part = pair(*paths), np.zeros(n, np.int64), TaskContext.get().partitionId()
        for _, aligned in _parts(both, batches):
            np.add.at(total, numbers(hashed, aligned.pairs()), 1)
        for i in range(0, n, PIECE):
            some = total[i : i + PIECE]
            if some.any():
                yield pa.RecordBatch.from_pydict({"piece": [i // PIECE], "slot": [part], "counts": [some.tobytes()]}, schema=pa.schema({"piece": pa.int64(), "slot": pa.int64(), "counts": pa.binary()}))

    tasks = rows.select("doc_id").rdd.getNumPartitions()
    vectors = small_batches(rows.coalesce(COUNT_TASKS)).mapInArrow(count, VECTORS)
    left = min(tasks, COUNT_TASKS)
    while left > 1:
        left = -(-left // FAN)
        vectors = small_batches(vectors.withColumn("slot", F.floor(F.col("slot") / FAN))).repartition("piece", "slot").sortWithinPartitions("piece", "slot").mapInArrow(_summed, VECTORS)
    return vectors


@functools.lru_cache(maxsize=2)
def _counts(folder: str, hashed: str) -> tuple[np.ndarray, np.ndarray]:
    """The count of each number, and whether it is the highest of its B id's pairs."""
    _, keys = _hash(hashed)
    found = np.zeros(len(keys), np.int64)
    for r in _read(folder):
        some = np.frombuffer(r["counts"], np.int64)
        found[r["piece"] * PIECE : r["piece"] * PIECE + len(some)] = some
    b = (np.asarray(keys) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    highest = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, b, found)
    return _mapped(found), _mapped(found == highest[b])


def align(docs: DataFrame, text: str = "text", id_col: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row; groups is the alignment itself, as text.

    Tokens are those of the text with a blank before it. Null and empty texts, and those whose tokens say other bytes, have none: zeros
    and an empty text. Repeated rows count as often as they are there and each come back; an empty table gives an empty result.
    """
    paths = (a or bpe.default_tokenizer(), b or default_pieces())
    rows = stored(tokens(docs, text, id_col, *paths), "token-pairs")
    folder = f"{shared_dir(docs.sparkSession)}/pair-counts-{uuid.uuid4().hex}"
    hashed, counted = f"{folder}/hash", f"{folder}/counts"
    n = build_hash(cut(distinct_pairs(rows, paths)), hashed)
    count_pairs(rows, paths, hashed, n).write.parquet(counted)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*paths)
        counts, best = _counts(counted, hashed)
        for batch, found in _parts(both, batches):
            at = numbers(hashed, found.pairs())
            if (at < 0).any():
                raise ValueError("a pair was not counted: the documents have changed")
            sums = [found.links_by_document(x) for x in (np.ones(len(at), np.int64), best[at], counts[at])]
            n_groups, groups = found.groups()
            columns = [np.diff(found.a_bounds), np.diff(found.b_bounds), n_groups, *sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array([g.decode() for g in groups], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return small_batches(rows).mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").withColumnRenamed("doc_id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256)).alias("groups_sha256")
    return align(docs.select("doc_id", "text")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed)
