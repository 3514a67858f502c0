"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted by Spark and kept as sorted hash arrays.

Words are 64-bit hashes. Every block of documents turns into the distinct pairs
(word before, word) with their counts, packed and shuffled to shards by the word
before, so that all that follows a word is counted in one shard; a word with too
large a share of the corpus is dealt out by the pair instead. A shard sorts its
pairs and writes them as a file of arrays to the shared folder: hashes of pairs
with counts, and words before with the sums that their discounts and weights
need. How often each word occurs, and behind how many different words, is summed
over the shards into a vocabulary, range-partitioned by hash and written as such
files too.

Scoring reads no model through the driver. A block looks its distinct words up in
the vocabulary, whose files it maps into memory, and sends its pairs to the
shards that have them, words as their places in the vocabulary. The shard maps
its file and the vocabulary, looks all pairs up by binary search and returns a
sum for each document.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import cut, shared_dir, small_batches, stored

#: Tokens that a shard and a block shall hold, shards at most, and the least share of a block with which a word may be a hot one.
SHARD_TOKENS, BLOCK_TOKENS, MAX_SHARDS, LEAST_SHARE = 3_000_000, 1_500_000, 1 << 16, 1 / (1 << 14)
FALLBACK = (0.5, 1.0, 1.5)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a row without an id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _constant(mark: bytes) -> np.int64:
    data = np.frombuffer(mark, np.uint8)
    return pretokens.span_hashes(data, np.array([0]), np.array([1])).view(np.int64)[0]


#: The end of a document, what stands before its first word, and words that the training rows do not have: hashes of white space, which is no word.
END, START, NO_WORD = _constant(b"\n"), _constant(b"\t"), _constant(b" ")


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, A-Z lower-cased, and END behind it; where each text's begin, and the end."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    text_ends = np.cumsum(np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts)))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    words = pretokens.span_hashes(data, starts, ends).view(np.int64) if len(starts) else np.empty(0, np.int64)
    before = np.searchsorted(starts, text_ends)  # words up to each text's end
    return np.insert(words, before, END), np.r_[0, before + np.arange(1, len(texts) + 1)]


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.view(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as bytes: each by planes of its bytes, compressed."""
    sizes = np.array([len(arrays), *map(len, arrays)], "<i8")
    planes = b"".join(np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + planes)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    found, at = [], 8 * (n + 1)
    for size in np.frombuffer(raw[8:at], "<i8").tolist():
        found.append(np.frombuffer(raw[at : at + 8 * size], np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(-1))
        at += 8 * size
    return found


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays in npy format below the shared folder; a repeated task writes the same file again."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        for key in sorted(arrays):
            np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(arrays[key]))
            f.write(np.ascontiguousarray(arrays[key]).data.cast("B") if len(arrays[key]) else b"")
    store.move(draft, f"{base}/{name}")


def map_arrays(folder: str, name: str, keys: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory: where it lies if all machines see that folder, else from a copy that goes with the mapping."""
    store, base = _store(folder)
    path = f"{base}/{name}"
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return _mapped(path, keys)
    handle, copy = tempfile.mkstemp(suffix=".arrays")
    try:
        with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as f:
            while some := f.read(1 << 24):
                out.write(some)
        return _mapped(copy, keys)
    finally:
        os.unlink(copy)


def _mapped(path: str, keys: tuple[str, ...]) -> dict[str, np.ndarray]:
    found = {}
    with open(path, "rb") as f:
        for key in sorted(keys):
            np.lib.format.read_magic(f)
            shape, _, dtype = np.lib.format.read_array_header_1_0(f)
            found[key] = np.memmap(path, dtype, "r", f.tell(), shape) if shape[0] else np.empty(0, dtype)
            f.seek(found[key].nbytes, os.SEEK_CUR)
    return found


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def found_in(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted keys each asked one stands, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def discounts(times: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney smoothing, from how many n-grams have the counts 1, 2, 3 and 4; FALLBACK where those give none."""
    n1, n2, n3, n4 = times
    if not (n1 and n2 and n3):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    found = tuple(i - (i + 1) * y * b / a for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return found if all(0 <= d <= i for i, d in enumerate(found, 1)) else FALLBACK


@dataclass(frozen=True)
class Model:
    """Where the model's arrays are, and the few numbers that all of it shares."""

    folder: str
    shards: int
    hot: np.ndarray  # sorted words that are dealt out by the pair
    hot_sums: np.ndarray  # of each: total, and how many pairs have the counts 1, 2, 3 and more
    vocabulary: tuple[tuple[int, int, str], ...]  # (first word, its place, file), ascending
    tokens: int
    words: int
    pairs: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    low_left: float  # of the words' own probability, what is left for all words alike

    def shard(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        return _shard(before, words, self.hot, self.shards)

    def places(self, words: np.ndarray) -> np.ndarray:
        """The place of each of some ascending words in the vocabulary; ``self.words`` where it is not there."""
        found, edges = np.full(len(words), self.words, np.int64), [*(v[0] for v in self.vocabulary), None]
        for (first, place, name), last in zip(self.vocabulary, edges[1:], strict=True):
            a, z = np.searchsorted(words, first), len(words) if last is None else np.searchsorted(words, last)
            if a < z:
                at, there = found_in(_vocabulary(self.folder, name)["words"], words[a:z])
                found[a:z] = np.where(there, place + at, self.words)
        return found

    def at(self, places: np.ndarray, field: str) -> np.ndarray:
        """A field (words, counts or behind) at ascending places; 0 where there is no word."""
        found, ends = np.zeros(len(places), np.int64), [*(v[1] for v in self.vocabulary[1:]), self.words]
        for (_, place, name), end in zip(self.vocabulary, ends, strict=False):
            a, z = np.searchsorted(places, (place, end))
            if a < z:
                found[a:z] = _vocabulary(self.folder, name)[field][places[a:z] - place]
        return found

    def own(self, behind: np.ndarray) -> np.ndarray:
        """The probability, as the least order has it, of words that stand behind so many different ones."""
        return np.maximum(behind - np.array([0.0, *self.low])[np.minimum(behind, 3)], 0) / max(1, self.pairs) + self.low_left / (self.words + 1)


@functools.lru_cache(maxsize=4096)
def _vocabulary(folder: str, name: str) -> dict[str, np.ndarray]:
    return map_arrays(folder, name, ("words", "counts", "behind"))


def _shard(before: np.ndarray, words: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    _, is_hot = found_in(hot, before)
    return (np.where(is_hot, pair_keys(before, words), pair_keys(before, before)).view(np.uint64) % np.uint64(shards)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows (id, text, held out) in blocks of about BLOCK_TOKENS: (id, held out) of each, the words of all, and where each row's begin."""
    rows, parts, sizes, n = [], [], [], 0
    read = (((i, h), t.as_py() or "") for b in batches for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True))
    for some, texts in pretokens.blocks(read):
        words, bounds = hashed_words(texts)
        rows += some
        parts.append(words)
        sizes.append(np.diff(bounds))
        n += len(words)
        if n >= BLOCK_TOKENS:
            yield rows, np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]
            rows, parts, sizes, n = [], [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]


def _before(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.r_[START, words[:-1]]
    before[bounds[:-1]] = START
    return before


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for s in np.flatnonzero(np.diff(np.r_[0, ends])).tolist():
        yield s, order[(ends[s - 1] if s else 0) : ends[s]]


def _coded(before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words' steps, order, steps of the words before, words) so that pairs stand in an order that packs well."""
    known, inverse = np.unique(np.r_[before, words], return_inverse=True)
    b, w = inverse[: len(before)], inverse[len(before) :]
    order = np.lexsort((w, b))
    return np.diff(known, prepend=0), order, np.diff(b[order], prepend=0), w[order]


def _rows(docs: DataFrame, text: str, id_col: str, out: Column) -> DataFrame:
    return small_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), out.alias("out")))


def _shape(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(shards, hot words): as many shards as the tokens ask for, and words before with over half a shard's share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, bounds in _blocks(batches):
            found, n = np.unique(_before(words, bounds), return_counts=True)
            often = n >= max(2, LEAST_SHARE * len(words))
            yield pa.RecordBatch.from_arrays([pa.array([None, *found[often].tolist()], pa.int64()), pa.array([len(words), *n[often].tolist()], pa.int64())], ["word", "n"])

    counted = cut(rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = sum(r.n for r in counted.filter("word is null").collect())
    shards = int(min(MAX_SHARDS, -(-total // SHARD_TOKENS) or 1))
    hot = counted.filter("word is not null").filter(F.col("n") * 2 * shards > total).select("word")  # 2 * shards words at most
    return shards, np.array(sorted(r.word for r in hot.collect()) if shards > 1 else [], np.int64)


PARTS = "kind int, word long, a long, b long, c long, d long"


def build(docs: DataFrame, text: str = "text", id_col: str = "doc_id", out: Column | None = None) -> Model:
    """A model of the rows that ``out`` (as ``held_out``) does not hold out, its arrays in the shared folder. Null texts count as empty."""
    rows = _rows(docs, text, id_col, held_out(id_col) if out is None else out).filter("not out")
    folder = f"{shared_dir(docs.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    shards, hot = _shape(rows)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, bounds in _blocks(batches):
            before = _before(words, bounds)
            _, first, n = np.unique(pair_keys(before, words), return_index=True, return_counts=True)
            before, words = before[first], words[first]
            for s, at in _by_shard(_shard(before, words, hot, shards), shards):
                known, order, b, w = _coded(before[at], words[at])
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([pack(known, b, w, n[at][order])], pa.binary())], ["shard", "pairs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and s != now:
                    yield from _counted(folder, now, held, hot)
                    held = []
                now = s
                held.append(packed.as_py())
        if held:
            yield from _counted(folder, now, held, hot)

    dealt = rows.mapInArrow(pairs, "shard long, pairs binary").repartition(shards, "shard").sortWithinPartitions("shard")
    parts = stored(dealt.mapInArrow(count, PARTS), "ngram-sums")
    sums = [F.sum(c).alias(c) for c in "abcd"]
    high = parts.filter("kind = 0").agg(*sums).first()
    hot_sums = {r.word: r[1:] for r in parts.filter("kind = 1").groupBy("word").agg(*sums).collect()}  # hot words only
    words = parts.filter("kind = 2").groupBy("word").agg(F.sum("a").alias("n"), F.sum("b").alias("behind"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*((c.to_numpy() for c in b.columns) for b in batches), strict=True)]
        if columns and len(columns[0]):
            word, n, behind = columns
            name = f"words-{TaskContext.get().partitionId():06d}"
            write_arrays(folder, name, {"words": word, "counts": _narrow(n), "behind": _narrow(behind)})
            times = [int((behind == i).sum()) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_pylist([dict(zip(("first", "name", "tokens", "words", "pairs", "n1", "n2", "n3", "n4"), (int(word[0]), name, int(n.sum()), len(word), int(behind.sum()), *times), strict=True))])

    schema = "first long, name string, tokens long, words long, pairs long, n1 long, n2 long, n3 long, n4 long"
    files = sorted(words.repartitionByRange(shards, "word").sortWithinPartitions("word").mapInArrow(store, schema).collect())  # one row a file
    tokens, distinct, types, *times = (sum(f[i] for f in files) for i in range(2, 9))
    low = discounts(tuple(times))
    left = (low[0] * times[0] + low[1] * times[1] + low[2] * (distinct - times[0] - times[1])) / types if types else 1.0
    return Model(folder, shards, hot, np.array([hot_sums.get(w, (0,) * 4) for w in hot.tolist()], np.int64).reshape(-1, 4), tuple((f[0], at, f[1]) for f, at in zip(files, np.cumsum([0, *(f[3] for f in files)]).tolist(), strict=False)), tokens, distinct, types, low, discounts(tuple(high[c] or 0 for c in "abcd")), left)


def _narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n


def _counted(folder: str, shard: int, packed: list[bytes], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's pairs, counted over all blocks, written; and what the whole corpus must sum: kinds 0 (pairs with the counts 1 to 4), 1 (hot words before), 2 (words)."""
    known = np.empty(0, np.int64)
    parts = []
    for p in packed:
        steps, b, w, n = unpack(p)
        words = np.cumsum(steps)
        parts.append((words[np.cumsum(b)], words[w], n))
    before, words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    keys, first, inverse = np.unique(pair_keys(before, words), return_index=True, return_inverse=True)
    before, words, n = before[first], words[first], np.bincount(inverse, n, len(keys)).astype(np.int64)
    del inverse, first
    small = np.minimum(n, 255).astype(np.uint8)
    large = np.flatnonzero(n >= 255)
    known, of = np.unique(before, return_inverse=True)
    sums = np.stack([np.bincount(of, n, len(known)), *(np.bincount(of, m, len(known)) for m in (n == 1, n == 2, n >= 3))]).astype(np.int64)
    often = np.flatnonzero(sums[0] >= 256)  # the other sums are no larger
    write_arrays(folder, f"pairs-{shard:06d}", {"keys": keys, "counts": small, "large": large, "large_counts": n[large], "before": known, "sums": np.minimum(sums, 255).astype(np.uint8).T.reshape(-1), "often": often, "often_sums": sums[:, often].T.reshape(-1)})
    at, there = found_in(known, hot)
    some, of = np.unique(words, return_inverse=True)
    yield _parts(0, np.zeros(1, np.int64), *(np.array([(n == i).sum()]) for i in (1, 2, 3, 4)))
    yield _parts(1, hot[there], *(s[at[there]] for s in sums))
    times, behind = np.bincount(of, n, len(some)).astype(np.int64), np.bincount(of, minlength=len(some))
    for i in range(0, len(some), 65_536):
        z = slice(i, i + 65_536)
        yield _parts(2, some[z], times[z], behind[z], 0 * behind[z], 0 * behind[z])


def _parts(kind: int, word: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), kind, np.int32)), pa.array(word), *(pa.array(np.asarray(s, np.int64)) for s in sums)], ["kind", "word", "a", "b", "c", "d"])


@functools.lru_cache(maxsize=1)
def _pairs(folder: str, shard: int) -> dict[str, np.ndarray]:
    return map_arrays(folder, f"pairs-{shard:06d}", ("keys", "counts", "large", "large_counts", "before", "sums", "often", "often_sums"))


def probabilities(model: Model, shard: int, before: np.ndarray, words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The model's probability of each word behind the word before it; own: as the least order has it. All pairs belong to one shard."""
    try:
        a = _pairs(model.folder, shard)
    except FileNotFoundError:  # no pair of the training documents is in this shard
        return own
    keys = pair_keys(before, words)
    asked, back = np.unique(keys, return_inverse=True)
    at, there = found_in(a["keys"], asked)
    n = np.where(there, a["counts"][at], 0).astype(np.int64)
    where, large = found_in(a["large"], at)
    n[there & large] = a["large_counts"][where[there & large]] if len(a["large"]) else 0
    n = n[back]
    firsts, back = np.unique(before, return_inverse=True)
    at, there = found_in(a["before"], firsts)
    sums = np.where(there[:, None], a["sums"].reshape(-1, 4)[at].astype(np.int64), 0)
    if len(a["often"]):
        where, large = found_in(a["often"], at)
        sums[there & large] = a["often_sums"].reshape(-1, 4)[where[there & large]]
    at, hot = found_in(model.hot, firsts)
    sums[hot] = model.hot_sums[at[hot]]
    total, d = np.maximum(sums[:, 0], 1), np.array([0.0, *model.high])
    left = np.where(sums[:, 0] > 0, sums[:, 1:] @ d[1:] / total, 1.0)
    return np.maximum(n - d[np.minimum(n, 3)], 0) / total[back] + left[back] * own


SCORES = "id long, out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", out: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    Tokens are the words and one end. score: log10 of the model's probability of the text; perplexity: 10 to minus its mean over tokens.
    base_score: as counts with one added have it; n_known: tokens that the training documents have. Null and empty texts are the end
    alone; repeated rows each come back; an empty table gives an empty result; a model of no documents gives every word the same
    probability. ``docs`` should be a stored table, so that a repeated task forms the same blocks.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for rows, words, bounds in _blocks(batches):
            doc = np.repeat(np.arange(len(rows)), np.diff(bounds))
            distinct, inverse = np.unique(words, return_inverse=True)
            places = model.places(distinct)
            order = np.argsort(places)  # words that are not there stand together behind the others
            count = np.empty(len(distinct), np.int64)
            count[order] = model.at(places[order], "counts")
            base = np.log10((count + 1) / (model.tokens + model.words + 1))[inverse]
            ids = np.array([r[0] or 0 for r in rows], np.int64)
            state = np.array([2 * (r[0] is None) + bool(r[1]) for r in rows], np.int64)
            sums = np.bincount(doc, base, len(rows))
            yield _asked(row // len(rows) % model.shards, 0, pack(np.array([row]), ids, state, np.diff(bounds), np.bincount(doc, count[inverse] > 0, len(rows)).astype(np.int64), sums.view(np.int64)))
            shard = model.shard(_before(words, bounds), words)
            place = places[inverse]
            # START is no word of the vocabulary and stands behind those that are not there.
            before = np.r_[model.words + 1, place[:-1]]
            before[bounds[:-1]] = model.words + 1
            del base, inverse, distinct, words
            for s, at in _by_shard(shard, model.shards):
                known, order, b, w = _coded(before[at], place[at])
                yield _asked(s, 1, pack(np.array([row]), known, b, w, doc[at][order]))
            row += len(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, kind, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                (row,), *rest = unpack(packed.as_py())
                if kind == 0:
                    yield _asked(int(row), 0, packed.as_py())
                    continue
                steps, b, w, doc = rest
                known, b = np.cumsum(steps), np.cumsum(b)
                words, own = model.at(known, "words"), model.own(model.at(known, "behind"))
                words[known == model.words], words[known == model.words + 1] = NO_WORD, START
                sums = np.bincount(doc, np.log10(probabilities(model, s, words[b], words[w], own[w])))
                some = np.unique(doc)
                yield _asked(int(row), 1, pack(np.diff(some, prepend=0), sums[some].view(np.int64)))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's documents come first, then what each shard says of them."""
        rows, scores = None, None

        def done() -> pa.RecordBatch:
            ids, state, n, n_known, base = rows
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=state >= 2), pa.array(state % 2 == 1), *map(pa.array, (n, n_known, base.view(np.float64), scores))], ["id", "out", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            for kind, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                arrays = unpack(packed.as_py())
                if kind == 0:
                    if rows:
                        yield done()
                    rows, scores = arrays[1:], np.zeros(len(arrays[1]))
                else:
                    scores[np.cumsum(arrays[0])] += arrays[1].view(np.float64)
        if rows:
            yield done()

    asked = _rows(docs, text, id_col, held_out(id_col) if out is None else out).mapInArrow(ask, "shard long, kind int, pairs binary")
    # A shard's pairs come in its rows one after the other, so the file that is mapped serves all of them.
    said = asked.repartition(model.shards, "shard").sortWithinPartitions("shard").mapInArrow(answer, "block long, kind int, said binary")
    one = said.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(total, SCORES)
    one = one.withColumnsRenamed({"id": id_col, "out": "held_out"})
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return one.select(id_col, "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", perplexity.alias("perplexity"))


def _asked(shard: int, kind: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([kind], pa.int32()), pa.array([packed], pa.binary())], ["shard", "kind", "pairs"])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, by a model of those not held out."""
    some = docs.select("doc_id", "text")
    return score(some, build(some)).drop("perplexity")
