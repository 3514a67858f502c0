"""BPE encoding with a minimal acyclic transducer as lexicon, and decoding.

The frequent pre-tokens of the corpus, counted over all documents, are compiled
into a minimal acyclic automaton: words share their prefixes and their suffixes,
and the weights along a word's path add up to the word's number, at which its
token ids stand. The automaton is one file of arrays that every worker maps
into memory. A pre-token is looked up by walking it; one that the automaton does
not accept is merged exactly by the tokenizer's merge ranks. Both are done for
all distinct pre-tokens of a block of texts at once.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import cut, small_batches
from .pretokens import gather

LEXICON_WORDS = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Lookup:
    """Positions of 64-bit keys: a hash table whose probes are array operations."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray | None = None):
        self.keys = keys
        if slots is None:
            slots = np.full(1 << max(4, int(len(keys) * 4).bit_length()), -1, np.int32)
            left = np.arange(len(keys))
            at = self._slot(keys, len(slots))
            while len(left):
                free = slots[at] < 0
                slots[at[free]] = left[free]
                again = slots[at] != left
                left, at = left[again], (at[again] + 1) % len(slots)
        self.slots = slots

    @staticmethod
    def _slot(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        at = self._slot(keys, len(self.slots))
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(left):
            at[left] = (at[left] + 1) % len(self.slots)
            hit = self.slots[at[left]]
            found[left] = hit
            left = left[(hit >= 0) & (self.keys[hit] != keys[left])]
        return found


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library, as arrays."""

    NEVER = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab = spec["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        added = {a["id"]: a["content"] for a in spec["added_tokens"]}
        size = max(*vocab.values(), *added) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            if i not in added:
                pieces[i] = bytes(byte[c] for c in token)
        for i, content in added.items():
            pieces[i] = content.encode()
        self.special = {content: i for i, content in added.items()}
        self.single = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = Lookup(keys)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_sizes = np.fromiter(map(len, pieces), np.int64, size)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words data[start:end], end to end, and how many each has.

        In every round each word's pair of lowest rank is merged wherever it stands, leftmost first; words without a pair are done.
        """
        sizes = ends - starts
        ids = self.single[gather(data, starts, sizes)]
        word = np.repeat(np.arange(len(starts)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), self.NEVER, np.int32)
            inner = np.flatnonzero(word[1:] == word[:-1])
            found = self.ranks((ids[inner].astype(np.uint64) << np.uint64(32)) | ids[inner + 1].astype(np.uint64))
            rank[inner] = np.where(found >= 0, found, self.NEVER)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, heads)
            counts = np.diff(np.r_[heads, len(ids)])
            open_ = np.repeat(lowest != self.NEVER, counts)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_words.append(word[~open_])
                if not open_.any():
                    break
            hit = open_ & (rank == np.repeat(lowest, counts))
            at = np.flatnonzero(hit)
            # Of pairs that overlap (a a a), every other one.
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            ids[at] = self.merged[rank[at]]
            keep = open_
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(starts), np.int64)
        all_ids, all_words = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.bincount(all_words, minlength=len(starts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of token ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        raw = gather(self.piece_bytes, self.piece_starts[ids], self.piece_sizes[ids]).tobytes()
        return raw.decode("utf-8", errors="replace").encode("utf-8")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """A minimal acyclic automaton of words, numbered in byte order, with the token ids of each."""

    FIELDS = ("arcs", "slots", "targets", "weights", "final", "starts", "sizes", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.lookup = Lookup(arrays["arcs"], arrays["slots"])

    @classmethod
    def compile(cls, words: list[bytes], vocab: Vocabulary) -> Transducer:
        words = sorted(set(words))
        nodes: list[tuple[dict[int, int], bool]] = []  # finished states: arcs in byte order, whether final
        same: dict[tuple, int] = {}

        def finish(state: tuple[dict[int, int], bool]) -> int:
            key = (state[1], *state[0].items())
            if key not in same:
                same[key] = len(nodes)
                nodes.append(state)
            return same[key]

        # States of the last word's path that may still grow; a state is finished, and shared with an equal one, when the words leave it.
        path: list[list] = [[{}, False]]
        last = b""

        def leave(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, final = path.pop()
                path[-1][0][last[len(path) - 1]] = finish((arcs, final))

        for w in words:
            common = len(os.path.commonprefix([last, w]))
            leave(common)
            path += [[{}, False] for _ in w[common:]]
            path[-1][1] = True
            last = w
        leave(0)
        root = finish((path[0][0], path[0][1]))
        below = np.zeros(len(nodes), np.int64)  # words from each state on; arcs lead to states finished before
        arcs, targets, weights = [], [], []
        for i, (out, final) in enumerate(nodes):
            total = int(final)
            for b, t in out.items():
                arcs.append(i << 8 | b)
                targets.append(t)
                weights.append(total)
                total += int(below[t])
            below[i] = total
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.r_[0, ends[:-1]] if words else ends
        ids, sizes = vocab.merge(data, starts, ends)
        keys = np.array(arcs, np.uint64)
        return cls({
            "arcs": keys, "slots": Lookup(keys).slots, "targets": np.array(targets, np.int32), "weights": np.array(weights, np.int32),
            "final": np.array([f for _, f in nodes] + [root], np.int32), "starts": np.cumsum(sizes) - sizes, "sizes": sizes, "ids": ids,
        })

    def dump(self) -> bytes:
        """The automaton as one file: each array in npy format, at offsets that a header lists."""
        body, at = io.BytesIO(), []
        for f in self.FIELDS:
            body.write(b"\0" * (-body.tell() % 64))
            at.append(body.tell())
            np.save(body, np.ascontiguousarray(self.a[f]))
        return np.array(at, "<i8").tobytes() + body.getvalue()

    @classmethod
    def load(cls, path: str) -> Transducer:
        """The automaton of a file, mapped into memory."""
        head = 8 * len(cls.FIELDS)
        arrays = {}
        with open(path, "rb") as f:
            for field, at in zip(cls.FIELDS, np.frombuffer(f.read(head), "<i8"), strict=True):
                f.seek(head + int(at))
                np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                arrays[field] = np.memmap(path, dtype, "r", f.tell(), shape) if shape[0] else np.empty(0, dtype)
        return cls(arrays)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end], or -1 where it is not accepted."""
        final, root = self.a["final"][:-1], int(self.a["final"][-1])
        number, state = np.zeros(len(starts), np.int64), np.full(len(starts), root, np.int64)
        going, depth = np.arange(len(starts)), 0
        answer = np.full(len(starts), -1, np.int64)
        while len(going):
            over = ends[going] - starts[going] == depth
            ended = going[over]
            answer[ended] = np.where(final[state[ended]] > 0, number[ended], -1)
            going = going[~over]
            if not len(going) or not len(self.a["arcs"]):
                break
            arc = self.lookup((state[going].astype(np.uint64) << np.uint64(8)) | data[starts[going] + depth].astype(np.uint64))
            going, arc = going[arc >= 0], arc[arc >= 0]
            number[going] += self.a["weights"][arc]
            state[going] = self.a["targets"][arc]
            depth += 1
        return answer


class Encoder:
    """Texts to token ids and back."""

    def __init__(self, vocab: Vocabulary, lexicon: Transducer):
        self.vocab, self.lexicon = vocab, lexicon

    def _distinct(self, block: pretokens.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, start and size of each distinct pre-token's ids."""
        data = np.frombuffer(block.data, np.uint8)
        number = self.lexicon.number(data, block.starts, block.ends)
        rare = np.flatnonzero(number < 0)
        ids, sizes = self.vocab.merge(data, block.starts[rare], block.ends[rare])
        start, size = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        known = number >= 0
        start[known], size[known] = self.lexicon.a["starts"][number[known]], self.lexicon.a["sizes"][number[known]]
        start[rare], size[rare] = len(self.lexicon.a["ids"]) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([self.lexicon.a["ids"], ids]), start, size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the strings of special tokens in it become those tokens, as the library has it."""
        parts, owner, special = [], [], []
        for n, text in enumerate(texts):
            for part in self._cut(text):
                parts.append(part if isinstance(part, str) else "")
                special.append(-1 if isinstance(part, str) else part)
                owner.append(n)
        block = pretokens.pretokenize(parts)
        flat, start, size = self._distinct(block)
        sizes = size[block.places]
        ids = gather(flat, start[block.places], sizes)
        ends = np.r_[0, np.cumsum(sizes)][block.bounds]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for n, s, a, b in zip(owner, special, ends[:-1], ends[1:], strict=True):
            found[n].append(ids[a:b] if s < 0 else np.array([s]))
        return [f[0] if len(f) == 1 else np.concatenate(f) if f else np.empty(0, np.int64) for f in found]

    def _cut(self, text: str) -> list[str | int]:
        for content, i in self.vocab.special.items():
            if content in text:
                return [x for k, part in enumerate(text.split(content)) for x in ((i,) if k else ()) + tuple(self._cut(part))]
        return [text] if text else []


@functools.lru_cache(maxsize=2)
def _mapped(content: str, make) -> Transducer:
    handle, path = tempfile.mkstemp(suffix=".lexicon")
    with os.fdopen(handle, "wb") as f:
        f.write(make.value)
    found = Transducer.load(path)
    os.unlink(path)  # the mapping keeps it
    return found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield i, t.as_py() or ""


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every pre-token of all texts, in bytes, and how often it occurs; counted in each block, then map-side, then over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pretokens.blocks((None, t.as_py() or "") for b in batches for t in b.column(0)):
            block = pretokens.pretokenize(texts)
            yield pa.RecordBatch.from_arrays([pa.array(block.words(), pa.binary()), pa.array(block.counts.astype(np.int64))], ["word", "n"])

    return small_batches(docs).select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str = "text", tokenizer: str | None = None, words: int = LEXICON_WORDS) -> Transducer:
    """The transducer of the most frequent pre-tokens, ``words`` of them at most; only those reach the driver.

    A histogram of the counts (in bins of three digits, so of bounded size) gives the count from which on they are few enough.
    """
    counts = cut(word_counts(docs, text).filter("n > 1"))
    digits = F.expr("cast(power(10, greatest(0, length(cast(n as string)) - 3)) as long)")
    bins = counts.groupBy((F.floor(F.col("n") / digits) * digits).alias("low")).count().orderBy(F.desc("low")).collect()
    least, total = None, 0
    for b in bins:
        total += b["count"]
        if total > words:
            break
        least = b.low
    top = [] if least is None else counts.filter(F.col("n") >= int(least)).select("word").collect()
    return Transducer.compile([bytes(r.word) for r in top], vocabulary(tokenizer or default_tokenizer()))


def encode_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) of every row.

    ids: array<int>. Null and empty texts have no ids; repeated rows each come back; an empty table gives an empty result.
    """
    path = tokenizer or default_tokenizer()
    content = build_lexicon(docs, text, path, words).dump()
    sent, name = docs.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path), _mapped(name, _Sent(sent)))
        for rows, texts in pretokens.blocks(_rows(batches)):
            found = encoder.encode(texts)
            sizes = [len(f) for f in found]
            flat = np.concatenate([*found, np.empty(0, np.int64)]).astype("<u4")
            hashes = [hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found]
            decoded = [hashlib.sha256(encoder.vocab.decode(f)).hexdigest() for f in found]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(hashes), pa.array(decoded)], ["id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


class _Sent:
    """A broadcast that lru_cache takes for any other."""

    def __init__(self, sent):
        self._sent = sent

    value = property(lambda self: self._sent.value)
    __hash__ = lambda self: 0
    __eq__ = lambda self, other: True


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode_documents(docs.select("doc_id", "text"), tokenizer=tokenizer).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
