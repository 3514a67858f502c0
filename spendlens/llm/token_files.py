"""Token-ID output: documents in id order as wavelet matrix files, one for each shard, and reading them back.

Documents are range-partitioned by id, so shard follows shard in id order. A task
encodes its range with the tokenizers library (the library's model is asked
once for each distinct pre-token, of which up to ``REMEMBERED`` are kept) and a file every ``SHARD_TOKENS`` tokens, so a task's memory has a bound whatever its
range holds. A file's name says its range and number; a repeated task
writes the same file again.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, pretokens
from .common import cut, shared_dir, small_batches
from .wavelet import WaveletMatrix

END_ID = 2
SHARD_TOKENS = 1 << 21
REMEMBERED = 1_000_000


class LibraryEncoder(bpe.Encoder):
    """Texts to ids by the tokenizers library, whose model is asked once for each pre-token that is not remembered.

    Remembered pre-tokens are arrays sorted by a 64-bit hash, with a second hash to tell apart those that share the first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocab, self.model = bpe.vocabulary(path), Tokenizer.from_file(path).model
        self.letters = dict(enumerate(bpe.byte_letters()))
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.others = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.starts, self.sizes, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _asked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has."""
        tokenize, letters = self.model.tokenize, self.letters
        found, sizes = [], []
        for w in words:
            got = tokenize(w.decode("latin-1").translate(letters))
            sizes.append(len(got))
            found += [t.id for t in got]
        return np.array(found, np.uint32), np.array(sizes, np.int64)

    def _distinct(self, block: pretokens.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = block.hashes
        others = pretokens.span_hashes(np.frombuffer(block.data, np.uint8), block.starts, block.ends, 1)
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        there = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        known = there.copy()
        known[there] = self.others[at[there]] == others[there]
        new = np.flatnonzero(~known)
        ids, n = self._asked(block.words(new.tolist()))
        starts, sizes = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        starts[new], sizes[new] = len(self.ids) + np.cumsum(n) - n, n
        self.ids = np.concatenate([self.ids, ids])
        keep = new[~there[new]]  # hashes that are not there yet
        place = np.searchsorted(self.hashes, hashes[keep])
        self.hashes, self.others = np.insert(self.hashes, place, hashes[keep]), np.insert(self.others, place, others[keep])
        self.starts, self.sizes = np.insert(self.starts, place, starts[keep]), np.insert(self.sizes, place, sizes[keep])
        return self.ids, starts, sizes


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def write_shards(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Encode ``docs``, append END_ID to each, write them below ``folder`` in ascending id order, and return the manifest.

    Manifest: (part, seq, path, n_docs, n_tokens, start), one row for each file, start being the ids before it. Null ids come
    first, rows with the same id in the order of a hash of their texts; null and empty texts are END_ID alone. No documents: no files.
    """
    path = tokenizer or bpe.default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        rows: list[int | None] = []
        tokens: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal rows, tokens, size, seq
            known = np.array([r is not None for r in rows])
            matrix = WaveletMatrix.build(np.array([r or 0 for r in rows], np.int64), known, np.array([len(t) for t in tokens], np.int64), np.concatenate(tokens))
            name = f"shard-{part:06d}-{seq:04d}.wvm"
            draft = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(matrix.tobytes())
            store.move(draft, f"{base}/{name}")
            done = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": name, "n_docs": len(rows), "n_tokens": size}])
            rows, tokens, size, seq = [], [], 0, seq + 1
            return done

        for ids, texts in pretokens.blocks(bpe._rows(batches)):
            for i, found in zip(ids, encoder.encode(texts), strict=True):
                rows.append(i)
                tokens.append(np.r_[found, END_ID].astype(np.uint32))
                size += len(found) + 1
                if size >= SHARD_TOKENS:
                    yield close()
        if rows:
            yield close()

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    files = cut(ordered.mapInArrow(write, "part long, seq long, path string, n_docs long, n_tokens long"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row for each task
    parts = parts.select("part", before(Window.orderBy("part")).alias("first"))
    own = files.withColumn("own", before(Window.partitionBy("part").orderBy("seq")))
    return own.join(parts, "part").withColumn("start", F.col("first") + F.col("own")).drop("first", "own")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    matrix = WaveletMatrix.frombytes(f.read())
                raw = memoryview(matrix.tokens().astype("<u4").tobytes())
                ends = np.cumsum(matrix.sizes)
                starts = ends - matrix.sizes
                if (matrix.access(ends - 1) != END_ID).any():
                    raise ValueError(f"{name}: a document does not end with {END_ID}")
                sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(matrix.docs, mask=~matrix.known), pa.array(first + starts), pa.array(matrix.sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path", "start").repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files written."""
    folder = new_folder(docs.sparkSession)
    return read_shards(write_shards(docs, folder, tokenizer=tokenizer), folder)
