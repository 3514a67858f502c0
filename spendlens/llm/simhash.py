"""SimHash near-dedup: a byte-position inverted index with count filtering.

Two 64-bit fingerprints with ``MAX_BITS`` (4) or fewer differing bits differ in
at most four of their eight bytes, so they share at least four positional bytes:
that is the guaranteed minimum of matches. Posting lists of single positional
bytes would hold a 256th of all fingerprints each. The index therefore posts
every fingerprint under triples of positional bytes, for the 20 triples of
``TRIPLES``: any four of the eight positions include one of them whole, so a
pair with the minimum of matches meets in a list, and a list holds about a
16-millionth of all. Pairs that meet are tallied for all eight bytes, those with
four or more matches stay, and their differing bits are counted.

Copies fall together before the index: it holds each fingerprint once. Inside a
list, links are followed from member to member (each is linked once to where it
was reached from), so a list of many near copies yields as many links as members
and not all their pairs. Lists longer than ``LONG_LIST`` are linked by midpoints
instead: two fingerprints within four bits have a common neighbour within two
bits of both, and all that share a neighbour are within four bits of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.components import connected_components

from . import near_copies
from .common import cut, small_batches
from .shingles import bit_sums, shingle_hashes

WORDS = 4
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
LONG_LIST = 50_000
SHORT_LIST = 12
ADDED = ("fingerprint", "component_id")


def triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any four positions include one whole (20, the least number there is).

    The positions fall into three parts; the triples are those inside a part and those with two in a part and one in the next.
    """
    part = lambda p: p % 3
    found = []
    for t in combinations(range(8), 3):
        parts = sorted(part(p) for p in t)
        if len(set(parts)) == 1 or (len(set(parts)) == 2 and (next(x for x in parts if parts.count(x) == 2) + 1) % 3 == next(x for x in parts if parts.count(x) == 1)):
            found.append(t)
    return found


TRIPLES = triples()


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: A-Z lower-cased, words split at ASCII white space, XXH64 of each 4-word shingle.

    A text of fewer words counts as one shingle; one without words, or null, has fingerprint 0.
    """
    hashes = shingle_hashes(text, WORDS)
    return int.from_bytes(np.packbits(bit_sums(hashes) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return small_batches(rows).mapInArrow(_fingerprints, "doc_id long, fp long")


def _close(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` share MIN_BYTES positional bytes with ``one`` and differ in MAX_BITS bits at most."""
    apart = others ^ one
    return (np.count_nonzero(apart.view(np.uint8).reshape(-1, 8) == 0, axis=1) >= MIN_BYTES) & (np.bitwise_count(apart) <= MAX_BITS)


def _reached(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what can be reached inside one list: at most one for each member."""
    links, left = [], prints
    while len(left) > 1:
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            one = wave.pop()
            hit = _close(one, left)
            new = left[hit]
            links += [(one, x) for x in new]
            wave += list(new)
            left = left[~hit]
    return links


def _linked(keys: np.ndarray, prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Links (from, to) of whole posting lists, rows sorted by key, and the members of long lists."""
    a, b, long = [], [], []
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    short = np.repeat(sizes <= SHORT_LIST, sizes)
    for d in range(1, min(SHORT_LIST, int(sizes.max(initial=1)))):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & short[d:])
        if not len(same):
            break
        x, y = prints[same], prints[same + d]
        apart = x ^ y
        hit = (np.count_nonzero(apart.view(np.uint8).reshape(-1, 8) == 0, axis=1) >= MIN_BYTES) & (np.bitwise_count(apart) <= MAX_BITS)
        a.append(x[hit])
        b.append(y[hit])
    for i in np.flatnonzero(sizes > SHORT_LIST):
        members = prints[bounds[i] : bounds[i + 1]]
        if len(members) > LONG_LIST:
            long.append(members)
        elif links := _reached(members):
            pairs = np.array(links, dtype=np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return a, b, long


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links; a list may run over several batches."""

    def out(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, long = _linked(keys, prints)
        x, y = (np.concatenate([*z, *long]).astype(np.uint64).view(np.int64) if z or long else np.empty(0, np.int64) for z in (a, b))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.arange(len(x)) >= len(x) - sum(map(len, long)))], ["src", "dst", "long"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows so far, and smaller keys before them

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            yield from out(np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held]))

    for batch in batches:
        if batch.num_rows:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (held and held[-1][0][-1] != keys[0]):
                held.append((keys[:last], prints[:last]))
                yield from close()
                held = []
            held.append((keys[last:], prints[last:]))
    yield from close()


def _neighbours() -> list[int]:
    """The masks of two bits at most, as signed longs."""
    masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _midpoint_links(prints: DataFrame) -> DataFrame:
    """Links among the members of long lists, through common neighbours; linear in the members."""
    masks = prints.sparkSession.createDataFrame([(m,) for m in _neighbours()], "mask long")
    near = prints.join(F.broadcast(masks)).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))  # 2,081 masks, always
    least = near.groupBy("mid").agg(F.min("fp").alias("dst"))
    return near.join(least, "mid").filter("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


def links(prints: DataFrame) -> DataFrame:
    """(src, dst) pairs of different fingerprints that join every pair within MAX_BITS. prints: distinct fp."""
    byte = lambda p: f"(shiftrightunsigned(fp, {8 * p}) & 255L)"
    key = lambda i, t: f"{i << 24}L | shiftleft({byte(t[0])}, 16) | shiftleft({byte(t[1])}, 8) | {byte(t[2])}"
    posted = prints.select(F.expr(f"explode(array({', '.join(key(i, t) for i, t in enumerate(TRIPLES))}))").alias("key"), "fp")
    found = cut(posted.repartition("key").sortWithinPartitions("key").mapInArrow(_lists, "src long, dst long, long boolean"))
    short = found.filter("not long").select("src", "dst")
    if found.filter("long").isEmpty():
        return short
    return short.unionByName(_midpoint_links(found.filter("long").select(F.col("src").alias("fp")).distinct()))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id among all rows reachable by links of MAX_BITS or
    fewer differing bits, equal fingerprints included. Null and empty texts have fingerprint 0 and link like any other;
    null ids count for no minimum (null if a component has no other); repeated rows each come back; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, text, id_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(nodes.select("fp")))
    member = cut(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    least = cut(member.groupBy("root").agg(F.min("least").alias("component_id")))  # stored, so that the rows of a large component can be split in the join
    label = member.join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, members: DataFrame, text: str, id_col: str) -> DataFrame:
    """The rows of ``docs`` but for those that ``members`` (doc_id, component_id) gives another id.

    Of rows alike in id and text one stays; rows without an id stay.
    """
    drop = members.filter("component_id is not null and doc_id <> component_id")
    drop = drop.select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.struct("*").alias("row"))
    named = named.join(drop.withColumnRenamed(id_col, "id"), "id", "left_anti").dropDuplicates(["id", "hash"])
    return named.select("row.*").unionByName(docs.filter(F.col(id_col).isNull()))


def representatives(docs: DataFrame, text: str = "text", id_col: str = "doc_id", verified: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, with the columns of ``docs``.

    Fingerprints of 64 bits within MAX_BITS are linked; or, if ``verified``, texts that share 0.8 or more of their five-word
    shingles, found by wide fingerprints in the same kind of index and verified on the shingles (near_copies).
    Of rows alike in id and text one stays; rows without an id stay.
    """
    members = near_duplicates(docs, text, id_col) if not verified else near_copies.near_copies(docs, text, id_col)
    return without_copies(docs, members, text, id_col)
