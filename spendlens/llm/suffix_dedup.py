"""Removal of repeated byte strings with a sparse suffix array sorted deep-shallow.

A byte goes if a string of ``LENGTH`` (400) bytes that covers it also starts
anywhere else. Not every suffix is sorted. Of the grams of ``GRAM`` bytes inside
a string, the one with the least hash (the leftmost of equals) is its anchor; that
depends on the string alone, so equal strings have their anchor at the same
place, and only strings with equal anchors need comparing. Strings that start
next to one another mostly share an anchor: such a run of starts is one row (its
anchor's hash, and a 128-bit hash of all the bytes its strings cover).

Rows that are alone with their anchor repeat nothing. Of the others, runs equal
in all bytes are counted together before anything meets in a task, and those
counted twice are repeated whole. Where an anchor has different runs, one of each is
sorted: the suffixes behind the anchor and, read backwards, the prefixes before
it. Sorting is deep-shallow: multikey quicksort by groups of characters to
``SHALLOW`` bytes, then a blind trie for each group that shares those. From the
order and the common prefixes of neighbours follows for every start whether
another run has the same LENGTH bytes there.

An anchor with more than ``GROUP_ROWS`` different runs is divided first: of the
places before the anchor at which a string may start, one half is taken at a
time. Strings that start in one half share bytes before and behind the anchor
that the half fixes, so runs meet only where those bytes are equal; halving goes
on until groups are small, at the latest at single starts, where a group is
one repeated string. So no group is larger than GROUP_ROWS in any task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, cut, small_batches, stored, text_of

LENGTH = 400
GRAM = 200
SHALLOW = 32
STEP = 8
#: Different runs of one group that are sorted in one task; up to FEW of them the common prefixes of all pairs are read off the order.
GROUP_ROWS = 4096
FEW = 16
BLOCK_BYTES = 256 << 10
ROWS_OUT = 4096
#: Rows of a run pack its first start, its number of starts and its anchor's offset: the last two are below 256.
PACK = 16
#: A run to sort: its group, which starts before the anchor count there, whether it is repeated itself, its text and place, and the bytes around the anchor.
RUN = ["group", "low", "high", "itself", "d", "h", "pos", "before", "behind"]
RUN_TYPE = "group string, low int, high int, itself int, d long, h long, pos long, before binary, behind binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of spans of one block of bytes, from prefix sums modulo 2**64."""

    _tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(16, len(data).bit_length())
        if (which, size) not in self._tables:
            base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which]
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            values = np.random.default_rng(23 + which).integers(1, 1 << 63, 256, dtype=np.uint64)
            self._tables[which, size] = values, np.multiply.accumulate(up), np.multiply.accumulate(down)
        values, up, self.down = self._tables[which, size]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def grams(self) -> np.ndarray:
        return _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: len(self.sums) - GRAM])

    def spans(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _mix((self.sums[starts + sizes] - self.sums[starts]) * self.down[starts] + sizes.astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if done < width else keys


def runs(data: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor, over texts that lie at firsts..lasts of ``data``: (text, start in data, starts, anchor's offset, key, two hashes)."""
    none = np.empty(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none, none, none
    one, two = Hasher(data, 0), Hasher(data, 1)
    grams = one.grams()
    order = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(firsts)), lasts - firsts)[:n]
    inside = np.arange(n) + LENGTH <= lasts[text]
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])])
    sizes = np.diff(np.r_[heads, n])
    keep = inside[heads]
    heads, sizes = heads[keep], sizes[keep]
    at = anchor[heads]
    width = sizes + LENGTH - 1
    signed = lambda x: x.view(np.int64)
    return text[heads], heads, sizes, at - heads, signed(grams[at]), signed(one.spans(heads, width)), signed(two.spans(heads, width))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Blocks of (doc, hash, offset, bytes); a long text comes in pieces that overlap by LENGTH - 1 bytes, so that each start is in one."""
    block, size = [], 0
    for b in batches:
        for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = t.as_py().encode("utf-8")
            for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK_BYTES):
                piece = raw[at : at + BLOCK_BYTES + LENGTH - 1]
                if size and size + len(piece) > 2 * BLOCK_BYTES:
                    yield block
                    block, size = [], 0
                block.append((d, h, at, piece))
                size += len(piece)
    if block:
        yield block


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _pieces(batches):
        sizes = np.array([len(p[3]) for p in block])
        lasts = np.cumsum(sizes)
        text, start, count, offset, key, r1, r2 = runs(np.frombuffer(b"".join(p[3] for p in block), np.uint8), lasts - sizes, lasts)
        d, h, base = (np.array([p[k] for p in block], np.int64)[text] for k in range(3))
        where = (base + start - (lasts - sizes)[text]) << PACK | count << 8 | offset
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, r1, r2, d, h, where)], ["key", "r1", "r2", "d", "h", "pos"])


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> PACK, (pos >> 8) & 255, pos & 255


def _grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by a key column, cut so that no key is in two parts."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        done = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if done:
            yield _columns([*held, b.slice(0, done)])
            held = [b.slice(done)]
        elif held and held[-1].column(key)[-1].as_py() != k[0]:
            yield _columns(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    t = pa.Table.from_batches(batches)
    return [c.to_numpy(zero_copy_only=False) if hasattr(c, "to_numpy") else np.array(c) for c in (x.combine_chunks() for x in t.columns)]


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run to sort the bytes before its anchor, backwards, and those behind it."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], RUN)

    rows: list[tuple] = []
    for b in batches:
        for d, h, text, wanted in zip(*(b.column(k) for k in range(4)), strict=True):
            raw = text.as_py().encode("utf-8")
            for w in wanted.as_py():
                pos = w["pos"]
                start, count, offset = pos >> PACK, (pos >> 8) & 255, pos & 255
                anchor = start + offset
                rows.append((str(w["key"]), 0, LENGTH - GRAM, w["itself"], d.as_py(), h.as_py(), pos, raw[start:anchor][::-1], raw[anchor + GRAM : start + count - 1 + LENGTH]))
                if len(rows) >= ROWS_OUT:
                    yield out(rows)
                    rows = []
    if rows:
        yield out(rows)


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (apart.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], which: list[int], depth: int) -> list[int]:
    """``which`` in the order of strings that share their first ``depth`` bytes.

    A node knows only where its children part and the byte they part at. A string goes down by those bytes alone to any
    leaf, is compared with that leaf once, and hangs where the two part.
    """

    def byte(i: int, at: int) -> int:
        s = strings[i]
        return s[at] if at < len(s) else -1

    root: list = [None, which[0]]  # leaf: [None, string, equal ones...]; inner node: [where, {byte: node}]
    for i in which[1:]:
        node = root
        while node[0] is not None:
            node = node[1].get(byte(i, node[0])) or next(iter(node[1].values()))
        j = node[1]
        part = depth + common(strings[i][depth:], strings[j][depth:])
        if part == len(strings[i]) == len(strings[j]):
            node.append(i)
            continue
        parent, node = None, root
        while node[0] is not None and node[0] < part:
            parent, node = node, node[1][byte(i, node[0])]
        if node[0] == part:
            node[1][byte(i, part)] = [None, i]
            continue
        inner = [part, {byte(j, part): node, byte(i, part): [None, i]}]
        if parent is None:
            root = inner
        else:
            parent[1][byte(i, parent[0])] = inner
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            order += node[1:]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return order


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """The order of strings: multikey quicksort, STEP bytes at a time, down to SHALLOW bytes, then blind tries."""
    order: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        which, depth = stack.pop()
        if len(which) < 2 or depth < 0:
            order += which
        elif depth >= SHALLOW:
            order += blind_trie_order(strings, which, depth)
        else:
            pivot = strings[which[len(which) // 2]][depth : depth + STEP]
            keys = [(strings[i][depth : depth + STEP], i) for i in which]
            same = [i for k, i in keys if k == pivot]
            stack.append(([i for k, i in keys if k > pivot], depth))
            stack.append((same, depth + STEP if len(pivot) == STEP else -1))  # a shorter pivot is a string's end: those are equal
            stack.append(([i for k, i in keys if k < pivot], depth))
    return order


def _ordered(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings, and the common prefix of each place with the one before."""
    order = deep_shallow_order(strings)
    return order, [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def _ranks(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each string's place in the order, and the common prefix of each place with the one before."""
    order, lcp = _ordered(strings)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array(lcp)


def _all_common(strings: list[bytes]) -> dict[tuple[int, int], int]:
    """The common prefix of each pair: the least of those between their places in the order."""
    order, lcp = _ordered(strings)
    found = {}
    for a, x in enumerate(order):
        least = len(strings[x])
        for b in range(a + 1, len(order)):
            least, y = min(least, lcp[b]), order[b]
            found[min(x, y), max(x, y)] = least
    return found


def repeated_starts(before: list[bytes], behind: list[bytes], itself: list[bool], low: int = 0, high: int = LENGTH - GRAM) -> list[list[tuple[int, int]]]:
    """Of each run the intervals j..k of bytes before the anchor, within low..high, at which a string starts that another run has too.

    A run's strings start jmin..jmax bytes before the anchor: jmax bytes are before it and GRAM - jmin behind. Runs that are
    repeated themselves take part in the comparing but need no answer.
    """
    m, most = len(before), LENGTH - GRAM
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m <= FEW:
        left = _all_common(before)
        for (x, y), right in _all_common(behind).items():
            a, b = max(low, most - right), min(high, left[x, y])
            if a <= b:
                found[x].append((a, b))
                found[y].append((a, b))
        return found
    (left, lcp_l), (right, lcp_r) = _ranks(before), _ranks(behind)
    jmax, jmin = np.fromiter(map(len, before), np.int64, m), most - np.fromiter(map(len, behind), np.int64, m)
    wanted = ~np.array(itself)
    for j in range(low, high + 1):
        here = np.flatnonzero((jmin <= j) & (j <= jmax))
        if len(here) < 2:
            continue
        code = np.cumsum(lcp_l < j)[left[here]] * (m + 1) + np.cumsum(lcp_r < most - j)[right[here]]
        _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        for i in here[(counts[inverse] > 1) & wanted[here]].tolist():
            if found[i] and found[i][-1][1] == j - 1:
                found[i][-1] = (found[i][-1][0], j)
            else:
                found[i].append((j, j))
    return found


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by group to repeated starts (d, h, first, last)."""
    for group, low, high, itself, d, h, pos, before, behind in _grouped(batches):
        out = []
        bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]).tolist()
        start, _, offset = (x.tolist() for x in _unpack(pos))
        dl, hl, itself = d.tolist(), h.tolist(), itself.astype(bool).tolist()
        for a, b in zip(bounds, bounds[1:]):
            if b - a == 1:
                continue
            for i, spans in enumerate(repeated_starts(list(before[a:b]), list(behind[a:b]), itself[a:b], int(low[a]), int(high[a])), a):
                if not itself[i]:
                    out += [(dl[i], hl[i], start[i] + offset[i] - k, start[i] + offset[i] - j) for j, k in spans]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["d", "h", "a", "b"])


def _halved(runs: DataFrame) -> DataFrame:
    """Rows of large groups by the two halves of their starts; each half's group adds the bytes that all its strings share."""
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    most = LENGTH - GRAM
    parts = runs.withColumn("part", F.explode(F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct((mid + 1).alias("low"), F.col("high").alias("high")))))
    parts = parts.withColumns({"low": F.col("part.low"), "high": F.col("part.high")}).drop("part")
    parts = parts.filter((F.octet_length("before") >= F.col("low")) & (most - F.octet_length("behind") <= F.col("high")))
    same = F.sha2(F.concat(F.substring("before", F.lit(1), F.col("low")), F.substring("behind", F.lit(1), most - F.col("high"))), 256)
    return parts.withColumn("group", F.concat_ws(":", F.substring_index("group", ":", 1), "low", same))


def sorted_starts(around: DataFrame) -> DataFrame:
    """(d, h, a, b): the repeated starts among different runs of (group, low, high, itself, d, h, pos, before, behind), groups divided until they are small."""
    out, left = [], around
    while True:
        large = cut(left.groupBy("group").agg(F.count("*").alias("n"), F.first("low").alias("l"), F.first("high").alias("t")).filter(F.col("n") > GROUP_ROWS))
        if large.isEmpty():
            out.append(left)
            break
        out.append(left.join(large.select("group"), "group", "left_anti"))
        # A group of a single start holds one string, as often as it has rows.
        whole = left.join(large.filter("l = t").select("group"), "group", "left_semi").withColumn("at", F.shiftright("pos", PACK) + F.col("pos").bitwiseAND(255) - F.col("low"))
        out.append(whole.filter("itself = 0").select("d", "h", F.col("at").alias("a"), F.col("at").alias("b")))
        left = cut(_halved(left.join(large.filter("l < t").select("group"), "group", "left_semi")))
    starts = None
    for part in out:
        if "group" in part.columns:
            part = part.repartition("group").sortWithinPartitions("group").mapInArrow(_sorted, "d long, h long, a long, b long")
        starts = part if starts is None else starts.unionByName(part)
    return starts


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows: list[tuple] = []
    size = 0
    for b in batches:
        for i, text, spans in zip(*(b.column(k) for k in range(3)), strict=True):
            raw = text.as_py().encode("utf-8")
            edge = np.zeros(len(raw) + 1, np.int64)
            if found := spans.as_py():
                np.add.at(edge, [s["a"] for s in found], 1)
                np.add.at(edge, [s["b"] + LENGTH for s in found], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((i.as_py(), len(raw), len(raw) - len(kept), int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1)), hashlib.sha256(kept).hexdigest(), kept))
            size += len(raw)
            if size >= 4 * BLOCK_BYTES:
                yield out(rows)
                rows, size = [], 0
    if rows:
        yield out(rows)


def remove_repeated(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept: the remaining bytes.

    Texts count as UTF-8 bytes, null as empty; strings do not cross documents, and overlapping and repeated ones in one
    document count. Texts under LENGTH bytes keep everything; of repeated rows each loses what the others have. Ids may be null
    or repeat. An empty table gives an empty result.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_of(text).alias("text"))
    # A row is known by its id and a hash of its text; rows alike in both have the same strings.
    rows = rows.withColumns({"d": F.coalesce("id", F.lit(-(1 << 63))), "h": F.xxhash64("text")})
    anchored = rows.filter(F.octet_length("text") >= LENGTH).select("d", "h", "text").mapInArrow(_anchored, "key long, r1 long, r2 long, d long, h long, pos long")
    anchored = stored(anchored, "runs")
    keys = cut(anchored.groupBy("key").count().filter("count > 1").select("key"))
    met = cut(KeyFilter(keys, "key", keys.count()).flag(anchored, "key", "__maybe").filter("__maybe").drop("__maybe").join(keys, "key"))
    run = ["key", "r1", "r2"]
    counted = cut(met.groupBy(*run).agg(F.count("*").alias("n"), F.first("d").alias("d"), F.first("h").alias("h"), F.first("pos").alias("pos")))
    start, last = F.shiftright("pos", PACK), F.shiftright("pos", PACK) + F.shiftright("pos", 8).bitwiseAND(255) - 1
    repeated = met.join(counted.filter("n > 1").select(*run), run).select("d", "h", start.alias("a"), last.alias("b"))

    several = counted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    to_sort = cut(counted.join(several, "key").select("d", "h", F.struct("key", "pos", (F.col("n") > 1).cast("int").alias("itself")).alias("run")))
    texts = rows.select("d", "h", "text")
    listed = to_sort.groupBy("d", "h").agg(F.collect_list("run").alias("wanted"))
    wanted = _flagged(texts, to_sort).filter("__maybe").drop("__maybe", "__k").join(listed, ["d", "h"])
    # Rows alike in id and text each bring their runs, which are repeated themselves (itself = 1) and so need no answer.
    around = cut(wanted.select("d", "h", "text", "wanted").mapInArrow(_around, RUN_TYPE))
    starts = repeated.unionByName(sorted_starts(around))
    spans = cut(starts.groupBy("d", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans")))

    flagged = _flagged(rows, spans)
    hit = flagged.filter("__maybe").drop("__maybe", "__k").join(spans, ["d", "h"], "left")
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = hit.select("id", "text", "spans").mapInArrow(_removed, out)
    raw = F.encode("text", "UTF-8")
    whole = flagged.filter("not __maybe").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return whole.unionByName(changed).withColumnRenamed("id", id_col)


def _flagged(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with __maybe: whether their (d, h) may be among ``keys``, so that the others need no shuffle."""
    hashed = keys.select(F.xxhash64("d", "h").alias("__k")).distinct()
    return KeyFilter(hashed, "__k", keys.count()).flag(rows.withColumn("__k", F.xxhash64("d", "h")), "__k", "__maybe")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text, the bytes that stay as text, of every document; a character cut in two shows as U+FFFD."""
    return remove_repeated(docs.select("doc_id", "text")).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
