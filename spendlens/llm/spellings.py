"""Spelling variant grouping: k-d trees over letter-count vectors, searched by boxes for each pair of lengths.

One edit moves a word's letter counts by an L1 distance of two at most: a
replaced letter takes one letter away and adds another, an inserted one adds
one. Distinct count vectors (words that are alike but for their order have one)
are dealt out by a k-d tree for each length, whose planes come from a bounded
sample; each cell becomes a k-d tree of its own in one task. A vector searches
the cells of its own length and of the next whose box it may reach, and inside
them the nodes whose box it may reach. Vectors that meet say which letter goes
and which comes. The order of letters is then verified word by word: the words
of one vector with that letter deleted or replaced, at each place where it
stands, are joined with the words that there are, so no two words are compared
only because their letters are alike. Words of over ``LONG_WORD`` letters meet
by an equal half instead and are compared, which keeps what is made of them
linear in their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, stored

RUN = "[A-Za-zÀ-ÿ]+"
#: Letters of a run once A-Z are lower-cased: the bytes of their code points.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS, MIN_TIMES, MARK, RATIO = 5, 3, 97, 2
#: Vectors that a cell shall hold, rows of the sample that its planes come from, and the longest words in that sample.
CELL_VECTORS, SAMPLE_VECTORS, SAMPLE_LETTERS = 20_000, 65_536, 256
NODE_POINTS, QUERIES, LONG_WORD = 32, 512, 64
MAX_ROUNDS = 40


def words(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): the distinct results of at least MIN_LETTERS code points that occur MIN_TIMES or more.

    Runs of letters of whole texts, only A-Z lower-cased. With h the crc32 of ``<id>:<run>``, a run whose h MARK divides loses its
    code point h % length. A null text has no runs; a null id counts as an empty string.
    """
    one = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN})"), 1)).alias("run"))
    one = one.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % MARK == 0, less).otherwise(F.col("run")).alias("word")
    return one.select(word).filter(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_TIMES)


def counts(letters: pa.Array | list[str]) -> np.ndarray:
    """How often each of LETTERS is in each string."""
    texts = letters if isinstance(letters, list) else letters.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    cells = np.repeat(np.arange(len(texts)) << 8, sizes) | data
    return np.bincount(cells, minlength=len(texts) << 8).reshape(-1, 256)[:, LETTERS].astype(np.int32)


class Cells:
    """For each length the planes that cut its vectors into cells; a length without planes is one cell.

    A cell's number is its length and its place among those of that length.
    """

    PLACES = 1 << 24

    def __init__(self, sample: list[str], share: float, cell: int = CELL_VECTORS):
        self.trees: dict[int, tuple] = {}
        by_length: dict[int, list[str]] = {}
        for s in sorted(sample):
            by_length.setdefault(len(s), []).append(s)
        for length, some in by_length.items():
            self.places = 0
            self.trees[length] = self._split(counts(some), cell * share)

    def _split(self, points: np.ndarray, most: float) -> tuple:
        """(place,) of a cell, or (letter, the greatest count to the left, left, right)."""
        if len(points) > most:
            spread = points.var(axis=0)
            for letter in np.argsort(-spread, kind="stable"):
                if spread[letter] == 0:
                    break
                values = points[:, letter]
                edge = int(np.median(values))
                edge = edge if (values > edge).any() else edge - 1
                left = values <= edge
                if left.any() and not left.all():
                    return int(letter), edge, self._split(points[left], most), self._split(points[~left], most)
        self.places += 1
        return (self.places - 1,)

    def near(self, length: int, queries: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for each cell of a length that a query reaches by adding ``up`` letters and taking ``down`` away."""
        found = []
        whole = np.arange(len(queries))
        # For each letter what a query has added so far, and what it has taken away, to be inside the cell's box.
        stack = [(self.trees.get(length, (0,)), whole, np.zeros_like(queries), np.zeros_like(queries))]
        while stack:
            node, at, added, taken = stack.pop()
            if len(node) == 1:
                found.append((at, np.full(len(at), length * self.PLACES + node[0])))
                continue
            letter, edge, left, right = node
            has = queries[at, letter]
            for side, more, less in ((left, 0, np.maximum(has - edge, 0)), (right, np.maximum(edge + 1 - has, 0), 0)):
                a, t = added.copy(), taken.copy()
                a[:, letter], t[:, letter] = np.maximum(a[:, letter], more), np.maximum(t[:, letter], less)
                reach = (a.sum(axis=1) <= up) & (t.sum(axis=1) <= down)
                if reach.any():
                    stack.append((side, at[reach], a[reach], t[reach]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (whole[:0], whole[:0])


class Tree:
    """A k-d tree of count vectors, each node with the box of its points."""

    def __init__(self, points: np.ndarray, most: int = NODE_POINTS):
        self.letters = np.flatnonzero(points.any(axis=0))
        self.points, self.order, self.nodes = points[:, self.letters], np.arange(len(points)), []
        self._build(0, len(points), most)

    def _build(self, a: int, z: int, most: int) -> int:
        at, some = len(self.nodes), self.points[self.order[a:z]]
        lo, hi = some.min(axis=0), some.max(axis=0)
        self.nodes.append(None)
        letter = int(np.argmax(hi - lo)) if len(lo) else 0
        if z - a <= most or hi[letter] == lo[letter]:
            self.nodes[at] = (lo, hi, a, z, None)
            return at
        values = some[:, letter]
        edge = np.median(values)
        right = values > edge if (values > edge).any() else values >= edge
        middle = a + int((~right).sum())
        self.order[a:z] = self.order[a:z][np.argsort(right, kind="stable")]
        self.nodes[at] = (lo, hi, a, z, (self._build(a, middle, most), self._build(middle, z, most)))
        return at

    def search(self, queries: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all points that a query becomes by adding ``up`` letters exactly and taking ``down`` away."""
        # Letters that no point has must all be taken away.
        other = queries.sum(axis=1) - queries[:, self.letters].sum(axis=1)
        queries, found = queries[:, self.letters], []
        stack = [(0, np.flatnonzero(other <= down))]
        while stack:
            node, at = stack.pop()
            lo, hi, a, z, below = self.nodes[node]
            rows = queries[at]
            at = at[(np.maximum(lo - rows, 0).sum(axis=1) <= up) & (np.maximum(rows - hi, 0).sum(axis=1) + other[at] <= down)]
            if not len(at):
                continue
            if below:
                stack += [(b, at) for b in below]
                continue
            points = self.points[self.order[a:z]]
            # A node that cannot be cut holds equal points, however many; distinct vectors make that one.
            for some in np.array_split(at, -(-len(at) // QUERIES)):
                apart = points[None] - queries[some][:, None]
                hit = (np.maximum(apart, 0).sum(axis=2) == up) & (np.maximum(-apart, 0).sum(axis=2) + other[some][:, None] == down)
                q, p = np.nonzero(hit)
                found.append((some[q], self.order[a + p]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (self.order[:0], self.order[:0])


def _dealt(cells: Cells):
    """Vectors to rows (cell, kind, letters): kind 0 in their own cell, 1 in other cells of their length, 2 in those of the next length."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            vectors, sizes = counts(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            out: list[tuple[np.ndarray, np.ndarray, int]] = []
            for length in np.unique(sizes):
                at = np.flatnonzero(sizes == length)
                q, own = cells.near(int(length), vectors[at], 0, 0)
                home = np.empty(len(at), np.int64)
                home[q] = own
                out.append((at[q], own, 0))
                q, cell = cells.near(int(length), vectors[at], 1, 1)
                later = cell > home[q]  # a pair of cells meets once
                out.append((at[q][later], cell[later], 1))
                q, cell = cells.near(int(length) + 1, vectors[at], 1, 0)
                out.append((at[q], cell, 2))
            for rows, cell, kind in out:
                for some in np.array_split(np.arange(len(rows)), -(-len(rows) // 8192) or 1):
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(cell[some]), pa.array(np.full(len(some), kind, np.int32)), b.column(0).take(pa.array(rows[some]))], ["cell", "kind", "letters"])

    return deal


def _pairs(points: list[str], tree: Tree | None, queries: list[str], vectors: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows (fewer, more, gone, new): vectors that one edit may join, the letter that goes (null where one is only added) and the one that comes."""
    if tree is None:
        return
    q, p = tree.search(vectors, 1, 0 if kind == 2 else 1)
    for some in np.array_split(np.arange(len(q)), -(-len(q) // 8192) or 1):
        rows = [(queries[i], points[j]) for i, j in zip(q[some].tolist(), p[some].tolist(), strict=True)]
        if kind == 0:
            rows = [r for r in rows if r[0] < r[1]]  # each pair of one cell is found from both
        if rows:
            apart = counts([r[1] for r in rows]) - counts([r[0] for r in rows])
            new = [chr(LETTERS[i]) for i in np.argmax(apart, axis=1)]
            gone = [None] * len(rows) if kind == 2 else [chr(LETTERS[i]) for i in np.argmin(apart, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(gone, pa.string()), pa.array(new)], ["fewer", "more", "gone", "new"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, kind, letters) sorted by cell and kind to pairs: a cell's points first become its tree, then its queries come in batches."""
    now, points, tree = None, [], None
    for b in batches:
        cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts = b.column(2).to_pylist()
        edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]), True])
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if cells[a] != now:
                if points and tree is None:  # a cell without queries from elsewhere
                    tree = Tree(counts(points))
                    yield from _own(points, tree)
                now, points, tree = cells[a], [], None
            if kinds[a] == 0:
                points += texts[a:z]
                continue
            if points and tree is None:
                tree = Tree(counts(points))
                yield from _own(points, tree)
            for i in range(a, z, 4096):
                some = texts[i : min(i + 4096, z)]
                yield from _pairs(points, tree, some, counts(some), int(kinds[a]))
    if points and tree is None:
        yield from _own(points, Tree(counts(points)))


def _own(points: list[str], tree: Tree) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(points), 4096):
        some = points[i : i + 4096]
        yield from _pairs(points, tree, some, counts(some), 0)


def near_vectors(vectors: DataFrame, cell: int = CELL_VECTORS) -> DataFrame:
    """(fewer, more, gone, new) of every two vectors that one edit may join. vectors: letters, the sorted letters of words, each once."""
    n = vectors.count()
    share = min(1.0, SAMPLE_VECTORS / max(1, n))
    drawn = F.pmod(F.xxhash64("letters", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = [r.letters for r in vectors.filter((F.length("letters") <= SAMPLE_LETTERS) & drawn).select("letters").limit(2 * SAMPLE_VECTORS).collect()]
    cells = Cells(sample, share, cell)
    dealt = small_batches(vectors).select("letters").mapInArrow(_dealt(cells), "cell long, kind int, letters string")
    return dealt.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_searched, "fewer string, more string, gone string, new string")


def _edited(word: Column, letter: Column, by: Column) -> Column:
    """The word with a letter replaced by ``by``, once for each place where the letter stands."""
    at = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)) == letter)
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), by, F.substring(word, i + 1, F.length(word)))))


def near_words(found: DataFrame, cell: int = CELL_VECTORS) -> DataFrame:
    """(word, n, near, near_n): every two words that one edit joins, both ways. found: word, n, each word once."""
    spelt = stored(found.select("word", "n", F.array_join(F.array_sort(F.split("word", "")), "").alias("letters")), "spellings")
    pairs = cut(near_vectors(spelt.select("letters").distinct(), cell))
    short = spelt.filter(F.length("letters") <= LONG_WORD)
    # Of words with a letter more it is deleted, so each word has as many candidates as it has that letter.
    added = pairs.filter("gone is null").join(short, pairs["more"] == short["letters"]).select("word", "n", F.explode(_edited(F.col("word"), F.col("new"), F.lit(""))).alias("near"))
    replaced = pairs.filter("gone is not null").join(short, pairs["fewer"] == short["letters"]).select("word", "n", F.explode(_edited(F.col("word"), F.col("gone"), F.col("new"))).alias("near"))
    there = spelt.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    links = added.unionByName(replaced).join(there, "near").unionByName(_long_words(pairs, spelt), allowMissingColumns=True)
    links = cut(links.select("word", "n", "near", "near_n"))
    return links.unionByName(links.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _long_words(pairs: DataFrame, spelt: DataFrame) -> DataFrame:
    """The same for words of which the one with fewer letters, or the other, has over LONG_WORD: they share the letters before the edit or those behind it.

    Of the two halves of the shorter word one is left whole by the edit, so the words meet by their vectors and an equal half.
    """
    long = pairs.filter((F.length("fewer") > LONG_WORD) | ((F.length("more") > LONG_WORD) & F.col("gone").isNull()))
    half = F.floor(F.length("fewer") / 2).cast("int")
    halves = lambda w: F.array(F.concat(F.lit("<"), F.substring(w, F.lit(1), half)), F.concat(F.lit(">"), F.substring(w, F.length(w) - (F.length("fewer") - half) + 1, F.length(w))))
    side = lambda end, word, n: long.join(spelt, long[end] == spelt["letters"]).select("fewer", "more", F.explode(F.transform(halves(F.col("word")), lambda x: F.sha2(x, 256))).alias("half"), F.col("word").alias(word), F.col("n").alias(n))
    met = side("fewer", "word", "n").join(side("more", "near", "near_n"), ["fewer", "more", "half"])
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: where following forms ends. A form is twice as frequent at least, so paths are short, and each round doubles the step."""
    step = cut(forms)
    for _ in range(MAX_ROUNDS):
        on = step.select(F.col("word").alias("form"), F.col("form").alias("further"))
        step = cut(step.join(on, "form", "left").select("word", F.coalesce("further", "form").alias("form"), F.col("further").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", F.col("form").alias("root"))
        step = step.drop("moved")
    raise RuntimeError("forms did not end")


def variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", cell: int = CELL_VECTORS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words``.

    n_near: words that one inserted, deleted or replaced code point joins to it. form: of those the most frequent (of equals the least by
    code points) if it is RATIO times as frequent at least, else null. root: where forms lead, the word itself if it has none.
    Null and empty texts have no words; repeated rows count as often as they are there; an empty table gives an empty result.
    """
    found = cut(words(docs, text, id_col))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    near = cut(near_words(found, cell).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")))
    marked = found.join(near, "word", "left")
    has = F.col("best.near_n") >= RATIO * F.col("n")
    marked = marked.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("best.near_n")).alias("form_n"))
    marked = cut(marked)
    ends = roots(marked.filter("form is not null").select("word", "form"))
    return marked.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    return variants(docs.select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")
