"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every document is a query against the items. Passages are windows of twice the
words of the benchmark's longest item, a window starting every such length, so an item lies whole in one of them. A score is an
item's BM25 score divided by the score its own words would get, so the threshold means the same for
short and long items. All items at or above it are retrieved (no top-k). Postings are kept in blocks
with their greatest impact; blocks are intervals of items, the same in every list, so the bounds of a
passage's words add up block by block and all blocks below the threshold are skipped, most passages
as a whole. In the blocks that are left, cursors over the postings skip items whose lists' maxima
can't reach the threshold.

A retrieved pair counts only if both parts of the item, question and answer, are found in the
passage: word 5-grams of each (shorter parts: all their words in a row), `overlap` of them. An item
without an answer column is split before its last sentence; one of a single sentence is all question.

The longest item, the number and mean length of items and every word's document frequency are taken over the
whole benchmark, by one tokeniser. The index is cut into parts of about `block_bytes` of item text, which are files in the
shared folder. A task holds one part at a time, and the words of `SLICE_BYTES` of text, which it searches in all parts in turn, so
neither memory nor results depend on `block_bytes`, and the documents are read once.

Defined results: null or empty document or item texts match nothing; items without a word are never
found. Ties don't matter, as all above the threshold are returned. Repeated items and documents are
reported each. Empty tables: no rows. Extra columns of `docs` pass through `keep_clean`.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.llm.common import scratch_path, table, written
from larkspur.llm.shared_files import make, opened, publish

K1, B = 1.2, 0.75
BLOCK = 8
EPS = 1e-9
#: Text whose words a task holds at a time (one document at least).
SLICE_BYTES = 1 << 20
_TOKEN = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item given as one text: the last sentence is the answer."""
    parts = [p for p in _SENTENCE.split((text or "").strip()) if words(p)]
    return (text or "", "") if len(parts) < 2 else (" ".join(parts[:-1]), parts[-1])


def grams(ws: list[str], n: int = 5) -> set[tuple[str, ...]]:
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def found_in(part: set[tuple[str, ...]], passage: list[str]) -> float:
    """Share of a part's word n-grams in the passage; an empty part is found."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    return len(part & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(part)


class _Items:
    """The items of an index as (id, question's n-grams, answer's n-grams), made when they are asked for."""

    def __init__(self, ids: list, parts: list[tuple[str, str]]):
        self.ids, self.parts = ids, parts

    def __len__(self):
        return len(self.ids)

    def __getitem__(self, at):
        q, a = self.parts[at]
        return self.ids[at], grams(words(q)), grams(words(a))


class _Postings:
    """The list of each term as {item: impact}, made when it is asked for."""

    def __init__(self, first: np.ndarray, item: np.ndarray, impact: np.ndarray):
        self.first, self.item, self.impact = first, item, impact

    def __len__(self):
        return len(self.first) - 1

    def __getitem__(self, term):
        lo, hi = self.first[term], self.first[term + 1]
        return dict(zip(self.item[lo:hi].tolist(), self.impact[lo:hi].tolist(), strict=True))


class Index:
    """Postings by term, in order of items, with impacts divided by each item's own score. Flat arrays: some 10 bytes a byte of item text.

    items: (id, question, answer); n, mean, longest and df (of these items' words at least) are of the whole benchmark."""

    def __init__(self, items: list[tuple[object, str, str]], df: dict[str, int], n: int, mean: float, longest: int):
        self.items, self.longest = _Items([i for i, _, _ in items], [(q, a) for _, q, a in items]), longest
        self.vocabulary: dict[str, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(f"{q} {a}")] for _, q, a in items]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for ws in ids for t in ws), np.int64, int(length.sum()))
        # one entry for each term and item, in that order
        pairs, tf = np.unique(flat * max(1, len(ids)) + np.repeat(np.arange(len(ids)), length), return_counts=True)
        term, item = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        idf = np.fromiter((math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in self.vocabulary), np.float64, len(self.vocabulary))
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(mean, 1e-9)))
        impact = score / np.bincount(item, score, len(ids))[item]
        size = len(self.vocabulary)
        self.postings = _Postings(np.searchsorted(term, np.arange(size + 1)), item.astype(np.int32), impact)
        # Blocks are intervals of BLOCK items, the same for all lists, so bounds of several lists add up block by block.
        self.n_blocks = -(-len(ids) // BLOCK)
        key = term * max(1, self.n_blocks) + item // BLOCK
        self.key, self.start = np.unique(key, return_index=True)
        self.most = np.maximum.reduceat(impact, self.start) if len(impact) else impact
        self.start = np.append(self.start, len(impact))
        self.block_of = self.key % max(1, self.n_blocks)
        self.first = np.searchsorted(self.key, np.arange(size + 1) * max(1, self.n_blocks))

    def live(self, ids: np.ndarray, least: float) -> list[tuple[int, int]]:
        """(passage, block of items) whose block maxima reach `least` together. ids: a term for each word of a document, or -1."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        half, size = at // self.longest, len(self.postings)
        keys = np.unique(np.concatenate((half * size + ids[at], (half[half > 0] - 1) * size + ids[at[half > 0]])))
        passage, term = keys // size, keys % size
        n = self.first[term + 1] - self.first[term]
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) + np.repeat(self.first[term] - (ends - n), n)
        bound = np.bincount(np.repeat(passage, n) * self.n_blocks + self.block_of[place], weights=self.most[place])
        return [divmod(int(x), self.n_blocks) for x in np.flatnonzero(bound >= least - EPS)]

    def everywhere(self, ids: np.ndarray, least: float, stretch: int = 4096):
        """live() over stretches of passages, so that memory is bounded for a text of any length."""
        stretch = max(1, min(stretch, (1 << 24) // max(1, self.n_blocks)))
        for at in range(0, -(-len(ids) // self.longest), stretch):
            part = ids[at * self.longest : (at + stretch + 1) * self.longest]
            yield from ((at + passage, block) for passage, block in self.live(part, least) if passage < stretch)

    def search(self, terms: np.ndarray, block: int, least: float) -> list[tuple[int, float]]:
        """Every item of a live block with a score of `least` or more, by WAND with the lists' maxima in this block."""
        out = []
        wanted = terms * self.n_blocks + block
        at = np.searchsorted(self.key, wanted)
        at = at[(at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == wanted)]
        # cursors: [current item, most in the block, its items in the block, their impacts, position]
        cursors = []
        for e in at.tolist():
            lo, hi = self.start[e], self.start[e + 1]
            own = self.postings.item[lo:hi].tolist()
            cursors.append([own[0], float(self.most[e]), own, self.postings.impact[lo:hi].tolist(), 0])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[1]
                if total >= least - EPS:
                    pivot = c[0]
                    break
            if pivot is None:
                return out
            if cursors[0][0] == pivot:
                # summed exactly, so that the order of terms, which differs between parts, has no say
                score = math.fsum(c[3][c[4]] for c in cursors if c[0] == pivot)
                if score >= least - EPS:
                    out.append((pivot, score))
                pivot += 1
            for c in cursors:
                while c[4] < len(c[2]) and c[2][c[4]] < pivot:
                    c[4] += 1
                c[0] = c[2][c[4]] if c[4] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def matches(self, text: str | list[str] | None, least: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(item, first word of the passage, score, question's and answer's overlap): the best passage of each verified item. text: or its words."""
        ws = text if isinstance(text, list) else words(text)
        if not ws or not len(self.items):
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        half = self.longest
        best: dict[int, tuple] = {}
        for passage, block in self.everywhere(ids, least):
            lo, hi = passage * half, (passage + 2) * half
            terms = np.unique(ids[lo:hi])
            for item, score in self.search(terms[terms >= 0], block, least):
                _, question, answer = self.items[item]
                q, a = found_in(question, ws[lo:hi]), found_in(answer, ws[lo:hi])
                if q >= overlap and a >= overlap and (item not in best or (q + a, round(score, 9)) > best[item][:2]):
                    best[item] = (q + a, round(score, 9), lo, q, a)
        return [(item, lo, score, q, a) for item, (_, score, lo, q, a) in sorted(best.items())]


def _tokenised(benchmark: DataFrame, item_id: str, question: str, answer: str | None) -> DataFrame:
    """Items with a word: (id, q, a, n words, distinct words), an item without an answer column split into its parts."""

    def run(batches):
        for batch in batches:
            ids, qs, sides = (batch.column(i) for i in range(3))
            parts = [split_item(q.as_py()) if answer is None else (q.as_py() or "", a.as_py() or "") for q, a in zip(qs, sides, strict=True)]
            tokens = [words(f"{q} {a}") for q, a in parts]
            cols = [ids, *(pa.array([p[i] for p in parts], pa.string()) for i in (0, 1)), pa.array(list(map(len, tokens)), pa.int64()), pa.array([sorted(set(ws)) for ws in tokens], pa.list_(pa.string()))]
            yield pa.record_batch(cols, names=["id", "q", "a", "n", "tokens"])

    kind = benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id).alias("id"), F.col(question).cast("string").alias("q"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a"))
    return written(items.mapInArrow(run, f"id {kind}, q string, a string, n long, tokens array<string>").filter("n > 0"), "items")


def indexes(benchmark: DataFrame, block_bytes: int = 4 << 20, item_id: str = "item_id", question: str = "text", answer: str | None = None):
    """One Index for each part of the items; a single one unless the items' text exceeds `block_bytes`."""
    items = _tokenised(benchmark, item_id, question, answer)
    total, n, mean, longest = items.agg(F.sum(F.octet_length("q") + F.octet_length("a")), F.count("*"), F.avg("n"), F.max("n")).first()
    if not n:
        return
    parts = max(1, -(-total // block_bytes))
    placed = items.withColumn("part", F.pmod(F.xxhash64("id", "q", "a"), F.lit(parts)))
    # words are distinct within an item, so counting rows counts items; each part gets the counts of its own words
    words_of = placed.select("part", F.explode("tokens").alias("t"))
    df = words_of.groupBy("t").agg(F.count("*").alias("df"))
    counted = written(words_of.distinct().join(df, "t"), "frequencies") if parts > 1 else df
    for k in range(parts):
        mine = placed.filter(F.col("part") == k) if parts > 1 else placed
        rows = sorted(((r["id"], r["q"], r["a"]) for r in mine.select("id", "q", "a").collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1], r[2]))
        counts = (counted.filter(F.col("part") == k) if parts > 1 else counted).select("t", "df").collect()
        if rows:
            yield Index(rows, {r["t"]: r["df"] for r in counts}, n, mean, longest)


#: The part that this worker holds: its path and the index.
_held: list = [None, None]


def _part(path: str) -> Index:
    if _held[0] != path:
        _held[:] = None, None
        store, where = opened(path)
        with store.open_input_stream(where, compression=None) as f:
            _held[:] = path, pickle.loads(f.read())
    return _held[1]


def _parts(benchmark: DataFrame, options: dict) -> list[str]:
    """Writes the index's parts to the shared folder; returns their paths."""
    folder, paths = scratch_path(benchmark.sparkSession, "bm25"), []
    make(folder)
    for k, index in enumerate(indexes(benchmark, **options)):
        with publish(folder, name := f"part-{k:05d}") as out:
            out.write(pickle.dumps(index, protocol=5))
        paths.append(f"{folder}/{name}")
    return paths


def _found(texts: pa.Array, paths: list[str], least: float, overlap: float, first_only: bool = False):
    """(place in `texts`, id of the item, passage, score, overlaps) of every match; with `first_only` nothing is looked for in a text once it has one."""
    lo, n = 0, len(texts)
    while lo < n:
        held, size = [], 0
        while lo + len(held) < n and (not held or size < SLICE_BYTES):
            text = texts[lo + len(held)].as_py()
            size += len(text or "")
            held.append(words(text))
        for path in paths:
            ix = _part(path)
            for i, ws in enumerate(held):
                for hit in ix.matches(ws, least, overlap):
                    yield lo + i, ix.items.ids[hit[0]], *hit[1:]
                    if first_only:
                        held[i] = []
                        break
        lo += len(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.7, overlap: float = 0.5, **options) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap) for every verified pair."""
    paths = _parts(benchmark, options)
    item = benchmark.schema[options.get("item_id", "item_id")].dataType
    types = [to_arrow_type(item), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches):
        for batch in batches:
            row, *cols = list(zip(*_found(batch.column(1), paths, least, overlap), strict=True)) or [[]] * 6
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, item_id {item.simpleString()}, passage long, score double, question_overlap double, answer_overlap double")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.7, overlap: float = 0.5, **options) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item of the benchmark."""
    paths, place = _parts(benchmark, options), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[i for i, *_ in _found(batch.column(place), paths, least, overlap, first_only=True)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
