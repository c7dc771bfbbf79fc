"""Evaluation texts leaking into training text (problem 7)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import word_hashes
from millrace.workspace import materialise

#: Characters without width that are removed before words are read. Fixed values.
INVISIBLE = "­​‌⁠"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_WORD = re.compile(r"[^\W_]+")

#: Postings in a block of a list, words of a passage, passages that are searched for at a time (this bounds a worker's memory).
BLOCK, PASSAGE, AT_ONCE = 16, 24, 4096
#: Bytes of item texts in one index. More are searched for in several passes, each with an index of its own.
INDEX_BYTES = 32 << 20
K1, B = 1.2, 0.75
#: A score of 1 is the threshold; this much is left to rounding.
ENOUGH = 0.999


def plain(text: str | None) -> str:
    """Without characters without width, after NFKC."""
    return text if not text or text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after removing characters without width, NFKC and lower-casing."""
    return _WORD.findall(plain(text).lower()) if text else []


@dataclass
class Index:
    """Posting lists of items with BM25 impacts, scaled so that any run of ``run`` words of an item scores 1 or more.

    Lists lie one after the other, each by item; ``at`` is term * items + item of every posting, so that one binary search finds a
    place in any list. Blocks of lists are kept in the same way. The last term is that of unknown words, its list is empty.
    """

    run: int
    ids: np.ndarray
    word_hashes: np.ndarray  # sorted
    word_terms: np.ndarray
    end: np.ndarray  # of each term's list
    at: np.ndarray
    impact: np.ndarray
    list_max: np.ndarray
    block_end: np.ndarray  # of each term's blocks
    block_at: np.ndarray  # term * items + last item
    block_max: np.ndarray
    grams: np.ndarray  # sorted keys of (hash of a run, item)
    runs: np.ndarray  # distinct runs of each item
    answers: list[str | None]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Terms of words by their hashes, -1 for a word that no item has."""
        at = np.minimum(np.searchsorted(self.word_hashes, hashes), len(self.word_hashes) - 1)
        return np.where(self.word_hashes[at] == hashes, self.word_terms[at], -1)


_MUL, _ITEM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _runs(terms: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of every ``run`` terms in a row."""
    n = len(terms) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(run):
        x = (terms[k : k + n].astype(np.uint64) + np.uint64(1)) * _MUL
        h = (h ^ (x ^ (x >> np.uint64(29)))) * _ITEM
        h ^= h >> np.uint64(32)
    return h


def _mixed(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    return h + (item.astype(np.uint64) + np.uint64(1)) * _MUL


def build_index(items: list[tuple[int, str | None, str | None]], run: int) -> Index | None:
    """The index of those items (id, text, answer) that have ``run`` words at all; null if there are none."""
    docs = [(i, w, answer) for i, t, answer in items if i is not None and len(w := words(t)) >= run]
    if not docs:
        return None
    vocabulary: dict[str, int] = {}
    terms = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64) for _, w, _ in docs]
    n = len(docs)
    df = np.zeros(len(vocabulary) + 1)
    for t in terms:
        df[np.unique(t)] += 1
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean = sum(map(len, terms)) / n
    at, impact = [], []
    for k, t in enumerate(terms):
        u, first, tf = np.unique(t, return_inverse=True, return_counts=True)
        score = idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
        windows = np.sort(np.lib.stride_tricks.sliding_window_view(first, run), axis=1)
        once = np.concatenate([np.ones((len(windows), 1), bool), windows[:, 1:] != windows[:, :-1]], axis=1)
        least = np.where(once, score[windows], 0).sum(axis=1).min()
        at.append(u * n + k)
        impact.append(score / least)
    at, impact = np.concatenate(at), np.concatenate(impact)
    order = np.argsort(at)
    at, impact = at[order], impact[order]
    end = np.searchsorted(at, (np.arange(len(vocabulary) + 1) + 1) * n)
    size = np.diff(end, prepend=0)
    blocks = -(-size // BLOCK)
    block_end = np.cumsum(blocks)
    first = np.repeat(end - size, blocks) + BLOCK * (np.arange(block_end[-1]) - np.repeat(block_end - blocks, blocks))
    last = np.minimum(first + BLOCK, np.repeat(end, blocks)) - 1
    block_max = np.maximum.reduceat(impact, first)
    list_max = np.zeros(len(size))
    list_max[:-1] = np.maximum.reduceat(block_max, (block_end - blocks)[:-1])
    keys = [np.unique(_mixed(_runs(t, run), np.full(len(t) - run + 1, k))) for k, t in enumerate(terms)]
    answers = [" ".join(["", *w, ""]) if (w := words(answer)) else None for _, _, answer in docs]
    hashed = word_hashes(list(vocabulary))[0]
    by_hash = np.argsort(hashed)
    return Index(run, np.array([i for i, _, _ in docs], np.int64), hashed[by_hash], by_hash, end, at, impact, list_max, block_end, at[last], block_max, np.sort(np.concatenate(keys)), np.array([len(k) for k in keys]), answers)


def _passages(flat: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of passages: stretches of indexed words in one document, cut so that every run lies in one passage."""
    known = flat >= 0
    if not known.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(known.astype(np.int8)) | (np.diff(doc) != 0)) + 1
    start = np.concatenate([[0], edge])
    end = np.concatenate([edge, [len(flat)]])
    keep = known[start] & (end - start >= run)
    start, end = start[keep], end[keep]
    step = PASSAGE - run + 1
    n = np.maximum(1, -(-(end - start - run + 1) // step))
    at = np.repeat(start, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return at, np.minimum(at + PASSAGE, np.repeat(end, n))


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, ``length`` of them."""
    return np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def retrieve(index: Index, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (passage, item) with a score of 1 or more, by block-max WAND; ``terms``: passage x its distinct terms.

    Every passage has a cursor in each of its lists, and all passages move together. In each step a passage's cursors are
    put in the order of their items; the pivot is the first item at which the lists' greatest impacts add up to the threshold,
    since no earlier item can reach it. If the blocks in which the pivot would lie can't reach the threshold, the cursors jump
    behind the nearest end of those blocks or to the next list's item; else the item is scored in full and they go past it.
    """
    n, lists = len(index.ids), len(index.end) - 1
    cursor = np.where(terms > 0, index.end[terms - 1], 0)
    cursor[terms == lists] = index.end[lists]
    alive, found = np.arange(len(terms)), []
    most = np.append(index.at, (lists + 1) * n)  # a place behind the last posting
    block_most, block_max, impact = np.append(index.block_at, (lists + 1) * n), np.append(index.block_max, 0.0), np.append(index.impact, 0.0)
    while len(alive):
        t = terms[alive]
        c = cursor[alive]
        item = np.where(c < index.end[t], most[c] - t * n, n)
        order = np.argsort(item, axis=1)
        sums = np.cumsum(np.take_along_axis(np.where(item < n, index.list_max[t], 0.0), order, axis=1), axis=1)
        open_ = sums[:, -1] >= ENOUGH
        if not open_.all():
            alive, t, c, item, order, sums = (x[open_] for x in (alive, t, c, item, order, sums))
            if not len(alive):
                break
        pivot = np.take_along_axis(item, np.take_along_axis(order, (sums >= ENOUGH).argmax(axis=1)[:, None], axis=1), axis=1)
        before = item <= pivot
        goal = t * n + pivot
        b = np.full(t.shape, len(index.block_at))
        b[before] = np.searchsorted(index.block_at, goal[before])
        held = before & (b < index.block_end[t])
        scored = np.where(held, block_max[b], 0.0).sum(axis=1) >= ENOUGH
        full = before & scored[:, None]
        p = np.searchsorted(index.at, goal[full])
        score = np.zeros(t.shape)
        score[full] = np.where(most[p] == goal[full], impact[p], 0.0)
        score = score[scored].sum(axis=1)
        hit = score >= ENOUGH
        found.append((alive[scored][hit], pivot[scored, 0][hit]))
        behind = np.minimum(np.where(held, block_most[b] - t * n, n).min(axis=1) + 1, np.where(before, n, item).min(axis=1))
        target = np.where(scored, pivot[:, 0] + 1, np.minimum(behind, n))
        c[before] = np.searchsorted(index.at, (t * n + target[:, None])[before])
        cursor[alive] = c
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([i for _, i in found])


def search(index: Index, flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, item) pairs that share a run, with the number of the item's distinct runs that the document has. Passages are the queries; what is retrieved is compared run by run."""
    pairs: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    start, end = _passages(flat, doc, index.run)
    for lo in range(0, len(start), AT_ONCE):
        s, e = start[lo : lo + AT_ONCE], end[lo : lo + AT_ONCE]
        n = e - s
        terms = np.full((len(s), PASSAGE), len(index.end) - 1)
        column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        terms[np.repeat(np.arange(len(s)), n), column] = flat[_spread(s, n)]
        terms.sort(axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = len(index.end) - 1
        p, i = retrieve(index, terms)
        h = _runs(flat[_spread(s, n)], index.run)  # those across two passages are never asked for
        first, runs = np.cumsum(n) - n, n - index.run + 1
        for a in range(0, len(p), AT_ONCE * 8):
            x, y = p[a : a + AT_ONCE * 8], i[a : a + AT_ONCE * 8]
            key = _mixed(h[_spread(first[x], runs[x])], np.repeat(y, runs[x]))
            at = np.minimum(np.searchsorted(index.grams, key), len(index.grams) - 1)
            ok = index.grams[at] == key
            pairs.append(np.repeat(doc[s[x]].astype(np.int64) * len(index.ids) + y, runs[x])[ok])
            keys.append(at[ok])
    if not sum(map(len, pairs)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(pairs), np.concatenate(keys)]), axis=1)
    pair, count = np.unique(both[0], return_counts=True)
    return *np.divmod(pair, len(index.ids)), count


LEAKS = "doc_id bigint, item_id bigint, question_share double, answer boolean"


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = broadcast.value
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hashes, sizes = word_hashes([plain(t) for t in texts])
            d, i, n = search(index, index.terms(hashes), np.repeat(np.arange(len(texts)), sizes))
            if len(d):
                text = {k: " ".join(["", *words(texts[k]), ""]) for k in np.unique(d).tolist()}
                answer = [None if (a := index.answers[y]) is None else a in text[x] for x, y in zip(d.tolist(), i.tolist())]
                columns = (batch.column(0).take(pa.array(d)), index.ids[i], n / index.runs[i], answer)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in zip(columns, kinds)], ["doc_id", "item_id", "question_share", "answer"])

    return run


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_answer: str | None = None) -> DataFrame:
    """``doc_id, item_id, question_share, answer``: a row where a document has at least ``run`` words in a row that the item has in a row.

    ``question_share`` is the part of the item's runs that the document has; ``answer`` says whether all words of the item's answer
    stand in a row in it too, null for an item without one.

    The items are the smaller side: a BM25 inverted index over them is sent to every worker. An index holds items with some
    32 MB of text; more items are dealt by a hash to several indexes, the documents are then read once for each, and never
    shuffled. A document's passages are its stretches of indexed words, cut with an overlap of ``run - 1`` so that no run is lost.
    Impacts are scaled per item by the least score that a run of that item can have, so that score 1 is a lossless threshold and
    block-max bounds skip without missing an item. What is retrieved is compared run by run.

    Null and empty texts match nothing, items of fewer than ``run`` words are never found, rows with a null id are left out, of
    repeated rows of a document the larger share counts, different texts of one item id are taken together. Other columns are not touched.
    """
    spark = documents.sparkSession
    answer = F.lit(None).cast("string") if item_answer is None else F.col(item_answer)
    small = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"), answer.alias("a")).distinct()
    parts = max(1, -(-(small.agg(F.sum(F.octet_length("t").cast("bigint"))).first()[0] or 0) // INDEX_BYTES))
    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("question_share"), F.lit(True).alias("answer")).where("false")
    for k in range(parts):
        mine = [tuple(r) for r in small.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()]
        index = build_index(mine, run)
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(index)
        one = docs.mapInArrow(_scan(sent), LEAKS)
        if parts > 1:  # so that one index at a time is held
            one = materialise(one, "leaks")
            sent.unpersist()
        found = found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(F.max("question_share").alias("question_share"), F.max("answer").alias("answer"))


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """For every item the number of documents that hold part of its question, and of those that hold the answer too: ``item_id, suite, documents, with_answer, leaked``."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if("answer").alias("with_answer"))
    zero = F.lit(0).cast("bigint")
    return items.select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("documents", zero).alias("documents"), F.coalesce("with_answer", zero).alias("with_answer"), F.col("documents").isNotNull().alias("leaked"))
