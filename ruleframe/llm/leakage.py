"""Evaluation passages inside training text, whole or in part, exact or with a few changed words.

Every window of ``window`` words of a test item is split into one piece more than the error budget allows, so a copy
with that many edits still has one piece unchanged. A document is read once; each piece found in it is verified by Myers'
bit-parallel distance (Hyyro's form), with words as symbols, between the windows around the piece and the document
around the hit. Pieces are found in one of two ways, with the same result:

* a set of items that a task can hold is put into one Aho-Corasick automaton, built once a worker;
* any larger set stays distributed. Pieces are hashed, and a bitmap of constant size, made by Spark, tells the pass over
  the documents which runs of words may be a piece. Only these, with the words around them, are exchanged and joined to
  the pieces by hash.

Items shorter than a window are searched whole and without errors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleframe.storage import cut

#: Up to so many words, items are held by every task; more are joined to the documents by exchange.
WORDS_IN_A_TASK = 500_000
#: The bitmap of piece hashes has 2 to this power bits (16 MB), however many pieces there are.
BITMAP_BITS = 27
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case."""
    return _WORD.findall(text.casefold())


def myers(pattern: list[str], text: list[str]) -> int:
    """The least number of word edits between ``pattern`` (at most 64 words or so) and any stretch of ``text``."""
    at: dict[str, int] = {}
    for k, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << k
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for w in text:
        eq = at.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right = down | (~(diag | up) & full)
        left = up & diag
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (~(diag | right) & full), right & diag
        best = min(best, score)
    return best


def _pieces(ws: list[str], window: int, budget: int) -> tuple[int, int, int]:
    """(words of a window, errors, words of a piece) for an item: short items are one window without errors."""
    return (window, budget, window // (budget + 1)) if len(ws) >= window else (len(ws), 0, len(ws))


def _near(item: list[str], p: int, window: int, budget: int, size: int, ws: list[str], d: int, seen: set, best: int) -> int:
    """The least distance, if within the budget and below ``best``, of the item's windows around its piece ``p`` to the
    words around place ``d``, where that piece stands."""
    for s in range(max(0, p - window + size), min(p, len(item) - window) + 1):
        if (s, d - p) in seen:
            continue
        seen.add((s, d - p))
        low = max(0, d - (p - s) - budget)
        far = myers(item[s : s + window], ws[low : d - (p - s) + window + budget])
        if far <= budget and far < best:
            best = far
            if far == 0:
                break
    return best


class _Searcher:
    def __init__(self, items: list[tuple[int, list[str]]], window: int, budget: int) -> None:
        import ahocorasick

        self.items, self.window, self.budget = dict(items), window, budget
        places: dict[str, list[tuple[int, int]]] = {}
        for item, ws in self.items.items():
            size = _pieces(ws, window, budget)[2]
            for k in range(len(ws) - size + 1 if ws else 0):
                places.setdefault(" " + " ".join(ws[k : k + size]) + " ", []).append((item, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (piece.count(" ") - 1, where))
        self.any = bool(places)
        if self.any:
            self.automaton.make_automaton()

    def search(self, text: str) -> dict[int, int]:
        """Items with the least distance of one of their windows, if within the budget."""
        if not self.any:
            return {}
        ws = words(text)
        line = " " + " ".join(ws) + " "
        best: dict[int, int] = {}
        seen: dict[int, set[tuple[int, int]]] = {}
        at, last = 0, 0
        for end, (size, where) in self.automaton.iter(line):
            # words before the piece's end: its last blank closes word number `at`
            at += line.count(" ", last, end)
            last = end
            for item, p in where:
                if best.get(item) == 0:
                    continue
                own = self.items[item]
                window, budget, _ = _pieces(own, self.window, self.budget)
                far = _near(own, p, window, budget, size, ws, at - size, seen.setdefault(item, set()), best.get(item, budget + 1))
                if far <= budget:
                    best[item] = far
        return best


_SEARCHERS: dict[str, _Searcher] = {}


def _searcher(key: str, shared, window: int, budget: int) -> _Searcher:
    """The automaton of a search, built once a worker process; only the latest is kept."""
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = _Searcher(shared.value, window, budget)
    return _SEARCHERS[key]


def _held(texts: DataFrame, given: list[tuple[int, list[str]]], window: int, budget: int, schema: str) -> DataFrame:
    shared, key = texts.sparkSession.sparkContext.broadcast(given), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = _searcher(key, shared, window, budget)
        for b in batches:
            rows = [(d, i, n, len(searcher.items[i])) for d, t in zip(b["doc_id"], b["text"]) for i, n in searcher.search(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "item_words"])

    return texts.mapInPandas(run, schema)


def _hash(ws: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(ws)) >> 1


def _exchanged(texts: DataFrame, items: DataFrame, window: int, budget: int, schema: str) -> DataFrame:
    spark = texts.sparkSession
    mask, context = (1 << BITMAP_BITS) - 1, window + budget
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((texts, "doc_id"), (items, "item_id")))

    def cut_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item_id"], b["text"]):
                ws = words(t)
                size = _pieces(ws, window, budget)[2]
                for p in range(len(ws) - size + 1 if ws else 0):
                    low = max(0, p - window + size)
                    rows.append((_hash(ws[p : p + size]), size, i, p - low, " ".join(ws[low : p + window]), len(ws)))
            yield pd.DataFrame(rows, columns=["h", "size", "item_id", "p", "around", "item_words"])

    pieces = cut(items.mapInPandas(cut_items, f"h long, size int, item_id {item_kind}, p int, around string, item_words int"))
    bit = F.col("h").bitwiseAND(F.lit(mask)) + 1
    chunks = pieces.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    table = np.zeros((mask >> 3) + 1, dtype=np.uint8)  # 4,096 buckets of 32,768 bits at most, counted from 1
    for r in chunks:
        at = (r["k"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    sizes = sorted(r[0] for r in pieces.select("size").distinct().collect())  # at most ``window`` of them
    shared = spark.sparkContext.broadcast(table)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = shared.value
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                ws = words(t)
                for size in sizes:
                    for at in range(len(ws) - size + 1):
                        h = _hash(ws[at : at + size])
                        place = h & mask
                        if marks[place >> 3] >> (place & 7) & 1:
                            low = max(0, at - context)
                            rows.append((d, h, size, at - low, " ".join(ws[low : at + size + context])))
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "h", "size", "at", "here"])
                        rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "h", "size", "at", "here"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                own, ws = r.around.split(" "), r.here.split(" ")
                if own[r.p : r.p + r.size] != ws[r.at : r.at + r.size]:
                    continue
                w, e, _ = (window, budget, 0) if r.item_words >= window else (r.item_words, 0, 0)
                far = _near(own, r.p, w, e, r.size, ws, r.at, set(), e + 1)
                if far <= e:
                    rows.append((r.doc_id, r.item_id, far, r.item_words))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "item_words"])

    hits = texts.mapInPandas(scan, f"doc_id {kind}, h long, size int, at int, here string")
    met = hits.join(pieces, ["h", "size"]).select("doc_id", "item_id", "size", "at", "here", "p", "around", "item_words")
    return met.mapInPandas(verify, schema)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, budget: int = 1) -> DataFrame:
    """(``doc_id``, ``item_id``, ``distance``, ``item_words``): documents that contain a ``window`` of words of an item with
    at most ``budget`` words changed, added or left out; the least distance of all windows.

    Items shorter than the window are found where all their words follow one another unchanged; ``item_words`` tells how
    many that are. Null texts and texts without words match nothing. Repeated documents are found each by itself in a
    held search, and as one row where items are exchanged. Whole texts are read, however long.
    """
    kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, item_words int"
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    given = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    held, n = [], 0
    for i, t in given.toLocalIterator():
        held.append((i, words(t)))
        n += len(held[-1][1])
        if n > WORDS_IN_A_TASK:
            break
    if n <= WORDS_IN_A_TASK:
        return _held(texts, held, window, budget, schema)
    return _exchanged(texts, given, window, budget, schema).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("item_words").alias("item_words"))
