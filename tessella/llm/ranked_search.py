"""Exact ranked search for a stated set of items by MaxScore, shard by shard, in whole numbers.

The items' terms are numbered, and one pass over the documents writes an inverted index of these terms: shards of a
bounded number of postings, with their share of the corpus' counts. Every term of a shard has an upper bound, its weight
times its best occurrence. For an item the terms are split by the score that a hit needs: those whose bounds together stay
below it are not essential. Only documents in the essential terms' lists are candidates, and the other lists are probed, the
largest bound first, while a candidate can still get there. A first wave of shards gives the score that a hit needs
everywhere, and every shard raises it for the next ones of its task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Postings of a shard, and bytes of a text whose words stand in memory at a time.
SHARD_POSTINGS = 1 << 20
PART_BYTES = 1 << 20
#: Items are searched in blocks of so many bytes of text; their terms are numbered on the driver.
ITEM_BYTES = 8 << 20
#: One shard in so many belongs to the first wave.
FIRST_WAVE = 16
#: Terms are runs of ASCII letters, digits and everything beyond ASCII; A-Z lower-cased.
_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def count_terms(raw: bytes, part: int = PART_BYTES) -> Counter:
    """Occurrences of each term of a text."""
    if len(raw) <= part:
        return Counter(raw.translate(_TERM).split())
    found: Counter = Counter()
    text, at = raw.translate(_TERM), 0
    while at < len(text):
        cut = text.find(b" ", at + part)
        cut = len(text) if cut < 0 else cut
        found.update(text[at:cut].split())
        at = cut
    return found


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of an item, in the order of their bytes."""
    return sorted(set((text or "").encode().translate(_TERM).split()))


INDEX = "shard string, n_docs long, n_terms long, terms binary, df binary, cut binary, docs binary, tf binary, ids binary, length binary"


def index(docs: DataFrame, vocabulary: dict[bytes, int], *, id_col: str, text_col: str) -> DataFrame:
    """Shards of postings of the vocabulary's terms: terms ascending, and for each its df and its run of docs and tf.

    n_docs and n_terms are the shard's part of all documents with a term and of all terms; rows without an id count
    there and in df, and have no posting.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        part, at = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        lengths: list[int] = []
        terms, tfs, sizes = [], [], []
        nameless: list[int] = []
        n_docs = n_terms = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, terms, tfs, sizes, nameless, n_docs, n_terms, held, at
            term, tf = np.array(terms, np.int32), np.array(tfs, np.int32)
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            order = np.argsort(term, kind="stable")
            term, tf, doc = term[order], tf[order], doc[order]
            some, df = np.unique(np.concatenate((term, np.array(nameless, np.int32))), return_counts=True)
            cut = np.searchsorted(term, some).astype(np.int32)
            values = [some.astype(np.int32), df.astype(np.int32), cut, doc, tf, np.array(ids, np.int64), np.array(lengths, np.int64)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{at}"]), pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in values]],
                ["shard", "n_docs", "n_terms", "terms", "df", "cut", "docs", "tf", "ids", "length"],
            )
            ids, lengths, terms, tfs, sizes, nameless = [], [], [], [], [], []
            n_docs = n_terms = held = 0
            at += 1
            return out

        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = count_terms((text.as_py() or "").encode(), PART_BYTES)
                if not found:
                    continue
                n = found.total()
                n_docs, n_terms = n_docs + 1, n_terms + n
                mine = [(t, c) for t, c in zip(map(number, found), found.values(), strict=True) if t is not None]
                held += len(mine)
                if id_ is None:
                    nameless += [t for t, _ in mine]
                elif mine:
                    ids.append(id_)
                    lengths.append(n)
                    terms += [t for t, _ in mine]
                    tfs += [c for _, c in mine]
                    sizes.append(len(mine))
                if held >= SHARD_POSTINGS:
                    yield flush()
        if n_docs:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, INDEX)


def document_counts(shards: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, df in zip(b.column("terms"), b.column("df"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int32)) for x in (terms, df)], ["term", "df"])

    return shards.select("terms", "df").mapInArrow(work, "term int, df int").groupBy("term").agg(F.sum("df").alias("df"))


class Hits:
    """The best k hits of every item so far: equal scores by ascending id. need is the score that the next hit needs."""

    def __init__(self, items: int, k: int, need: np.ndarray | None = None):
        self.k = k
        self.need = np.ones(items, np.int64) if need is None else need.copy()
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, ids: np.ndarray, score: np.ndarray) -> None:
        if item in self.best:
            old = self.best[item]
            ids, score = np.concatenate((old[0], ids)), np.concatenate((old[1], score))
        order = np.lexsort((ids, -score))[: self.k]
        self.best[item] = ids[order], score[order]
        if len(order) == self.k:
            self.need[item] = max(self.need[item], score[order[-1]])


class Shard:
    """Postings of one shard with their impacts."""

    def __init__(self, row: dict, n: int, length: int):
        """n: documents of the corpus with a term, length: all their terms."""
        self.terms, self.cut, self.docs, tf = (np.frombuffer(row[k], np.int32) for k in ("terms", "cut", "docs", "tf"))
        self.ids, own = (np.frombuffer(row[k], np.int64) for k in ("ids", "length"))
        self.cut = np.append(self.cut, len(self.docs))
        # in whole numbers of any size: the product may pass 64 bits
        some, at = np.unique(own, return_inverse=True)
        m = np.array([100 - 50 + 50 * x * n // length for x in some.tolist()], np.int64)[at]
        tf = tf.astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])
        self.best = np.zeros(len(self.terms), np.int64)
        some = self.cut[1:] > self.cut[:-1]
        if some.any():
            self.best[some] = np.maximum.reduceat(self.impact, self.cut[:-1][some])
        self.probed = 0

    def search(self, terms: np.ndarray, weight: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents of the shard, scores) of at least need, all of them; terms ascending, weight of each."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weight = at[here], weight[here]
        bound = weight * self.best[at]
        order = np.argsort(bound, kind="stable")
        at, weight, bound = at[order], weight[order], bound[order]
        below = np.cumsum(bound)
        first = int(np.searchsorted(below, need))  # the least essential term
        lists = [(slice(self.cut[a], self.cut[a + 1]), w) for a, w in zip(at.tolist(), weight.tolist(), strict=True)]
        if first == len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.concatenate([self.docs[s] for s, _ in lists[first:]])
        part = np.concatenate([w * self.impact[s] for s, w in lists[first:]])
        self.probed += len(doc)
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        start = np.flatnonzero(np.diff(doc, prepend=-1))
        doc, score = doc[start], np.add.reduceat(part[order], start)
        for j in range(first - 1, -1, -1):
            can = score + below[j] >= need
            doc, score = doc[can], score[can]
            if not len(doc):
                break
            s, w = lists[j]
            mine = self.docs[s]
            place = np.minimum(np.searchsorted(mine, doc), len(mine) - 1)
            self.probed += len(doc)
            score = score + np.where(mine[place] == doc, w * self.impact[s][place], 0)
        good = score >= need
        return doc[good], score[good]


HITS = "item int, doc_id long, score long"


def _search(shards: DataFrame, asked, k: int) -> DataFrame:
    """The best k hits of every item in each task's shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, terms, weight, need, n, length = asked.value
        hits = Hits(len(cut) - 1, k, need)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n, length)
                for item, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    doc, score = shard.search(terms[a:b], weight[terms[a:b]], int(hits.need[item]))
                    if len(doc):
                        hits.add(item, shard.ids[doc], score)
        for item, (ids, score) in hits.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids), pa.array(score)], ["item", "doc_id", "score"])

    return shards.select("terms", "cut", "docs", "tf", "ids", "length").mapInArrow(work, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of every item, equal scores by ascending id.

    Scores are whole numbers; only those above 0 are hits. Every row of items is an item of its own, so a repeated id has
    several lists; its null text has no hit. A null document text has no term; a document without an id counts in the
    statistics and is no hit; repeated documents are hits each. Empty tables give an empty result; extra columns are
    ignored. Long texts are worked on in parts of PART_BYTES. Items are searched in blocks of ITEM_BYTES, each with a
    pass of its own over the documents: the driver holds one block's terms, never anything of the documents.
    """
    spark = docs.sparkSession
    asked_items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kind = dict(asked_items.dtypes)["item_id"]
    parts = [_rank_block(docs, block, kind, k, id_col, text_col) for block in _blocks(asked_items, ITEM_BYTES)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rank_block(docs: DataFrame, block: list[tuple], kind: str, k: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    lists = [terms_of(t) for _, t in block]
    names = sorted({t for x in lists for t in x})
    vocabulary = {t: i for i, t in enumerate(names)}
    cut = np.cumsum([0, *map(len, lists)]).tolist()
    terms = np.array([vocabulary[t] for x in lists for t in x], np.int32)
    shards = materialize(index(docs, vocabulary, id_col=id_col, text_col=text_col), "ranked-index")
    n, length = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not n:
        return None
    weight = np.zeros(len(names), np.int64)
    counts = document_counts(shards).toArrow()
    df = counts.column("df").to_pylist()
    weight[counts.column("term").to_numpy()] = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df]
    need = np.ones(len(block), np.int64)
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST_WAVE)) == 0
    share = spark.sparkContext.broadcast
    begun = materialize(_best(_search(shards.where(first), share((cut, terms, weight, need, n, length)), k), k), "ranked-first")
    full = begun.where(F.col("rank") == k).select("item", "score").toArrow()
    need[full.column("item").to_numpy()] = full.column("score").to_numpy()
    rest = _search(shards.where(~first), share((cut, terms, weight, need, n, length)), k)
    found = _best(begun.drop("rank").unionByName(rest), k)
    ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {kind}")
    return found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
