"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e+1 pieces; any text within e edits of it holds one piece
unchanged. An Aho-Corasick automaton over all pieces finds these hits in one pass over a text. The pieces are the leaves
of a tree that halves the item and its budget: where a part of an item holds at most its share of the edits, one of its
halves does too. So a hit is verified from the leaf to the root, each time with Myers' bit-parallel search over a
region twice as long, and one that stands in other text ends at a region of a few letters. Myers' search over the
regions that reach the root gives the item's distance. No document is compared with another, and nothing is shuffled.
The test items, not the corpus, are held in memory, in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text of the test items that one pass holds; more items take more passes.
BLOCK_BYTES = 16 << 20
#: Edits that an item may have, as a part of its normalised length.
ERROR_RATE = 0.1
#: A shorter item says too little inside a longer text: it leaks only where it is the whole text, within its budget.
MIN_LENGTH = 16

_RUN = re.compile(r"[\W_]+")


def normalize(text: str | None) -> str:
    """Lower case, every run of other than letters and digits one space, none at the ends."""
    return _RUN.sub(" ", (text or "").lower()).strip()


def myers(peq: dict[str, int], m: int, text: str, limit: int) -> int:
    """Least edit distance of the pattern (given by its character masks) to any substring of text, or limit + 1."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, min(m, limit + 1)
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = (ph << 1) & mask
        pv = ((mh << 1) & mask) | (~(xv | ph) & mask)
        mv = ph & xv
    return best


@dataclass(slots=True)
class Node:
    """A part a..b of an item with its share of the budget; the root is the whole item."""

    a: int
    b: int
    budget: int
    masks: dict[str, int]
    parent: Node | None
    item: int


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(text):
        masks[c] |= 1 << i
    return dict(masks)


class Matcher:
    """All items (id, normalised text) of one block."""

    def __init__(self, items: Iterable[tuple[int, str]], error_rate: float = ERROR_RATE, min_length: int = MIN_LENGTH):
        import ahocorasick

        self.items: list[tuple[int, int, int, dict[str, int]]] = []  # id, length, budget, masks
        self.short: list[tuple[int, str, int]] = []
        leaves: dict[str, list[Node]] = defaultdict(list)
        for id_, text in items:
            m = len(text)
            if not m:
                continue
            e = min(int(error_rate * m), m - 1)
            if m < min_length:
                self.short.append((id_, text, e))
                continue
            root = Node(0, m, e, _masks(text), None, len(self.items))
            self._split(root, text, leaves)
            self.items.append((id_, m, e, root.masks))
        self.automaton = ahocorasick.Automaton()
        for piece, nodes in leaves.items():
            self.automaton.add_word(piece, (len(piece), nodes))
        if leaves:
            self.automaton.make_automaton()

    def _split(self, node: Node, text: str, leaves: dict[str, list[Node]]) -> None:
        if not node.budget:
            leaves[text[node.a : node.b]].append(node)
            return
        # the two shares and one edit more are the budget: both halves cannot exceed theirs
        left = (node.budget - 1) // 2
        mid = node.a + (node.b - node.a) * (left + 1) // (node.budget + 1)
        for a, b, e in ((node.a, mid, left), (mid, node.b, node.budget - 1 - left)):
            part = text[a:b]
            self._split(Node(a, b, e, _masks(part) if e else {}, node, node.item), text, leaves)

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item id, distance) of the items within their budget of some substring of a normalised text, by id."""
        out = []
        for id_, item, e in self.short:
            if abs(len(item) - len(text)) <= e:
                d = edit_distance(item, text)
                if d <= e:
                    out.append((id_, d))
        if not self.items:
            return sorted(out)
        windows: dict[int, list[list[int]]] = defaultdict(list)
        seen: dict[int, int] = {}
        for end, (length, leaves) in self.automaton.iter(text):
            start = end + 1 - length
            for leaf in leaves:
                # where the item would begin
                origin = start - leaf.a
                node = leaf.parent
                while node is not None and node.parent is not None:
                    e = node.budget
                    # a region is judged once for all leaves under the node that put the item at one place
                    key = (id(node), origin)
                    known = seen.get(key)
                    if known is None:
                        region = text[max(origin + node.a - e, 0) : origin + node.b + e]
                        known = seen[key] = myers(node.masks, node.b - node.a, region, e) <= e
                    if not known:
                        break
                    node = node.parent
                else:
                    _, m, e, _ = self.items[leaf.item]
                    windows[leaf.item].append([origin - e, origin + m + e])
        for i, spans in windows.items():
            id_, m, e, masks = self.items[i]
            best = e + 1
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                best = min(best, myers(masks, m, text[max(a, 0) : b], e))
                if not best:
                    break
            if best <= e:
                out.append((id_, best))
        return sorted(out)


def edit_distance(a: str, b: str) -> int:
    """Of two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that no given one clashes with, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, min_length: int = MIN_LENGTH, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: ids of the test items in the text, and their edit distances.

    Texts and items are compared normalised. Items of fewer than min_length characters leak only as a whole text; null
    and empty ones match nothing, nor does a null or empty text; items repeated under one id count once with the least
    distance. All columns and rows of docs stay.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, ceil(size / block_bytes))
    a = fresh(docs.columns, "leaked_items")
    b = fresh([*docs.columns, a], "leak_distances")
    schema = T.StructType([*docs.schema.fields, T.StructField(a, T.ArrayType(T.LongType())), T.StructField(b, T.ArrayType(T.IntegerType()))])
    out, names = docs, docs.columns
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).distinct().orderBy("i", "t").collect()
        kept = [(r["i"], n) for r in rows if (n := normalize(r["t"]))]
        shared = docs.sparkSession.sparkContext.broadcast(kept)
        first = k == 0

        def work(batches, shared=shared, first=first):
            matcher = Matcher(shared.value, error_rate, min_length)
            for batch in batches:
                found = []
                text = batch.column(text_col)
                for i in range(batch.num_rows):
                    best = dict(reversed(sorted(matcher.match(normalize(text[i].as_py())), key=lambda x: x[1])))
                    if not first:
                        for item, d in zip(batch.column(a)[i].as_py(), batch.column(b)[i].as_py(), strict=True):
                            best[item] = min(d, best.get(item, d))
                    found.append(sorted(best.items(), key=lambda x: (x[0] is None, x[0])))
                ids = pa.array([[x for x, _ in f] for f in found], pa.list_(pa.int64()))
                dist = pa.array([[d for _, d in f] for f in found], pa.list_(pa.int32()))
                old = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*old, ids, dist], [*names, a, b])

        out = out.mapInArrow(work, schema)
    return out, a, b


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, contaminated, item_ids, distances."""
    found, a, b = find_leaks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, text_col="text", **options)
    return found.select(F.col("id").alias(id_col), (F.size(a) > 0).alias("contaminated"), F.col(a).alias("item_ids"), F.col(b).alias("distances"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no test item, with the columns of docs."""
    found, a, b = find_leaks(docs, benchmark, **options)
    return found.where(F.size(a) == 0).drop(a, b)
