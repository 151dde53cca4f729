"""Byte-level BPE of whole texts and back: merges replayed over a corpus' distinct pieces in rank order.

Texts are cut into pieces by the vocabulary's pattern. A task gathers the distinct new pieces of a run of texts and merges
all of them together: an inverted index leads from the rank of a pair of tokens to all places where such a pair stands,
the least rank comes first, and a merge looks again only at the two pairs beside it. What a piece has become is kept, so
that later runs of the task bring new pieces only. Nothing is shuffled, and no result depends on how texts are dealt.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops
from .token_output import read_bytes

#: Bytes of a longer text that are worked on at a time, cut where a piece begins.
PART_BYTES = 1 << 20
#: Pieces whose ids a task keeps; with more it starts anew, which costs time only.
KEPT_PIECES = 800_000
LETTER, NUMBER, SPACE, OTHER = range(4)


@cache
def classes() -> np.ndarray:
    r"""For each code point: a \p{L}, a \p{N}, a \s, or none of these."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.findall(pattern, every):
            out[[ord(c) for c in run]] = number
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code point) of every character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    if len(at) == len(data):
        return at, lead
    width = np.diff(at, append=len(data))
    point = np.where(width == 1, lead, lead & (0x7F >> width))
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        point[more] = (point[more] << 6) | (data[at[more] + k] & 0x3F)
    return at, point


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all matches of PATTERN in the texts; they cover every byte.

    Runs of one class are found first. The last space of a run of white space goes to what follows it, or stands alone if
    it is another white space; an apostrophe that begins a match takes one of the listed endings with it.
    """
    at, point = code_points(data)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[point]
    first = np.zeros(n + 1, bool)  # of each text, and the end
    first[np.searchsorted(at, offsets)] = True
    new = first.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.append(space, False)  # the last white space before something else of its text
    last[:-1] &= np.append(~space[1:], False) & ~first[1:]
    end = np.flatnonzero(last)
    start = new[:n].copy()
    # what follows a space begins with it; the rest of the run stands for itself
    start[end] = True
    joined = end[point[end] == 0x20]
    start[joined + 1] = False
    quote = np.flatnonzero((point == 0x27) & start)
    if len(quote):
        padded = np.concatenate((point, np.zeros(3, point.dtype)))
        border = np.concatenate((first, np.ones(3, bool)))  # no ending reaches into the next text
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~border[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long_ = inside & ~border[quote + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        for which, size in ((short, 2), (long_, 3)):
            q = quote[which]
            start[q + 1] = False
            if size == 3:
                start[q + 2] = False
            follow = q + size
            follow = follow[follow < n]
            # the rest of the word is a match of its own, unless a match begins there anyway or a space went to it
            start[follow[kind[follow] == LETTER]] = True
    return at[start]


class Vocabulary:
    """Ranks of byte strings, as in a public rank file: a token's rank is its id."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)])
        rank = self.rank.get
        #: The rank of every token that two tokens make, by both their ranks.
        self.pairs = {}
        for whole, r in self.rank.items():
            for k in range(1, len(whole)):
                a = rank(whole[:k])
                if a is not None and (b := rank(whole[k:])) is not None:
                    self.pairs[a << 32 | b] = r
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that pairs make, or -1. A side of -1 is a border."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], -1)


#: While a rank has more places than this, on a running average, its merges are worked on as arrays.
MANY_PLACES = 24


class Replay:
    """Pieces side by side, their merges applied in the order of ranks.

    index leads from a rank to the places of its pairs; a place that a merge has touched since is told by its rank.
    Within a piece the least rank goes first and of equal ones the leftmost: where a merge makes a pair of a lower rank
    than its own, that one comes before the piece's further places.
    """

    def __init__(self, pieces: list[bytes], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        self.ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        # one more place stands for what is behind the borders
        self.token = np.append(vocabulary.byte[data], -1)
        self.after, self.before = np.arange(1, n + 2), np.arange(-1, n)
        self.after[self.ends - 1] = self.before[self.ends[:-1]] = self.before[0] = self.after[n] = n
        self.rank = vocabulary.pair(self.token, self.token[np.minimum(self.after, n)])
        self.index: dict[int, list] = {}
        self.heap: list[int] = []
        self._note(self.rank[:n], np.arange(n))
        self.many()
        self.few()

    def _note(self, rank: np.ndarray, place: np.ndarray) -> None:
        some = rank >= 0
        rank, place = rank[some], place[some]
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cut = np.flatnonzero(np.diff(rank, prepend=-1, append=-1)).tolist()
        for r, a, b in zip(rank[cut[:-1]].tolist(), cut, cut[1:], strict=False):
            if r in self.index:
                self.index[r].append(place[a:b])
            else:
                self.index[r] = [place[a:b]]
                heappush(self.heap, r)

    def many(self) -> None:
        """All places of a rank at a time."""
        token, after, before, rank, pair = self.token, self.after, self.before, self.rank, self.vocabulary.pair
        usual = 10.0 * MANY_PLACES
        while self.heap and usual > MANY_PLACES:
            r = heappop(self.heap)
            found = np.unique(np.concatenate(self.index.pop(r)))
            found = found[rank[found] == r]
            usual += 0.02 * (len(found) - usual)
            if not len(found):
                continue
            # of places that share a token, every second one from the left
            alone = np.ones(len(found), bool)
            alone[1:] = found[1:] != after[found[:-1]]
            step = np.arange(len(found))
            every, found = found, found[(step - np.maximum.accumulate(np.where(alone, step, 0))) % 2 == 0]
            same = np.full(len(found), r)
            j = after[found]
            low = (self._below(pair(token[before[found]], same), r) | self._below(pair(same, token[after[j]]), r)).any() or 0 <= self.vocabulary.pairs.get(r << 32 | r, -1) < r
            if low:
                # a lower rank comes up: only the first place of each piece now
                first = np.unique(np.searchsorted(self.ends, every, side="right"), return_index=True)[1]
                found, rest = every[first], np.delete(every, first)
                if len(rest):
                    self.index[r] = [rest]
                    heappush(self.heap, r)
                same, j = np.full(len(found), r), after[found]
            far, p = after[j], before[found]
            token[found], token[j], rank[j] = r, -1, -1
            after[found] = far
            before[far] = found
            rank[found] = right = pair(token[found], token[far])
            q = np.unique(p)
            rank[q] = left = pair(token[q], token[after[q]])
            rank[-1], before[-1], after[-1] = -1, len(token) - 1, len(token) - 1
            self._note(np.concatenate((left, right)), np.concatenate((q, found)))

    @staticmethod
    def _below(rank: np.ndarray, r: int) -> np.ndarray:
        return (rank >= 0) & (rank < r)

    def few(self) -> None:
        """One place at a time."""
        index, heap = {r: np.concatenate(x).tolist() for r, x in self.index.items()}, self.heap
        token, after, before, rank = (x.tolist() for x in (self.token, self.after, self.before, self.rank))
        known = self.vocabulary.pairs.get
        while heap:
            r = heappop(heap)
            found = index.pop(r)
            found.sort()
            for k, i in enumerate(found):
                if rank[i] != r:
                    continue
                j = after[i]
                far, p = after[j], before[i]
                token[i], token[j], rank[j], after[i], before[far] = r, -1, -1, far, i
                low = right = known(r << 32 | token[far], -1) if token[far] >= 0 else -1
                rank[i] = right
                if right >= 0:
                    if right in index:
                        index[right].append(i)
                    else:
                        index[right] = [i]
                        heappush(heap, right)
                if token[p] >= 0:
                    rank[p] = left = known(token[p] << 32 | r, -1)
                    if left >= 0:
                        low = min(low, left) if low >= 0 else left
                        if left in index:
                            index[left].append(p)
                        else:
                            index[left] = [p]
                            heappush(heap, left)
                if 0 <= low < r and k + 1 < len(found):
                    index[r] = found[k + 1 :]
                    heappush(heap, r)
                    break
        self.token = np.array(token)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all pieces, one piece behind the other, numbers of ids up to the end of each)."""
        left = self.token[:-1] >= 0
        return self.token[:-1][left], np.cumsum(left)[self.ends - 1]


class Codec:
    """Encodes and decodes bytes; remembers the ids of pieces."""

    def __init__(self, data: bytes):
        self.vocabulary = Vocabulary(data)
        self.known: dict[bytes, bytes] = {}

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(ids of every piece as little-endian 32-bit numbers, number of pieces before each text)."""
        start = piece_starts(data, offsets)
        raw = data.tobytes()
        edge = start.tolist()
        pieces = [raw[a:b] for a, b in zip(edge, [*edge[1:], len(raw)], strict=False)]
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        whole = self.vocabulary.rank.get
        new = []
        for p in set(pieces).difference(self.known):
            r = whole(p)
            if r is None:
                new.append(p)
            else:
                self.known[p] = r.to_bytes(4, "little")
        if new:
            found, end = Replay(new, self.vocabulary).ids()
            blob, end = found.astype("<u4").tobytes(), (4 * end).tolist()
            self.known.update(zip(new, [blob[a:b] for a, b in zip([0, *end], end, strict=False)], strict=True))
        return list(map(self.known.__getitem__, pieces)), np.searchsorted(start, offsets)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def parts(data: np.ndarray, size: int = PART_BYTES) -> Iterator[np.ndarray]:
    """A text in parts of about the size; each but the first begins with a lone space, where a piece begins anyway."""
    raw, at = data.tobytes(), 0
    while len(raw) - at > size:
        cut = at + size
        while True:
            cut = raw.find(b" ", cut)
            if cut < 0 or cut + 1 >= len(raw):
                cut = len(raw)
                break
            if 0x20 < raw[cut - 1] < 0x7F and 0x20 < raw[cut + 1] < 0x7F:
                break
            cut += 1
        yield data[at:cut]
        at = cut
    if at < len(raw) or not len(raw):
        yield data[at:]


@cache
def _codec(data: bytes) -> Codec:
    return Codec(data)


SCHEMA = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row: id, n_tokens, ids_sha256 of the ids as little-endian 32-bit numbers, decoded_sha256 of the decoded bytes.

    with_ids adds the ids themselves. vocabulary is the path of a rank file. The ids are decoded again from themselves
    alone. Null and empty texts have no token; null ids and repeated rows are rows like others; an empty table gives an
    empty result; extra columns are ignored. Long texts are worked on in parts of PART_BYTES; memory grows with the
    longest piece only, by about 200 bytes for each byte of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_bytes(docs.sparkSession, vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for rows, data, offsets in bytesops.runs(batch):
                out: list[list] = [[], [], [], []]

                def add(blobs: Iterator[bytes], out=out) -> None:
                    n, coded, decoded, held = 0, hashlib.sha256(), hashlib.sha256(), []
                    for b in blobs:
                        n += len(b) // 4
                        coded.update(b)
                        decoded.update(codec.decode(b))
                        if with_ids:
                            held.append(b)
                    for col, v in zip(out, (n, coded.hexdigest(), decoded.hexdigest(), b"".join(held) if with_ids else None), strict=True):
                        col.append(v)

                if len(data) > 2 * PART_BYTES:
                    # only a run of one text is so long; others may stand beside it with no bytes
                    for a, b in zip(offsets, offsets[1:], strict=False):
                        add(b"".join(codec.ids(x, np.array([0, len(x)]))[0]) for x in parts(data[a:b], PART_BYTES))
                else:
                    ids, cut = codec.ids(data, offsets)
                    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                        add(iter([b"".join(ids[a:b])]))
                types = (pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("id"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)
    return (out if with_ids else out.drop("ids")).withColumnRenamed("id", id_col)
