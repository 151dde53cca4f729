"""Collocations: phrases whose words stand together more often than their parts would by chance.

Texts become shards of numbered words. A shard's pieces are put into one generalised suffix automaton of bounded depth:
its states are the classes of phrases that end at the same places, with the number of these places, and a suffix link
leads from a state to that of the phrases' longest suffix with more places. The automaton is built for all pieces at
once: the places of each state are parted by one more word to the left, so the tree of suffix links grows level by level,
and a state of one place needs no parting. Counts of shards are summed by phrase.

Lengths are counted one after the other. A phrase can only be frequent if its words, and all its parts, are: the frequent
phrases of one length leave a bit filter of bounded size, and the next automata only take places that it accepts. A filter
never rejects a frequent phrase; the last pass counts the phrases themselves, so hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops
from .shared import materialize, tasks

LONGEST = 5
#: Words of a shard, and bytes of a long text that are worked on at a time, cut between pieces.
SHARD_WORDS = 1 << 20
PART_BYTES = 4 << 20
#: Hashes that a bucket gathers before it adds them up.
MEET_KEYS = 2 << 20
#: Bits of a filter for each frequent phrase, and its least and largest sizes: 1 and 16 MB.
BITS_PER_PHRASE, MIN_BITS, MAX_BITS = 64, 1 << 23, 1 << 27
#: A-Z lower-cased, tab to space, and every byte that parts pieces to a full stop.
_BYTES = bytearray(bytes(range(256)).lower())
_BYTES[0x09] = 0x20
for _b in (*b".,;:!?", *range(0x0A, 0x0E)):
    _BYTES[_b] = 0x2E
BREAK = -1
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Words numbered from 0 as they come; the full stop, which is no word, is BREAK."""

    def __init__(self) -> None:
        super().__init__({b".": BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def tokens(raw: bytes, part: int = PART_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in order, with b"." between pieces, in parts of bounded size."""
    raw = raw.translate(bytes(_BYTES))
    at = 0
    while at < len(raw):
        cut = raw.find(b".", at + part) if len(raw) - at > part else -1
        cut = len(raw) if cut < 0 else cut
        yield raw[at:cut].replace(b".", b" . ").split()
        at = cut


SHARDS = "shard string, lang string, n long, words binary, codes binary"


def shards_of(docs: DataFrame) -> DataFrame:
    """(shard, lang, n, words, codes) of rows (lang, text): n words; words distinct, joined by full stops; codes number them, BREAK parts pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, total = TaskContext.get().partitionId(), 0, 0
        open_: dict[str, tuple[Numbers, list[np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at, total
            for lang, (numbers, codes) in open_.items():
                code = np.concatenate(codes)
                del numbers[b"."]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{at}"]), pa.array([lang]), pa.array([int((code >= 0).sum())], pa.int64()), pa.array([b".".join(numbers)], pa.binary()), pa.array([code.tobytes()], pa.binary())],
                    ["shard", "lang", "n", "words", "codes"],
                )
                at += 1
            open_.clear()
            total = 0

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for words in tokens((text.as_py() or "").encode(), PART_BYTES):
                    if lang not in open_:
                        open_[lang] = Numbers(), []
                    numbers, codes = open_[lang]
                    codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    codes.append(np.full(1, BREAK, np.int32))
                    total += len(words)
                if total >= SHARD_WORDS:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(work, SHARDS)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one after the other: a batch of large values never stands in memory twice."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


class Filter:
    """Hashes, each a bit of a table of bounded size."""

    def __init__(self, hashes: DataFrame, min_bits: int | None = None):
        """hashes: one column h of longs."""
        spark = hashes.sparkSession
        self.bits, n = min_bits or MIN_BITS, hashes.count()
        while self.bits < min(n * BITS_PER_PHRASE, MAX_BITS):
            self.bits *= 2
        slot = F.col("h").bitwiseAND(F.lit(self.bits - 1))
        words = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("m"))
        # at most bits / 64 rows, whatever the number of phrases
        found = words.toArrow()
        table = np.zeros(self.bits // 64, np.int64)
        table[found.column("w").to_numpy()] = found.column("m").to_numpy()
        self.shared = spark.sparkContext.broadcast(table)

    def accepts(self, h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64(self.bits - 1)
        word = self.shared.value[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return ((word >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


class Automaton:
    """The generalised suffix automaton of a shard's pieces, for phrases of up to depth words.

    State s holds the phrases of low[s] to high[s] words that end at end[s] and at no other set of places; count[s] is the
    number of these places and link[s] the state of the longest suffix with more of them (-1: none). reach[i] is the
    number of words of the longest phrase that may end at i.
    """

    def __init__(self, codes: np.ndarray, reach: np.ndarray, depth: int = LONGEST):
        self.codes = codes
        reach = np.minimum(reach, depth)
        low, high, link, count, end = [], [], [], [], []
        states = 0
        place = np.flatnonzero(reach >= 1)  # still to be parted
        of = np.zeros(len(place), np.int64)  # their group of the level before
        state, size = np.full(1, -1, np.int64), np.zeros(1, np.int64)  # the state of each such group, and its places
        number = int(codes.max(initial=-1)) + 1
        for d in range(1, depth + 1):
            keep = reach[place] >= d
            place, of = place[keep], of[keep]
            if not len(place):
                break
            key = of * number + codes[place - d + 1]
            _, at, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            above = of[at]
            # a group as large as the one it comes from is the same state, one word longer
            same = n == size[above]
            now = np.empty(len(n), np.int64)
            now[same] = state[above[same]]
            new = ~same
            now[new] = states + np.arange(new.sum())
            states += int(new.sum())
            if d > 1:
                grown = np.concatenate(high)
                grown[now[same]] = d
                high = [grown]
            low.append(np.full(new.sum(), d)), high.append(np.full(new.sum(), d))
            link.append(state[above[new]]), count.append(n[new]), end.append(place[at[new]])
            size, state, of = n, now, group
        self.low, self.high, self.link, self.count, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (low, high, link, count, end))

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(last place of one occurrence, number of places) of every phrase of the length."""
        s = np.flatnonzero((self.low <= length) & (self.high >= length))
        return self.end[s], self.count[s]


class Shard:
    """A shard's words as hashes, and the phrases that filters leave."""

    def __init__(self, row: dict, filters: list[Filter]):
        self.codes = np.frombuffer(row["codes"], np.int32)
        raw = row["words"]
        self.words = raw.split(b".") if raw else []
        size = np.array([len(w) for w in self.words], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        seed = np.frombuffer(row["lang"].encode(), np.uint8)
        data = np.frombuffer(raw, np.uint8)
        h = bytesops.span_hash(bytesops.prefix_hash(data), begin, begin + size)
        self.hash = np.append(bytesops.mix(bytesops.mix(h + size.astype(np.uint64)) ^ bytesops.prefix_hash(seed)[-1]), np.uint64(0))
        # reach: words of the longest phrase that may end at a place
        self.filters = filters
        n = len(self.codes)
        self.reach = np.zeros(n, np.int8)
        ok = self.codes >= 0
        self.reach[ok] = 1
        hashes = self.hash[self.codes]
        here = hashes
        for k, f in enumerate(filters, 1):
            # here: the hash of the phrase of k words that ends at each place
            yes = np.flatnonzero(ok)
            ok = ok.copy()
            ok[yes] = f.accepts(here[yes])
            self.reach[yes[~ok[yes]]] = k - 1
            # one word more: both parts of k words have to be frequent
            longer = np.zeros(n, bool)
            longer[1:] = ok[1:] & ok[:-1]
            if k == 1:
                longer[1:] &= self.codes[:-1] >= 0
            ok = longer
            self.reach[ok] = k + 1
            here = np.concatenate((here[:1], bytesops.mix(here[:-1] * _STEP + hashes[1:])))

    def hashes(self, ends: np.ndarray, length: int) -> np.ndarray:
        h = self.hash[self.codes[ends - length + 1]]
        for k in range(length - 2, -1, -1):
            h = bytesops.mix(h * _STEP + self.hash[self.codes[ends - k]])
        return h

    def texts(self, ends: np.ndarray, length: int) -> list[str]:
        names = [w.decode() for w in self.words]
        columns = [map(names.__getitem__, self.codes[ends - k].tolist()) for k in range(length - 1, -1, -1)]
        return list(map(" ".join, zip(*columns, strict=True)))


#: Bytes of a hash that travel; a filter has fewer bits, and what two hashes share there is only counted together.
KEY_BYTES = 5
_KEY = np.uint64((1 << 8 * KEY_BYTES) - 1)


def _short(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[start], np.add.reduceat(n, start)


def frequent(shards: DataFrame, length: int, least: int, filters: list[Filter]) -> DataFrame:
    """(h): hashes of phrases of the length that may stand least times or more; every such phrase's hash is there.

    A shard sends one row of hashes and counts for each bucket; hashes that it has once go without a count.
    """
    deal = tasks(shards.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                shard = Shard(row, filters)
                ends, count = Automaton(shard.codes, shard.reach, length).phrases(length)
                h = shard.hashes(ends, length)
                bucket = ((h >> np.uint64(40)) % np.uint64(deal)).astype(np.int64)
                # of each bucket, what stands once comes first
                order = np.lexsort((count > 1, bucket))
                h, count, bucket = h[order] & _KEY, count[order].astype(np.uint32), bucket[order]
                cut = np.searchsorted(bucket, np.arange(deal + 1)).tolist()
                out: list[list] = [[], [], []]
                for b in range(deal):
                    x, n = h[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]]
                    if len(x):
                        for col, v in zip(out, (b, _short(x), n[n > 1].tobytes()), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "h", "count"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for b in batches:
            for x, c in zip(b.column("h"), b.column("count"), strict=True):
                key, many = _long(x.as_py()), np.frombuffer(c.as_py(), np.uint32)
                n = np.ones(len(key), np.int64)
                n[len(key) - len(many) :] = many
                keys.append(key)
                counts.append(n)
                held += len(key)
            if held > MEET_KEYS:
                key, n = _sums(keys, counts)
                keys, counts, held = [key], [n], 0
        if keys:
            key, n = _sums(keys, counts)
            key = key[n >= least].view(np.int64)
            for a in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)])], ["h"])

    sent = shards.mapInArrow(send, "bucket int, h binary, count binary")
    return sent.repartition(deal, "bucket").select("h", "count").mapInArrow(meet, "h long")


def phrase_counts(shards: DataFrame, filters: list[Filter], longest: int, least: int) -> DataFrame:
    """(lang, words, phrase, f) of the phrases that stand least times or more, counted as they are written.

    A shard sends the phrases that the filters leave, one row for each bucket; a bucket has them as a table of its own.
    """
    deal = tasks(shards.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                shard = Shard(row, filters)
                automaton = Automaton(shard.codes, shard.reach, longest)
                out: dict[int, tuple[list[str], list[np.ndarray]]] = {}
                for length in range(1, longest + 1):
                    ends, count = automaton.phrases(length)
                    bucket = ((shard.hashes(ends, length) >> np.uint64(40)) % np.uint64(deal)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    text = shard.texts(ends[order], length)
                    cut = np.searchsorted(bucket[order], np.arange(deal + 1)).tolist()
                    for b in range(deal):
                        if cut[b] < cut[b + 1]:
                            texts, counts = out.setdefault(b, ([], []))
                            texts += text[cut[b] : cut[b + 1]]
                            counts.append(count[order[cut[b] : cut[b + 1]]].astype(np.uint32))
                # no phrase has a line break
                cells = [(b, "\n".join(texts), np.concatenate(counts).tobytes()) for b, (texts, counts) in out.items()]
                columns = list(zip(*cells, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array([row["lang"]] * len(cells), pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], ["bucket", "lang", "phrases", "counts"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[str, int]] = {}
        for batch in batches:
            for row in rows_of(batch):
                mine = found.setdefault(row["lang"], {})
                for phrase, n in zip(row["phrases"].split("\n"), np.frombuffer(row["counts"], np.uint32).tolist(), strict=True):
                    mine[phrase] = mine.get(phrase, 0) + n
        for lang, mine in found.items():
            kept = [(p, n) for p, n in mine.items() if n >= least]
            for a in range(0, len(kept), 1 << 14):
                part = kept[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([p.count(" ") + 1 for p, _ in part], pa.int32()), pa.array([p for p, _ in part]), pa.array([n for _, n in part], pa.int64())], ["lang", "words", "phrase", "f"]
                )

    sent = shards.mapInArrow(send, "bucket int, lang string, phrases string, counts binary")
    return sent.repartition(deal, "bucket").mapInArrow(meet, "lang string, words int, phrase string, f long")


def collocations(docs: DataFrame, *, least: int = 100, longest: int = LONGEST, percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of 2 to longest words of each language.

    a is the phrase's number of occurrences, l and r those of the parts at its weakest cut, n the language's number of
    words, score floor(1000 * a * n / (l * r)). A phrase inside a longer one with 100 * f(longer) >= percent * a goes:
    its neighbours of one word more decide, as anything longer is no more frequent than they are. Equal scores are
    ranked by a, then by the phrase's bytes. Null texts are empty; a null language is `und`; repeated rows count each; an
    empty table gives an empty result; extra columns are ignored. Long texts are worked on in parts between pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = materialize(shards_of(rows), "phrase-shards")
    filters: list[Filter] = []
    for length in range(1, longest):
        filters.append(Filter(materialize(frequent(shards, length, least, filters), f"phrases-{length}")))
    counts = materialize(phrase_counts(shards, filters, longest, least), "phrase-counts")
    phrases = counts.where("words > 1")
    words = F.split("phrase", " ", -1)

    def cut_at(first: Column, size: Column) -> Column:
        return F.array_join(F.slice(words, first, size), " ")

    # a phrase within one of one word more
    longer = phrases.where("words > 2").select("lang", F.explode(F.array(cut_at(F.lit(1), F.col("words") - 1), cut_at(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("f").alias("g"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("g").alias("g"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("g").isNull() | (100 * F.col("g") < percent * F.col("f"))).drop("g")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), words.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    whole = "decimal(19,0)"
    # products of two whole numbers of 19 digits; div gives the whole part
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(f"(cast(1000 * a AS {whole}) * cast(n AS {whole})) div (cast(l AS {whole}) * cast(r AS {whole}))"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
