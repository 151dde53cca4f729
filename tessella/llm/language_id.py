"""Language identification with bit-sliced Bloom filters of n-grams.

Each slot of the filter holds one bit per language, in as many words as the languages need; the AND of an n-gram's slots
is the set of all languages whose filter contains it. A text's popcount per language, less the false positives that the
language's fill predicts, decides. The filter grows with the n-grams learned up to a stated size; beyond it the fill
rises, and with it the correction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops
from .shared import id_hash, materialize

GRAM = 4  # bytes of lower-case text
#: Slots of the filter for each gram of the largest language, and the least and largest numbers of slots.
SLOTS_PER_GRAM, MIN_SLOTS, MAX_SLOTS = 8, 1 << 20, 1 << 23
HASHES = 3
WORD = 64  # languages of one word of a slot
UNDETERMINED = "und"

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, first byte) of every window of GRAM bytes within one text, but those with two blanks together."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    x = _LETTERS[data]
    w = x.astype(np.uint32)
    g = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
    keep = np.ones(len(g), dtype=bool)
    for back in range(1, GRAM):
        cut = offsets[1:-1] - back
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    pair = (x[:-1] == 32) & (x[1:] == 32)
    keep &= ~(pair[:-2] | pair[1:-1] | pair[2:])
    at = np.flatnonzero(keep)
    return g[at], at


def slots(g: np.ndarray, n_slots: int) -> list[np.ndarray]:
    h = bytesops.mix(g.astype(np.uint64) + np.uint64(1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(n_slots - 1)).astype(np.int64) for i in range(HASHES)]


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    i = batch.schema.get_field_index("text")
    return batch.set_column(i, "text", pc.utf8_lower(pc.fill_null(batch.column("text"), "")))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    masks: np.ndarray  # words x slots: the language bits of each slot
    false: np.ndarray  # how often a gram that a language lacks passes its filter
    prior: int

    @classmethod
    def build(cls, languages: list[str], masks: np.ndarray, prior: int) -> LanguageModel:
        fill = [np.mean((masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)) for i in range(len(languages))]
        return cls(languages, masks, np.array(fill, dtype=float) ** HASHES, prior)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) corrected counts, and the grams per text."""
        g, at = grams(data, offsets)
        where = slots(g, self.masks.shape[1])
        cut = np.searchsorted(at, offsets)
        n = np.diff(cut).astype(float)
        out = np.zeros((len(n), len(self.languages)))
        for i, false in enumerate(self.false):
            if i % WORD == 0:
                word = self.masks[i // WORD]
                mask = word[where[0]] & word[where[1]] & word[where[2]]
            hits = bytesops.per_text((mask >> np.uint64(i % WORD)) & np.uint64(1), cut)
            out[:, i] = np.maximum(hits - n * false, 0) / max(1 - false, 1e-9)
        return out, n


def train(rows: DataFrame, *, min_count: int = 3, min_share: float = 0.15) -> LanguageModel:
    """Learn from rows (text, lang) with lang not null.

    A gram enters a language's filter if the language holds it min_count times and has at least min_share of the gram's
    frequency over all languages.
    """

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def emit():
            for lang, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for rows_, data, offsets in bytesops.runs(lowered(batch), run_bytes=4 << 20):
                langs = rows_.column("lang").to_numpy(zero_copy_only=False)
                g, at = grams(data, offsets)
                doc = np.searchsorted(offsets, at, side="right") - 1
                names, code = np.unique(langs.astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    u, n = np.unique(g[code[doc] == i], return_counts=True)
                    if str(name) in held:
                        a, m = held[str(name)]
                        u, back = np.unique(np.concatenate((a, u)), return_inverse=True)
                        n = np.bincount(back, weights=np.concatenate((m, n)), minlength=len(u)).astype(np.int64)
                    held[str(name)] = (u, n)
                if sum(len(u) for u, _ in held.values()) > 2_000_000:
                    yield from emit()
        yield from emit()

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageModel.build([], np.zeros((1, MIN_SLOTS), np.uint64), 0)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    size = F.create_map(*[F.lit(x) for k in languages for x in (k, float(totals[k]))])
    rate = counts.withColumn("rate", F.col("n") / size[F.col("lang")]).withColumn("bit", number[F.col("lang")])
    total = rate.groupBy("gram").agg(F.sum("rate").alias("all"), F.collect_list(F.struct("bit", "rate", "n")).alias("by"))
    kept = total.select("gram", "all", F.explode("by").alias("b")).where((F.col("b.n") >= min_count) & (F.col("b.rate") >= min_share * F.col("all")))
    bits = kept.select("gram", "b.bit", F.expr(f"cast(b.bit div {WORD} as int)").alias("word"), F.expr(f"shiftleft(1L, cast(b.bit % {WORD} as int))").alias("mask"))
    bits = materialize(bits, "language-bits")
    most = bits.groupBy("bit").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n_slots = MIN_SLOTS
    while n_slots < min(most * SLOTS_PER_GRAM, MAX_SLOTS):
        n_slots *= 2
    chosen = bits.groupBy("gram", "word").agg(F.bit_or("mask").alias("mask"))

    def spread(batches):
        for b in batches:
            g, m = b.column("gram").to_numpy().astype(np.uint32), b.column("mask").to_numpy()
            for s in slots(g, n_slots):
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(s), pa.array(m)], ["word", "slot", "mask"])

    table = chosen.mapInArrow(spread, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((-(-len(languages) // WORD), n_slots), dtype=np.uint64)
    masks[table.column("word").to_numpy(), table.column("slot").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return LanguageModel.build(languages, masks, int(np.argmax([totals[k] for k in languages])))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out_fold: int = 0, **options) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score in 0..1.

    Learns from rows with a language outside the held-out fold. A text that is null or has no letter is "und" with score
    0, as is every text if nothing could be learned. A text with letters but no known gram gets the most frequent
    language with score 0. Equal counts go to the language first by name. A null id is never held out.
    """
    held = F.coalesce(id_hash(F.col(id_col), folds) == held_out_fold, F.lit(False))
    # a null id has no fold of its own and is still a row to learn from
    model = train(docs.where(~held & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False)
            batch = lowered(batch).append_column("letters", letters)
            for rows, data, offsets in bytesops.runs(batch):
                ok = rows.column("letters").to_numpy(zero_copy_only=False) & bool(m.languages)
                best, score = np.full(len(ok), len(names) - 1), np.zeros(len(ok))
                if m.languages:
                    c, _ = m.counts(data, offsets)
                    total = c.sum(axis=1)
                    best = np.where(ok, np.where(total > 0, c.argmax(axis=1), m.prior), len(names) - 1)
                    score = np.where(ok & (total > 0), c.max(axis=1) / np.maximum(total, 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    id_type = dict(docs.dtypes)[id_col]
    cols = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return cols.mapInArrow(predict, f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
