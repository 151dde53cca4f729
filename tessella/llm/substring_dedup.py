"""Removal of long substrings that an earlier document holds, by suffix arrays over routed segments.

Every window of LENGTH bytes is routed by the least hash of the GRAM-byte strings in it (winnowing): equal windows have
equal least hashes, so all occurrences of a window meet in one shard, wherever they stand. Consecutive windows with one
least hash travel as one segment. A first pass over the hashes alone finds those that two different texts share, and
only their segments travel. A shard then builds, block by block, the suffix array and Burrows-Wheeler order of its
distinct segments and expands intervals breadth-first. A step puts one symbol before the strings of all intervals at
once: two neighbours of the order stay together if their symbols agree and the suffixes behind these, which the inverse
of the LF mapping gives, are in one interval of the step before. The first step knows symbols alone; common prefixes come
out by increasing value, and the expansion stops at LENGTH, where intervals are exactly the equal windows. The least
document of an interval keeps its bytes; in the others they go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops
from .shared import IdFilter, materialize, release_shuffles, tasks

LENGTH = 50
GRAM = 20
#: Windows of one segment at most: a text of one repeated byte is cut.
SEGMENT_WINDOWS = 4096
#: Windows that are hashed at a time.
PIECE = 1 << 16
#: Bytes of the input, as it is stored, for each shard.
SHARD_BYTES = 16 << 20
#: Bytes of distinct segments that one suffix array covers; a hash with more is a block of its own.
BLOCK_BYTES = 1 << 20


def window_minimum(g: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (width - size)], g[width - size :]) if size < width else g


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, windows, hash) of every maximal run of windows with one least hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    least = np.empty(len(data) - length + 1, np.uint64)
    for a in range(0, len(least), PIECE):
        # piece by piece: hashes of a long text never stand in memory together
        b = min(a + PIECE, len(least))
        piece = data[a : b + length - 1]
        prefix = bytesops.prefix_hash(piece)
        least[a:b] = window_minimum(bytesops.mix(bytesops.span_hash_all(prefix, gram)), length - gram + 1)
    size = np.diff(offsets)
    long_ = size >= length
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edge, offsets[:-1][long_], 1)
    np.add.at(edge, offsets[1:][long_] - length + 1, -1)
    valid = np.cumsum(edge[: len(least)], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[offsets[:-1][long_]] = True
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    # a run ends before the next one or at the last window of its text
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.concatenate((start[1:], [len(data)])), offsets[doc + 1] - length + 1)
    many = -(-(end - start) // SEGMENT_WINDOWS)
    if many.max() > 1:
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        doc, ends = np.repeat(doc, many), np.repeat(end, many)
        h = np.repeat(least[start], many)
        start = np.repeat(start, many) + step * SEGMENT_WINDOWS
        return doc, start, np.minimum(ends - start, SEGMENT_WINDOWS), h
    return doc, start, end - start, least[start]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each key among the different ones, from 1)."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return order, rank


def equal_windows(x: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A number for every position: equal for two positions if and only if the length bytes from there are equal.

    Positions of fewer than length bytes count as followed by zero bytes, and get numbers no better than that.
    """
    n = len(x)
    padded = np.concatenate((x, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    order, rank = _dense(key)
    depth = 8
    while depth < length:
        follow = np.zeros(n, np.int64)
        follow[: max(n - depth, 0)] = rank[depth:]
        order, rank = _dense((rank << 32) | follow)
        depth *= 2
    position = np.empty(n + 1, dtype=np.int32)  # of each suffix in the order; the empty suffix stands last
    position[order] = np.arange(n, dtype=np.int32)
    position[n] = n
    successor = position[np.concatenate((order + 1, [n]))]  # where each suffix without its first byte stands
    # from the intervals of one symbol, one more at a time: neighbours stay together while their successors do
    symbol = x[order]
    bound = np.ones(n + 1, dtype=bool)
    bound[1:n] = symbol[1:] != symbol[:-1]
    open_ = np.flatnonzero(~bound).astype(np.int32)
    here, before = successor[open_], successor[open_ - 1]
    for _ in range(1, length):
        if not len(open_):
            break
        interval = np.cumsum(bound, dtype=np.int32)
        apart = interval[here] != interval[before]
        if apart.any():
            bound[open_[apart]] = True
            together = ~apart
            open_, here, before = open_[together], here[together], before[together]
    return np.cumsum(bound, dtype=np.int32)[position[:n]]


def flag_windows(block: list[bytes], owner: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments and occurrences (owner: segment number, id): the least id of each window, segment by segment, and the windows of each."""
    least = np.full(len(block), np.iinfo(np.int64).max)
    np.minimum.at(least, owner, ids)
    x = np.frombuffer(b"".join(block), dtype=np.uint8)
    size = np.array([len(b) for b in block])
    begin = np.cumsum(size) - size
    windows = size - length + 1
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    group = equal_windows(x, length)[at]
    of = np.repeat(np.arange(len(block)), windows)
    low = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, least[of])
    return low[group], windows


def _deal(shards: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by shard, cuts between shards)."""
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


BUCKETS = "bucket int, ids binary, values binary"


def _to_buckets(ids: np.ndarray, values: np.ndarray, shards: int):
    """Values of 8 bytes for ids, one row per bucket of ids: a task's rows do not grow with the texts it knows of."""
    order, cut = _deal(shards, bytesops.mix(ids.astype(np.uint64)))
    some = np.flatnonzero(np.diff(cut))
    parts = [order[cut[i] : cut[i + 1]] for i in some]
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _binary([ids[x].tobytes() for x in parts]), _binary([values[x].tobytes() for x in parts])], ["bucket", "ids", "values"])


def _by_id(rows: DataFrame, shards: int) -> DataFrame:
    """(id, values): all values of each id."""

    def gather(batches):
        ids, values = [], []
        for b in batches:
            ids += [np.frombuffer(x.as_py(), np.int64) for x in b.column("ids")]
            values += [np.frombuffer(x.as_py(), np.uint64) for x in b.column("values")]
        if not ids:
            return
        id_, v = np.concatenate(ids), np.concatenate(values)
        order = np.argsort(id_, kind="stable")
        id_, v = id_[order], v[order]
        cut = np.flatnonzero(np.concatenate(([True], id_[1:] != id_[:-1], [True])))
        for at in range(0, len(cut) - 1, 1024):
            c = cut[at : at + 1025]
            yield pa.RecordBatch.from_arrays([pa.array(id_[c[:-1]]), _binary([v[x:y].tobytes() for x, y in zip(c, c[1:], strict=False)])], ["id", "values"])

    return rows.repartition(shards, "bucket").mapInArrow(gather, "id long, values binary")


#: The first pass compares 48 bits of a hash; a chance agreement only lets a segment travel in vain.
ROUTE_MASK = np.uint64((1 << 48) - 1)


def _short(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _shared_hashes(docs: DataFrame, shards: int) -> DataFrame:
    """(id, hashes): the document's segment hashes that another text has too."""

    def send(batches):
        for batch in batches:
            for rows, data, offsets in bytesops.runs(batch):
                doc, _, _, h = segments(data, offsets)
                h = h & ROUTE_MASK
                # once per text
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[keep], h[keep]
                ids, content = rows.column("id").to_numpy(), rows.column("content").to_numpy()
                order, cut = _deal(shards, h)
                out = []
                for s in np.flatnonzero(np.diff(cut)):
                    part = order[cut[s] : cut[s + 1]]
                    who, n = np.unique(doc[part], return_counts=True)
                    out.append((int(s), _short(h[part]), ids[who].tobytes(), content[who].tobytes(), n.astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[_binary([o[k] for o in out]) for k in range(1, 5)]], ["shard", "h", "ids", "content", "n"])

    def meet(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for h, ids, content, n in zip(*(b.column(c) for c in ("h", "ids", "content", "n")), strict=True):
                n = np.frombuffer(n.as_buffer(), np.int32)
                parts.append((_long(h.as_buffer()), np.repeat(np.frombuffer(ids.as_buffer(), np.int64), n), np.repeat(np.frombuffer(content.as_buffer(), np.int64), n)))
        if not parts:
            return
        h, ids, content = (np.concatenate([p[k] for p in parts]) for k in range(3))
        parts.clear()
        order = np.argsort(h)
        h, ids, content = h[order], ids[order], content[order]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        several = np.minimum.reduceat(content, begin) != np.maximum.reduceat(content, begin)
        hot = np.repeat(several, np.diff(np.concatenate((begin, [len(h)]))))
        yield from _to_buckets(ids[hot], h[hot], shards)

    sent = docs.mapInArrow(send, "shard int, h binary, ids binary, content binary, n binary")
    return _by_id(sent.repartition(shards, "shard").mapInArrow(meet, BUCKETS), shards).withColumnRenamed("values", "hashes")


def _spans(docs: DataFrame, shards: int) -> DataFrame:
    """(id, spans) of rows (id, text, hashes): pairs of 32-bit start and end, to be united."""

    def send(batches):
        for batch in batches:
            for rows, data, offsets in bytesops.runs(batch):
                doc, start, windows, h = segments(data, offsets)
                mine = []
                for i, wanted in enumerate(rows.column("hashes")):
                    a, b = np.searchsorted(doc, [i, i + 1])
                    mine.append(a + np.flatnonzero(np.isin(h[a:b] & ROUTE_MASK, np.frombuffer(wanted.as_buffer(), np.uint64))))
                mine = np.concatenate(mine)
                doc, start, windows, h = doc[mine], start[mine], windows[mine], h[mine]
                ids = rows.column("id").to_numpy()
                raw = data.tobytes()
                order, cut = _deal(shards, h)
                out = []
                for s in np.flatnonzero(np.diff(cut)):
                    part = order[cut[s] : cut[s + 1]]
                    number: dict[bytes, int] = {}
                    owner = np.array([number.setdefault(raw[a : a + n + LENGTH - 1], len(number)) for a, n in zip(start[part].tolist(), windows[part].tolist(), strict=True)], np.int32)
                    first = np.unique(owner, return_index=True)[1]
                    size = np.array([len(x) for x in number], np.int32)
                    out.append((int(s), b"".join(number), size.tobytes(), h[part][first].tobytes(), owner.tobytes(), ids[doc[part]].tobytes(), (start - offsets[doc])[part].astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[_binary([o[k] for o in out]) for k in range(1, 7)]], ["shard", "bytes", "size", "h", "owner", "ids", "start"])

    def meet(batches):
        number: dict[bytes, int] = {}
        hashes: list[int] = []
        owners, ids, starts = [], [], []
        for b in batches:
            for raw, size, h, owner, i, start in zip(*(b.column(c) for c in ("bytes", "size", "h", "owner", "ids", "start")), strict=True):
                raw, at, local = raw.as_py(), 0, []
                for n, x in zip(np.frombuffer(size.as_buffer(), np.int32).tolist(), np.frombuffer(h.as_buffer(), np.uint64).tolist(), strict=True):
                    segment = raw[at : at + n]
                    k = number.setdefault(segment, len(number))
                    if k == len(hashes):
                        hashes.append(x)
                    local.append(k)
                    at += n
                owners.append(np.array(local, np.int64)[np.frombuffer(owner.as_buffer(), np.int32)])
                ids.append(np.frombuffer(i.as_py(), np.int64))
                starts.append(np.frombuffer(start.as_py(), np.int32))
        if not number:
            return
        owner, id_, start = np.concatenate(owners), np.concatenate(ids), np.concatenate(starts).astype(np.int64)
        h = np.array(hashes, np.uint64)
        names = list(number)
        number.clear()
        by_hash = np.argsort(h, kind="stable")
        place = np.empty(len(h), np.int64)
        place[by_hash] = np.arange(len(h))
        owner = place[owner]
        order = np.argsort(owner, kind="stable")
        owner, id_, start = owner[order], id_[order], start[order]
        names = [names[i] for i in by_hash]
        h = h[by_hash]
        filled = np.cumsum([len(x) for x in names])
        a = 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while a < len(names):
            b = max(int(np.searchsorted(filled, (filled[a - 1] if a else 0) + BLOCK_BYTES)), a + 1)
            b = int(np.searchsorted(h, h[b - 1], side="right"))
            lo, hi = np.searchsorted(owner, [a, b])
            flat, count = flag_windows(names[a:b], owner[lo:hi] - a, id_[lo:hi])
            # windows of each occurrence, at most a segment's worth at a time
            begin = np.cumsum(count) - count
            for c in range(lo, hi, 20_000):
                o = owner[c : min(c + 20_000, hi)] - a
                n = count[o]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gone = flat[np.repeat(begin[o], n) + step] < np.repeat(id_[c : c + len(o)], n)
                head = gone & ~(np.concatenate(([False], gone[:-1])) & (step > 0))
                tail = gone & ~(np.concatenate((gone[1:], [False])) & (np.concatenate((step[1:], [0])) > 0))
                which = np.repeat(np.arange(len(o)), n)
                p, q = np.flatnonzero(head), np.flatnonzero(tail)
                s = start[c + which[p]]
                found.append((id_[c + which[p]], (s + step[p]).astype(np.int32), (s + step[q] + LENGTH).astype(np.int32)))
            a = b
        id_, s, e = (np.concatenate([f[k] for f in found]) for k in range(3))
        yield from _to_buckets(id_, np.stack((s, e), axis=1).view(np.uint64).ravel(), shards)

    sent = docs.mapInArrow(send, "shard int, bytes binary, size binary, h binary, owner binary, ids binary, start binary")
    return _by_id(sent.repartition(shards, "shard").mapInArrow(meet, BUCKETS), shards).withColumnRenamed("values", "spans")


def unite(spans: list[bytes], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    pairs = sorted((int(a), min(int(b), size)) for x in spans for a, b in np.frombuffer(x, np.int32).reshape(-1, 2))
    out: list[list[int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if a < b]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, spans: array of binary) of rows (id, text) with something to remove. Null ids are left out."""
    spark = docs.sparkSession
    rows = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    # a shard is held by one task: their number grows with the input, as far as Spark knows its size
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(tasks(spark), -(-size // SHARD_BYTES) if 0 < size < 1 << 50 else 1)
    # whole copies need no search: all but the least id's go
    same = rows.where(F.octet_length("text") >= LENGTH).select("id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    least = same.groupBy("h", "m").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = same.join(least, ["h", "m"]).where("id > least").select("id").distinct()
    copies = materialize(copies, "repeat-copies")
    hot = _shared_hashes(rows.select("id", "text", F.xxhash64("text").alias("content")), shards)
    hot = materialize(hot.join(copies, "id", "left_anti"), "repeat-hashes")
    release_shuffles(spark)
    near, _ = IdFilter(hot.select("id")).split(rows.select("id", "text"), "id")
    spans = materialize(_spans(near.join(hot, "id").select("id", "text", "hashes"), shards), "repeat-spans")
    release_shuffles(spark)
    whole = np.array([0, np.iinfo(np.int32).max], np.int32).tobytes()
    return spans.unionByName(copies.select("id", F.lit(whole).alias("spans"))).groupBy("id").agg(F.collect_list("spans").alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    A byte goes if a LENGTH-byte string over it also starts in a row of smaller id; strings are those of the input, and
    none crosses two rows. Null text is empty. Rows of one id are expected to hold one text and are treated alike; a row
    with a null id keeps everything and takes nothing from others. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = materialize(repeated_spans(rows), "repeat-united")
    touched, clean = IdFilter(spans.select("id")).split(rows, "id")
    touched = touched.join(spans, "id", "left")
    clean = clean.withColumn("spans", F.lit(None).cast("array<binary>"))

    def cut(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                gone = unite(found or [], len(raw))
                at, kept = 0, []
                for s, e in gone:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                for col, v in zip(out, (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    parts = [x.select("id", "text", "spans").mapInArrow(cut, schema) for x in (clean, touched)]
    out = parts[0].unionByName(parts[1]).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
