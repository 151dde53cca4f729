"""Token ids packed into rows of fixed capacity: best-fit decreasing with a segment tree over residual capacities.

Documents are cut losslessly into segments, and a task packs its own segments in blocks of bounded size, so nothing is
shuffled. A row of the result is a row of an id matrix with the cumulative segment lengths; positions restart at 0 in
every segment.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a task holds while it packs.
BLOCK_TOKENS = 2 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class CapacityTree:
    """Maximum segment tree over bins' residual capacities, to find the bin that an item fits most tightly.

    Leaves stand for residual capacities 0..capacity, each with a stack of the bins that have exactly that much left;
    a node counts the bins below it, and the search goes to the first non-empty leaf at or right of the item's length.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, residual: int, by: int) -> None:
        at = residual + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, residual: int, bin_: int) -> None:
        self.bins[residual].append(bin_)
        self._add(residual, 1)

    def tightest(self, length: int) -> int:
        """The least residual of at least length, or -1."""
        at = length + self.size
        if self.count[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size

    def pop(self, residual: int) -> int:
        self._add(residual, -1)
        return self.bins[residual].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        residual = tree.tightest(lengths[i])
        if residual < 0:
            bins.append([i])
            b, residual = len(bins) - 1, capacity
        else:
            b = tree.pop(residual)
            bins[b].append(i)
        if residual - lengths[i] > 0:
            tree.push(residual - lengths[i], b)
    return bins


class Tokenizer:
    """A public byte-level vocabulary of ranks; ids are those of encode_ordinary() on the whole text."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.encoding = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2") if max(ranks.values()) < 1 << 16 else np.dtype("<u4")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian bytes."""
        return np.array(self.encoding.encode_ordinary(text), dtype=self.dtype).tobytes()

    def decode(self, ids: bytes) -> str:
        return self.encoding.decode_bytes(np.frombuffer(ids, dtype=self.dtype).tolist()).decode("utf-8")


def read_bytes(spark, path: str) -> bytes:
    """A file as Spark reads it, so any store serves. A path without a scheme is the driver's own."""
    from urllib.parse import urlparse

    uri = path if urlparse(path).scheme else "file://" + path
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(uri)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


SCHEMA = "row string, doc_ids array<long>, segments array<int>, ids binary, positions binary, cu_seqlens array<int>, n_tokens int, sha256 string"


def pack_tokens(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of the id matrix: row, doc_ids, segments, ids, positions, cu_seqlens, n_tokens, sha256 of the n_tokens ids.

    ids are capacity little-endian values, padded with pad_id behind the first n_tokens; positions (16 or 32 bits, as
    the capacity needs) restart at 0 in every segment and are 0 in the padding. Segment k of a document holds its ids
    k*capacity onwards; joined in order they are the whole document's ids. Rows are filled best within a block of
    block_tokens; fill() says how well. Empty and null texts have no token and appear in no row; a null id
    stands as null; repeated rows are packed each; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_bytes(docs.sparkSession, vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(shared.value)
        width = tok.dtype.itemsize
        part, block = TaskContext.get().partitionId(), 0
        padding = pad_id.to_bytes(width, "little") * capacity
        place = np.dtype("<u2") if capacity <= 1 << 16 else np.dtype("<u4")
        counting = np.arange(capacity, dtype=place)
        held: list[tuple[int, int, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, block
            bins = best_fit_decreasing([len(x[2]) // width for x in held], capacity)
            for at in range(0, len(bins), 256):
                out: list[list] = [[] for _ in range(8)]
                for b, members in enumerate(bins[at : at + 256], at):
                    ids = b"".join(held[i][2] for i in members)
                    cu = np.cumsum([0, *[len(held[i][2]) // width for i in members]]).tolist()
                    whole = ids + padding[len(ids) :]
                    at_ = np.zeros(capacity, place)
                    at_[: cu[-1]] = counting[: cu[-1]] - np.repeat(np.array(cu[:-1], place), np.diff(cu))
                    for col, v in zip(out, (f"{part}-{block}-{b}", [held[i][0] for i in members], [held[i][1] for i in members], whole, at_.tobytes(), cu, cu[-1], hashlib.sha256(ids).hexdigest()), strict=True):
                        col.append(v)
                types = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["row", "doc_ids", "segments", "ids", "positions", "cu_seqlens", "n_tokens", "sha256"])
            held, tokens, block = [], 0, block + 1

        step = capacity * width
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = tok.encode(text.as_py() or "")
                # a very long text is packed block by block like any other rows
                for k, start in enumerate(range(0, len(ids), step)):
                    held.append((id_, k, ids[start : start + step]))
                    tokens += len(held[-1][2]) // width
                    if tokens >= block_tokens:
                        yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids: 0, 1, ... again in every segment."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: rows, tokens, and the share of the matrix that is no padding."""
    found = packed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return found.withColumn("fill", F.when(F.col("rows") > 0, F.col("tokens") / (F.col("rows") * capacity)).otherwise(1.0))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrix as Parquet: ids and positions of every row, with cu_seqlens."""
    packed.select("row", "ids", "positions", "cu_seqlens").write.mode("overwrite").parquet(path)
