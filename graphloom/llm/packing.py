"""Best-fit packing of token sequences with matched large pieces (operator 6)."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.tables import BATCH_ROWS, written
from graphloom.llm.text import batch_arrays
from graphloom.llm.tokens import CACHE_WORDS, default_path, encoder, vocabulary


def pieces(df: DataFrame, capacity: int = 2048, path: str | None = None, end: int = 0, with_ids: bool = False, cache_words: int = CACHE_WORDS, part_bytes: int = 8 << 20) -> DataFrame:
    """Cuts each document (doc_id, text; a null text is empty) into pieces of at most `capacity` token ids.

    A document is its ids and then `end`. Only longer ones are cut, and only the last piece may be shorter.
    Gives doc_id, piece, start (ids before it), length, ids_crc32 (of little-endian 32-bit ids), and ids if asked for.
    `cache_words` and `part_bytes` trade a Python worker's memory for time; results are the same.
    """
    source = df.sparkSession.sparkContext.broadcast(vocabulary(path or default_path()))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        import pyarrow as pa

        for keys, texts in batch_arrays(batches, "doc_id", "text", part_bytes=part_bytes):
            offsets, ids = encoder(source.value, end, cache_words).encode(texts)
            sizes = np.diff(offsets)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = piece * capacity
            length = np.minimum(sizes[row] - at, capacity)
            begin = offsets[row] + at
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            out = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, offsets[-1]), pa.int32()), pa.array(ids.astype("<i4"))))
            yield pa.RecordBatch.from_arrays(out, schema=pa.schema([(k, x.type) for k, x in zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), out, strict=False)]))

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, offset): equal lengths are handled together, so the work and the plan
    depend on the number of lengths (at most `capacity`), not on the number of pieces.

    Pieces above a third of the capacity go at most two to a bin: the longest is matched with the longest that fits
    beside it. Smaller ones, longest first, each go to the bin with the least room that holds them, or to a new one.
    """
    rest = {k: v for k, v in counts.items() if v}
    done: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: ranges of bins
    bins = 0

    def put(length: int, first: int, n: int, offset: int) -> None:
        out.append((length, done[length], done[length] + n, first, offset))
        done[length] += n
        rest[length] -= n

    large = sorted((k for k in rest if 3 * k > capacity), reverse=True)
    for length in large:
        for other in large:
            if not rest[length]:
                break
            if other > length or length + other > capacity or not rest[other]:
                continue
            n = min(rest[length], rest[other]) if other != length else rest[length] // 2
            if n:
                put(length, bins, n, 0)
                put(other, bins, n, length)
                open_bins[capacity - length - other].append((bins, n))
                bins += n
        if n := rest[length]:
            put(length, bins, n, 0)
            open_bins[capacity - length].append((bins, n))
            bins += n
    for length in sorted((k for k in rest if 3 * k <= capacity), reverse=True):
        room = length
        while rest[length]:
            while room <= capacity and not open_bins.get(room):
                room += 1
            if room > capacity:  # new bins, each filled with this length
                n = max(1, rest[length] // (capacity // length)) if rest[length] >= capacity // length else 1
                open_bins[capacity].append((bins, n))
                bins += n
                room = capacity
            first, n = open_bins[room].pop()
            each = min(room // length, rest[length])
            use = min(n, rest[length] // each)
            if use < n:
                open_bins[room].append((first + use, n - use))
            for k in range(each):
                put(length, first, use, capacity - room + k * length)
            if left := room - each * length:
                open_bins[left].append((first, use))
    return out


def pack(cut: DataFrame, capacity: int = 2048, part_rows: int | None = None) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to a table of pieces with doc_id, piece and length (1 to capacity).

    Equal lengths are ranked in parts of some `part_rows` (500, or a 200,000th of all pieces) by a hash of doc_id and piece,
    so that a hot length, as that of full pieces is, is split. Only counts by length and part reach the driver: one row for
    each length and for each `part_rows` pieces, some 200,000 at most. Rows that are alike in doc_id, piece and length are interchangeable. An empty table gives an
    empty result.
    """
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    part_rows = part_rows or max(500, sum(lengths.values()) // 200_000)
    if max(lengths.values(), default=0) > part_rows:
        # at most `capacity` rows
        deal = cut.sparkSession.createDataFrame([(k, 1 + n // part_rows) for k, n in lengths.items()], "length long, _parts long")
        salted = cut.join(F.broadcast(deal), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts")).cast("int")).drop("_parts")
        counted = {(r["length"], r["_part"]): r["n"] for r in salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        salted = cut.withColumn("_part", F.lit(0))
        counted = {(k, 0): n for k, n in lengths.items()}
    total: dict[int, int] = defaultdict(int)
    parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, part in sorted(counted):
        n = counted[length, part]
        parts[length].append((part, total[length], total[length] + n))
        total[length] += n
    placed = defaultdict(list)
    for length, lo, hi, first, offset in plan(total, capacity):
        placed[length].append((lo, hi, first, offset))
    rows = []
    for length, spans in placed.items():
        at = 0
        for part, base, end in parts[length]:  # both lists ascend
            while at and spans[at - 1][1] > base:
                at -= 1
            while at < len(spans) and spans[at][0] < end:
                lo, hi, first, offset = spans[at]
                if hi > base:
                    a, b = max(lo, base), min(hi, end)
                    rows.append((length, part, a - base, b - base, first + a - lo, offset))
                at += 1
    ranges = cut.sparkSession.createDataFrame(rows, "length long, _part int, _lo long, _hi long, _bin long, offset long")
    # one row for each length, part and step of the plan
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(ranges), ["length", "_part"]).where("_rank >= _lo AND _rank < _hi")
    return joined.withColumn("sequence_id", F.col("_bin") + F.col("_rank") - F.col("_lo")).drop("_part", "_rank", "_lo", "_hi", "_bin")


def pack_documents(df: DataFrame, capacity: int = 2048, path: str | None = None, with_ids: bool = False, cache_words: int = CACHE_WORDS, part_bytes: int = 8 << 20, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Cuts and packs documents: the rows of pieces() with sequence_id and offset.

    The cut pieces are written once in the shared folder, as both the plan and the placement read them.
    """
    cut = pieces(df, capacity, path, with_ids=with_ids, cache_words=cache_words, part_bytes=part_bytes)
    return pack(written(cut, batch_rows), capacity)
