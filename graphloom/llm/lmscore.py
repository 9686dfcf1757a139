"""Cross-entropy difference of matched n-gram models (operator 3)."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import written
from graphloom.llm.text import batch_arrays, coded
from graphloom.llm.tokens import forget

def folded(df: DataFrame) -> DataFrame:
    """df with fold, 0 or 1: equal texts fall in one fold, so that no model has seen the text it scores."""
    return df.withColumn("fold", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 1).isin(*"13579bdf").cast("int"))


#: Text of one block of documents, and of the corpus's share whose keys one task merges.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Key of the context that stands before a text's first word.
START = np.uint64(0x5354415254)
KEY_ROWS = "block long, kind int, bucket int, keys binary, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Counts (keys by groups), compressed group by group and byte by byte in the narrowest type that holds them all."""
    narrow = np.ascontiguousarray(counts.T.astype(np.min_scalar_type(int(counts.max(initial=0)))))
    return bytes([narrow.itemsize]) + zlib.compress(narrow.view(np.uint8).reshape(-1, narrow.itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, wide: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").reshape(wide, -1).T


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed steps, byte by byte."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def keyed(texts):
    """(offsets, words, before, ids, pairs, of) of a block: its distinct words as ascending 64-bit hashes, START among
    them; the place there of each word and of the one before it; its distinct pairs as ascending 64-bit hashes, and each
    word's pair there."""
    offsets, codes, uniques = coded(texts, lower=True)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in uniques], dtype=np.uint64)
    words, place = np.unique(np.concatenate((hashes, [START])), return_inverse=True)
    ids = place[:-1][codes] if len(codes) else np.zeros(0, np.int64)
    before = np.full(len(ids), place[-1], np.int64)
    before[1:] = ids[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = place[-1]
    with np.errstate(over="ignore"):
        mixed = words[before] * np.uint64(0x9E3779B97F4A7C15) + words[ids] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    pairs, of = np.unique(mixed, return_inverse=True)
    return offsets, words, before, ids, pairs, of


def _grouped(place: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place * 4 + group, minlength=4 * n).reshape(n, 4)


def _blocked(df: DataFrame, blocks: int) -> DataFrame:
    """doc_id, fold, block and the compressed text: texts are exchanged twice."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [zlib.compress(x.encode(), 6) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["doc_id", "fold", "block", "text"])

    block = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(blocks))
    return df.select("doc_id", "fold", block.alias("block"), "text").mapInArrow(pack, "doc_id long, fold int, block long, text binary")


def _texts(column):
    """A block's texts as one array."""
    import pyarrow as pa

    return pa.array([zlib.decompress(x).decode() for x in column.to_pylist()], pa.large_string())


def key_counts(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """Per block and bucket (a key's first `bits` bits) the distinct keys of its documents and their counts by group, 2 *
    fold + target: of kind 0 words, as words and as contexts, and of kind 1 pairs. A key that all documents share
    is one entry a block."""

    def count(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        left = left.combine_chunks()
        rows = []
        if left.num_rows:
            forget()
            target = pc.fill_null(pc.is_in(left["doc_id"], value_set=right["doc_id"].combine_chunks()), False).to_numpy(zero_copy_only=False)
            target &= pc.is_valid(left["doc_id"]).to_numpy(zero_copy_only=False)
            offsets, words, before, ids, pairs, of = keyed(_texts(left["text"]))
            group = np.repeat(2 * left["fold"].to_numpy() + target, np.diff(offsets)).astype(np.int64)
            n = len(words)
            both = np.concatenate((_grouped(ids, group, n), _grouped(before, group, n)), axis=1)
            for kind, keys, counts in ((0, words, both), (1, pairs, _grouped(of, group, len(pairs)))):
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(keys) else np.zeros(1, np.int64)
                for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    rows.append((left["block"][0].as_py(), kind, int(bucket[b]), _packed_keys(keys[b:e]), _packed(counts[b:e])))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        names = ["block", "kind", "bucket", "keys", "counts"]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return docs.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(count, KEY_ROWS)


def totals(rows: DataFrame) -> DataFrame:
    """key_counts() with each row's counts replaced by those of the corpus, in the order of its keys. Rows without a block give,
    for a bucket of words, how many there are and how often each group has them."""

    def merge(part):
        import pyarrow as pa

        keys = [_unpacked_keys(x) for x in part["keys"].to_pylist()]
        wide = 8 if part["kind"][0].as_py() == 0 else 4
        counts = [_unpacked(x, wide) for x in part["counts"].to_pylist()]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        whole = np.stack([np.bincount(place, np.concatenate([c[:, g] for c in counts]), len(known)) for g in range(wide)], axis=1).astype(np.int64)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        found = [_packed(whole[place[b:e]]) for b, e in zip(cuts[:-1], cuts[1:], strict=True)]
        blocks, kinds, buckets = part["block"].to_pylist(), part["kind"].to_pylist(), part["bucket"].to_pylist()
        stats = [None] * len(keys)
        if wide == 8:
            blocks, kinds, buckets, found = [*blocks, None], [*kinds, 0], [*buckets, buckets[0]], [*found, None]
            words = whole[:, :4]
            stats.append([int((words.sum(axis=1) > 0).sum()), *words.sum(axis=0).tolist()])
        arrays = [pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(found, pa.binary()), pa.array(stats, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, names=["block", "kind", "bucket", "counts", "stats"])

    return rows.groupBy("kind", "bucket").applyInArrow(merge, "block long, kind int, bucket int, counts binary, stats array<bigint>")


def exact_losses(ids, before, of, words, pairs, inside: int, outside: int, vocabulary: int, sizes, mix: float = 0.4, extra: float = 0.5):
    """Negative log probabilities, in nats, of each word by the target's and the background's model:
    interpolated bigram models, smoothed alike.

    words: by word, its counts by group as a word and as a context; pairs: by pair. The background's counts are scaled to
    the target's number of words; the vocabulary is that of the corpus.
    """
    out = []
    for group in (inside, outside):
        scale = sizes[inside] / sizes[outside] if group == outside and sizes[inside] and sizes[outside] else 1.0
        word = (words[:, group].astype(np.float64) * scale + extra) / (sizes[group] * scale + extra * vocabulary)
        context = words[before, 4 + group].astype(np.float64)
        share = np.divide(pairs[of, group], context, out=np.zeros(len(ids)), where=context > 0)
        m = np.where(context > 0, mix, 0)
        out.append(-np.log(m * share + (1 - m) * word[ids]))
    return out


def exact_scores(docs: DataFrame, found: DataFrame, vocabulary: int, sizes: list[int]) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score, their difference a word (the lower, the more like the
    target), by the corpus's counts of each block's keys."""

    def one(left, right):
        import pyarrow as pa

        left = left.combine_chunks()
        keys = left["doc_id"].combine_chunks() if left.num_rows else pa.array([], pa.int64())
        offsets, words, before, ids, pairs, of = keyed(_texts(left["text"]))
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds, raws = (right[c].to_pylist() for c in ("kind", "counts"))
        tables = []
        for kind, wide, want in ((0, 8, len(words)), (1, 4, len(pairs))):
            parts = [_unpacked(x, wide) for k, x in zip(kinds, raws, strict=True) if k == kind]
            tables.append(np.concatenate(parts) if parts else np.zeros((0, wide)))
            if left.num_rows and len(tables[-1]) != want:
                raise ValueError("a block's keys and their counts do not agree")
        n = np.diff(offsets)
        fold = np.repeat(left["fold"].to_numpy(), n)
        losses = np.zeros((2, len(ids)))
        for f in (0, 1):
            part = fold == f
            outside = 2 * (1 - f)
            if part.any():
                losses[:, part] = exact_losses(ids[part], before[part], of[part], *tables, outside + 1, outside, vocabulary, sizes)
        out = []
        for row in losses:
            upto = np.concatenate(([0.0], np.cumsum(row)))
            out.append(np.divide(upto[offsets[1:]] - upto[offsets[:-1]], n, out=np.zeros(len(n)), where=n > 0))
        columns = [pa.array(np.round(x, 6), pa.float64(), mask=n == 0) for x in (*out, out[0] - out[1])]
        return pa.Table.from_arrays([keys, pa.array(n, pa.int64()), *columns], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(one, "doc_id long, n_words long, target_loss double, background_loss double, score double")


def cross_entropy_difference(df: DataFrame, labels: DataFrame, target: str = "quality = 1 AND toxic = 0") -> DataFrame:
    """Losses and score of every row of df by models of the labelled documents that `target` picks and of all others.

    All words and pairs are counted under 64-bit hashes, in tables that grow with the corpus: each block of documents
    sends its distinct keys and their counts to the keys' buckets and gets the corpus's counts back.

    labels (doc_id, ...) may hold a document several times; one row that fits makes it a target. Documents without
    labels are background. Texts are dealt to two folds and scored by the other fold's models. Where a fold has no
    target rows, its target model is uniform. Repeated rows count and are scored each.
    """
    wanted = labels.where(target).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    docs = folded(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    docs = _blocked(docs, blocks)
    # labels grow with the documents, so they are never broadcast
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    found = written(totals(key_counts(docs, wanted, (size // BUCKET_BYTES).bit_length())))
    stats = found.where("block IS NULL").select(*[F.sum(F.get("stats", F.lit(k))) for k in range(5)]).first()
    vocabulary, *sizes = (int(x or 0) for x in stats)
    return exact_scores(docs, found.where("block IS NOT NULL").select("block", "kind", "bucket", "counts"), vocabulary, sizes)
