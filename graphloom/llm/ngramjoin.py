"""Jaccard self-join of documents on word n-grams with rare-first prefixes (operator 9)."""

from __future__ import annotations

from math import log

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import sums
from graphloom.llm.components import components, salted
from graphloom.llm.tables import drop, settle, written
from graphloom.llm.text import batch_arrays, coded
from graphloom.llm.tokens import forget

#: Bits of the slots of hashed document frequencies: a slot for 1.5 KB of text, within these bounds; a byte each on executors.
SLOT_BITS, SLOT_BYTES = (20, 24), 1536
#: Bits of the filter that spares texts without candidates: 2 MB on each executor.
FILTER_BITS = 1 << 24
#: Text that a task turns into n-grams at a time.
PART_BYTES = 1 << 20
#: Rows that one part of a frequent n-gram, a leader or a component has, of all that the corpus may give it.
PART_ROWS = 20_000
#: Pairs of one document from which on they are split.
MANY_PAIRS = 100


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """The set of each text as ascending 64-bit hashes: its distinct runs of `width` words, A-Z folded. Fewer words
    are one run; no words, an empty set."""
    offsets, codes, uniques = coded(texts, lower=True)
    base = np.array([xxhash.xxh3_64_intdigest(w) for w in uniques] or [0], dtype=np.uint64)
    h = base[codes] if len(codes) else np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        runs = h[: max(0, len(h) - width + 1)].copy()
        for k in range(1, width):
            runs = _mixed(runs * step + h[k : k + len(runs)])
        out = []
        for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if e - b >= width:
                s = np.sort(runs[b : e - width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif e > b:
                s = h[b : b + 1] + np.uint64(e - b)
                for k in range(b + 1, e):
                    s = _mixed(s * step + h[k : k + 1])
                out.append(s)
            else:
                out.append(runs[:0])
    return out


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _code(counts):
    """Counts in a byte each: eight steps for each doubling. Ranking by them is ranking by counts, in coarser classes."""
    return np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)


def _print(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def _described(df: DataFrame, width: int, bits: int) -> DataFrame:
    """Per document doc_id, n and print (of its set); and per task the hashed document frequencies, in chunks."""

    def scan(batches):
        import pyarrow as pa

        forget()
        counts = np.zeros(1 << bits, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
        for keys, texts in batch_arrays(batches, "doc_id", "text", part_bytes=PART_BYTES):
            sets = shingle_sets(texts, width)
            if sets:
                found, often = np.unique(_slot(np.concatenate(sets), bits), return_counts=True)
                counts[found] += often.astype(np.uint32)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        got = list(sums.chunks(counts))
        m = len(got)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 3 + [pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], schema=schema)

    return df.mapInArrow(scan, "doc_id long, n long, print long, chunk int, counts binary")


def _prefixes(df: DataFrame, width: int, num: int, den: int, counts, bits: int, hot: float, parts_of: int) -> DataFrame:
    """The rarest n-grams of each document that any partner must share one of: gram, its rank pos, the set's print and
    n, and rest: how many later n-grams fall in each of eight hash classes, a byte each. part deals out n-grams whose
    slot counts over `hot` documents to `parts_of` parts, and is 0 for others. A task skips sets it has seen."""

    def scan(batches):
        import pyarrow as pa

        forget()
        often, seen, over = counts.value, set(), int(_code(np.array([hot]))[0]) if hot >= 0 else -1
        for (texts,) in batch_arrays(batches, "text", part_bytes=PART_BYTES):
            grams, pos, of, sizes, rest, parts = [], [], [], [], [], []
            for s in shingle_sets(texts, width):
                n = len(s)
                if n * (den - num) < num or (p := _print(s)) in seen:
                    continue  # too few n-grams for a partner other than an equal set
                seen.add(p)
                k = n + (-num * n // den) + 1
                order = s[np.argsort(often[_slot(s, bits)], kind="stable")]
                first = order[:k]
                kinds = (order & np.uint64(7)).astype(np.int64)
                upto = np.cumsum(kinds[:k, None] == np.arange(8), axis=0)
                after = (np.bincount(kinds, minlength=8) - upto).astype(np.uint8)
                grams.append(first.view(np.int64))
                pos.append(np.arange(k))
                of.append(np.full(k, p))
                sizes.append(np.full(k, n))
                rest.append(np.ascontiguousarray(after).view("<i8")[:, 0])
                parts.append(np.where(often[_slot(first, bits)].astype(np.int64) > over, 1 + p % parts_of, 0))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((grams, pa.int64()), (parts, pa.int32()), (pos, pa.int32()), (of, pa.int64()), (sizes, pa.int32()), (rest, pa.int64()))], names=["gram", "part", "pos", "print", "n", "rest"])

    return df.select("text").mapInArrow(scan, "gram long, part int, pos int, print long, n int, rest long")


def _held(rows: DataFrame, parts: int) -> DataFrame:
    """The prefix rows whose n-gram several sets hold, each with lead, the row in which it stands first.

    The rows are exchanged once, by n-gram and part. A frequent n-gram's parts find their own leaders, and the least of
    these, one for each part, is joined back: no task holds more than a part of a frequent n-gram's rows.
    """
    lead = F.min(F.struct("pos", "n", "print", "rest"))
    inside = Window.partitionBy("gram", "part")
    near = rows.withColumn("lead", lead.over(inside)).withColumn("_p", F.min("print").over(inside)).withColumn("_q", F.max("print").over(inside))
    near = written(near.where("part > 0 OR _p <> _q"))
    few = near.where("part = 0").drop("part", "_p", "_q")
    whole = near.where("part > 0").groupBy("gram").agg(F.min("lead").alias("lead"), F.min("_p").alias("_p"), F.max("_q").alias("_q")).where("_p <> _q").drop("_p", "_q")
    many = salted(near.where("part > 0").drop("lead", "part", "_p", "_q"), "gram", whole, "print", parts)
    held = written(few.unionByName(many).dropDuplicates(["gram", "print"]))
    drop(near)
    return held


def _passes(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and suffix filters on two prefix rows with the same n-gram, seen as the pair's first shared one."""
    col = lambda side, name: F.col(f"{side}.{name}")
    na, nb = col(a, "n"), col(b, "n")
    sa, sb = na - col(a, "pos") - 1, nb - col(b, "pos") - 1
    byte = lambda x, k: F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255))
    apart = F.lit(0)
    for k in range(8):
        d = F.abs(byte(col(a, "rest"), k) - byte(col(b, "rest"), k))
        apart = apart + F.least(d, 256 - d)  # counts are kept modulo 256, so this is a lower bound
    need = num * (na + nb)
    length = F.lit(num) * F.greatest(na, nb) <= F.lit(den) * F.least(na, nb)
    positional = (num + den) * (1 + F.least(sa, sb)) >= need
    suffix = (num + den) * (2 + sa + sb - apart) >= 2 * need
    return length & positional & suffix


def _place(doc_id: Column) -> Column:
    """1 to FILTER_BITS: bitmap functions number places from 1, and put 0 in a bucket of its own before the first."""
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)) + 1


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b: prints) whose sets are alike enough. Sets are built again for the pairs' documents alone."""
    spark = docs.sparkSession
    asked = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print"))).distinct()
    place = _place(F.col("doc_id"))
    bits = asked.join(classes, "print").select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.collect():  # FILTER_BITS / 8 bytes at most
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        table[(row["k"] - 1) * 4096 : (row["k"] - 1) * 4096 + len(part)] = part
    asked_bits = spark.sparkContext.broadcast(table)

    def build(batches):
        import pyarrow as pa

        table = asked_bits.value
        for batch in batches:
            h = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((table[h // 8] >> (h % 8).astype(np.uint8)) & 1 == 1))
            if batch.num_rows:
                for (texts,) in batch_arrays([batch], "text", part_bytes=PART_BYTES):
                    sets = shingle_sets(texts, width)
                    yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["print", "grams"])

    sets = docs.select("text", (place - 1).alias("h")).mapInArrow(build, "print long, grams binary").dropDuplicates(["print"])

    def alike(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.sort(np.concatenate((p, q)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * shared >= num * (len(p) + len(q) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    grams = lambda key, name: sets.select(F.col("print").alias(key), F.col("grams").alias(name))
    many = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print"))).groupBy("print").count().where(F.col("count") > MANY_PAIRS)
    many = written(many.select("print", (F.col("count") / MANY_PAIRS).cast("int").alias("parts")))
    n = many.count()
    if not n:
        return pairs.select("a", "b").join(grams("a", "x"), "a").join(grams("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")
    # at most two for each MANY_PAIRS pairs
    small = F.broadcast(many) if n <= 1_000_000 else many
    side = lambda key: small.select(F.col("print").alias(key), F.col("parts").alias(f"_{key}"))
    dealt = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    few = dealt.where("_a IS NULL AND _b IS NULL").select("a", "b").join(grams("a", "x"), "a").join(grams("b", "y"), "b")
    # a document with many pairs goes to a part of them at a time; the other one's set is fetched first
    hub = F.when(F.coalesce("_a", F.lit(0)) >= F.coalesce("_b", F.lit(0)), F.col("a")).otherwise(F.col("b"))
    hubs = dealt.where("_a IS NOT NULL OR _b IS NOT NULL").select("a", "b", hub.alias("hub"), F.greatest("_a", "_b").alias("parts"))
    hubs = hubs.withColumn("other", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))).withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"))
    split = sets.join(small, "print").select(F.col("print").alias("hub"), F.col("grams").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wide = hubs.join(grams("other", "y"), "other").join(split, ["hub", "part"])
    return few.select("a", "b", "x", "y").unionByName(wide.select("a", "b", "x", "y")).mapInArrow(alike, "a long, b long")


def join_classes(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, hot: int = 10_000) -> DataFrame:
    """doc_id, n_shingles, component_id and linked for each row of df (doc_id, text): documents link where
    den * intersection >= num * union of their sets of `width`-word shingles; component_id is the least doc_id
    that links lead to. Null, empty and blank texts have no shingles and link with nothing.

    1. Every set gets a print (64-bit hash), so that equal sets become one; n-grams are ranked rare first by document
       frequencies counted over all documents in hash slots that grow with the text. Any fixed ranking finds the same pairs.
    2. Each set's prefix, its rarest n - ceil(num/den * n) + 1 n-grams, meets others' by n-gram. Pairs of each n-gram's
       leader (the set in which it stands first) and its other holders that pass the filters are verified, and joined
       into components.
    3. What can still change components are pairs from two of them. Holders of an n-gram outside its leader's
       component are paired with all holders in other components that pass the filters; new pairs are verified.
    What many documents share, an n-gram, a leader, a component, is joined in parts of its rows. In step 3 partners are
    looked for among sets of like size only. Any pair alike enough is met at the first prefix n-gram it shares, so no link that could join components is lost,
    while the pairs inside a large group of near copies are never listed. Repeated rows share a set, and each gets its row.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = df.sparkSession
    low, high = SLOT_BITS
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(high, max(low, (size // SLOT_BYTES).bit_length()))
    scanned = written(_described(docs, width, bits))
    rows = scanned.where("chunk IS NULL").select("doc_id", "n", "print")
    counts = sums.gather(scanned.where("chunk IS NOT NULL").select("chunk", "counts"), 1 << bits, _code, np.uint8)
    classes = written(rows.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id")))
    total, sets = rows.agg(F.sum("n"), F.count(F.lit(1))).first()
    parts = max(64, sets // PART_ROWS)
    # a slot holds several n-grams: those far above the mean hold a frequent one
    limit = hot + 4 * ((total or 0) >> bits)
    held = _held(_prefixes(docs, width, num, den, spark.sparkContext.broadcast(counts), bits, limit, parts), parts)

    settle(spark)
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    led = held.alias("x").where(F.col("x.print") != F.col("x.lead.print")).withColumn("y", F.col("x.lead"))
    tried = written(ordered(led.where(_passes("x", "y", num, den)), F.col("x.print"), F.col("y.print")))
    del led
    links = written(_verified(docs, classes, tried, width, num, den))
    settle(spark)

    roots = written(components(links))
    part = held.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lead_roots = roots.select(F.col("node").alias("_lp"), F.col("root").alias("_lr"))
    part = salted(part.withColumn("_lp", F.col("lead.print")), "_lp", lead_roots, "print", parts, "left").withColumn("outside", F.col("root") != F.coalesce("_lr", "_lp"))
    part = written(part.select("gram", "pos", "print", "n", "rest", "root", "outside", F.floor(F.log(F.col("n")) / (log(den / num) * (1 + 1e-9))).cast("int").alias("size") if num < den else F.col("n").alias("size")))
    drop(held)
    # partners' sizes lie in the same class or one beside it
    outer = part.where("outside").withColumn("at", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)))
    met = outer.alias("x").join(part.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.at") == F.col("y.size")) & (F.col("x.root") != F.col("y.root")) & _passes("x", "y", num, den))
    more = written(ordered(met, F.col("x.print"), F.col("y.print")).join(tried, ["a", "b"], "left_anti"))
    drop(part)
    drop(tried)
    del part, outer, met
    settle(spark)
    links = links.unionByName(written(_verified(docs, classes, more, width, num, den)))

    roots = components(links)
    tops = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = tops.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_sets"))
    named = salted(tops.select("print", "root"), "root", least, "print", parts).select("print", "component_id", (F.col("_sets") > 1).alias("linked"))
    out = salted(rows.where("n > 0"), "print", named, "doc_id", parts).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "linked")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(False).alias("linked")))


def one_of_each(df: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """df (doc_id, text, ...) with one document of each component of join_classes(): the one with the least doc_id.

    doc_id names a document: of several rows with one doc_id the one with the least text stays (nulls first), by a hash of
    its columns among equal texts. Rows without a doc_id all stay, as nothing names them. Columns of df stay, whatever
    their names; an empty table gives no rows.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    classes = join_classes(df.where("doc_id IS NOT NULL"), width, num, den).where("doc_id = component_id")
    kept = written(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    # merged whatever the size: a table of ids that is broadcast while small would hide what larger ones exchange
    named = rows.hint("merge").join(kept, "doc_id")
    nameless = df.where("doc_id IS NULL")
    if not kept.where("n > 1").limit(1).count():
        return named.select("row.*").unionByName(nameless)
    told = [F.col("row").getField(c) for c, kind in df.dtypes if kind.split("<")[0] not in ("map", "variant")]
    least = named.where("n > 1").groupBy("doc_id").agg(F.min_by("row", F.struct("row.text", F.xxhash64(*told))).alias("row"))
    return named.where("n = 1").select("row.*").unionByName(least.select("row.*")).unionByName(nameless)
