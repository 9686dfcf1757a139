"""Mixing sources to target weights that change over training (operator 8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.tables import written
from graphloom.llm.text import words

#: Finest parts of a source; it has fewer while its rows are few.
FINE = 16_384
#: A schedule: (time, weight) knots from time 0 to 1, linear between them.
Schedule = list[tuple[float, float]]


def targets(sizes: list[int], weights: list[float], limit: float = 3.0) -> list[float]:
    """Shares of the sum of sizes by weight; none exceeds limit * its size, and the excess is shared again by weight."""
    total, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while free and left > 0:
        whole = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / whole > limit * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = limit * sizes[i]
            left -= out[i]
        free -= over
    return out


def integrate(schedule: Schedule, target: float) -> list[tuple[float, float, float, float]]:
    """(cumulative demand, time, demand rate, slope of the rate) at the start of each linear piece; all sums to target."""
    area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False))
    scale, done, out = (target / area if area else 0.0), 0.0, []
    for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False):
        if b > a:
            out.append((done, a, u * scale, (v - u) * scale / (b - a)))
            done += (b - a) * (u + v) / 2 * scale
    return out


def default_schedule(rank: int) -> Schedule:
    """Every other source fades out over training while the ones between them come in; each averages 1."""
    return [(0.0, 1.5), (1.0, 0.5)] if rank % 2 == 0 else [(0.0, 0.5), (1.0, 1.5)]


def place(df: DataFrame, weight: Callable[[int, str | None], float], schedule: Callable[[int], Schedule] = default_schedule, limit: float = 3.0, whole: bool = False, part_rows: int = 2000, seed: int = 17) -> DataFrame:
    """Adds source_size, target, taken and copies (array of copy, words, position) to rows with doc_id, source and size.

    Sources are ordered by code point, null last; weight(rank, source) is each one's weight. A source's documents stand
    in a fixed random order (a hash of doc_id) and are read again from its start until the target is reached, at most
    ceil(limit) times. A copy's position in [0, 1] is the time at which the integral of the source's schedule, scaled to
    its target, reaches the middle of the copy. With `whole` a document that the target cuts is taken whole if its
    first word is; otherwise `taken` counts only the words up to the target, so that each source meets it to the word.

    The sources, a mix's configuration, reach the driver with their sizes; documents do not. Running sums go over parts
    of some `part_rows` rows of each source, then over part totals, so a source with most of the rows is split. Equal
    doc_ids stand by size; rows alike in both are interchangeable. A null size counts 0; documents of size 0 take 0 words.
    Columns of df stay, whatever their names, but for size and the four that are added; an empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0)).alias("row")
    rows = df.select(row, F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    rows = rows.withColumn("fine", F.pmod("h", F.lit(FINE)).cast("int"))
    sums = written(rows.groupBy("s", "n", "fine").agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("count")))
    sources = sorted(((r["n"], r["s"], int(r["z"]), r["c"]) for r in sums.groupBy("s", "n").agg(F.sum("sum").alias("z"), F.sum("count").alias("c")).collect()), key=lambda r: r[:2])
    goal = targets([z for _, _, z, _ in sources], [weight(i, None if null else s) for i, (null, s, _, _) in enumerate(sources)], limit)
    plan = [(s, null, z, g, round(g), integrate(schedule(i), g), max(1, FINE * part_rows // max(c, 1))) for i, ((null, s, z, c), g) in enumerate(zip(sources, goal, strict=True))]
    spark = df.sparkSession
    few = len(plan) <= 100_000
    plan = spark.createDataFrame(plan, "s string, n boolean, source_size long, target double, goal long, pieces array<struct<c: double, t: double, d: double, m: double>>, step long")
    steps = F.broadcast(plan.select("s", "n", "step")) if few else plan.select("s", "n", "step")
    parted = lambda df: df.join(steps, ["s", "n"]).withColumn("part", F.floor(F.col("fine") / F.col("step")).cast("int")).drop("step", "fine")
    rows = parted(rows)
    sums = parted(sums).groupBy("s", "n", "part").agg(F.sum("sum").alias("sum"))
    before = Window.partitionBy("s", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum").join(plan.drop("step"), ["s", "n"])
    inside = Window.partitionBy("s", "n", "part").orderBy("h", "i", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("c", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["s", "n", "part"]).withColumn("c", F.col("c") + F.col("base"))

    def copy(k):
        start = k * F.col("source_size") + F.col("c")
        room = F.greatest(F.col("goal") - start, F.lit(0))
        took = F.when(room > 0, F.col("size")).otherwise(F.lit(0)) if whole else F.least(room, F.col("size"))
        return F.struct(k.cast("int").alias("copy"), took.cast("long").alias("words"), at(F.least(start + took / 2, F.col("target"))).alias("position"))

    def at(y):
        piece = F.element_at(F.filter("pieces", lambda p: p["c"] <= y), -1)
        return F.element_at(F.transform(F.array(piece), lambda p: p["t"] + F.coalesce(F.try_divide(2 * (y - p["c"]), p["d"] + F.sqrt(F.greatest(p["d"] * p["d"] + 2 * p["m"] * (y - p["c"]), F.lit(0.0)))), F.lit(0.0))), 1)

    laps = int(-(-limit // 1))
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(laps - 1)), copy), lambda c: c["words"] > 0)
    rows = rows.withColumn("copies", copies).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "source_size", "target", "taken", "copies")


def in_order(placed: DataFrame) -> DataFrame:
    """One row per copy, with copy, words and position in place of copies and of columns of those names, range-sorted by
    position, then doc_id and copy. Rows without copies go; an empty table gives no rows."""
    kept = [c for c in placed.columns if c not in ("copies", "copy", "words", "position")]
    rows = placed.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.explode("copies").alias("x")).select("row.*", "x.*")
    return rows.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source and size (words) of each document, written once without the texts."""
    return written(df.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size")))
