"""Mixing sources to target weights on a time-varying curriculum, DataFrame functions only.

Every source has a weight schedule: knots (time from 0 to 1, weight) joined by
straight lines.  Its integral is the source's weight in the whole mix.  Targets
share the mix's words by weight; one beyond ``most`` times its source's words
stops there, and the rest is shared again by weight.  A source's documents,
in the order of a hash of their ids, and over again for repeats, are a stream
of words; the stream ends in the document where its target is reached.  The
cumulative demand of a source up to a time is its target times the integral
of its schedule so far, so a document's training position is the time at
which demand reaches its first word: the integral inverted, a root of a
quadratic in one piece.  Documents are range-sorted by position.

Running totals come from sorted ranges and their sums, so neither a hot source
nor the sources together are one task's work.  A source's totals reach its
documents by a join that Spark broadcasts only below its own size limit.

Defined cases: null or empty text has no words, is never taken and has no
position; a null source is a source of its own, the last one; rows with the
same or no id are documents each; an empty table stays empty; other columns
are not read unless carried, and those named as a result's are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .shared import SPACE_CLASS, col, stored

Schedule = Sequence[tuple[float, float]]
#: Even, falling, and rising in the second half; their integrals are 1, 2 and 3.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 3.0), (1.0, 1.0)), ((0.0, 2.0), (0.5, 2.0), (1.0, 6.0)))
SHARE_PCT, MOST, SEED = 100, 3, 2024
RESULT = ("size", "source_size", "target", "taken", "position", "copies")


def integral(schedule: Schedule) -> float:
    """The weight of the whole schedule; its knots must go from 0 to 1 and no weight be negative."""
    times = [t for t, _ in schedule]
    if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule's knots go from time 0 to 1 with weights of 0 or more")
    area = sum((v + w) / 2 * (u - t) for (t, v), (u, w) in zip(schedule, schedule[1:]))
    if area <= 0:
        raise ValueError("a schedule needs weight")
    return area


def when_reached(schedule: Schedule, share: Column) -> Column:
    """The time at which the schedule's integral reaches ``share`` (0 to 1) of the whole."""
    area, done, out = share * F.lit(integral(schedule)), 0.0, F.lit(1.0)
    pieces = []
    for (t, v), (u, w) in zip(schedule, schedule[1:]):
        over, slope = area - F.lit(done), (w - v) / (u - t)
        root = F.lit(v) + F.sqrt(F.lit(v * v) + F.lit(2 * slope) * over)
        pieces.append((done + (v + w) / 2 * (u - t), F.when(over <= 0, F.lit(t)).otherwise(F.lit(t) + F.lit(2.0) * over / root)))
        done = pieces[-1][0]
    for end, time in reversed(pieces):
        out = F.when(area < F.lit(end), time).otherwise(out)
    return out


def by_number(schedules: Sequence[Schedule], number: Column, of) -> Column:
    """``of`` the schedule of the source with this number; schedules repeat."""
    out = of(schedules[-1])
    for i in range(len(schedules) - 1):
        out = F.when(number % len(schedules) == i, of(schedules[i])).otherwise(out)
    return out


def level(sources: DataFrame, budget: int, most: int) -> float | None:
    """Words per unit of weight of the sources below their limit (``words``, ``weight``); None if all are at it.

    A round finds who is above the limit at this level, and shares what they
    leave among the others; no more rounds than sources, and few in practice.
    """
    capped, at = F.lit(False), None
    while True:
        got = sources.agg(F.sum(F.when(capped, F.lit(most) * F.col("words"))).alias("cap"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if not got.weight:
            return None
        before, at = at, (budget - (got.cap or 0)) / got.weight
        if at == before:
            return at
        capped = F.col("weight") * F.lit(at) > F.lit(most) * F.col("words")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, schedules: Sequence[Schedule] = SCHEDULES,
         share_pct: int = SHARE_PCT, most: int = MOST, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """One row a document, range-sorted by ``position``: the id, ``size, source_size, target, taken, position, copies`` and the columns of ``carry``.

    ``taken``: words of it in the mix, repeats counted; ``copies``: (epoch, words,
    position) of each time it is used; ``position``: of the first, null if never.
    """
    words = F.regexp_count(F.coalesce(col(text_col), F.lit("")), F.lit(f"[^{SPACE_CLASS[1:]}+")).cast("long")
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 15), 16, 10).cast("long")
    kept = [c for c in carry if c not in RESULT]
    sized = docs.select(col(id_col).alias("id_"), col(source_col).cast("string").alias("source_"), words.alias("size"), key.alias("key_"), *(col(c).alias(f"carried_{i}") for i, c in enumerate(kept)))
    sized = stored(sized, "sizes")
    in_order = F.col("source_").asc_nulls_last()
    sources = sized.groupBy("source_").agg(F.sum("size").alias("words"))
    sources = prefix_sums(sources, [in_order], {"number": F.lit(1).cast("long"), "ahead": F.col("words")})
    sources = stored(sources.withColumn("weight", by_number(schedules, F.col("number"), lambda s: F.lit(integral(s)))), "sources")
    budget = (sources.agg(F.sum("words")).first()[0] or 0) * share_pct // 100
    at = level(sources, budget, most)
    limit = (F.lit(most) * F.col("words")).cast("double")
    sources = sources.select(F.col("source_").alias("of_"), F.col("words").alias("source_size"), "number", "ahead", (limit if at is None else F.least(F.col("weight") * F.lit(at), limit)).alias("target"))
    placed = prefix_sums(sized, [in_order, F.col("key_"), F.col("id_"), F.col("size")], {"before": F.col("size")})
    placed = placed.join(sources, F.col("source_").eqNullSafe(F.col("of_")))

    def copy(epoch: Column) -> Column:
        first = epoch * F.col("source_size") + F.col("before") - F.col("ahead")
        got = F.greatest(F.least(F.col("size"), F.floor("target") - first), F.lit(0))
        share = F.when(F.col("target") > 0, first / F.col("target")).otherwise(F.lit(0.0))
        return F.struct(epoch.alias("epoch"), got.cast("long").alias("words"), by_number(schedules, F.col("number"), lambda s: when_reached(s, share)).alias("position"))

    copies = F.filter(F.array(*(copy(F.lit(e).cast("long")) for e in range(most))), lambda x: x["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = placed.withColumn("copies", copies).select(F.col("id_").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"),
                                                     "copies", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(kept) if c != id_col))
    return out.orderBy(F.col("position").asc_nulls_last(), col(id_col))


def training_order(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row each time a document is used, range-sorted: the columns of ``planned`` with ``epoch``, ``words`` and that copy's ``position``."""
    rest = [c for c in planned.columns if c not in ("copies", "position", "taken")]
    return planned.select(*(col(c) for c in rest), F.inline("copies")).orderBy("position", col(id_col))
