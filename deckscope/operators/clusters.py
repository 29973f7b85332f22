"""K-means that does not depend on how rows are laid out.

Scores are taken to a millionth and summed as integers, so sums do not
depend on their order; means and deviations come from those exact sums.  The
first centre is the row whose key hashes lowest; each next one is drawn with
probability proportional to the squared distance to the nearest centre, by the
largest of log distance plus Gumbel noise from a hash of the key (one
aggregate).  A round of Lloyd's adds up each batch's integer sums per centre
in its task and then the few sums; rounds end when no centre moves by more
than ``TOLERANCE`` deviations, or after ``ROUNDS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckscope.operators.ranking import materialize

MILLION, ROUNDS, TOLERANCE = 1_000_000, 20, 1e-4


def _total(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)"))


def z_scores(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension less its mean over its sample deviation (0 if that is 0), from integer sums."""
    q = {d: F.round(F.col(d) * MILLION).cast("long") for d in dims}
    got = df.agg(F.count(F.lit(1)).alias("n"), *[a for d in dims for a in (_total(q[d]).alias(f"s_{d}"), _total(q[d].cast("decimal(19,0)") * q[d].cast("decimal(19,0)")).alias(f"q_{d}"))]).first()
    out = []
    for d in dims:
        n, s, ss = got["n"], int(got[f"s_{d}"] or 0), int(got[f"q_{d}"] or 0)
        mean = float(Decimal(s) / Decimal(n)) if n else 0.0
        var = float((Decimal(ss) - Decimal(s) * Decimal(s) / Decimal(n)) / Decimal(n - 1)) if n > 1 else 0.0
        out.append((q[d] - F.lit(mean)) / F.lit(var ** 0.5) if var > 0 else F.lit(0.0))
    return out


def _distance(z: list[Column], centre: tuple) -> Column:
    total = F.lit(0.0)
    for a, c in zip(z, centre):
        total = total + (a - F.lit(c)) * (a - F.lit(c))
    return total


def _nearest(z: list[Column], centres: list[tuple]) -> Column:
    """Number of the nearest centre, the first of equals."""
    return F.array_min(F.array(*[F.struct(_distance(z, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))


def _sums_of(centres: np.ndarray):
    """Counts and integer sums of a task's rows per nearest centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], 1) if batch.num_rows else np.zeros((0, centres.shape[1]), np.int64)
            d = np.zeros((len(x), len(centres)))
            for j in range(centres.shape[1]):                       # the order of ``_distance``
                d += (x[:, j, None] - centres[None, :, j]) ** 2
            near = d.argmin(1)
            n += np.bincount(near, minlength=len(centres))
            np.add.at(total, near, x)
        yield pa.record_batch([pa.array(range(len(centres)), pa.int32()), pa.array(n), *[pa.array(total[:, j].copy()) for j in range(centres.shape[1])]],
                              ["i", "n", *[f"s{j}" for j in range(centres.shape[1])]])
    return run


def k_means(df: DataFrame, dims: list[str], key: str, k: int, seed: int = 42, rounds: int = ROUNDS) -> tuple[DataFrame, list[tuple]]:
    """(``df`` with ``cluster`` and the vector ``features`` of z-scores, the centres).  Rows must have all ``dims``."""
    z = z_scores(df, dims)
    units = [F.round(c * MILLION).cast("long") for c in z]          # z-scores to a millionth, as integers
    rows = materialize(df.select(F.col(key).alias("_key"), *[u.alias(f"_u{i}") for i, u in enumerate(units)]))
    u = [F.col(f"_u{i}") for i in range(len(dims))]
    place = F.struct(*u)
    first = rows.agg(F.min_by(place, F.struct(F.xxhash64("_key", F.lit(seed)), "_key", *u)).alias("c")).first()
    centres = [tuple(float(x) for x in first["c"])] if first["c"] else []
    while centres and len(centres) < k:
        d = _nearest(u, centres)["d"]
        noise = (F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(len(centres))), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        score = F.log(d) - F.log(-F.log(noise))
        got = rows.filter(d > 0).agg(F.max_by(place, F.struct(score, F.col("_key"), *u)).alias("c")).first()
        if got["c"] is None:                                        # fewer different rows than k
            break
        centres.append(tuple(float(x) for x in got["c"]))
    for _ in range(rounds if centres else 0):
        sums = rows.drop("_key").mapInArrow(_sums_of(np.array(centres)), "i int, n long, " + ", ".join(f"s{j} long" for j in range(len(dims))))
        sums = sums.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(len(dims))]).collect()
        moved = list(centres)
        for r in (r for r in sums if r["n"]):                       # at most k rows
            moved[r["i"]] = tuple(float(Decimal(r[f"s{j}"]) / Decimal(r["n"])) for j in range(len(dims)))
        far = max(sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(centres, moved)) ** 0.5
        centres = moved
        if far <= TOLERANCE * MILLION:
            break
    cluster = _nearest(units, centres)["i"] if centres else F.lit(None).cast("int")
    return df.withColumns({"cluster": cluster.cast("int"), "features": array_to_vector(F.array(*z))}), centres
