"""Links between vectors of high cosine: an exact range join in the metric space of angles.

Pivots divide the vectors of a label. A vector within half the range of a dense pivot is in its core: by the triangle
inequality all vectors of one core are linked, so they are counted and never compared. Every other vector belongs to the
cell of the nearest wide pivot. A vector visits each core and cell that the triangle inequality doesn't exclude from
holding a neighbour of it: it is too far from the pivot, or so much nearer to its own. Cores and cells are then joined
with their visitors independently, in blocks of bounded size; what leaves a block is the number of links of each vector
and a root for each connected part, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.components import components
from maskwright.session import written

SAMPLE = 4000
DENSE, WIDE = 64, 6
BLOCK = 2048
SLACK = 1e-6  # far above the rounding of an angle, far below any range
BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class Pivots:
    dense: np.ndarray
    wide: np.ndarray


def unit(values) -> np.ndarray | None:
    """The vector with length 1 in double precision; None if it has no direction or a part that is no finite number."""
    if values is None or not len(values):
        return None
    v = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
    if not np.isfinite(v).all():
        return None
    v = v / max(np.abs(v).max(), np.finfo(np.float64).tiny)
    size = math.sqrt(float(v @ v))
    return v / size if size > 0 and math.isfinite(size) else None


def choose_pivots(sample: np.ndarray, reach: float, dense: int = DENSE, wide: int = WIDE) -> Pivots:
    """Dense pivots: each has the most vectors of the sample, not yet in a core, within half the range. Wide ones: each
    the farthest from those before it."""
    angles = np.arccos(np.clip(sample @ sample.T, -1, 1))
    near, left, chosen = angles <= reach / 2 - SLACK, np.ones(len(sample), bool), []
    while len(chosen) < dense and left.any():
        many = (near & left).sum(axis=1)
        best = int(many.argmax())
        if many[best] < 2:
            break
        chosen.append(best)
        left &= ~near[best]
    far = [0] if len(sample) else []
    while far and len(far) < min(wide, len(sample)):
        far.append(int(angles[far].min(axis=0).argmax()))
    return Pivots(sample[chosen], sample[far])


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles to pivots, cut or filled with zeros to the vectors' length. A pivot without direction is a right angle off."""
    if not len(pivots):
        return np.zeros((len(vectors), 0))
    fitted = np.zeros((len(pivots), vectors.shape[1]))
    n = min(vectors.shape[1], pivots.shape[1])
    fitted[:, :n] = pivots[:, :n]
    sizes = np.linalg.norm(fitted, axis=1, keepdims=True)
    return np.arccos(np.clip(vectors @ (fitted / np.where(sizes > 0, sizes, 1)).T, -1, 1))


def _placed(vectors: DataFrame, pivots: Pivots, reach: float) -> DataFrame:
    """Each vector with its home (the number of a core; those of cells come after them), its length and what it may visit.

    Vectors without direction are left out.
    """
    shift = len(pivots.dense)
    schema = T.StructType(
        [*vectors.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("home", T.IntegerType()),
         T.StructField("visits", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit(x.values) if x.is_valid else None for x in batch.column(2)]
            rows = [i for i, v in enumerate(found) if v is not None]
            sizes, homes, visits = [], [], []
            for i in rows:
                v = found[i][None, :]
                to_dense, to_wide = _angles(v, pivots.dense)[0], _angles(v, pivots.wide)[0]
                core = int(to_dense.argmin()) if shift else -1
                inside = shift and to_dense[core] <= reach / 2 - SLACK
                cell = int(to_wide.argmin())
                cores = np.flatnonzero(to_dense <= 1.5 * reach + SLACK)
                cells = np.flatnonzero(to_wide - to_wide[cell] <= 2 * reach + SLACK) + shift
                sizes.append(v.shape[1])
                homes.append(core if inside else cell + shift)
                visits.append(np.concatenate([cores[cores != core] if inside else cores, cells]).astype(np.int32))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sizes, pa.int32()), pa.array(homes, pa.int32()), pa.array(visits, pa.list_(pa.int32()))],
                names=schema.names,
            )

    return vectors.mapInArrow(run, schema)


def _block_links(least: float):
    """Links between the members and the visitors of one block: per vector a count and the root of its part."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        vectors = np.stack([unit(x.values) for x in table.column("vector")])
        own, guest = ids[member], ids[~member]
        if not len(own) or not len(guest):
            return _links_table([], [], [])
        linked = (vectors[~member] @ vectors[member].T) >= least
        linked &= guest[:, None] != own[None, :]
        if not linked.any():
            return _links_table([], [], [])
        many = linked.sum(axis=1)
        rows, columns = np.flatnonzero(many), np.flatnonzero(linked.any(axis=0))
        linked, guest, own, many = linked[np.ix_(rows, columns)], guest[rows], own[columns], many[rows]
        top = np.iinfo(np.int64).max
        guest_root, own_root = guest.copy(), own.copy()
        while True:  # the smallest id spreads over links until nothing changes
            before = guest_root, own_root
            guest_root = np.minimum(guest_root, np.where(linked, own_root[None, :], top).min(axis=1))
            own_root = np.minimum(own_root, np.where(linked, guest_root[:, None], top).min(axis=0))
            if (before[0] == guest_root).all() and (before[1] == own_root).all():
                break
        zeros = np.zeros(len(own), np.int64)
        return _links_table(
            np.concatenate([guest, own]), np.concatenate([many, zeros]), np.concatenate([guest_root, own_root])
        )

    return run


def _links_table(ids, many, roots) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(many, pa.int64()), "root": pa.array(roots, pa.int64())})


def link_vectors(
    df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE,
    dense: int = DENSE, wide: int = WIDE, block: int = BLOCK,
) -> DataFrame:
    """`vec_id`, `n_links`, `component_id` and `kept` for every row: vectors of equal label with cosine >= `least`.

    The pivots come from at most `sample` vectors, the ones with the lowest hash of the key; they decide what is compared
    with what, not the result. NULL labels, vectors that are NULL, empty, zero or hold NULL or non-finite parts, and
    vectors of different length are linked with nothing. The key should name one vector; rows that repeat it count as one
    and get the same result. Rows with a NULL key are linked with nothing and kept, with a NULL component.
    """
    if not 0 < least < 1:
        raise ValueError("the least cosine must be between 0 and 1")
    reach = math.acos(least)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    known = rows.filter("id is not null and label is not null and vector is not null").dropDuplicates(["id"])
    drawn = [
        v
        for r in known.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column(0)
        if (v := unit(r.values)) is not None
    ]
    size = max((len(v) for v in drawn), default=1)
    points = np.stack([v for v in drawn if len(v) == size]) if drawn else np.eye(1)
    pivots = choose_pivots(points, reach, dense, wide)
    placed = written(_placed(known, pivots, reach), "placed-vectors")

    cell = ["label", "size", "cell"]
    members = placed.select("id", "label", "size", F.col("home").alias("cell"), "vector")
    guests = placed.select("id", "label", "size", F.explode("visits").alias("cell"), "vector")
    sizes = (
        members.groupBy(*cell).agg(F.count("*").alias("m"), F.lit(0).cast("long").alias("g"), F.min("id").alias("first"))
        .unionByName(
            guests.groupBy(*cell).agg(F.lit(0).cast("long").alias("m"), F.count("*").alias("g"), F.lit(None).cast("long").alias("first"))
        )
        .groupBy(*cell).agg(F.sum("m").alias("m"), F.sum("g").alias("g"), F.min("first").alias("first"))
        .filter("m > 0")
    )
    sizes = written(sizes, "cells")
    shares = sizes.select(
        *cell,
        F.ceil(F.col("m") / block).cast("int").alias("member_shares"),
        F.ceil(F.col("g") / block).cast("int").alias("guest_shares"),
    ).filter("guest_shares > 0")
    if shares.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        shares = F.broadcast(shares)

    def dealt(side: DataFrame, member: bool) -> DataFrame:
        own, other = ("member", "guest") if member else ("guest", "member")
        return side.join(shares, cell).select(
            *cell,
            F.pmod(F.xxhash64("id"), F.col(f"{own}_shares")).cast("int").alias(f"{own}_share"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_shares") - 1)).alias(f"{other}_share"),
            F.lit(member).alias("member"),
            "id",
            "vector",
        )

    blocks = dealt(members, True).unionByName(dealt(guests, False)).groupBy(*cell, "member_share", "guest_share")
    found = written(blocks.applyInArrow(_block_links(least), "id long, n long, root long"), "vector-links")
    cores = placed.filter(F.col("home") < F.lit(len(pivots.dense))).withColumnRenamed("home", "cell")
    inside = cores.join(sizes.filter("m > 1"), cell).select("id", (F.col("m") - 1).alias("n"), F.col("first").alias("root"))
    every = found.unionByName(inside)
    counts = every.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(every.select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = rows.select("id").join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
