"""Embedding near-dedup by E8 lattice hashing.

A unit vector is projected at random to eight dimensions, scaled and decoded to the nearest point of
the E8 lattice; that point is its cell. Several tables use several projections, and each vector also
probes the neighbouring cells nearest to it. Vectors that meet in a cell are compared by cosine in
double precision; only confirmed pairs count.

Groups of copies are never expanded. Equal vectors are one. In each cell of the first table, the
vectors within half the link angle of the cell's smallest id form a ball with it: by the triangle
inequality on the sphere all its members link with one another, so they count each other by the
ball's size. Balls and single vectors meet as classes, by the angle that their centres can have at
most; only where a ball meets another class are members compared, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.components import connected_components
from tesselle.llm.storage import discard, materialize

MIN_COSINE = 0.93
TABLES, PROBES, SCALE = 8, 4, 5.0
#: Classes of a cell, and members of a class, that are compared in one task at most.
CELL_BLOCK, MEMBER_BLOCK = 512, 1024


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        bits = np.array([m >> k & 1 for k in range(8)])
        if bits.sum() % 2 == 0:
            out.append(0.5 - bits)
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    worst = np.abs(x[odd] - r[odd]).argmax(axis=1)
    r[odd, worst] += np.where(x[odd, worst] >= r[odd, worst], 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice points: the better of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=64)
def projection(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal rows (repeated draws where dim < 8) and an offset of the lattice."""
    g = np.random.Generator(np.random.PCG64([41, table, dim]))
    m = g.standard_normal((dim, 8))
    q = np.linalg.qr(m)[0] if dim >= 8 else m / np.sqrt(dim)
    return q * np.sqrt(dim / 64.0), g.random(8)


def cells(unit: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
    """Cell hashes of unit vectors: own cell first, then the ``probes`` next nearest neighbours of it."""
    dim = unit.shape[1]
    q, offset = projection(table, dim)
    x = unit @ q * SCALE + offset
    home = decode_e8(x)
    near = minimal_vectors()
    order = np.argsort(-((x - home) @ near.T), axis=1, kind="stable")[:, :probes]
    points = np.concatenate([home[:, None], home[:, None] + near[order]], axis=1)
    factors = np.random.Generator(np.random.PCG64([43, table, dim])).integers(1, 2**62, 8, dtype=np.int64) * 2 + 1
    h = (points * 2).astype(np.int64) * factors
    return h.sum(axis=2)


def _units(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """Rows that are usable vectors, and their unit vectors one below the other as a list of arrays."""
    units, usable = [], []
    for k, v in enumerate(column.to_pylist()):
        if not v:
            continue
        x = np.array([math.nan if c is None else c for c in v], np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            continue
        x = x / top
        units.append(x / np.sqrt(x @ x))
        usable.append(k)
    return units, usable


def _half_angle(cosine: float) -> float:
    return math.cos(math.acos(cosine) / 2) + 1e-12


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that no cell (the first six columns) is split; holds one batch and one cell."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        start = _starts(t)
        if len(start) > 1:
            yield t.slice(0, int(start[-1]))
        rest = t.slice(int(start[-1])) if len(start) else None
    if rest is not None and rest.num_rows:
        yield rest


def _starts(t: pa.Table) -> np.ndarray:
    """First rows of the cells of a sorted table."""
    if not t.num_rows:
        return np.zeros(0, np.int64)
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for c in ("label", "tab", "cell", "i", "j", "dim"):
        v = t.column(c).combine_chunks()
        v = (v.dictionary_encode().indices if c == "label" else v).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _cell_pairs(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
    """Pairs of classes of one cell whose centres are near enough and of which one is at home there."""
    start = _starts(t)
    size = np.diff(np.append(start, t.num_rows))
    cls, home, wide, dim = (t.column(c).to_numpy() for c in ("cls", "home", "wide", "dim"))
    wide = wide.astype(np.int64)
    raw = t.column("unit").to_pylist()
    xs, ys = [], []
    for m in np.unique(size):
        if m < 2:
            continue
        low, high = np.triu_indices(int(m), 1)
        own = start[size == m]
        step = max(1, 200_000 // len(low))
        for k in range(0, len(own), step):
            x, y = (own[k : k + step, None] + low).ravel(), (own[k : k + step, None] + high).ravel()
            some = home[x] | home[y]
            xs.append(x[some])
            ys.append(y[some])
    if not xs:
        return pa.RecordBatch.from_pydict({"a": [], "b": [], "single": []}, schema=PAIRS)
    x, y = np.concatenate(xs), np.concatenate(ys)
    kept = np.zeros(len(x), bool)
    for d in np.unique(dim):
        rows = np.flatnonzero(dim == d)
        unit = np.frombuffer(b"".join(raw[r] for r in rows), np.float64).reshape(len(rows), -1)
        place = np.zeros(t.num_rows, np.int64)
        place[rows] = np.arange(len(rows))
        own = np.flatnonzero(dim[x] == d)
        for k in range(0, len(own), 50_000):
            part = own[k : k + 50_000]
            cos = np.einsum("ij,ij->i", unit[place[x[part]]], unit[place[y[part]]])
            kept[part] = cos >= bounds[wide[x[part]] + wide[y[part]]]
    x, y = x[kept], y[kept]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y])), pa.array((wide[x] + wide[y]) == 0)], schema=PAIRS)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("single", pa.bool_())])


def link_components(vectors: DataFrame, cosine: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is
    at least ``cosine``. Null or zero vectors, and those with null, NaN or infinite components, link
    with nothing. Rows with a null id are neighbours of none and have a null component. Rows of one
    id are one vector: of different ones the first by label and hash counts, the same in every run.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for b in batches:
            units, usable = _units(b.column(1))
            raw = [u.tobytes() for u in units]
            h = [xxh3_128_intdigest(x) for x in raw]
            keep = b.take(pa.array(usable, pa.int64()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(2), pa.array([(x & (2**64 - 1)) - 2**63 for x in h], pa.int64()), pa.array([(x >> 64) - 2**63 for x in h], pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "h1", "h2", "unit"])

    usable = v.filter("vec_id is not null and label is not null and embedding is not null")
    ready = materialize(usable.mapInArrow(prepare, "vec_id long, label string, h1 long, h2 long, unit binary"), "units")
    of_id = materialize(ready.groupBy("vec_id").agg(F.min(F.struct("label", "h1", "h2")).alias("x")).select("vec_id", "x.*"), "ids")
    one = of_id.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("uid"), F.count("*").alias("mult"))
    one = materialize(one, "distinct")
    units = ready.join(one, ["label", "h1", "h2"]).filter("vec_id = uid").dropDuplicates(["uid"]).select("uid", "label", "mult", "unit")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            for size in sorted({len(x) for x in raw}):
                own = [k for k, x in enumerate(raw) if len(x) == size]
                unit = np.frombuffer(b"".join(raw[k] for k in own), np.float64).reshape(len(own), -1)
                part = b.take(pa.array(own, pa.int64()))
                for t in range(tables):
                    c = cells(unit, t, probes)
                    at = np.tile(np.arange(c.shape[1]), len(own))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(own)), c.shape[1]))), part.column(1).take(pa.array(np.repeat(np.arange(len(own)), c.shape[1]))), pa.array(np.full(c.size, t, np.int32)), pa.array(c.ravel()), pa.array(at == 0)], names=["uid", "label", "tab", "cell", "home"])

    units = materialize(units, "vectors")
    posted = materialize(units.select("uid", "label", "unit").mapInArrow(hashed, "uid long, label string, tab int, cell long, home boolean"), "cells")

    # Balls: members of a home cell of the first table that lie within half the link angle of its smallest id.
    home = posted.filter("tab = 0 and home").select("uid", "label", "cell")
    first = home.groupBy("label", "cell").agg(F.min("uid").alias("lead"), F.count("*").alias("m")).filter("m > 1").select("label", "cell", "lead")
    towards = home.join(first, ["label", "cell"]).filter("uid <> lead").select("uid", "lead")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _half_angle(cosine)
        for b in batches:
            ok = [len(x) == len(y) and float(np.frombuffer(x) @ np.frombuffer(y)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    lead_units = units.select(F.col("uid").alias("lead"), F.col("unit").alias("lead_unit"))
    in_ball = towards.join(lead_units, "lead").join(units.select("uid", "unit"), "uid").select("uid", "lead", "unit", "lead_unit").mapInArrow(within, "uid long, lead long")
    in_ball = materialize(in_ball, "balls")
    of = units.select("uid", "label", "mult").join(in_ball, "uid", "left").withColumn("cls", F.coalesce("lead", "uid")).select("uid", "label", "mult", "cls")
    of = materialize(of, "classes")
    ball = of.groupBy("cls").agg(F.count("*").alias("members"), F.sum("mult").alias("weight"))

    # Classes that meet in a cell.
    met = posted.join(of.select("uid", "cls"), "uid").groupBy("label", "tab", "cell", "cls").agg(F.max("home").alias("home"))
    busy = met.groupBy("label", "tab", "cell").agg(F.count("*").alias("m")).filter("m > 1")
    met = met.join(busy, ["label", "tab", "cell"])
    blocks = F.ceil(F.col("m") / CELL_BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = met.select("label", "tab", "cell", "cls", "home", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("label", "tab", "cell", "cls", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    centres = ball.join(units.select(F.col("uid").alias("cls"), "unit"), "cls").select("cls", (F.col("members") > 1).alias("wide"), "unit")
    angle = math.acos(cosine)
    bounds = [cosine] + [math.cos(min(math.pi, angle * (1 + k / 2))) - 1e-12 for k in (1, 2)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells_ in _whole_cells(batches):
            yield _cell_pairs(cells_, np.array(bounds))

    order = ["label", "tab", "cell", "i", "j"]
    near = met.join(centres, "cls").select(*order, F.octet_length("unit").alias("dim"), "cls", "home", "wide", "unit")
    pairs = near.repartition(*order).sortWithinPartitions(*order, "dim").mapInArrow(meet, "a long, b long, single boolean").distinct()
    pairs = materialize(pairs, "pairs")

    # Pairs of single vectors are links already; others are settled member by member.
    mult = of.filter("uid = cls").select("uid", "mult")
    alone = pairs.filter("single")
    counts = alone.select(F.col("a").alias("uid"), F.col("b").alias("o")).union(alone.select(F.col("b").alias("uid"), F.col("a").alias("o"))).join(mult.select(F.col("uid").alias("o"), "mult"), "o").select("uid", F.col("mult").alias("links"))
    member = of.select("uid", "mult", "cls").join(ball.select("cls", "members"), "cls").join(units.select("uid", "unit"), "uid")
    parts = F.ceil(F.col("members") / MEMBER_BLOCK).cast("int")
    member = member.withColumn("blk", F.pmod(F.xxhash64("uid"), parts).cast("int"))
    blocks_of = ball.select("cls", F.sequence(F.lit(0), F.ceil(F.col("members") / MEMBER_BLOCK).cast("int") - 1).alias("bs"))
    wide = pairs.filter("not single").join(blocks_of.select(F.col("cls").alias("a"), F.col("bs").alias("ba")), "a").join(blocks_of.select(F.col("cls").alias("b"), F.col("bs").alias("bb")), "b")
    wide = wide.select("a", "b", F.explode("ba").alias("i"), "bb").select("a", "b", "i", F.explode("bb").alias("j"))
    sides = wide.select("a", "b", "i", "j", F.col("a").alias("cls"), F.col("i").alias("blk"), F.lit(0).alias("side")).union(wide.select("a", "b", "i", "j", F.col("b").alias("cls"), F.col("j").alias("blk"), F.lit(1).alias("side")))

    def settle(data: pa.Table) -> pa.Table:
        uid, w, side = (np.array(data.column(c).to_pylist()) for c in ("uid", "mult", "side"))
        raw = data.column("unit").to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        unit = [np.frombuffer(b"".join(raw[k] for k in s), np.float64).reshape(len(s), -1) for s in (left, right)]
        ok = unit[0] @ unit[1].T >= cosine
        n = np.concatenate([ok @ w[right], ok.T @ w[left]])
        ids = np.concatenate([uid[left], uid[right]])
        some = n > 0
        edge = (int(data.column("a")[0].as_py()), int(data.column("b")[0].as_py())) if ok.any() else None
        return pa.table({"uid": pa.array(ids[some], pa.int64()), "links": pa.array(n[some], pa.int64()), "a": pa.array([edge and edge[0]] * int(some.sum()), pa.int64()), "b": pa.array([edge and edge[1]] * int(some.sum()), pa.int64())})

    settled = materialize(sides.join(member, ["cls", "blk"]).select("a", "b", "i", "j", "side", "uid", "mult", "unit").groupBy("a", "b", "i", "j").applyInArrow(settle, "uid long, links long, a long, b long"), "settled")
    more = counts.union(settled.select("uid", "links")).groupBy("uid").agg(F.sum("links").alias("links"))
    edges = alone.select("a", "b").union(settled.select("a", "b").distinct()).union(of.filter("uid <> cls").select(F.col("uid").alias("a"), F.col("cls").alias("b")))
    comp = connected_components(edges)
    per = of.join(ball.select("cls", "weight"), "cls").join(more, "uid", "left").join(comp.select(F.col("node").alias("uid"), "component"), "uid", "left")
    per = per.select("uid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    known = of_id.join(one, ["label", "h1", "h2"]).select("vec_id", "uid").join(per, "uid").select("vec_id", "n_links", "component")
    out = v.select("vec_id").join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "components")
    discard(ready, of_id, one, units, posted, in_ball, of, pairs, settled, comp)
    return out
