"""Holes of rasters filled by Laplace's equation: tiles are relaxed on their own and exchange their edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage

#: Cells along a side of a tile, and of a block that counts as one cell for the first guess; sweeps over a
#: tile between two exchanges of edges; rounds at most.
TILE, COARSE, SWEEPS, ROUNDS = 256, 8, 400, 400
_STATE = "tj int, ti int, ny int, nx int, cells binary, fixed binary, residual double"
#: The four neighbours of a tile: step in j and i, and the side of the receiver (fixed values).
_SIDES = {"above": (1, 0), "below": (-1, 0), "left": (0, 1), "right": (0, -1)}


def _edges(cells: np.ndarray) -> dict[str, np.ndarray]:
    """What each neighbour sees of a tile, by the receiver's side."""
    return {"above": cells[-1], "below": cells[0], "left": cells[:, -1], "right": cells[:, 0]}


def _relax(cells: np.ndarray, fixed: np.ndarray, halo: dict[str, np.ndarray], sweeps: int, tolerance: float) -> float:
    """Over-relax the open cells in place, checkered; the greatest residual before the first sweep.

    The residual of a cell is its neighbours' mean less its own value; at the border of the raster
    there are fewer neighbours.
    """
    ny, nx = cells.shape
    wide, there = np.zeros((ny + 2, nx + 2)), np.zeros((ny + 2, nx + 2))
    there[1:-1, 1:-1] = 1
    for side, at in (("above", (0, slice(1, -1))), ("below", (-1, slice(1, -1))), ("left", (slice(1, -1), 0)), ("right", (slice(1, -1), -1))):
        if side in halo:
            wide[at], there[at] = halo[side], 1
    around = lambda x: x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:]
    n = np.maximum(around(there), 1)
    j, i = np.indices(cells.shape)
    colours = [(~fixed) & ((j + i) % 2 == c) for c in (0, 1)]
    wide[1:-1, 1:-1] = cells
    first = float(np.max(np.abs(np.where(fixed, 0.0, around(wide) / n - wide[1:-1, 1:-1])), initial=0.0))
    omega = 2 / (1 + np.sin(np.pi / (max(ny, nx) + 1)))
    for _ in range(sweeps if first > tolerance else 0):
        worst = 0.0
        for colour in colours:
            change = np.where(colour, around(wide) / n - wide[1:-1, 1:-1], 0.0)
            wide[1:-1, 1:-1] += omega * change
            worst = max(worst, float(np.max(np.abs(change))))
        if worst < tolerance / 4:
            break
    cells[:] = wide[1:-1, 1:-1]
    return first


def _tile(row) -> tuple[np.ndarray, np.ndarray]:
    shape = int(row["ny"]), int(row["nx"])
    return np.frombuffer(row["cells"], "<f8").reshape(shape).copy(), np.frombuffer(row["fixed"], bool).reshape(shape)


def fill_holes(cells: DataFrame, nx: int, ny: int, tolerance: float = 0.1, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """(j, i, v) of the whole raster: missing cells get the mean of their neighbours, all at once.

    Holes start at the values of a coarser raster of block means, filled likewise.  A
    round sends the edges of tiles with holes to their neighbours, measures how far every open cell is
    from its neighbours' mean, and relaxes each tile on its own; rounds are staged, tiles without holes
    only lend their edges once.  It ends when no cell is further than ``tolerance`` from that mean, at
    edges that have just been exchanged; more than ``rounds`` rounds, or no known cell, are a ValueError.
    """
    known = cells.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    known = known.where((F.col("j") >= 0) & (F.col("j") < ny) & (F.col("i") >= 0) & (F.col("i") < nx)).groupBy("j", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    known = stage(known, "known")
    mean = known.agg(F.avg("v")).first()[0]
    if mean is None:
        raise ValueError("a raster without a known cell cannot be filled")
    if tile % COARSE:
        raise ValueError(f"a tile has a multiple of {COARSE} cells along a side")
    spark, tiles_j, tiles_i = cells.sparkSession, -(-ny // tile), -(-nx // tile)
    guess = None
    if max(tiles_j, tiles_i) > 1:
        blocks = known.groupBy(F.floor(F.col("j") / COARSE).cast("int").alias("j"), F.floor(F.col("i") / COARSE).cast("int").alias("i")).agg(F.avg("v").alias("v"))
        guess = fill_holes(blocks, -(-nx // COARSE), -(-ny // COARSE), tolerance, tile, rounds)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tj, ti = map(int, key)
        h, w = min(tile, ny - tj * tile), min(tile, nx - ti * tile)
        values, fixed = np.zeros((h, w)), np.zeros((h, w), bool)
        values += mean
        for size, some in pdf[pdf["v"].notna()].groupby("size"):
            part = values if size == 1 else np.full((-(-h // COARSE), -(-w // COARSE)), mean)
            at = some["j"].to_numpy(int) - tj * tile // size, some["i"].to_numpy(int) - ti * tile // size
            part[at] = some["v"].to_numpy(float)
            if size == 1:
                fixed[at] = True
            else:
                blocks = np.kron(part, np.ones((COARSE, COARSE)))[:h, :w]
                values[~fixed] = blocks[~fixed]
        return pd.DataFrame({"tj": [tj], "ti": [ti], "ny": [h], "nx": [w], "cells": [values.astype("<f8").tobytes()], "fixed": [fixed.tobytes()], "residual": [0.0 if fixed.all() else np.inf]})

    # every tile has a row of its own, so that those without a known cell are there too
    every = spark.range(tiles_j * tiles_i).select(F.floor(F.col("id") / tiles_i).cast("int").alias("tj"), (F.col("id") % tiles_i).cast("int").alias("ti"))
    place = lambda df, size: df.select(*[F.floor(F.col(c) * size / tile).cast("int").alias(f"t{c}") for c in "ji"], "j", "i", "v", F.lit(size).alias("size"))
    none = F.lit(None).cast("int")
    rows = place(known, 1).unionByName(every.select("tj", "ti", none.alias("j"), none.alias("i"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("size")))
    if guess is not None:
        rows = rows.unionByName(place(guess, COARSE))
    state = stage(rows.groupBy("tj", "ti").applyInPandas(build, _STATE), "tiles")
    drop(known)

    def send(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                for side, edge in _edges(_tile(row)[0]).items():
                    dj, di = _SIDES[side]
                    out.append((row["tj"] + dj, row["ti"] + di, side, edge.astype("<f8").tobytes()))
            yield pd.DataFrame(out, columns=["tj", "ti", "side", "edge"])

    def work(key: tuple, tiles: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(tiles):
            return tiles
        row = tiles.iloc[0].copy()
        values, fixed = _tile(row)
        halo = {s: np.frombuffer(e, "<f8") for s, e in zip(edges["side"], edges["edge"])}
        row["residual"] = _relax(values, fixed, halo, SWEEPS, tolerance)
        row["cells"] = values.astype("<f8").tobytes()
        return pd.DataFrame([row])

    edge = "tj int, ti int, side string, edge binary"
    whole, first = state.where("residual = 0"), state
    lent = stage(whole.mapInPandas(send, edge), "edges")
    state = state.where("residual > 0")
    for _ in range(rounds):
        moved = state.mapInPandas(send, edge).unionByName(lent)
        relaxed = stage(state.groupBy("tj", "ti").cogroup(moved.groupBy("tj", "ti")).applyInPandas(work, _STATE), "tiles")
        if state is not first and hasattr(state, "_staged_path"):
            drop(state)
        state = relaxed
        worst = state.agg(F.max("residual")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise ValueError(f"after {rounds} rounds a cell is still {worst} from its neighbours' mean")
    drop(lent)

    def cells_of(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                values = _tile(row)[0]
                j, i = np.indices(values.shape)
                yield pd.DataFrame({"j": (j + row["tj"] * tile).ravel(), "i": (i + row["ti"] * tile).ravel(), "v": values.ravel()})

    return whole.unionByName(state).mapInPandas(cells_of, "j int, i int, v double")
