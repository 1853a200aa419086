"""Embedding near-duplicates by an exact metric range join.

On the unit sphere cosine >= c is distance <= r = sqrt(2 - 2c). Each vector has its home in the cell of its
nearest pivot. A vector with its home in cell i can only have a partner in cell j if it is within r of the
region of j, that is, by the triangle inequality for the plane between the pivots p_i and p_j,
(d_j^2 - d_i^2) / (2 |p_i - p_j|) <= r. It is copied to such cells of a smaller number, so each linked pair
meets in exactly one cell and cells join on their own, in blocks of bounded size.

Equal vectors are joined as one. A block task returns per vector its number of links and one root among the
vectors that its links connect, not the pairs, so a group of copies costs rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.components import components
from sessionloom.sources.scratch import materialise

COSINE = 0.95
CELL = 16_384  # vectors per pivot
PIVOTS = 1024  # pivots at most; cells beyond CELL are joined in more blocks
SAMPLE = 16_384  # vectors that pivots are chosen from
BLOCK = 8192
_STRIP = 512
_CLOSE = 1e-9  # products this near the limit are computed again, one by one
_LEFT_CELL = "dim int, cell int, native boolean, node bigint, copies bigint, vector array<float>"


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(distinct: DataFrame, dim: int, wanted: int) -> np.ndarray:
    """Pivots far from one another, from a sample of SAMPLE vectors at most."""
    if wanted < 2:
        return np.zeros((0, dim))
    rows = (
        distinct.filter(F.col("dim") == dim)
        .orderBy(F.xxhash64("node"), "node")
        .limit(SAMPLE)
        .select("vector")
        .toPandas()
    )
    x = _units(rows["vector"])
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(wanted, len(x)):
        n = int(np.argmin(near))
        picked.append(n)
        near = np.maximum(near, x @ x[n])
    return x[picked]


def _to_cells(distinct: DataFrame, dim: int, pivots: np.ndarray, cosine: float) -> DataFrame:
    """Rows (dim, cell, native, node, copies, vector): every vector at home and where it may have partners."""
    radius = (2.0 - 2.0 * cosine) ** 0.5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots @ pivots.T))
        for pdf in batches:
            if not len(pdf):
                continue
            if len(pivots):
                like = np.full((len(pdf), len(pivots)), -2.0)
                mine = (pdf["dim"] == dim).to_numpy()
                like[mine] = _units(pdf["vector"][mine]) @ pivots.T
                home = np.where(mine, like.argmax(axis=1), 0)
                over = 2.0 * (like[np.arange(len(pdf)), home][:, None] - like)
                reach = (over <= 2.0 * radius * between[home] + 1e-9) & (np.arange(len(pivots)) < home[:, None])
                reach[~mine] = False
            else:
                home, reach = np.zeros(len(pdf), np.int64), np.zeros((len(pdf), 0), bool)
            row, cell = np.nonzero(reach)
            out = pdf.iloc[np.concatenate([np.arange(len(pdf)), row])].copy()
            out["cell"] = np.concatenate([home, cell]).astype(np.int32)
            out["native"] = np.arange(len(out)) < len(pdf)
            yield out[["dim", "cell", "native", "node", "copies", "vector"]]

    return distinct.mapInPandas(run, _LEFT_CELL)


def _blocks(cells: DataFrame, block: int) -> DataFrame:
    """Deal each cell's vectors to tasks of at most about two blocks: home with home, home with copied."""
    sizes = cells.groupBy("dim", "cell").agg(
        F.ceil(F.sum(F.col("native").cast("int")) / block).alias("homes"),
        F.ceil(F.sum((~F.col("native")).cast("int")) / block).alias("copied"),
    )
    placed = cells.join(F.broadcast(sizes), ["dim", "cell"])  # one row per cell, at most PIVOTS and one per dim
    own = F.pmod(F.xxhash64("node"), F.when(F.col("native"), F.col("homes")).otherwise(F.greatest("copied", F.lit(1))))
    placed = placed.withColumn("own", own)
    every_home = F.sequence(F.lit(0).cast("bigint"), F.col("homes") - 1)
    every_copied = F.when(F.col("copied") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("copied") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    at = F.col("own")

    def seat(kind: str, i, j, left):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"))

    home_seats = F.concat(
        F.transform(every_home, lambda x: seat("h", F.least(x, at), F.greatest(x, at), at <= x)),
        F.transform(every_copied, lambda x: seat("c", at, x, F.lit(True))),
    )
    copy_seats = F.transform(every_home, lambda x: seat("c", x, at, F.lit(False)))
    return placed.select(
        "dim", "cell", "node", "copies", "vector",
        F.inline(F.when(F.col("native") & (F.col("homes") > 0), home_seats).when(F.col("homes") > 0, copy_seats)),
    )


def _links(a: np.ndarray, b: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of two blocks, or of one with itself (each pair once)."""
    other = a if b is None else b
    for s in range(0, len(a), _STRIP):
        product = a[s : s + _STRIP] @ other.T
        i, j = np.nonzero(product >= cosine - _CLOSE)
        value = product[i, j]
        i += s
        if b is None:
            keep = i < j
            i, j, value = i[keep], j[keep], value[keep]
        sure = value >= cosine + _CLOSE
        for n in np.flatnonzero(~sure):
            u, v = a[i[n]], other[j[n]]
            sure[n] = u.dot(v) / (u.dot(u) * v.dot(v)) ** 0.5 >= cosine
        yield i[sure], j[sure]


def _join_block(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].iloc[0]
        same = kind == "h" and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        pdf = pdf.sort_values(["left", "node"], ascending=[False, True])
        x, copies, node = _units(pdf["vector"]), pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        n = len(pdf) if same else int(pdf["left"].sum())
        shift = 0 if same else n
        found = np.zeros(len(pdf), np.int64)
        root = np.arange(len(pdf))
        for i, j in _links(x[:n], None if same else x[n:], cosine):
            j = j + shift
            np.add.at(found, i, copies[j])
            np.add.at(found, j, copies[i])
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            for s, e in zip(starts, [*starts[1:], len(i)], strict=len(starts) > 0):
                roots = np.unique(np.append(root[j[s:e]], root[i[s]]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        some = found > 0
        return pd.DataFrame({"node": node[some], "links": found[some], "root": node[root[some]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of (vec_id, embedding).

    Vectors link when their cosine, in double precision, is at least ``cosine``; ``n_links`` counts the other
    rows linked directly, equal vectors included. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different length. Rows that share a vec_id
    are one component; a row without vec_id links with nothing. Infinite norms cannot arise: components are scaled first.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    good = rows.filter(sound)
    distinct = materialise(
        good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).select(
            "node", "copies", F.size("vector").alias("dim"), "vector"
        ),
        "vectors",
    )
    dims = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim, n = (dims["dim"], dims["count"]) if dims else (0, 0)
    pivots = choose_pivots(distinct, dim, min(PIVOTS, -(-n // cell)))
    cells = materialise(_to_cells(distinct, dim, pivots, cosine), "cells")
    tasks = _blocks(cells, block)
    found = materialise(
        tasks.groupBy("dim", "cell", "kind", "i", "j").applyInPandas(_join_block(cosine), "node bigint, links bigint, root bigint"),
        "links",
    )
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = (
        distinct.select("node", "copies", "vector")
        .join(totals, "node", "left")
        .join(classes.withColumnRenamed("id", "node"), "node", "left")
        .filter("copies > 1 or links is not null")
        .select(
            "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    known = rows.select("vec_id", F.when(sound, F.col("vector")).alias("vector"))
    component = F.coalesce("component", "vec_id")
    return known.join(facts, "vector", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
