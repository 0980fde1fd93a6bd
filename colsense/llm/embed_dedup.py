"""Embedding near-duplicates by collision-counting projections (operator 10).

Unit vectors with cosine >= t differ by at most r = sqrt(2 - 2 t) in length, so
on a line of random direction (standard normal weights) their projections differ
by a normal number of deviation at most r, while the whole set spreads over
deviation 1.  A pair *collides* on a line when the projections differ by at most
WIDTH * r: the window around the query on the sorted line.  With p the chance
of a collision at cosine t, a linked pair collides on at least REQUIRED of LINES
lines with the recall that the binomial distribution gives; REQUIRED is the
largest count that keeps it at RECALL.  Pairs with fewer collisions are not
looked at; the rest are verified by their cosine in double precision.

The first LEAD lines also deal the work out: each is cut into cells, a vector is
stored in its own cell and asked for in all cells that its (wider, LEAD_WIDTH)
window touches.  A cell of a label with more than TILE stored vectors is cut into
tiles, so no task gathers an unbounded group; a task sorts its tile by the first
line, walks the LEAD_WIDTH windows there and on the other lead lines, and counts
collisions on all lines, so a miss on a lead line is one of those that REQUIRED
allows.  With the lead windows the recall of a pair at the threshold is 0.9999.  Equal vectors are one class from the start and are
never paired with each other; a task emits, per vector, the number of its links
and a spanning forest of what it found, not all pairs.

The share of the vectors in a window doesn't shrink as their number grows, so
the counting takes time with the square of a label's *distinct* vectors, times
that share; more LEAD lines make it smaller at the cost of more copies.

Cases: null labels and vectors that are null, empty, zero or hold null or
non-finite components link with nothing and come back as themselves; vectors of
other lengths have cosine only within their length; ties and repeated vectors
are copies; rows that repeat a vec_id are rows of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_groups, stage, table

COSINE = 0.98
LINES = 32
WIDTH = 2.5
RECALL = 0.9999
LEAD = 3
LEAD_WIDTH = 4.5
TILE = 1024


def required_collisions(lines: int = LINES, width: float = WIDTH, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with this probability."""
    p = math.erf(width / math.sqrt(2))
    tail = [sum(math.comb(lines, j) * p**j * (1 - p) ** (lines - j) for j in range(k, lines + 1)) for k in range(lines + 1)]
    return max(k for k in range(lines + 1) if tail[k] >= recall)


def projections(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(7_919 + dim).standard_normal((dim, lines))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, the largest component first so that no square overflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _cells(cosine: float):
    """Per class: stored once in its own cell, asked for in every cell its window touches."""
    reach = LEAD_WIDTH * math.sqrt(2 - 2 * cosine)

    def run(batches):
        import pandas as pd
        for df in batches:
            for dim, part in df.groupby("dim"):
                u = _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                p = u @ projections(int(dim))[:, :LEAD]
                own = np.floor(p / (2 * reach)).astype(np.int64)
                low, high = np.floor((p - reach) / (2 * reach)).astype(np.int64), np.floor((p + reach) / (2 * reach)).astype(np.int64)
                keys = part[["label", "dim", "cls"]].reset_index(drop=True)
                shown = [own[:, i] for i in range(LEAD)]
                yield keys.assign(cell=_cell(shown), asks=False)
                for mask in range(1 << LEAD):
                    pick = [(high if mask >> i & 1 else low)[:, i] for i in range(LEAD)]
                    new = np.ones(len(keys), bool)
                    for i in range(LEAD):
                        if mask >> i & 1:
                            new &= high[:, i] != low[:, i]
                    yield pd.DataFrame(keys.assign(cell=_cell(pick), asks=True)[new])
    return run


def _cell(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.int64)
    for x in parts:
        out = out * 4096 + x + 2048
    return out


def _linked(cosine: float, least: int):
    reach, lead = (w * math.sqrt(2 - 2 * cosine) for w in (WIDTH, LEAD_WIDTH))

    def run(g):
        asks = g["asks"]
        ids, weight = g["cls"], g["copies"]
        u = _unit(np.stack(g["embedding"]).astype(np.float64))
        p = u @ projections(u.shape[1])
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(a) or not len(b):
            return
        b = b[np.argsort(p[b, 0], kind="stable")]
        line = p[b, 0]
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        links = np.zeros(len(ids), np.int64)
        us, vs = [], []
        for i in a:
            at = b[np.searchsorted(line, p[i, 0] - lead) : np.searchsorted(line, p[i, 0] + lead, side="right")]
            for k in range(1, LEAD):
                at = at[np.abs(p[at, k] - p[i, k]) <= lead]
            at = at[ids[at] != ids[i]]
            if not len(at):
                continue
            at = at[(np.abs(p[at] - p[i]) <= reach).sum(axis=1) >= least]
            at = at[u[at] @ u[i] >= cosine]
            if len(at):
                links[i] = weight[at].sum()
                x = find(int(ids[i]))
                for j in ids[at].tolist():
                    y = find(j)
                    if x != y:
                        root[y] = x
                        us.append(int(ids[i]))
                        vs.append(j)
        k = a[links[a] > 0]
        yield {"u": np.concatenate([ids[k], np.array(us, np.int64)]), "v": np.concatenate([ids[k], np.array(vs, np.int64)]),
               "n": np.concatenate([links[k], np.zeros(len(us), np.int64)])}
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"),
                         F.col(label_col).cast("string").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & ~zero, F.lit(False))
    # -0.0 is 0.0
    src = src.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).withColumn("able", able)
    src = src.withColumn("cls", F.when(F.col("able"), F.xxhash64("label", "embedding")))
    rows = stage(src.select("vec_id", "able", "cls"))
    classes = stage(src.where("able").groupBy("label", "cls").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
                    .withColumn("dim", F.size("embedding")))
    placed = stage(classes.select("label", "dim", "cls", "embedding")
                   .mapInPandas(_cells(cosine), "label string, dim int, cls long, cell long, asks boolean"))
    cell = ["label", "dim", "cell"]
    cut = placed.where("not asks").groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")))
    # the queries of a tile are cut as well, so that no group grows with the input
    asked = placed.where("asks").groupBy(*cell).agg(F.ceil(F.count("*") / (4 * TILE)).cast("int").alias("asked"))
    lane = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("cls", F.lit(1)), F.col("asked")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("asked") - 1))
    dealt = (placed.join(cut, cell).join(asked, cell).withColumn("tile", F.explode(tile)).withColumn("lane", F.explode(lane))
             .join(classes.select("label", "cls", "embedding", "copies"), ["label", "cls"])
             .select(F.xxhash64(*cell).alias("cell"), "tile", "lane", "asks", "cls", "copies", "embedding"))
    found = stage(map_groups(dealt, ["cell", "tile", "lane"], _linked(cosine, required_collisions()), "u long, v long, n long"))
    links = found.where("u = v").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("u <> v").select("u", "v"))
    known = (classes.select("cls", "copies").join(comps.toDF("cls", "comp"), "cls", "left").join(links, "cls", "left")
             .select("cls", F.coalesce("comp", "cls").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = rows.where("able").join(known, "cls")
    first = named.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    out = named.join(first, "comp").select("vec_id", "n_links", "component_id")
    alone = rows.where("not able").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
