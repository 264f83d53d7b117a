"""The k most similar vectors of every vector, by an inverted multi-index.

A vector is normalised and cut into two halves, each quantised by its own
codebook; a pair of centroids is a cell of the index.  A query visits cells in
order of the sum of its two centroid distances, which a heap yields without
sorting all pairs, until enough entries are gathered; these are reranked by
cosine similarity.

Every group (say namespace and producer) has codebooks of its own, fitted on a
bounded sample of it.  A group of up to a block is one index.  A larger one is
laid out in blocks by a coarser multi-index, whose number of cells grows with
the group: a query goes by the same heap to the blocks of its first cells, and
searches the index of each.  So no task holds more than a block and a slice of
its queries, and what a query costs doesn't grow with its group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stage

#: Rows per block, and blocks' worth of rows that a query of a larger group visits.
BLOCK, VISITS = 16_000, 4
#: Entries that a query gathers in a block: LEAST and this share of the block.
LEAST, SHARE = 256, 0.35
#: Most centroids per half of a block's index; the halves of a large group have as many as its cells ask for.
CENTROIDS = 32
#: Codebooks are fitted on at most about this many vectors of a block or group, those of lowest hash.
SAMPLE = 8_000
#: Queries that meet a block in one task.
QUERIES = 8_000


def usable(vectors: DataFrame, dim: int, key: str, vector: str, group: list[str]) -> DataFrame:
    """(id, grp, v): rows with vectors of ``dim`` finite numbers that aren't all zero.

    Null, short, long, NaN-bearing, infinite and all-zero vectors take no
    part, nor do rows with a null key; a null group value is a group.
    """
    x = F.col(vector)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    good = vectors.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) == dim))
    good = good.withColumn("__square", square).where((F.col("__square") > 0) & (F.col("__square") < F.lit(float("inf"))))
    named = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"g{i}") for i, g in enumerate(group)]
    return good.select(F.col(key).alias("id"), F.concat_ws("\1", *named).alias("grp"), x.cast("array<float>").alias("v"))


def means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample by Lloyd's iterations, from k of its points."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        own = np.bincount(near, minlength=len(c))
        at = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[at], np.minimum(np.r_[0, np.cumsum(own)[:-1]], len(x) - 1), axis=0)
        c = np.where(own[:, None] > 0, sums / np.maximum(own, 1)[:, None], c).astype(np.float32)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))[:, None].astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, but for what is the same for all centroids of a row."""
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.float32)


def order_cells(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs (i, j) by d1[i] + d2[j], lazily: a heap over the sorted distances of the two halves."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    push, pop, n1, n2 = heapq.heappush, heapq.heappop, len(o1), len(o2)
    while heap:
        _, a, b = pop(heap)
        yield o1[a], o2[b]
        if b == 0 and a + 1 < n1:
            push(heap, (s1[a + 1] + s2[0], a + 1, 0))
        if b + 1 < n2:
            push(heap, (s1[a] + s2[b + 1], a, b + 1))


class Index:
    """The inverted multi-index over the entries of one block, with codebooks fitted on the first ``sample`` of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centroids: int = CENTROIDS, sample: int = SAMPLE):
        half = x.shape[1] // 2
        k = int(np.clip(round(np.sqrt(len(x)) / 3), 2, centroids))
        # Ids have no order that tells anything about vectors once they are hashed.
        picked = np.argsort(_scrambled(ids), kind="stable")[:sample]
        self.c1, self.c2 = means(x[picked, :half], k, 5), means(x[picked, half:], k, 6)
        cell = distances(x[:, :half], self.c1).argmin(1) * len(self.c2) + distances(x[:, half:], self.c2).argmin(1)
        at = np.lexsort((ids, cell))
        self.ids, self.x = ids[at], x[at]
        self.edge = np.searchsorted(cell[at], np.arange(len(self.c1) * len(self.c2) + 1)).tolist()

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, neighbour id, similarity), at most k a query and never the query's own id.

        Cells are gathered whole, in the heap's order, until they hold ``candidates`` entries.
        """
        half, width, edge = self.c1.shape[1], len(self.c2), self.edge
        d1, d2 = distances(q[:, :half], self.c1), distances(q[:, half:], self.c2)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for n in range(len(q)):
            spans, found = [], 0
            for i, j in order_cells(d1[n], d2[n]):
                cell = i * width + j
                lo, hi = edge[cell], edge[cell + 1]
                if hi > lo:
                    spans.append(slice(lo, hi))
                    found += hi - lo
                    if found >= candidates:
                        break
            i, s = _best(np.concatenate([self.ids[p] for p in spans]), np.concatenate([self.x[p] for p in spans]) @ q[n], int(ids[n]), k)
            out.append((np.full(len(i), n), i, s))
        return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def _scrambled(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _best(ids: np.ndarray, sims: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k entries of highest similarity, ties to the lower id, without the query's own."""
    if len(ids) > k + 1:
        # One more than k, as the query itself may be among them.
        least = np.partition(sims, len(sims) - k - 1)[len(sims) - k - 1]
        at = np.flatnonzero(sims >= least)
        ids, sims = ids[at], sims[at]
    other = ids != own
    ids, sims = ids[other], sims[other]
    at = np.lexsort((ids, -sims))[:k]
    return ids[at], sims[at]


def neighbours(
    vectors: DataFrame, k: int = 10, *, key: str = "row_id", vector: str = "embedding", group: tuple[str, ...] = ("namespace", "producer_version"),
    dim: int = 64, block: int = BLOCK, visits: int = VISITS, least: int = LEAST, share: float = SHARE, queries: int = QUERIES,
) -> DataFrame:
    """(id, other, similarity, position) of the ``k`` most similar rows of every usable row in its group.

    Copies of a row count once.  Ties go to the lower id.  A query gathers
    ``least`` entries and a ``share`` of its block besides, so a group of few
    rows is gathered whole.  Of rows with equal vectors only the k + 1 lowest
    are entries: the others have the lowest k of them as neighbours.
    """
    rows = usable(vectors, dim, key, vector, list(group)).dropDuplicates(["id"]).withColumn("h", F.xxhash64("v"))
    rows = stage(rows, "vectors")
    equal = rows.groupBy("grp", "h").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("grp", "h")
    surplus = None
    if not equal.isEmpty():
        # The window keeps k + 1 rows of a class in each partition before it shuffles.
        order = Window.partitionBy("grp", "h").orderBy("id")
        low = rows.select("grp", "h", "id").join(equal, ["grp", "h"], "left_semi").withColumn("p", F.row_number().over(order)).where(F.col("p") <= k + 1)
        low = stage(low.groupBy("grp", "h").agg(F.max("id").alias("last"), F.sort_array(F.collect_list("id")).alias("lowest")), "equal")
        surplus = rows.select("grp", "h", "id").join(low, ["grp", "h"]).where(F.col("id") > F.col("last"))
        rows = rows.join(low.select("grp", "h", "last"), ["grp", "h"], "left").where(F.col("last").isNull() | (F.col("id") <= F.col("last")))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    near = rows.select("grp", "id", "v").join(sizes, "grp")
    # A group of one block: its rows are entries in each slice and queries in one.
    slices = F.ceil(F.col("n") / queries).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), slices).cast("int")
    small = near.where(F.col("n") <= block).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    met = small.select("grp", F.lit(0).alias("block"), "slice", "id", "v", F.lit(True).alias("entry"), (F.col("slice") == own).alias("query"))
    if not sizes.where(F.col("n") > block).isEmpty():
        met = met.unionByName(_laid_out(near.where(F.col("n") > block), block, visits, queries))

    def search(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = unit(np.stack(pdf["v"].to_numpy()).astype(np.float32)), pdf["id"].to_numpy()
        entry, q = pdf["entry"].to_numpy(dtype=bool), pdf["query"].to_numpy(dtype=bool)
        if not entry.any() or not q.any():
            return pd.DataFrame({"id": [], "other": [], "similarity": []}).astype({"id": "int64", "other": "int64", "similarity": "float32"})
        at, other, s = Index(ids[entry], x[entry]).search(ids[q], x[q], k, least + int(share * entry.sum()))
        return pd.DataFrame({"id": ids[q][at], "other": other, "similarity": s})

    found = met.groupBy("grp", "block", "slice").applyInPandas(search, "id long, other long, similarity float")
    best = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("other"))))
    # At most k rows per id and visited block are gathered.
    top = found.groupBy("id").agg(F.slice(best, 1, k).alias("top"))
    out = top.select("id", F.posexplode("top").alias("p", "t")).select(
        "id", F.col("t.other").alias("other"), (-F.col("t.s")).alias("similarity"), (F.col("p") + 1).alias("position")
    )
    if surplus is not None:
        rest = surplus.select("id", F.posexplode(F.slice("lowest", 1, k)).alias("p", "other"))
        out = out.unionByName(rest.select("id", "other", F.lit(1.0).cast("float").alias("similarity"), (F.col("p") + 1).alias("position")))
    return out


def _laid_out(rows: DataFrame, block: int, visits: int, queries: int) -> DataFrame:
    """(grp, block, slice, id, v, entry, query) of the rows (grp, id, v, n) of groups larger than a block.

    A group's codebooks, and the map of its cells to blocks, reach its rows
    slice by slice: a slice of about a block's rows is cogrouped with one copy
    of them, so nothing that grows with the data is broadcast or put on a row.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.ceil(F.col("n") / block)).cast("int"))
    parts = rows.groupBy("grp").agg(F.max("n").alias("n"))
    each = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("part")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf["v"].to_numpy()).astype(np.float32))
        half, n = x.shape[1] // 2, int(pdf["n"].iloc[0])
        # A cell holds about a quarter of a block.
        k = max(2, int(np.ceil(np.sqrt(4 * n / block))))
        return pd.DataFrame([{"grp": pdf["grp"].iloc[0], "c1": means(x[:, :half], k, 7).tobytes(), "c2": means(x[:, half:], k, 8).tobytes(), "half": half}])

    # Numbers from a hash, evenly spread over [0, 1): a sample of about SAMPLE rows a group, or four a centroid if that is more.
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    wanted = F.greatest(F.lit(float(SAMPLE)), 8 * F.sqrt(F.col("n") / block))
    books = rows.where(draw < wanted / F.col("n")).select("grp", "v", "n").groupBy("grp").applyInPandas(fit, "grp string, c1 binary, c2 binary, half int")
    books = stage(books.join(parts, "grp"), "codebooks")

    def halves(book: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        half = int(book["half"].iloc[0])
        return *(np.frombuffer(book[c].iloc[0], np.float32).reshape(-1, half) for c in ("c1", "c2")), half

    def assign(pdf: pd.DataFrame, book: pd.DataFrame) -> pd.DataFrame:
        c1, c2, half = halves(book)
        x = unit(np.stack(pdf["v"].to_numpy()).astype(np.float32)) if len(pdf) else np.zeros((0, 2 * half), np.float32)
        pdf["cell"] = (distances(x[:, :half], c1).argmin(1) * len(c2) + distances(x[:, half:], c2).argmin(1)).astype("int32")
        return pdf[["grp", "part", "id", "v", "cell"]]

    keyed = lambda df: df.groupBy("grp", "part")
    copies = books.select("grp", "c1", "c2", "half", each)
    placed = keyed(rows.select("grp", "part", "id", "v")).cogroup(keyed(copies)).applyInPandas(assign, "grp string, part int, id long, v array<float>, cell int")
    placed = stage(placed, "cells")
    plan = _layout(placed.groupBy("grp", "cell").agg(F.count("*").alias("n")), block)
    # Per block: how many there are in its cell's row of blocks, and its rows; per group one list of as many entries as it has cells.
    maps = plan.groupBy("grp").agg(F.collect_list(F.struct("cell", "first", "width", "n")).alias("cells"))
    copies = books.join(maps, "grp").select("grp", "c1", "c2", "half", "cells", each)

    def route(pdf: pd.DataFrame, book: pd.DataFrame) -> pd.DataFrame:
        c1, c2, half = halves(book)
        cells = {c["cell"]: (c["first"], c["width"], c["n"]) for c in book["cells"].iloc[0]}
        held: dict[int, int] = {}
        for first, width, n in cells.values():
            held[first] = held.get(first, 0) + n
        x = unit(np.stack(pdf["v"].to_numpy()).astype(np.float32)) if len(pdf) else np.zeros((0, 2 * half), np.float32)
        d1, d2 = distances(x[:, :half], c1), distances(x[:, half:], c2)
        take, to, entry = [], [], []
        ids, home = pdf["id"].to_numpy(), pdf["cell"].to_numpy()
        salt = _scrambled(ids)
        for n in range(len(pdf)):
            first, width, _ = cells[int(home[n])]
            take.append(n)
            to.append(first + int(salt[n] % np.uint64(width)))
            entry.append(True)
            goal: dict[int, int] = {}
            seen = 0
            for i, j in order_cells(d1[n], d2[n]):
                at = cells.get(i * len(c2) + j)
                if at and at[0] not in goal:
                    goal[at[0]] = at[1]
                    seen += held[at[0]]
                    if seen >= visits * block:
                        break
            for first, width in goal.items():
                # A cell larger than a block has several; its rows may be in any of them.
                take += [n] * width
                to += range(first, first + width)
                entry += [False] * width
        out = pdf[["grp", "id", "v"]].iloc[take].reset_index(drop=True)
        out.insert(1, "block", np.array(to, dtype="int32"))
        out["entry"] = np.array(entry, dtype=bool)
        return out

    sent = keyed(placed).cogroup(keyed(copies)).applyInPandas(route, "grp string, block int, id long, v array<float>, entry boolean")
    sent = stage(sent, "routed")
    slices = sent.where(~F.col("entry")).groupBy("grp", "block").agg(F.ceil(F.count("*") / queries).cast("int").alias("slices"))
    wide = sent.join(slices, ["grp", "block"])
    one = F.array(F.pmod(F.xxhash64("id", F.lit(4)), F.col("slices")).cast("int"))
    wide = wide.withColumn("slice", F.explode(F.when(F.col("entry"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(one)))
    return wide.select("grp", "block", "slice", "id", "v", "entry", (~F.col("entry")).alias("query"))


def _layout(counts: DataFrame, block: int) -> DataFrame:
    """(grp, cell, n, first, width): cells of a group packed, in order of number, into blocks of at most ``block`` rows.

    A cell of more rows than a block gets ``width`` blocks of its own.  One
    row per group and cell; a group has some four cells a block.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell").reset_index(drop=True)
        first, width, at, room = [], [], 0, block
        for n in pdf["n"]:
            parts = int(-(-n // block))
            if n > room:
                at, room = at + 1, block
            first.append(at)
            width.append(parts)
            if parts > 1:
                at, room = at + parts, block
            else:
                room -= n
        return pdf.assign(first=np.array(first, "int32"), width=np.array(width, "int32"))[["grp", "cell", "n", "first", "width"]]

    return counts.groupBy("grp").applyInPandas(pack, "grp string, cell int, n long, first int, width int")


def similar_pairs(vectors: DataFrame, least: float = 0.85, k: int = 10, **how) -> DataFrame:
    """(row_id_a, row_id_b), a < b: similarity of at least ``least``, one among the other's ``k`` most similar.

    Similarity is taken again in double precision where single precision
    leaves the threshold open.
    """
    near = neighbours(vectors, k, **how).where(F.col("similarity") >= least - 1e-5)
    pairs = near.select(F.least("id", "other").alias("row_id_a"), F.greatest("id", "other").alias("row_id_b"), "similarity")
    pairs = pairs.groupBy("row_id_a", "row_id_b").agg(F.max("similarity").alias("s"))
    clear = pairs.where(F.col("s") >= least + 1e-5).select("row_id_a", "row_id_b")
    open_ = pairs.where(F.col("s") < least + 1e-5).select("row_id_a", "row_id_b")
    key, vector = how.get("key", "row_id"), how.get("vector", "embedding")
    one = usable(vectors, how.get("dim", 64), key, vector, list(how.get("group", ("namespace", "producer_version")))).dropDuplicates(["id"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)
    a, b = one.select(F.col("id").alias("row_id_a"), F.col("v").alias("va")), one.select(F.col("id").alias("row_id_b"), F.col("v").alias("vb"))
    exact = open_.join(a, "row_id_a").join(b, "row_id_b")
    cosine = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))
    return clear.unionByName(exact.where(cosine >= least).select("row_id_a", "row_id_b"))
