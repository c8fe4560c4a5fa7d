"""Hard-negative mining over candidate lists that a cluster of anchors shares.

Anchors are clustered by direction. For a cluster with centroid c whose members
lie within an angle t of it, no member's score with a candidate v can exceed
``|anchor| * |v| * cos(max(0, angle(v, c) - t))``. The candidates are sorted by
this bound once for the whole cluster; every member walks the list and stops
where the bound times its own length is certified too small (Abuzaid et al.,
"To Index or Not to Index: Optimizing Exact Maximum Inner Product Search", 2019).

The list is kept in two levels, so that no task holds it whole. Candidates lie
in cells around the same directions, each cell in blocks of bounded size. A
cluster orders the cells by their bound and walks the first few of them, which
gives every member a threshold; of the others it visits those whose bound
reaches a member's threshold. Inside a block the candidates are sorted by the
bound of each. The list is walked twice: once for the positives, then for the
negatives, whose range of scores follows from the positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopguard.llm.common import written

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90        # percent of the positive's score between which a negative's lies
SCALE = 256
CELLS = 1024              # most cells; their directions and sizes are broadcast
SAMPLE = 4096             # rows the directions are fitted on
SAMPLE_BYTES = 1 << 25
BLOCK_BYTES = 2 << 20     # vectors of one block of candidates
BLOCK = 4096
CLUSTER = 256             # anchors of one cluster
TOGETHER = 16             # clusters that meet one block in one task
PROBE = 8192              # candidates a cluster walks before it has thresholds
RUN = 512                 # candidates scored at a time

_PACKED = "n int, dim int, ids binary, labels binary, data binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
              scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v, rid)``: ``v`` is floor(scale x) as integers; rows that can take no part are left out."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    whole = (F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
             & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"),
        F.monotonically_increasing_id().alias("rid"))


def _matrix(values: list, dim: int) -> np.ndarray:
    """Rows padded with zeros to ``dim``."""
    out = np.zeros((len(values), dim), np.int64)
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def _directions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); a zero vector stays zero."""
    f = m.astype(float)
    n = np.linalg.norm(f, axis=1)
    return f / np.where(n > 0, n, 1)[:, None], n


def _angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1, 1))


def fitted_directions(table: DataFrame, cells: int, dim: int, rounds: int = 8) -> np.ndarray:
    """Unit directions of the cells: spherical k-means over the rows with the smallest hashes (a bounded sample).

    Which directions come out decides where rows meet, never what is found.
    """
    size = max(cells, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    rows = table.orderBy(F.xxhash64("rid"), "rid").limit(size).select("v").toPandas()["v"].tolist()
    units, _ = _directions(_matrix(rows, dim))
    centres = units[:cells].copy()
    for _ in range(rounds):
        near = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        moved, n = _directions(sums)
        centres = np.where(n[:, None] > 0, moved, centres)
    return centres


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where those are exact, since only they have fast kernels."""
    if np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _packer(dim: int, extra: list[str]):
    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, len(f), dim, f["vec_id"].to_numpy().astype("<i8").tobytes(),
                              f["label"].to_numpy().astype("<i8").tobytes(),
                              _matrix(f["v"].tolist(), dim).astype("<i8").tobytes()]],
                            columns=[*extra, "n", "dim", "ids", "labels", "data"])
    return pack


def _unpack(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(r.ids, "<i8"), np.frombuffer(r.labels, "<i8"),
            np.frombuffer(r.data, "<i8").reshape(r.n, r.dim))


class Cluster:
    """The anchors of one cluster with the cone they lie in."""

    def __init__(self, row):
        self.ids, self.labels, self.data = _unpack(row)
        units, self.norms = _directions(self.data)
        mean, n = _directions(units.sum(0, keepdims=True))
        self.centre = mean[0] if n[0] else units[0]
        turned = _angles(units, self.centre)[self.norms > 0]
        self.cone = float(turned.max()) if len(turned) else 0.0

    def bounds(self, norms: np.ndarray, angles: np.ndarray) -> np.ndarray:
        """Most that a member of length one can score with candidates of these lengths and angles to the centre."""
        return norms * np.cos(np.maximum(0.0, angles - self.cone))

    def reach(self, bound: float) -> np.ndarray:
        """``bound`` for each member, with room for the rounding of angles."""
        return bound * self.norms + 1e-6 * abs(bound) * self.norms + 1e-3


def _best(scores: np.ndarray, ids: np.ndarray, k: int, had: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k first of (score, id) by descending score, then id, of the new ones and those ``had``."""
    s, i = np.concatenate([had[0], scores]), np.concatenate([had[1], ids])
    if len(s) > 4 * k + 16:                          # what can't be among the first k needn't be sorted
        keep = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, i = s[keep], i[keep]
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


_NONE = np.empty(0, np.int64), np.empty(0, np.int64)


def walk(cluster: Cluster, block, wanted: list[list[tuple[int, int | None, int, int]]], same: bool,
         k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Walk one block in the order of the cluster's bound.

    ``wanted`` holds for each member its lists ``(slot, least, most, floor)``:
    scores from ``least`` to ``most`` (in hundredths; None: any) of which only
    those of at least ``floor`` matter. Yields (member, slot, scores, ids), the
    first ``k`` of the block for each list.
    """
    ids, labels, data = _unpack(block)
    units, norms = _directions(data)
    bound = cluster.bounds(norms, _angles(units, cluster.centre))
    order = np.argsort(-bound, kind="stable")
    ids, labels, data, bound = ids[order], labels[order], data[order], bound[order]
    best = [[_NONE] * len(w) for w in wanted]

    def need(i: int) -> float:
        """Least score that could still change one of the member's lists."""
        return min((max(lo / 100 if lo is not None else -np.inf, floor, b[0][-1] if len(b[0]) == k else -np.inf)
                    for (_, lo, _, floor), b in zip(wanted[i], best[i])), default=np.inf)

    needs = np.array([need(i) for i in range(len(wanted))])
    for a in range(0, len(ids), RUN):
        live = np.flatnonzero(cluster.reach(float(bound[a])) >= needs)
        if not len(live):
            break
        part = slice(a, min(a + RUN, len(ids)))
        scores = exact_scores(cluster.data[live], data[part])
        for row, i in zip(scores, live.tolist()):
            fit = (row >= needs[i]) & (ids[part] != cluster.ids[i])
            fit &= (labels[part] == cluster.labels[i]) if same else (labels[part] != cluster.labels[i])
            if not fit.any():
                continue
            s, j = row[fit], ids[part][fit]
            for n, (_, lo, hi, floor) in enumerate(wanted[i]):
                ok = s >= floor if lo is None else (s >= floor) & (100 * s >= lo) & (100 * s <= hi)
                if ok.any():
                    best[i][n] = _best(s[ok], j[ok], k, best[i][n])
            needs[i] = need(i)
    for i, w in enumerate(wanted):
        for n, (slot, *_) in enumerate(w):
            if len(best[i][n][0]):
                yield i, slot, *best[i][n]


_LOWEST = np.iinfo(np.int64).min // 2


def lists_of(cluster: Cluster, m, low: int, high: int) -> list[list[tuple[int, int | None, int, int]]]:
    """Each member's lists (see ``walk``) from its rows ``m``; a range that holds no score has none."""
    place = {v: i for i, v in enumerate(cluster.ids.tolist())}
    out: list[list] = [[] for _ in place]
    for x in m:
        p = x["p"]
        lo, hi = (None, 0) if p is None else (low * p, high * p)
        if lo is None or lo <= hi:
            out[place[x["anchor_id"]]].append((x["slot"], lo, hi, _LOWEST if x["floor"] is None else x["floor"]))
    return out


class _Search:
    """One walk over all candidates: first the probed cells, then the others that can still matter."""

    def __init__(self, clusters: DataFrame, blocks: DataFrame, cells: DataFrame, dim: int, k: int, same: bool,
                 low: int = 0, high: int = 0):
        self.clusters, self.blocks, self.dim, self.k, self.same = clusters, blocks, dim, k, same
        self.low, self.high = low, high
        spark = clusters.sparkSession
        rows = cells.collect()                       # at most CELLS
        self.cells = spark.sparkContext.broadcast(
            {"cell": [r.cell for r in rows], "n": [r.n for r in rows], "top": [r.top for r in rows],
             "wide": [r.wide for r in rows], "centre": [list(r.centre) for r in rows]})
        self.sizes = spark.createDataFrame([(r.cell, r.blocks) for r in rows], "cell int, blocks int")

    def _lists(self, state: DataFrame) -> DataFrame:
        """The clusters with their members' lists (``m``: member id, slot, positive score, floor)."""
        grouped = state.groupBy("cluster").agg(F.collect_list(F.struct("anchor_id", "slot", "p", "floor")).alias("m"))
        return self.clusters.join(grouped, "cluster")

    def _visits(self, state: DataFrame, probe: bool) -> DataFrame:
        """(cluster, cell) pairs of a round, from the cells' bounds alone."""
        held, low, high = self.cells, self.low, self.high

        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value
            names, sizes = np.array(c["cell"]), np.array(c["n"])
            centres, top, wide = np.array(c["centre"], float), np.array(c["top"]), np.array(c["wide"])
            for f in frames:
                out = []
                for r in f.itertuples():
                    cluster = Cluster(r)
                    bound = np.maximum(cluster.bounds(top, np.maximum(0.0, _angles(centres, cluster.centre) - wide)), 0.0)
                    order = np.argsort(-bound, kind="stable")
                    # Rows of the cells before each: the probe takes cells until it has seen PROBE rows.
                    first = np.cumsum(sizes[order]) - sizes[order] < PROBE
                    if probe:
                        take = order[first]
                    else:
                        lists = lists_of(cluster, r.m, low, high)
                        need = np.array([min((max(lo / 100 if lo is not None else -np.inf, floor)
                                              for _, lo, _, floor in w), default=np.inf) for w in lists])
                        take = np.array([k for k in order[~first].tolist()
                                         if (cluster.reach(float(bound[k])) >= need).any()], int)
                    out += [(r.cluster, int(names[k])) for k in take.tolist()]
                yield pd.DataFrame(out, columns=["cluster", "cell"])

        return self._lists(state).mapInPandas(choose, "cluster long, cell int")

    def round(self, state: DataFrame, probe: bool, name: str) -> DataFrame:
        """``(cluster, anchor_id, slot, p, vec_id, score)``: the first k of each list among the visited blocks."""
        visits = written(self._visits(state, probe).join(F.broadcast(self.sizes), "cell")
                         .select("cluster", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                 F.floor(F.col("cluster") / TOGETHER).cast("long").alias("team")), f"{name}-visits")
        left = visits.join(self._lists(state), "cluster")
        right = (visits.select("cell", "block", "team").distinct().join(self.blocks, ["cell", "block"])
                 .select(*[F.col(c).alias(f"b_{c}") for c in ("cell", "block", "team")], "n", "dim", "ids", "labels", "data"))
        low, high, same, k = self.low, self.high, self.same, self.k

        def search(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            out = []
            for b in blocks.itertuples():            # one
                for a in anchors.itertuples():
                    cluster = Cluster(a)
                    for i, slot, s, v in walk(cluster, b, lists_of(cluster, a.m, low, high), same, k):
                        out.append(pd.DataFrame({"cluster": a.cluster, "anchor_id": int(cluster.ids[i]), "slot": slot,
                                                 "vec_id": v, "score": s}))
            columns = ["cluster", "anchor_id", "slot", "vec_id", "score"]
            return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns}, dtype="int64")

        return written(left.groupBy("cell", "block", "team").cogroup(right.groupBy("b_cell", "b_block", "b_team")).applyInPandas(
            search, "cluster long, anchor_id long, slot int, vec_id long, score long"), f"{name}-found")

    def first(self, found: DataFrame) -> DataFrame:
        """The first k rows of each list with their ``rank``."""
        w = Window.partitionBy("cluster", "anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)

    def run(self, state: DataFrame, name: str) -> DataFrame:
        """The first k of every list of ``state`` (``cluster, anchor_id, slot, p``)."""
        probed = self.round(state.withColumn("floor", F.lit(None).cast("long")), True, f"{name}-probe")
        floors = self.first(probed).where(F.col("rank") == self.k).select(
            "cluster", "anchor_id", "slot", F.col("score").alias("floor"))
        tight = written(state.join(floors, ["cluster", "anchor_id", "slot"], "left"), f"{name}-state")
        return self.first(probed.unionByName(self.round(tight, False, f"{name}-rest")))


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         block: int = BLOCK, cluster: int = CLUSTER) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``; their positives the
    first ``positives`` other rows of their label by score (ties to the smaller
    id); the negatives of a pair the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    Rows without id, label or vector, or with a NULL or non-finite component,
    take no part. A vector shorter than the longest counts as padded with zeros.
    A repeated id is a repeated row: no candidate for anchors of its own id, else
    found as often as it occurs; a repeated anchor is answered once, by its smallest (vector, label).
    Other columns play no part; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    table = written(quantised(vectors, id_col, vec_col, label_col), "negatives-vectors")
    n, dim = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], schema)
    dim = max(int(dim), 1)
    block = max(1, min(block, BLOCK_BYTES // (8 * dim)))
    cluster = max(1, min(cluster, BLOCK_BYTES // (8 * dim)))
    centres = fitted_directions(table, max(1, min(CELLS, -(-n // block), SAMPLE_BYTES // (8 * dim))), dim)
    held = spark.sparkContext.broadcast(centres)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            units, norms = _directions(_matrix(f["v"].tolist(), dim))
            cos = units @ held.value.T
            cell = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(f)), cell], -1, 1)) if len(f) else np.zeros(0)
            yield f.assign(cell=cell.astype(np.int32), angle=np.where(norms > 0, angle, 0.0), norm=norms)

    placed = written(table.mapInPandas(near, "vec_id long, label long, v array<long>, rid long, cell int, angle double, "
                                             "norm double"), "negatives-placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.max("angle").alias("wide"))
    cells = written(cells.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "negatives-cells")
    centre_of = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    cells = cells.join(F.broadcast(centre_of), "cell")
    dealt = F.pmod(F.xxhash64("rid"), F.col("blocks").cast("long")).cast("int")
    blocks = written(placed.join(F.broadcast(cells.select("cell", "blocks")), "cell").withColumn("block", dealt)
                     .groupBy("cell", "block").applyInPandas(_packer(dim, ["cell", "block"]), f"cell int, block int, {_PACKED}"),
                     "negatives-blocks")

    # Anchors of one cell, cut to clusters of bounded size and numbered.
    asked = written(placed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(
        F.min(F.struct("v", "label", "cell")).alias("r")).select("vec_id", "r.*"), "negatives-asked")
    counts = [(r.cell, -(-r.n // cluster)) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not counts:
        return spark.createDataFrame([], schema)
    before = np.cumsum([0, *[c for _, c in counts]]).tolist()
    numbers = spark.createDataFrame([(c, k, b) for (c, k), b in zip(counts, before)], "cell int, k long, start long")
    members = asked.join(F.broadcast(numbers), "cell").withColumn(
        "cluster", F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("k")))
    clusters = written(members.groupBy("cluster").applyInPandas(_packer(dim, ["cluster"]), f"cluster long, {_PACKED}"),
                       "negatives-clusters")

    state = members.select("cluster", F.col("vec_id").alias("anchor_id"), F.lit(0).alias("slot"),
                           F.lit(None).cast("long").alias("p"))
    pos = written(_Search(clusters, blocks, cells, dim, positives, True).run(state, "positives")
                  .select("cluster", "anchor_id", F.col("rank").alias("slot"), F.col("score").alias("p"),
                          F.col("vec_id").alias("positive_id")), "negatives-positives")
    neg = _Search(clusters, blocks, cells, dim, negatives, False, low, high).run(pos.drop("positive_id"), "negatives")
    return neg.join(pos, ["cluster", "anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
