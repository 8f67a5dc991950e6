"""Operator 5, approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product.  With M the largest norm, a vector x gains the
coordinate sqrt(M**2 - |x|**2) and a query the coordinate 0: then the nearest by
Euclidean distance are those of largest inner product, and Gaussian (2-stable)
projections cut into cells of width W hash them.  A table concatenates K cells.

A query visits its own bucket and perturbed ones.  Perturbation sets are ordered
by estimated success: one template over the ranks of the 2K sorted cell-edge
distances, with their expected squares as costs (Lv et al.), mapped onto each
query's own order.  The number of probes is calibrated on a bounded sample
against brute force; nearer neighbours in the full table are only easier.  Where
``MOST_PROBES`` probes do not reach the recall, K is lowered, so buckets grow,
until they do; where no K does, every query is scored against all vectors.

Buckets are hashed to groups of about ``GROUP`` vectors; a bucket larger than
``HOT`` is salted over several.  A group's vectors are read once, then the
queries that probe its buckets stream past, are scored bucket by bucket in double
precision, and each query's best are kept; the tables' candidates are merged by
query.  Queries that found too few, or all if no K sufficed, are scored against
all vectors, group by group.

Equal vectors are one entry with their smallest ids, so a vector that a third of
the rows share costs one candidate.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonmend.llm.common import materialize, read_table

#: Hash tables, and the width of a cell in standard deviations of a projection.
TABLES = 3
WIDTH = 3.5
#: Vectors in a group; vectors in a bucket before it is salted.
GROUP = 32_768
HOT = 16_384
#: Query visits after which a group is dealt out again, so that no task meets an unbounded stream.
VISITS = 1_000_000
#: Most buckets that are salted; the least size of such a bucket rises beyond that.
MOST_SALTED = 1_000_000
#: Scores held at once.
CELLS = 4_000_000
#: Sample for calibration, its queries, the recall it must show, and the most probes of a hasher.
SAMPLE, SAMPLE_QUERIES, RECALL, MOST_PROBES = 4_096, 128, 0.96, 6_000
#: The most and fewest cells that a table concatenates.
MOST_K, LEAST_K = 20, 4


def probe_template(k: int, probes: int) -> np.ndarray:
    """(probes, width) ranks in 1..2K of the edge distances to cross, 0-padded; the first row crosses none.

    Rank j's expected squared distance is j(j+1)/(4(K+1)(K+2)) up to K and
    mirrored above; ranks j and 2K+1-j are the two edges of one cell.
    """
    j = np.arange(1, 2 * k + 1, dtype=float)
    low = j * (j + 1) / (4 * (k + 1) * (k + 2))
    high = 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2))
    cost = np.where(j <= k, low, high)
    sets, heap = [()], [(cost[0], (1,))]
    while heap and len(sets) < probes:
        total, ranks = heapq.heappop(heap)
        last = ranks[-1]
        if last < 2 * k:
            heapq.heappush(heap, (total - cost[last - 1] + cost[last], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last], (*ranks, last + 1)))
        if all(2 * k + 1 - r not in ranks for r in ranks):
            sets.append(ranks)
    width = max(map(len, sets)) or 1
    return np.array([[*s, *[0] * (width - len(s))] for s in sets], dtype=np.int64)


@dataclass
class Hasher:
    """Projections (tables, K, dim + 1), offsets, cell width, bucket-key coefficients, probe template, norm bound."""

    planes: np.ndarray
    offsets: np.ndarray
    width: float
    coefs: np.ndarray
    template: np.ndarray
    bound: float

    @classmethod
    def build(cls, dim: int, k: int, bound: float, spread: float, tables: int = TABLES, seed: int = 5) -> Hasher:
        rng = np.random.default_rng(seed)
        width = WIDTH * spread
        coefs = rng.integers(0, 1 << 63, size=(tables, k), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        return cls(rng.normal(size=(tables, k, dim + 1)), rng.uniform(0, width, size=(tables, k)), width, coefs, probe_template(k, 1), bound)

    def cells(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, K) projections in units of the cell width."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.bound**2 - (vectors**2).sum(axis=1), 0))
        flat = self.planes.reshape(-1, self.planes.shape[2])
        return (np.column_stack([vectors, rest]) @ flat.T + self.offsets.reshape(-1)).reshape(len(vectors), *self.offsets.shape) / self.width

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket keys."""
        cells = np.floor(self.cells(vectors, False)).astype(np.int64).astype(np.uint64)
        return (cells * self.coefs).sum(axis=2).view(np.int64)

    def probes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) bucket keys in order of estimated success."""
        at = self.cells(vectors, True)
        floor = np.floor(at)
        part = at - floor
        base = (floor.astype(np.int64).astype(np.uint64) * self.coefs).sum(axis=2)
        edges = np.concatenate([part, 1 - part], axis=2)
        steps = np.broadcast_to(np.concatenate([np.uint64(0) - self.coefs, self.coefs], axis=1), edges.shape)
        ranked = np.take_along_axis(steps, np.argsort(edges, axis=2, kind="stable"), axis=2)
        ranked = np.concatenate([np.zeros((*ranked.shape[:2], 1), np.uint64), ranked], axis=2)
        out = np.empty((*base.shape, len(self.template)), dtype=np.uint64)
        for r in range(len(vectors)):
            out[r] = base[r][:, None] + ranked[r][:, self.template].sum(axis=2)
        return out.view(np.int64)


def calibrated(sample: np.ndarray, near: int, bound: float, rows: int) -> Hasher:
    """A hasher whose probes reach ``RECALL`` of the ``near`` nearest within the sample.

    K starts at what the row count suggests and is lowered until the recall is
    reached.  A template without probes says that no K reaches it.
    """
    start = int(np.clip(round(np.log2(max(rows, 2))), LEAST_K, MOST_K))
    trial = Hasher.build(sample.shape[1], start, bound, 1.0)
    spread = float(np.median(trial.cells(sample, False).std(axis=0))) * trial.width
    asked = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    queries = sample[asked]
    score = queries @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf  # its own bucket always holds a query: no evidence
    keep = min(near, len(sample) - 1)
    truth = np.argpartition(-score, keep, axis=1)[:, :keep]
    for k in range(start, LEAST_K - 1, -1):
        hasher = Hasher.build(sample.shape[1], k, bound, max(spread, 1e-9 * bound))
        hasher.template = probe_template(k, MOST_PROBES)
        first = _first_hits(hasher, sample, queries, truth)
        needed = int(np.quantile(first, RECALL, method="higher")) + 1 if first.size else 1
        if needed <= len(hasher.template):
            break
        needed = 0
    hasher.template = hasher.template[:needed]
    return hasher


def _first_hits(hasher: Hasher, sample: np.ndarray, queries: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """The first probe, over all tables, that finds each of the ``truth`` rows; the template's length if none does."""
    buckets, probes = hasher.buckets(sample), hasher.probes(queries)
    first = np.full(truth.shape, len(hasher.template))
    for q in range(len(queries)):
        for t in range(buckets.shape[1]):
            order = np.argsort(probes[q, t], kind="stable")
            sought = buckets[truth[q], t]
            place = np.minimum(np.searchsorted(probes[q, t], sought, sorter=order), len(order) - 1)
            hit = probes[q, t][order[place]] == sought
            first[q] = np.minimum(first[q], np.where(hit, order[place], len(hasher.template)))
    return first


def _vectors(column) -> np.ndarray:
    data = b"".join(column)
    return np.frombuffer(data, dtype=np.float64).reshape(len(column), -1)


def _group_of(keys: np.ndarray, table: np.ndarray | int, salt: np.ndarray | int, groups: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(salt).astype(np.uint64) + np.uint64(1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(33)) % np.uint64(groups)).astype(np.int64) + np.asarray(table) * groups


def _best(q: np.ndarray, x: np.ndarray, uid: np.ndarray, score: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, uid, exact score) of each query's ``near`` best by (score, smaller uid); -inf in ``score`` is no candidate.

    Every candidate within rounding of the cut takes part in the exact order, so
    ties at the cut go to the smaller uid however many there are.
    """
    keep = min(near, score.shape[1])
    cut = np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep]
    slip = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1).max())
    row, col = np.nonzero((score >= (cut - slip)[:, None]) & (score > -np.inf))
    exact = np.empty(len(row))
    for a in range(0, len(row), 65_536):
        part = slice(a, a + 65_536)
        exact[part] = (q[row[part]] * x[col[part]]).sum(axis=1)
    rank = np.lexsort((uid[col], -exact, row))
    row, col, exact = row[rank], col[rank], exact[rank]
    top = np.arange(len(row)) - np.searchsorted(row, row) < near
    return row[top], uid[col[top]], exact[top]


class _Group:
    """The vectors of one group, by bucket."""

    def __init__(self, uid: list, bucket: list, vec: list):
        bucket = np.concatenate(bucket)
        order = np.argsort(bucket, kind="stable")
        self.uid, self.x = np.concatenate(uid)[order], np.concatenate(vec)[order]
        self.names, self.begin = np.unique(bucket[order], return_index=True)
        self.end = np.append(self.begin[1:], len(bucket))

    def score(self, quid: np.ndarray, q: np.ndarray, keys: list, near: int) -> pa.RecordBatch:
        """Best ``near`` candidates of each query among the buckets it seeks (null: all)."""
        score = np.full((len(q), len(self.x)), -np.inf)
        visits = [np.zeros((2, 0), np.int64)]
        for r, sought in enumerate(keys):
            if sought is None:
                score[r] = self.x @ q[r]
                continue
            place = np.minimum(np.searchsorted(self.names, sought), len(self.names) - 1)
            place = np.unique(place[self.names[place] == sought])
            visits.append(np.stack([place, np.full(len(place), r)]))
        place, who = np.concatenate(visits, axis=1)
        order = np.argsort(place, kind="stable")
        place, who = place[order], who[order]
        cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            rows, span = who[c:d], slice(self.begin[place[c]], self.end[place[c]])
            score[rows, span] = q[rows] @ self.x[span].T
        row, uid, exact = _best(q, self.x, self.uid, score, near)
        return pa.RecordBatch.from_arrays([pa.array(quid[row]), pa.array(uid), pa.array(exact)], ["quid", "uid", "score"])


def _score_groups(near: int):
    """Rows (gid, split, kind, id, bucket, keys, vec) sorted by group, its vectors (kind 0) before its queries (kind 1)."""

    def run(batches):
        at, held, group = None, ([], [], []), None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(axis=1)))
            for a, b in zip(cuts, np.append(cuts[1:], len(name)), strict=True):
                if at != tuple(name[a, :2]):
                    at, held, group = tuple(name[a, :2]), ([], [], []), None
                part = batch.slice(a, b - a)
                ids, vecs = part.column(3).to_numpy(), _vectors(part.column(6).to_pylist())
                if name[a, 2] == 0:
                    for column, value in zip(held, (ids, part.column(4).to_numpy(), vecs), strict=True):
                        column.append(value)
                    continue
                if group is None and held[0]:
                    group = _Group(*held)
                    held = ([], [], [])
                if group is not None:
                    step = max(1, CELLS // len(group.x))
                    keys = part.column(5)
                    for c in range(0, len(ids), step):
                        sought = [None if k.values is None else k.values.to_numpy() for k in keys.slice(c, step)]
                        yield group.score(ids[c : c + step], vecs[c : c + step], sought, near)

    return run


class _Salts:
    """How many groups each salted bucket is dealt over."""

    def __init__(self, table: np.ndarray, bucket: np.ndarray, pieces: np.ndarray):
        order = np.lexsort((bucket, table))
        self.tables = [tuple(x[order][table[order] == t] for x in (bucket, pieces)) for t in range(TABLES)]

    def of(self, table: int, keys: np.ndarray) -> np.ndarray:
        bucket, pieces = self.tables[table]
        if not len(bucket):
            return np.ones(len(keys), dtype=np.int64)
        place = np.minimum(np.searchsorted(bucket, keys), len(bucket) - 1)
        return np.where(bucket[place] == keys, pieces[place], 1)


def nearest(vectors: DataFrame, queries: DataFrame, near: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``near`` nearest other rows found.

    ``queries`` holds ids (in ``id_col``) of rows of ``vectors``.  Nearest first,
    ties to the smaller id; score is the inner product in double precision.
    Rows take no part if the id or vector is null, the vector is zero or has a
    null or non-finite component, or its dimension is not the most frequent one
    (ties: the larger); of rows that share an id the one with the smallest
    vector counts.  A query with fewer than ``near`` other rows gets all of
    them; an empty table gives no row.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(fine)
    base = materialize(base.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    sizes = base.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes["dim"], sizes["count"]
    base = base.filter(F.size("vec") == dim)
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    own = base.groupBy("vec").agg(F.min("vec_id").alias("uid"), F.count(F.lit(1)).alias("rows"))
    own = materialize(own, "distinct-vectors")
    repeats = materialize(base.join(own.filter("rows > 1"), "vec").select("vec_id", "uid"), "equal-vectors")
    single = own.filter("rows = 1").select(F.col("uid").alias("vec_id"), "uid")
    query_ids = materialize(repeats.unionByName(single).join(asked, "vec_id", "left_semi"), "query-ids")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    facts = own.agg(F.max(norm).alias("bound"), F.count(F.lit(1)).alias("n")).first()
    draw = F.pmod(F.xxhash64("uid", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = own.filter(draw < SAMPLE / facts["n"]).select("vec").limit(2 * SAMPLE).collect()
    sample = np.array([r["vec"] for r in sample] or [own.select("vec").first()["vec"]], dtype=np.float64)
    hasher = spark.sparkContext.broadcast(calibrated(sample, near, facts["bound"], facts["n"]))
    groups = -(-facts["n"] // GROUP)
    hot_from = max(HOT, facts["n"] * TABLES // MOST_SALTED)

    def pack(batches):
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in v], pa.binary())], ["uid", "vec"])

    packed = materialize(own.select("uid", "vec").mapInArrow(pack, "uid long, vec binary"), "packed-vectors")

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = hasher.value.buckets(_vectors(batch.column(1).to_pylist()))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(keys[:, t])], ["uid", "vec", "tab", "bucket"])

    rows = packed.mapInArrow(index, "uid long, vec binary, tab int, bucket long")
    crowded = rows.groupBy("tab", "bucket").count().filter(F.col("count") > hot_from).toPandas()  # at most MOST_SALTED by the bound
    shipped = spark.sparkContext.broadcast(_Salts(crowded["tab"].to_numpy(), crowded["bucket"].to_numpy(), -(-crowded["count"].to_numpy() // hot_from)))

    def deal(batches):
        """Index rows to their groups."""
        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column(0).to_numpy()
            keys = hasher.value.buckets(_vectors(batch.column(1).to_pylist()))
            for t in range(TABLES):
                own = np.ascontiguousarray(keys[:, t])
                gid = _group_of(own, t, uid * 2654435761 % shipped.value.of(t, own), groups)
                yield pa.RecordBatch.from_arrays([pa.array(gid), batch.column(0), pa.array(own), batch.column(1)], ["gid", "uid", "bucket", "vec"])

    def ask(batches):
        """Queries to the groups that hold their probes, with the keys they seek there."""
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                vecs = part.column(1).to_pylist()
                probes = hasher.value.probes(_vectors(vecs))
                out = ([], [], [], [])
                for r, quid in enumerate(part.column(0).to_pylist()):
                    for t in range(TABLES):
                        pieces = shipped.value.of(t, probes[r, t])
                        keys = np.repeat(probes[r, t], pieces)
                        salt = np.arange(len(keys)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                        if not len(keys):
                            continue
                        gid = _group_of(keys, t, salt, groups)
                        order = np.argsort(gid, kind="stable")
                        names, first = np.unique(gid[order], return_index=True)
                        for g, sought in zip(names.tolist(), np.split(keys[order], first[1:]), strict=True):
                            for column, value in zip(out, (g, quid, sought, vecs[r]), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], ["gid", "quid", "keys", "vec"])

    asked_uids = query_ids.select("uid").distinct()
    n_queries = max(1, asked_uids.count())
    visits = min(len(hasher.value.template), groups) or groups  # without probes all queries meet all groups
    splits = -(-n_queries * visits // (groups * VISITS))
    indexed = packed.mapInArrow(deal, "gid long, uid long, bucket long, vec binary")
    wanted = packed.join(asked_uids, "uid", "left_semi")
    asking = wanted.repartition(max(8, min(2000, n_queries // 256))).mapInArrow(ask, "gid long, quid long, keys array<long>, vec binary")

    def scored(index_rows: DataFrame, query_rows: DataFrame) -> DataFrame:
        share = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))) if splits > 1 else F.lit(0).cast("long")
        index_rows = index_rows.select("gid", share.alias("split"), F.lit(0).cast("long").alias("kind"), F.col("uid").alias("id"), "bucket", F.lit(None).cast("array<long>").alias("keys"), "vec")
        share = F.pmod(F.xxhash64("quid"), F.lit(splits))
        query_rows = query_rows.select("gid", share.alias("split"), F.lit(1).cast("long").alias("kind"), F.col("quid").alias("id"), F.lit(0).cast("long").alias("bucket"), "keys", "vec")
        both = index_rows.unionByName(query_rows).repartition("gid", "split").sortWithinPartitions("gid", "split", "kind")
        return both.mapInArrow(_score_groups(near + 1), "quid long, uid long, score double")

    found = materialize(scored(indexed, asking), "candidates")
    weight = F.least(F.col("rows"), F.lit(near + 1))
    reach = found.select("quid", "uid").distinct().join(own.select("uid", weight.alias("rows")), "uid").groupBy("quid").agg(F.sum("rows").alias("n"))
    short = asked_uids.join(reach.filter(F.col("n") >= min(near + 1, total)).select(F.col("quid").alias("uid")), "uid", "left_anti")
    short = materialize(short, "short-queries")
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
        whole = packed.join(short, "uid", "left_semi").select(every.alias("gid"), F.col("uid").alias("quid"), F.lit(None).cast("array<long>").alias("keys"), "vec")
        more = scored(indexed.filter(F.col("gid") < groups), whole)
        found = found.unionByName(materialize(more, "exact-candidates"))
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "uid")
    top = found.groupBy("quid", "uid").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= near + 1)
    low = Window.partitionBy("uid").orderBy("vec_id")
    spread = materialize(repeats.withColumn("place", F.row_number().over(low)).filter(F.col("place") <= near + 1).select(F.col("uid").alias("of"), "vec_id"), "smallest-ids")
    full = top.join(spread, F.col("uid") == F.col("of"), "left").select("quid", F.coalesce("vec_id", "uid").alias("vec_id"), "score")
    lists = full.groupBy("quid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    lists = materialize(lists.select("quid", F.slice("near", 1, near + 1).alias("near")), "lists")
    each = query_ids.join(lists, query_ids["uid"] == lists["quid"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, near)
    return each.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
