"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is cut by balanced two-means splits; the means of the parts are the centroids. Every
vector goes to the list of its nearest centroid and, near a boundary, to further lists whose distance
is within a ratio of the nearest. Centroids are found by best-first search in a neighbour graph that
each task holds in memory. A query reads the lists whose centroid distance is within a second ratio,
chosen on the sample so that its true neighbours are found. Lists that lie near each other are one
bundle, and bundles meet their queries by shuffle: a query comes once to each bundle it reads, with the
names of its lists there. A list larger than a bundle, or a bundle that many queries read, is dealt out
to several groups.

Nearness is the inner product. One further component, the square root of (largest squared length less the vector's),
gives all vectors one length, so that the largest inner product is the smallest distance.

Equal vectors are one entry with its ``k + 1`` smallest ids: no answer can hold more of them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.session import dealt, materialise

from .common import small_batches

NEIGHBOURS = 20
#: Vectors in the fitting sample, about.
SAMPLE = 20_000
#: Vectors for which there is a list, and lists at most.
LIST = 256
MOST_LISTS = 16_384
#: Lists that one vector may be in, and how far beyond the nearest distance they may be.
REPLICAS = 4
REPLICA_RATIO = 1.1
#: Share of true neighbours that the sample's queries have to find.
TARGET = 0.98
#: Members and queries of one group, and numbers in the vectors of either, at most.
BLOCK = 32_768
QUERY_BLOCK = 32_768
CELLS = 1 << 21
#: Groups that there are at least, as far as lists go round.
BUNDLES = 64
DEGREE = 16
#: Centroids wanted at once from which the graph is walked in waves: one at a time sorts what was found as often.
WIDE = 64
SEED = 5


def usable(vector: Column, size: int) -> Column:
    """Not null, of the index's length, not all zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """Means of ``count`` parts of nearly equal size: the largest part is halved until there are enough."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < min(count, len(x)):
        parts.sort(key=len)
        part = parts.pop()
        own = x[part]
        ends = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            gap = _distances(own, ends)
            order = np.argsort(gap[:, 0] - gap[:, 1], kind="stable")
            half = len(own) // 2
            ends = np.stack([own[order[:half]].mean(0), own[order[half:]].mean(0)])
        parts += [part[order[:half]], part[order[half:]]]
    return np.stack([x[p].mean(0) for p in parts])


@dataclass
class CentroidGraph:
    """Centroids, and for each the places of its nearest ones and of a few others far away."""

    centroids: np.ndarray
    edges: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE, seed: int = SEED) -> CentroidGraph:
        n = len(centroids)
        near = min(degree, n - 1)
        edges = np.zeros((n, near), np.int64)
        for start in range(0, n, 1024):
            gap = _distances(centroids[start : start + 1024], centroids)
            gap[np.arange(len(gap)), np.arange(start, start + len(gap))] = np.inf
            edges[start : start + 1024] = np.argsort(gap, axis=1, kind="stable")[:, :near]
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        return cls(centroids, np.hstack([edges, far]))

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of about the ``width`` nearest centroids of each query, nearest first.

        All queries take a step together: each opens the nearest place that it has not opened and looks
        at its neighbours, until the ``width`` nearest seen are all open. Where many are wanted it opens all that wait.
        """
        n, rows = len(self.centroids), np.arange(len(queries))
        width = min(width, n)
        if width >= WIDE:
            some = max(1, CELLS // n)
            found = [self._waves(queries[k : k + some], width) for k in range(0, len(queries), some)]
            return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        seen = np.zeros((len(queries), n), bool)
        starts = np.linspace(0, n - 1, min(8, n)).astype(np.int64)
        places = np.full((len(queries), width + self.edges.shape[1]), -1)
        gaps = np.full(places.shape, np.inf)
        first = _distances(queries, self.centroids[starts])
        m = min(len(starts), width)
        order = np.argsort(first, axis=1, kind="stable")[:, :m]
        places[:, :m], gaps[:, :m] = starts[order], np.take_along_axis(first, order, 1)
        seen[:, starts] = True
        open_ = np.zeros(places.shape, bool)
        lengths = (self.centroids * self.centroids).sum(1)
        own = (queries * queries).sum(1)
        for _ in range(n):
            waiting = np.where(open_[:, :width], np.inf, gaps[:, :width])
            at = waiting.argmin(1)
            active = np.flatnonzero(np.isfinite(waiting[rows, at]))
            if not len(active):
                break
            at = at[active]
            open_[active, at] = True
            reached = self.edges[places[active, at]]
            new = ~seen[active[:, None], reached]
            # A place that is met twice in one step counts once.
            ordered = np.sort(np.where(new, reached, -1), axis=1)
            new = (ordered >= 0) & np.hstack([np.ones((len(ordered), 1), bool), ordered[:, 1:] != ordered[:, :-1]])
            reached = np.where(new, ordered, 0)
            dots = np.einsum("qed,qd->qe", self.centroids[reached], queries[active])
            gap = np.maximum(own[active][:, None] + lengths[reached] - 2 * dots, 0)
            seen[np.repeat(active, new.sum(1)), reached[new]] = True
            places[active, width:] = np.where(new, reached, -1)
            gaps[active, width:] = np.where(new, gap, np.inf)
            open_[active, width:] = False
            order = np.argsort(gaps[active], axis=1, kind="stable")
            for table in (places, gaps, open_):
                table[active] = np.take_along_axis(table[active], order, 1)
        return places[:, :width], np.sqrt(gaps[:, :width])

    def _waves(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same in fewer steps: one opens all that wait, and what was seen is not kept in order."""
        every = _distances(queries, self.centroids)
        seen, opened = np.zeros(every.shape, bool), np.zeros(every.shape, bool)
        seen[:, np.linspace(0, len(self.centroids) - 1, min(8, len(self.centroids))).astype(np.int64)] = True
        while True:
            gaps = np.where(seen, every, np.inf)
            waiting = seen & ~opened & (gaps <= np.partition(gaps, width - 1, axis=1)[:, width - 1 : width])
            row, place = np.nonzero(waiting)
            if not len(row):
                break
            opened |= waiting
            seen[row[:, None], self.edges[place]] = True
        places = np.argsort(gaps, axis=1, kind="stable")[:, :width]
        gaps = np.take_along_axis(gaps, places, 1)
        return np.where(np.isfinite(gaps), places, -1), np.sqrt(gaps)


@dataclass
class PostingIndex:
    """Lists (list, rep, ids, v) on disk, and what every task needs to find lists.

    A list is in ``parts`` bundles from ``first`` on, by the hash of ``rep``.
    """

    lists: DataFrame
    entries: DataFrame
    members: DataFrame
    graph: CentroidGraph
    longest: float
    ratio: float
    width: int
    first: np.ndarray
    parts: np.ndarray
    neighbours: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        return _lift(x, self.longest)

    def aim(self, x: np.ndarray) -> np.ndarray:
        return _aim(x, self.longest)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def _aim(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries of the stored length: only their direction decides what is nearest."""
    return np.hstack([x * (longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))])


def _chosen(places: np.ndarray, gaps: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """Which of the found centroids are within the ratio of the nearest; the nearest always is."""
    near = gaps <= gaps[:, :1] * ratio + 1e-12
    near[:, 0] = True
    near[:, most:] = False
    return near & (places >= 0)


def _tour(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places ``at`` in an order in which near ones are close together: halves by the widest coordinate."""
    if len(at) < 3:
        return at
    own = x[at]
    at = at[np.argsort(own[:, own.var(0).argmax()], kind="stable")]
    return np.concatenate([_tour(x, at[: len(at) // 2]), _tour(x, at[len(at) // 2 :])])


def _bundles(counts: np.ndarray, tour: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of each list: bundles of at most about ``most`` members, in the order of the tour."""
    first, parts = np.zeros(len(counts), np.int64), np.maximum(-(-counts // most), 1)
    bundle, held = -1, most + 1
    for k in tour:
        if parts[k] > 1 or held + counts[k] > most:
            bundle, held = bundle + 1, 0
        first[k] = bundle
        held += counts[k]
        bundle += parts[k] - 1
    return first, parts


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """Entries (rep, ids, v) of distinct vectors, and members (id, rep) of every row that takes part.

    Only vectors whose hash occurs twice are compared whole. Their ids are cut to the ``keep`` smallest
    in salted groups first, so that no task sees all copies of one vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"), size)).withColumn("h", F.xxhash64("v"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    counts = materialise(counts, "repeated-vectors")
    single = rows.join(counts, "h", "left_anti").select(F.col("id").alias("rep"), F.array("id").alias("ids"), "v")
    copies = rows.join(counts, "h", "left_semi")
    rank = F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))
    salted = copies.groupBy("h", "v", "id").agg(F.lit(1)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = salted.withColumn("rank", rank).where(F.col("rank") <= keep)
    several = some.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"))
    several = several.select("h", F.element_at("ids", 1).alias("rep"), "ids", "v")
    several = materialise(several, "copied-vectors")
    entries = materialise(single.unionByName(several.select("rep", "ids", "v")), "distinct-vectors")
    many = copies.join(several.select("h", "v", "rep"), ["h", "v"]).select("id", "rep").distinct()
    members = single.select(F.col("rep").alias("id"), "rep").unionByName(many)
    return entries, members


def build_index(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    neighbours: int = NEIGHBOURS,
    sample: int = SAMPLE,
    list_size: int = LIST,
) -> PostingIndex | None:
    """Index every usable vector; None if there is none.

    Null vectors and ids, vectors of zeros, with null or non-finite components, or of another length than
    most take no part. Rows that repeat an id and its vector count once.
    """
    sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("size")).count()
    # Vector lengths, not rows: the most frequent, the larger one if two are.
    top = sizes.where("size > 0").orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not top:
        return None
    size = top[0]["size"]
    entries, members = distinct_vectors(vectors, id_col, vector_col, size, neighbours + 1)
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    known = entries.agg(F.count(F.lit(1)).alias("n"), F.max(squared).alias("longest")).first()
    if not known["n"]:
        return None
    longest, n = float(np.sqrt(known["longest"])) * (1 + 1e-12), known["n"]
    share = min(1.0, sample / n)
    drawn = entries.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    table = drawn.orderBy("rep").select("v").toArrow()
    points = _lift(_matrix(table.column("v").combine_chunks(), size), longest)
    count = int(np.clip(-(-n // list_size), 1, min(MOST_LISTS, max(len(points) // 4, 1))))
    graph = CentroidGraph.build(balanced_centroids(points, count))
    ratio, width = _tune(graph, points, longest, neighbours)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            places, gaps = graph.search(_lift(_matrix(batch.column("v"), size), longest), 4 * REPLICAS)
            row, at = np.nonzero(_chosen(places, gaps, REPLICA_RATIO, REPLICAS))
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[row, at]), *taken.columns], names=["list", "rep", "ids", "v"]
            )

    placed = entries.select("rep", "ids", "v").mapInArrow(place, "list long, rep long, ids array<long>, v array<double>")
    placed = materialise(placed, "posting-lists")
    counts = np.zeros(len(graph.centroids), np.int64)
    # A row per list, at most MOST_LISTS.
    for r in placed.groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    most = max(1, min(BLOCK, CELLS // size, max(int(counts.sum()) // BUNDLES, REPLICAS * list_size)))
    first, parts = _bundles(counts, _tour(graph.centroids, np.arange(len(counts))), most)
    return PostingIndex(placed, entries, members, graph, longest, ratio, width, first, parts, neighbours)


def _tune(graph: CentroidGraph, points: np.ndarray, longest: float, neighbours: int) -> tuple[float, int]:
    """The ratio, and the number of lists to look for, at which sampled queries find their neighbours.

    Queries and neighbours are those of the sample alone. In all data neighbours are nearer, so they
    share lists at least as often.
    """
    rng = np.random.default_rng(SEED)
    asked = rng.choice(len(points), min(300, len(points)), replace=False)
    queries = _aim(points[asked][:, :-1], longest)
    near = _distances(queries, points)
    near[np.arange(len(asked)), asked] = np.inf
    count = min(neighbours, len(points) - 1)
    if not count:
        return 1.0, 1
    truth = np.argpartition(near, count - 1, axis=1)[:, :count]
    found = [graph.search(points[k : k + 1024], 4 * REPLICAS) for k in range(0, len(points), 1024)]
    places, gaps = (np.concatenate(x) for x in zip(*found))
    kept = np.where(_chosen(places, gaps, REPLICA_RATIO, REPLICAS), places, -1)[:, :REPLICAS]
    to_lists = np.sqrt(_distances(queries, graph.centroids))
    ranks = to_lists.argsort(1).argsort(1)
    rows = np.arange(len(asked))[:, None, None]
    lists = kept[truth]
    gap = np.where(lists >= 0, to_lists[rows, lists], np.inf)
    nearest = gap.argmin(2)
    best = np.take_along_axis(gap, nearest[:, :, None], 2)[:, :, 0] / np.maximum(to_lists.min(1), 1e-12)[:, None]
    rank = np.take_along_axis(np.where(lists >= 0, ranks[rows, lists], len(graph.centroids)), nearest[:, :, None], 2)
    ratio = float(np.quantile(best, TARGET))
    within = rank[:, :, 0][best <= ratio]
    width = int(np.max((to_lists <= to_lists.min(1)[:, None] * ratio).sum(1)))
    return ratio, max(width, int(within.max(initial=0)) + 1, 1)


def _best(
    query: np.ndarray, x: np.ndarray, some: np.ndarray, reps: np.ndarray, count: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``some`` of ``x`` those with the ``count`` largest inner products, nearest first, ties to the smaller rep; and those products."""
    exact = (x[some] * query).sum(1)
    order = np.lexsort((reps[some], -exact))[:count]
    return some[order], exact[order]


def _bits(flags: np.ndarray) -> np.ndarray:
    """The flags of each row as 64-bit words."""
    flags = np.pad(flags, ((0, 0), (0, -flags.shape[1] % 64)))
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def _edges(rough: np.ndarray, keep: int) -> np.ndarray:
    """A number for each row that its ``keep`` largest are not below: that of the largest of 64 parts, if there are enough."""
    parts = rough.shape[1] // 64
    if parts > keep:
        rough = rough[:, : 64 * parts].reshape(len(rough), 64, parts).max(1)
    if rough.shape[1] <= keep:
        return np.full(len(rough), -np.inf)
    return np.partition(rough, rough.shape[1] - keep, axis=1)[:, rough.shape[1] - keep]


def _readable(
    q: np.ndarray, reads: np.ndarray, x: np.ndarray, held: np.ndarray, keep: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(place of a query, rows of ``x`` among which its ``keep`` largest inner products are).

    A query reads the entries of its lists: ``reads`` is true where a query reads a list, ``held`` where a row
    of ``x`` is in one. A block of products rounds as it likes; all rows within that rounding of the last
    place are given, to be summed pair by pair, so that equal products stay equal whatever block they are in.
    """
    slack = 1e-12 * q.shape[1] * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    # Queries of the same lists are neighbours, so that a block reads few lists beside its own.
    order = np.argsort(reads.argmax(1), kind="stable")
    asks, holds = _bits(reads), _bits(held)
    rows = max(1, CELLS // len(x))
    for start in range(0, len(order), rows):
        some = order[start : start + rows]
        columns = np.flatnonzero((holds & np.bitwise_or.reduce(asks[some], axis=0)).any(1))
        near, words = (x, holds) if len(columns) == len(x) else (x[columns], holds[columns])
        apart = np.ones((len(some), len(columns)), bool)
        for k in range(words.shape[1]):
            apart &= (asks[some, k][:, None] & words[:, k]) == 0
        rough = q[some] @ near.T
        np.copyto(rough, -np.inf, where=apart)
        close = ~apart & (rough >= (_edges(rough, keep) - slack[some])[:, None])
        for k, place in enumerate(some.tolist()):
            yield place, columns[np.flatnonzero(close[k])]


def search(index: PostingIndex, queries: DataFrame, times: int = 1) -> DataFrame:
    """(rep, ids, scores): for each entry ``rep`` in ``queries`` its nearest ids, its own among them.

    One more than ``index.neighbours`` are given, since a query leaves itself out. Scores are inner
    products of the original vectors in double precision, ties to the smaller id. With ``times`` above 1
    that many times the lists are read, whatever their distance.
    """
    keep, ratio, width, first, parts = index.neighbours + 1, index.ratio, index.width, index.first, index.parts
    width = min(width * times, len(parts))
    graph, longest = index.graph, index.longest
    size = graph.centroids.shape[1] - 1
    asked = index.entries.select("rep", "v").join(queries.select("rep").distinct(), "rep", "left_semi")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            points = _aim(_matrix(batch.column("v"), size), longest)
            if times > 1 and width == len(parts):
                places = np.broadcast_to(np.arange(width), (len(points), width))
                chosen = np.ones(places.shape, bool)
            else:
                places, gaps = graph.search(points, width)
                chosen = _chosen(places, gaps, ratio, width) if times == 1 else (places >= 0) & np.isfinite(gaps)
            row, at = np.nonzero(chosen)
            again = parts[places[row, at]]
            row, lists = np.repeat(row, again), np.repeat(places[row, at], again)
            bundle = first[lists] + np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
            order = np.lexsort((lists, bundle, row))
            row, lists, bundle = row[order], lists[order], bundle[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(bundle, prepend=-1))
            ends = np.append(starts[1:], len(row))
            # A vector comes once for each bundle that it reads: so few rows go out at once.
            some = max(1, CELLS // (4 * size))
            for k in range(0, len(starts), some):
                own, low = starts[k : k + some], starts[k]
                offsets = np.append(own, ends[k : k + some][-1]) - low
                names = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists[low : low + offsets[-1]]))
                taken = batch.take(pa.array(row[own]))
                yield pa.RecordBatch.from_arrays([pa.array(bundle[own]), names, *taken.columns], names=["bundle", "lists", "rep", "v"])

    # Few bytes, much work: merged by bytes they would be a task or two.
    probes = dealt(asked).mapInArrow(probe, "bundle long, lists array<long>, rep long, v array<double>")
    probes = materialise(probes, "list-probes")
    most = max(1, min(QUERY_BLOCK, CELLS // size))
    # A row per bundle that many queries read; there are no more bundles than lists and parts of lists.
    many = probes.groupBy("bundle").count().where(F.col("count") > most).collect()
    spark = index.lists.sparkSession
    kind = pa.schema([("bundle", pa.int64()), ("turns", pa.int64())])
    turns = [(r["bundle"], -(-r["count"] // most)) for r in many]
    turns = F.broadcast(spark.createDataFrame(pa.table({"bundle": [t[0] for t in turns], "turns": [t[1] for t in turns]}, schema=kind)))
    turn = F.coalesce("turns", F.lit(1).cast("long"))
    sized = F.broadcast(spark.createDataFrame(pa.table({"list": np.arange(len(parts)), "first": first, "parts": parts})))
    members = index.lists.join(sized, "list").withColumn("bundle", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")))
    members = members.join(turns, "bundle", "left").select(
        "bundle", F.explode(F.sequence(F.lit(0).cast("long"), turn - 1)).alias("turn"), "list", "rep", "ids", "v"
    )
    probes = probes.join(turns, "bundle", "left").select(
        "bundle", F.pmod(F.xxhash64("rep"), turn).alias("turn"), "lists", "rep", "v"
    )

    def score(asked: pa.Table, stored: pa.Table) -> pa.Table:
        names, offsets, out_ids, out_scores = array("q"), array("i", [0]), array("q"), array("d")
        if asked.num_rows and stored.num_rows:
            q = _matrix(asked.column("v").combine_chunks(), size)
            x = _matrix(stored.column("v").combine_chunks(), size)
            reps = stored.column("rep").to_numpy()
            # An entry may be in several lists of the bundle; two entries may have one rep.
            keys = np.ascontiguousarray(np.hstack([reps[:, None].view(np.float64), x])).view(f"V{8 * (size + 1)}").ravel()
            _, one, entry = np.unique(keys, return_index=True, return_inverse=True)
            known, place = np.unique(stored.column("list").to_numpy(), return_inverse=True)
            x, reps = x[one], reps[one]
            held = np.zeros((len(one), len(known)), bool)
            held[entry, place] = True
            ids = stored.column("ids").combine_chunks().take(pa.array(one)).to_pylist()
            wanted = asked.column("lists").combine_chunks()
            row = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
            wanted = wanted.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            reads = np.zeros((len(q), len(known)), bool)
            # A list without members in this part of it is not known here.
            reads[row[known[at] == wanted], at[known[at] == wanted]] = True
            asking = asked.column("rep").to_numpy().tolist()
            for k, some in _readable(q, reads, x, held, keep):
                best, exact = _best(q[k], x, some, reps, keep)
                pairs = [(i, s) for c, s in zip(best.tolist(), exact.tolist()) for i in ids[c]]
                pairs.sort(key=lambda p: (-p[1], p[0]))
                names.append(asking[k])
                out_ids.extend(p[0] for p in pairs[:keep])
                out_scores.extend(p[1] for p in pairs[:keep])
                offsets.append(len(out_ids))
        cut = pa.array(np.array(offsets, np.int32))
        columns = [pa.ListArray.from_arrays(cut, pa.array(np.array(c, t))) for c, t in ((out_ids, np.int64), (out_scores, np.float64))]
        return pa.table([pa.array(np.array(names, np.int64)), *columns], ["rep", "ids", "scores"])

    keys = ("bundle", "turn")
    kind = "rep long, ids array<long>, scores array<double>"
    found = probes.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(score, kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pairs = None, {}

        def out() -> pa.RecordBatch:
            best = sorted(pairs.items(), key=lambda p: (-p[1], p[0][0]))[:keep]
            return pa.RecordBatch.from_pylist(
                [{"rep": current, "ids": [p[0][0] for p in best], "scores": [p[1] for p in best]}],
                pa.schema([("rep", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]),
            )

        for batch in batches:
            for rep, ids, scores in zip(*[c.to_pylist() for c in batch.columns]):
                if rep != current:
                    if current is not None:
                        yield out()
                    current, pairs = rep, {}
                # An entry in two lists has one score; an id with two vectors has two.
                pairs.update({(i, s): s for i, s in zip(ids, scores)})
                if len(pairs) > 64 * keep:
                    pairs = dict(sorted(pairs.items(), key=lambda p: (-p[1], p[0][0]))[:keep])
        if current is not None:
            yield out()

    return found.repartition("rep").sortWithinPartitions("rep").mapInArrow(merge, kind)


def nearest(
    vectors: DataFrame,
    asked: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    neighbours: int = NEIGHBOURS,
    sample: int = SAMPLE,
    list_size: int = LIST,
) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``asked`` (on ``id``) holds, its nearest other rows.

    Queries whose lists hold too few candidates read further ones, eight times as many each time, until
    they have ``neighbours`` rows or have read every list. Equal vectors are searched for once. Queries that do not take part, see :func:`build_index`, and an
    empty table give no rows.
    """
    index = build_index(vectors, id_col, vector_col, neighbours, sample, list_size)
    kind = f"query_id long, rank int, {id_col} long, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], kind)
    queries = index.members.where(asked)
    found = materialise(search(index, queries), "list-answers")
    there = index.members.select("id").distinct().count()
    times, wanted, everything = 1, min(index.neighbours + 1, there), False
    while not everything:
        few = materialise(found.where(F.size("ids") < wanted).select("rep"), "short-answers")
        if few.isEmpty():
            break
        times *= 8
        everything = index.width * times >= len(index.parts)
        more = search(index, few, times)
        found = materialise(found.join(few, "rep", "left_anti").unionByName(more), "list-answers")
    met = queries.join(found, "rep")
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda p: p["ids"] != F.col("id"))
    best = F.slice(pairs, 1, neighbours)
    return met.select(F.col("id").alias("query_id"), F.posexplode(best).alias("place", "p")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("p.ids").alias(id_col), F.col("p.scores").alias("score")
    )
