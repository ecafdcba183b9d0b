"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector x to the cells floor((a_k . x + b_k) / w) of m Gaussian projections (2-stable: their
differences are spread as the distance is). A query visits its own bucket and perturbed ones, in the order of their
estimated success: the squared distances from its projections to the borders crossed, summed, least first. Candidates
of all tables are merged and ranked by exact cosine in double precision on the original vectors.

m and the number of probes are fitted: for a bounded sample of queries the true neighbours are found by a scan in
blocks; of all m, with as many probes as reach `recall` for these (at most MOST_PROBES of a table), the one is taken
that visits the least share of a bounded background sample. Every row is indexed, whatever the sample.

A bucket of many rows is split by vector id and met in each part. Spark partitions hold whole bucket parts; a task
keeps the rows of one shard (about SHARD) in memory and passes the queries that come to it in batches, so its memory
depends neither on the rows nor on the queries. A shard returns the best k for each query, never all pairs, in order of
the exact score and the id: ties are settled before anything is left out. A query that found fewer than k takes all
rows, in parts.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components
take no part; repeated rows (equal id and vector) count once; ids null take no part; ties go to the smaller id; a
query without any other row has no result; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, quoted, small

#: Rows of a bucket that meet their queries in one part, and bucket rows of a shard (on average).
PART, SHARD = 8192, 32768
#: The tables, the width of their cells (unit vectors lie at most 2 apart), and most probes of a table.
TABLES, WIDTH, MOST_PROBES = 8, 3.0, 16
#: Bounds of the samples that m and the probes are fitted on, and the recall they are fitted for.
SAMPLE_QUERIES, SAMPLE_ROWS, RECALL = 64, 4096, 0.95
#: Queries of a step against a shard.
STEP = 256


class Hashing:
    """The tables of one dimension, the same wherever they are made. Without projections (m = 0) all is one bucket."""

    def __init__(self, dim: int, m: int, probes: int = 1, tables: int = TABLES, seed: int = 11):
        rng = np.random.default_rng(seed + m)
        self.m, self.probes, self.tables = m, probes, tables
        self.a = rng.standard_normal((tables, dim, m))
        self.b = rng.random((tables, m)) * WIDTH
        self.mix = rng.integers(1, 2**62, m, dtype=np.int64) | 1

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables, n, m) cells and where in them, from 0 to 1, the unit vectors lie."""
        at = (np.einsum("nd,tdm->tnm", x, self.a, optimize=True) + self.b[:, None, :]) / WIDTH
        cell = np.floor(at).astype(np.int64)
        return cell, at - cell

    def codes(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(axis=-1)

    def order(self, inside: np.ndarray) -> np.ndarray:
        """(probes, m) steps of -1, 0 or 1, from the most to the least promising, by the shift-and-expand heap."""
        m = self.m
        if not m:
            return np.zeros((1, 0), dtype=np.int64)
        cost = np.concatenate([inside**2, (1 - inside) ** 2])
        rank = np.argsort(cost)
        z, dims, signs = cost[rank].tolist(), (rank % m).tolist(), np.where(rank < m, -1, 1).tolist()
        out = np.zeros((self.probes, m), dtype=np.int64)
        heap, n = [(z[0], (0,))], 1
        while heap and n < self.probes:
            s, picked = heapq.heappop(heap)
            last = picked[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (s - z[last] + z[last + 1], (*picked[:-1], last + 1)))
                heapq.heappush(heap, (s + z[last + 1], (*picked, last + 1)))
            if len({dims[i] for i in picked}) == len(picked):
                for i in picked:
                    out[n, dims[i]] = signs[i]
                n += 1
        return out[:n]

    def first_probe(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(queries, rows): the earliest probe, over all tables, that meets each of a query's rows (queries, rows, dim);
        `probes` where none does."""
        out = np.full(rows.shape[:2], self.probes)
        cells, inside = self.cells(queries)
        there = self.cells(rows.reshape(-1, rows.shape[-1]))[0].reshape(self.tables, *rows.shape[:2], self.m)
        power = 3 ** np.arange(self.m)
        for t in range(self.tables):
            for i in range(len(queries)):
                code = ((self.order(inside[t, i]) + 1) * power).sum(axis=1)
                by = np.argsort(code)
                step = there[t, i] - cells[t, i]
                near = (np.abs(step) <= 1).all(axis=1)
                want = ((np.clip(step, -1, 1) + 1) * power).sum(axis=1)
                place = np.minimum(np.searchsorted(code[by], want), len(by) - 1)
                hit = near & (code[by][place] == want)
                out[i] = np.minimum(out[i], np.where(hit, by[place], self.probes))
        return out


def fitted(queries: np.ndarray, neighbours: np.ndarray, background: np.ndarray, recall: float = RECALL) -> tuple[Hashing, float]:
    """The hashing that visits the least share of the rows, and that share. queries (q, d), their true neighbours
    (q, k, d) and background (n, d) are units. Each query is compared with its part of the background."""
    best = None
    each = background[: len(background) // len(queries) * len(queries)].reshape(len(queries), -1, background.shape[1])
    k = neighbours.shape[1]
    for m in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 24):
        most = min(3**m, MOST_PROBES)
        first = Hashing(queries.shape[1], m, most)
        first = first.first_probe(queries, np.concatenate([neighbours, each], axis=1))
        reached = np.sort(first[:, :k].ravel())
        need = int(reached[int(np.ceil(recall * reached.size)) - 1]) + 1
        if need > most and m < 8:
            continue
        share = float((first[:, k:] < need).mean()) if each.shape[1] else 1.0
        if best and need > most:
            break  # more projections need still more probes
        if need <= most and (best is None or share < best[1]):
            best = Hashing(queries.shape[1], m, need), share
    return best if best else (Hashing(queries.shape[1], 0, tables=1), 1.0)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """(n, dim) doubles of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Powers of two bring the largest components near 1 without changing any digit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _sums(products) -> np.ndarray:
    """Summed from the first to the last, so that a score is the same in every task."""
    total = 0.0
    for p in products:
        total = total + p
    return total


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosines of scaled vectors with scaled vectors, row by row, in double precision."""
    dims = range(q.shape[1])
    dot = _sums(q[:, j] * x[:, j] for j in dims)
    return dot / (np.sqrt(_sums(q[:, j] * q[:, j] for j in dims)) * np.sqrt(_sums(x[:, j] * x[:, j] for j in dims)))


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v of the vectors that take part, each once."""
    v = F.col(quoted(embedding))
    inf = float("inf")
    fine = F.col(quoted(vec_id)).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    good = df.filter(F.coalesce(fine, F.lit(False))).select(F.col(quoted(vec_id)).alias("id"), v.alias("v"))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.filter(F.size("v") == (lengths[0].d if lengths else 0)).dropDuplicates(["id", "v"])


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _batch(q: np.ndarray, i: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


#: How far apart equal scores may seem by rounding, and candidates of a step that are kept before they are settled.
MARGIN, PENDING = 1e-9, 1 << 19


class _Best:
    """The best k of each query of a step: near scores find what may be among them, exact ones decide."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.scaled, self.unit, self.k = ids, _scaled(vectors), _unit(vectors), k
        self.floor = np.full(len(ids), -np.inf)  # at most the k-th best near score
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # queries, rows, near scores
        self.n = 0
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # queries, ids, exact scores

    def meet(self, who: np.ndarray, rows: np.ndarray, ids: np.ndarray, scaled: np.ndarray, unit: np.ndarray) -> None:
        """Queries meet some rows of a shard."""
        near = self.unit[who] @ unit[rows[0] : rows[-1] + 1].T
        near[self.ids[who][:, None] == ids[rows][None, :]] = -np.inf
        if near.shape[1] > self.k:
            self.floor[who] = np.maximum(self.floor[who], np.partition(near, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((near >= self.floor[who][:, None] - MARGIN) & (near > -np.inf))
        self.pending.append((who[q], rows[c], near[q, c]))
        self.n += len(q)
        if self.n > PENDING:
            self.settle(ids, scaled)

    def settle(self, ids: np.ndarray, scaled: np.ndarray) -> None:
        """The best k by exact score, then id, of what was found and what is pending."""
        if not self.pending:
            return
        q, c, near = (np.concatenate(x) for x in zip(*self.pending))
        self.pending, self.n = [], 0
        keep = near >= self.floor[q] - MARGIN
        q, c = q[keep], c[keep]
        q, c = np.unique(np.stack([q, c]), axis=1)
        score = np.concatenate([exact(self.scaled[q[i : i + 4096]], scaled[c[i : i + 4096]]) for i in range(0, len(q), 4096)]) if len(q) else np.zeros(0)
        q, v, score = (np.concatenate(x) for x in zip(self.found, (q, ids[c], score)))
        by = np.lexsort((v, -score, q))
        q, v, score = q[by], v[by], score[by]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, score = q[new], v[new], score[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.found = q[rank < self.k], v[rank < self.k], score[rank < self.k]

    def rows(self, ids: np.ndarray, scaled: np.ndarray) -> pa.RecordBatch:
        self.settle(ids, scaled)
        q, v, score = self.found
        return _batch(self.ids[q], v, score)


def scan(members: DataFrame, queries: list[tuple[int, list]], k: int) -> DataFrame:
    """query_id, vec_id, score: the exact k nearest of a few queries (in the task's code), in blocks of rows."""
    dim = len(queries[0][1]) if queries else 1
    own_ids = np.array([q for q, _ in queries], dtype=np.int64)
    own = np.array([v for _, v in queries], dtype=np.float64).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(own_ids, own, k)
        for batch in batches:
            if batch.num_rows:
                x, ids = _vectors(batch.column(1), dim), batch.column(0).to_numpy()
                scaled = _scaled(x)
                best.meet(np.arange(len(own_ids)), np.arange(len(ids)), ids, scaled, _unit(x))
                best.settle(ids, scaled)
        q, v, score = best.found
        yield _batch(own_ids[q], v, score)

    return members.select("id", "v").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, each row once; different parts give a pair the same score."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def fit(vectors: DataFrame, members: DataFrame, query: str, dim: int, k: int) -> Hashing:
    """The hashing for these rows, from samples of bounded size drawn by hash."""
    sample = lambda df, n, seed: df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    queries = [(r.id, r.v) for r in sample(vectors.filter(query), SAMPLE_QUERIES, 1).collect()]
    if not queries:
        return Hashing(dim, 0, tables=1)
    background = np.array([r.v for r in sample(members, SAMPLE_ROWS, 2).select("v").collect()], dtype=np.float64)
    near = _ranked(scan(members, queries, k), k).select("query_id", "vec_id").collect()  # at most k for each sampled query
    ids = members.filter(F.col("id").isin(sorted({r.vec_id for r in near}))).dropDuplicates(["id"]).collect() if near else []
    of = {r.id: r.v for r in ids}
    by: dict[int, list] = {}
    for r in near:
        by.setdefault(r.query_id, []).append(of[r.vec_id])
    full = [(v, by[q]) for q, v in queries if len(by.get(q, ())) == k]
    if not full:
        return Hashing(dim, 0, tables=1)
    unit = lambda x: _unit(np.array(x, dtype=np.float64))
    return fitted(unit([v for v, _ in full]), unit([n for _, n in full]), _unit(background))[0]


def search(members: DataFrame, queries: DataFrame, hashing: Hashing, rows: int, dim: int, k: int, part: int = PART, shard_rows: int = SHARD) -> DataFrame:
    """query_id, vec_id, score: the best k of each shard that a query (id, v) visits."""
    vector = members.schema["v"].dataType

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = hashing.codes(hashing.cells(_unit(_vectors(batch.column(1), dim)))[0])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.T.tolist(), type=pa.list_(pa.int64()))], names=["id", "v", "codes"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                cells, inside = hashing.cells(_unit(_vectors(batch.column(1), dim)))
                codes = [[hashing.codes(cells[t, i] + hashing.order(inside[t, i])).tolist() for t in range(hashing.tables)] for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, type=pa.list_(pa.list_(pa.int64())))], names=["id", "v", "codes"])

    longs = T.ArrayType(T.LongType())
    schema = lambda codes: T.StructType([T.StructField("id", T.LongType()), T.StructField("v", vector), T.StructField("codes", codes)])
    index = cut_lineage(members.select("id", "v").mapInArrow(hashed, schema(longs)))
    placed = index.select("id", "v", F.posexplode("codes").alias("t", "code"))
    heavy = cut_lineage(placed.groupBy("t", "code").count().filter(F.col("count") > part).select("t", "code", F.ceil(F.col("count") / part).cast("int").alias("parts")))
    n_heavy = heavy.count()
    asked = cut_lineage(queries.select("id", "v").mapInArrow(probed, schema(T.ArrayType(longs))))
    visits = asked.select("id", F.posexplode("codes").alias("t", "codes")).select("id", "t", F.explode("codes").alias("code"))
    parts = F.lit(1)
    if n_heavy:
        placed, visits = (x.join(small(heavy, n_heavy), ["t", "code"], "left") for x in (placed, visits))
        parts = F.coalesce("parts", F.lit(1))
    # A query comes to a shard once, with the codes of all buckets it visits there.
    shards = max(1, -(-rows * hashing.tables // shard_rows))
    shard = lambda salt: F.pmod(F.xxhash64("t", "code", salt), F.lit(shards)).cast("int").alias("shard")
    side = placed.withColumn("s", F.pmod(F.xxhash64("id"), parts).cast("int")).select(shard(F.col("s")), F.lit(0).alias("kind"), "id", "v", F.array(F.xxhash64("t", "code", "s")).alias("codes"))
    visits = visits.withColumn("s", F.explode(F.sequence(F.lit(0), parts - 1))).select("id", shard(F.col("s")), F.xxhash64("t", "code", "s").alias("b"))
    visits = visits.groupBy("id", "shard").agg(F.collect_list("b").alias("codes"))
    ask = visits.join(asked.select("id", "v"), "id").select("shard", F.lit(1).alias("kind"), "id", "v", "codes")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a shard come first, then its queries, which are answered step by step."""
        now, held, ready = None, [], None

        def prepare():
            """The shard's rows by bucket: codes, where each begins, ids and vectors."""
            ids, x, codes = (np.concatenate(c) for c in zip(*held))
            by = np.argsort(codes, kind="stable")
            codes, starts = np.unique(codes[by], return_index=True)
            return codes, np.append(starts, len(by)), ids[by], _scaled(x[by]), _unit(x[by])

        for batch in batches:
            shard_of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if shard_of[a] != now:
                    now, held, ready = shard_of[a], [], None
                if kinds[a] == 0:
                    own = batch.slice(a, b - a)
                    held.append((own.column(2).to_numpy(), _vectors(own.column(3), dim), own.column(4).flatten().to_numpy()))
                    continue
                if not held:
                    continue
                ready = ready or prepare()
                codes, starts, ids, scaled, unit = ready
                for at in range(a, b, STEP):
                    own = batch.slice(at, min(STEP, b - at))
                    best = _Best(own.column(2).to_numpy(), _vectors(own.column(3), dim), k)
                    asked_for = own.column(4).flatten().to_numpy()
                    owner = np.repeat(np.arange(own.num_rows), np.diff(own.column(4).offsets.to_numpy()))
                    where = np.searchsorted(codes, asked_for)
                    hit = where < len(codes)
                    hit[hit] = codes[where[hit]] == asked_for[hit]
                    pairs = np.unique(np.stack([where[hit], owner[hit]], axis=1), axis=0)
                    for group in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else []:
                        best.meet(group[:, 1], np.arange(starts[group[0, 0]], starts[group[0, 0] + 1]), ids, scaled, unit)
                    yield best.rows(ids, scaled)

    both = side.unionByName(ask).repartition("shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(met, _FOUND)


def nearest(df: DataFrame, query: str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of df for which `query` (SQL over id) holds."""
    vectors = cut_lineage(usable(df, vec_id, embedding))
    rows = vectors.count()
    dim = len(vectors.first().v) if rows else 1
    # Equal vectors differ by id only: no query needs more than the k + 1 smallest ids of each, one of them its own.
    members = cut_lineage(vectors.withColumn("i", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("i") <= k + 1).select("id", "v"))
    n = members.count()
    queries = vectors.filter(query)
    hashing = fit(vectors, members, query, dim, k)
    found = cut_lineage(_ranked(search(members, queries, hashing, n, dim, k, part), k))
    # Whoever found fewer than there are takes all rows.
    enough = found.groupBy(F.col("query_id").alias("id")).count().filter(F.col("count") >= min(k, max(0, n - 1)))
    short = cut_lineage(queries.join(enough, "id", "left_anti")) if hashing.m else queries.limit(0)
    if not short.isEmpty():
        rest = _ranked(search(members, short, Hashing(dim, 0, tables=1), n, dim, k, part), k)
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
