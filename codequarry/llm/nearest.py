"""Operator 11: nearest neighbours by cosine, over a hierarchical navigable small-world graph for each shard.

Vectors that are equal in every component are one node, with the least ids that a query may need. Nodes are dealt
to shards by a hash, all of one length to shards of their own. A shard's nodes stand in order of
their levels, highest first, so that each layer's nodes are a prefix and its links a flat array of places, one row a node. Layers are built from the
top: a layer's first nodes are linked by comparing all of them, later ones batch after batch, by searching the layer as far
as it goes. A node links to near nodes that are nearer to it than to each other, and to the next nearest if
there are too few; links go both ways, and a full row is chosen anew. A search goes down the layers to a few entries
and then keeps the EF best nodes found, in lockstep for a block of queries, whatever their number.

Every block of queries meets every shard, in tasks of one block and one shard each; a shard gives each query its K nearest ids, and
the shards' results are merged by query. All vectors are indexed; the graph alone is approximate: scores are exact,
in double precision on the original components, and recall is measured in tests.

Nulls: vectors that are null, empty, all zero, or that hold null or non-finite components take no part, nor do rows with a null
vec_id. Repeated rows count once; rows of one id and different vectors are candidates each, and queries each, for which every row of their id is their own.
Queries have only candidates of their own length, fewer than K if there are no more. Ties go to the smaller vec_id.
An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm._common import bounded, materialise, mix

K = 5
#: Rows whose id this divides are queries.
EVERY = 50
#: Nodes of a shard, about: more of them make fewer searches a query, and longer tasks.
SHARD = 8_192
#: Queries of a block, about.
BLOCK = 512
#: Links of a node in upper layers; twice as many in the lowest one.
LINKS = 16
#: Best nodes that a search keeps, when links are made and when queries are answered.
EF_BUILD, EF = 64, 128
#: Nodes that are inserted at once, at most, and that each step of a search opens.
BATCH, OPENED = 512, 4
#: Up to so many nodes a search compares all of them.
PLAIN = 512
SEED = np.uint64(0x2545F4914F6CDD1D)


def top(sims: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest of each row, largest first."""
    n = min(n, sims.shape[1])
    at = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.tile(np.arange(n), (len(sims), 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)


def diverse(units: np.ndarray, found: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """m of each row's nodes (sorted by sims, -1 where there is none): those that are nearer to the row's node than to any chosen
    before, then the nearest others."""
    out = np.full((len(found), m), -1, np.int32)
    for a in range(0, len(found), BATCH):
        own, near = found[a : a + BATCH], sims[a : a + BATCH]
        vectors = units[own]
        between = vectors @ vectors.transpose(0, 2, 1)
        chosen = np.zeros(own.shape, bool)
        for j in range(own.shape[1]):
            chosen[:, j] = ~((between[:, j] > near[:, j, None]) & chosen).any(axis=1)
        chosen &= own >= 0
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :m]
        out[a : a + BATCH, : order.shape[1]] = np.take_along_axis(own, order, 1)
    return out


class Graph:
    """Layers over nodes in order of their levels: links[l] has a row for each node of layer l, places or -1; links[0] is the lowest."""

    def __init__(self, units: np.ndarray, links: list[np.ndarray]):
        self.units, self.links = units, links

    @classmethod
    def built(cls, units: np.ndarray, sizes: list[int], m: int = LINKS, ef: int = EF_BUILD) -> Graph:
        """sizes: nodes of each layer, the lowest first."""
        own = cls(units, [np.zeros((0, 0), np.int32)] * len(sizes))
        for layer in reversed(range(len(sizes))):
            own._build(layer, sizes, m, ef)
        return own

    def _build(self, layer: int, sizes: list[int], m: int, ef: int) -> None:
        size, most = sizes[layer], m if layer else 2 * m
        links = np.full((size, most), -1, np.int32)
        at = min(size, max(PLAIN, sizes[layer + 1] if layer + 1 < len(sizes) else 0))
        for a in range(0, at, BATCH):
            self._link(links, np.arange(a, min(at, a + BATCH)), np.zeros((0, 0), np.int64), np.arange(at), ef, m)
        while at < size:
            new = np.arange(at, min(size, at + min(BATCH, at)))
            self.links[layer] = links[:at]
            found, _ = self._searched(layer, self.units[new], self.entries(self.units[new], layer), ef)
            self._link(links, new, found, new, ef, m)
            at += len(new)
        self.links[layer] = links

    def _link(self, links: np.ndarray, new: np.ndarray, found: np.ndarray, others: np.ndarray, ef: int, m: int) -> None:
        """Link new nodes to the best of what was found for each and of the others, and back."""
        mutual = self.units[new] @ self.units[others].T
        mutual[others == new[:, None]] = -np.inf
        best = top(mutual, ef)
        sims, found = [np.take_along_axis(mutual, best, 1)], [*([found] if found.size else []), others[best]]
        if len(found) > 1:
            sims.insert(0, self._sims(self.units[new], found[0]))
        sims, found = np.concatenate(sims, axis=1), np.concatenate(found, axis=1)
        order = top(sims, ef)
        sims, found = np.take_along_axis(sims, order, 1), np.take_along_axis(found, order, 1)
        found = np.where(np.isfinite(sims), found, -1)
        links[new, :m] = diverse(self.units, found, sims, m)
        back, to = links[new, :m].ravel().astype(np.int64), np.repeat(new, m)
        back, to = back[there := back >= 0], to[there]
        near = np.einsum("ij,ij->i", self.units[back], self.units[to])
        order = np.lexsort((-near, back))
        back, to = back[order], to[order]
        rows, first, n = np.unique(back, return_index=True, return_counts=True)
        most = links.shape[1]
        nth = np.arange(len(back)) - np.repeat(first, n)
        more = np.full((len(rows), min(most, int(n.max(initial=0)))), -1, np.int64)
        kept = nth < more.shape[1]
        more[np.repeat(np.arange(len(rows)), n)[kept], nth[kept]] = to[kept]
        every = np.sort(np.concatenate([links[rows], more], axis=1), axis=1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        sims = self._sims(self.units[rows], every)
        order = np.argsort(-sims, axis=1, kind="stable")
        every, sims = np.take_along_axis(every, order, 1), np.take_along_axis(sims, order, 1)
        full = (every >= 0).sum(axis=1) > most
        links[rows[~full]] = np.pad(every[~full], ((0, 0), (0, max(0, most - every.shape[1]))), constant_values=-1)[:, :most]
        links[rows[full]] = diverse(self.units, every[full], sims[full], most)

    def _sims(self, queries: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Of each query with each of its nodes; -inf for none."""
        out = np.empty(found.shape, np.float32)
        for a in range(0, len(found), BATCH):
            out[a : a + BATCH] = (self.units[found[a : a + BATCH]] @ queries[a : a + BATCH, :, None])[:, :, 0]
        return np.where(found >= 0, out, -np.inf)

    def entries(self, queries: np.ndarray, layer: int, n: int = 8) -> np.ndarray:
        """Nodes from which a search of a layer begins, by the layers above."""
        found = np.zeros((len(queries), 1), np.int64)
        for above in range(len(self.links) - 1, layer, -1):
            found = self._searched(above, queries, found, n)[0]
        return found

    def _searched(self, layer: int, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of a layer: ids and sims of the ef best nodes found, best first, -1 and -inf where there are fewer."""
        links = self.links[layer]
        if len(links) <= PLAIN:
            sims = queries @ self.units[: len(links)].T
            found = top(sims, ef)
            return found, np.take_along_axis(sims, found, 1)
        rows, n = np.arange(len(queries)), len(queries)
        seen = np.zeros((n, len(links)), bool)
        there = entries >= 0
        seen[np.repeat(rows, there.sum(axis=1)), entries[there]] = True
        ids = np.concatenate([entries, np.full((n, max(0, ef - entries.shape[1])), -1)], axis=1)
        sims, opened = self._sims(queries, ids), ids < 0
        while len(rows):
            waiting = np.where(opened[rows], -np.inf, sims[rows])
            going = (waiting > -np.inf).any(axis=1)
            rows, waiting = rows[going], waiting[going]
            if not len(rows):
                break
            at = np.argpartition(-waiting, OPENED, axis=1)[:, :OPENED]
            nodes = np.where(np.take_along_axis(waiting, at, 1) > -np.inf, np.take_along_axis(ids[rows], at, 1), -1)
            opened[rows[:, None], at] = True
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(rows), -1)
            near = np.sort(np.where(seen[rows[:, None], near], -1, near), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            there = near >= 0
            seen[np.repeat(rows, there.sum(axis=1)), near[there]] = True
            every = np.concatenate([sims[rows], self._sims(queries[rows], near)], axis=1)
            best = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
            sims[rows] = np.take_along_axis(every, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), best, 1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], ~there], axis=1), best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """The nodes found for each query, nearest first, -1 where there are fewer."""
        return self._searched(0, queries, self.entries(queries, 0), ef)[0]


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, each times a power of two by which no square overflows or vanishes, and their norms."""
    exact = vectors.astype(np.float64)
    exact = np.ldexp(exact, -np.frexp(np.abs(exact).max(axis=1, initial=0))[1][:, None])
    return exact, np.sqrt(np.einsum("ij,ij->i", exact, exact))


def units_of(vectors: np.ndarray) -> np.ndarray:
    exact, norm = directions(vectors)
    return (exact / norm[:, None]).astype(np.float32)


def layer_sizes(level: np.ndarray) -> list[int]:
    return [int((level >= x).sum()) for x in range(int(level.max(initial=0)) + 1)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, its length and 128 bits of its hash, of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull())
    own = own.where(finite & F.exists(e, lambda x: x != 0))
    return own.select("vec_id", "embedding", F.size(e).alias("dim"), F.xxhash64(e).alias("h1"), F.xxhash64(F.lit("second"), e).alias("h2"))


def nodes(own: DataFrame, k: int = K) -> DataFrame:
    """Every distinct vector with its k + 1 least ids: dim, h1, h2, embedding, ids."""
    vectors = own.groupBy("dim", "h1", "h2").agg(F.first("embedding").alias("embedding"))
    order = Window.partitionBy("dim", "h1", "h2").orderBy("vec_id")
    least = own.select("dim", "h1", "h2", "vec_id").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    return vectors.join(least.groupBy("dim", "h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), ["dim", "h1", "h2"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


GRAPH = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("sizes", pa.list_(pa.int32())), ("links", pa.binary())])


def graphs(held: DataFrame, shards: DataFrame, m: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """A row for each shard: its vectors and their ids in order of levels, the layers' sizes, and their links one after another."""
    wide = held.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if wide == "float" else np.float64

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        hashes = rows["h1"].to_numpy().view(np.uint64)
        level = np.floor(-np.log(((mix(hashes + SEED) >> np.uint64(11)) + 0.5) * 2.0**-53) / np.log(m)).astype(np.int64)
        order = np.lexsort((hashes, -level))
        vectors = matrix(rows["embedding"])[order].astype(kind)
        sizes = layer_sizes(level)
        made = Graph.built(units_of(vectors), sizes, m, ef)
        row = {"dim": key[0].as_py(), "shard": key[1].as_py(), "vectors": vectors.tobytes(), "ids": rows["ids"].take(pa.array(order)).to_pylist(), "sizes": sizes, "links": b"".join(x.tobytes() for x in made.links)}
        return pa.Table.from_pylist([row], GRAPH)

    dealt = held.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), "shards"))
    return dealt.select("dim", "shard", "h1", "embedding", "ids").groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, vectors binary, ids array<array<long>>, sizes array<int>, links binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK, m: int = LINKS, ef_build: int = EF_BUILD, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of vectors found for each of queries (vec_id, embedding)."""
    bounded(vectors.sparkSession)
    held = materialise(nodes(usable(vectors), k), "vectors")
    shards = held.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard)).alias("shards"))  # a row for each length of vectors
    made = materialise(graphs(held, shards, m, ef_build), "graphs")
    kind = np.float32 if held.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    asked = usable(queries).dropDuplicates(["dim", "vec_id", "h1", "h2"])
    element = held.schema["embedding"].dataType.simpleString()
    asked = materialise(asked.withColumn("embedding", F.col("embedding").cast(element)), "queries")
    parts = asked.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    dealt = asked.join(F.broadcast(parts), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "h1"), "blocks"))
    blocks = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "h1", "h2", "embedding")).alias("queries"))
    pairs = blocks.join(F.broadcast(shards), "dim").select("dim", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).join(made, ["dim", "shard"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                dim, sizes, ids = one.column("dim")[0].as_py(), one.column("sizes")[0].as_py(), one.column("ids")[0].as_py()
                own = np.frombuffer(one.column("vectors")[0].as_py(), kind).reshape(-1, dim)
                flat, links, a = np.frombuffer(one.column("links")[0].as_py(), np.int32), [], 0
                for x, size in enumerate(sizes):
                    width = m if x else 2 * m
                    links.append(flat[a : a + size * width].reshape(size, width))
                    a += size * width
                asking = one.column("queries").flatten()
                exact, norm = directions(matrix(asking.field("embedding")))
                there, norms = directions(own)
                near = Graph((there / norms[:, None]).astype(np.float32), links).search((exact / norm[:, None]).astype(np.float32), max(ef, 2 * k))[:, : 2 * k + 6]
                score = np.einsum("ij,ikj->ik", exact, there[near]) / (norm[:, None] * norms[near])
                rows = []
                for own_id, h1, h2, places, scores in zip(*(asking.field(c).to_pylist() for c in ("vec_id", "h1", "h2")), near.tolist(), score.tolist(), strict=True):
                    best = sorted((-s, i) for p, s in zip(places, scores, strict=True) if p >= 0 for i in ids[p] if i != own_id)[:k]
                    rows += [(own_id, h1, h2, i, -s) for s, i in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if j == 4 else pa.int64()) for j, c in enumerate(zip(*rows, strict=True) if rows else [[]] * 5)], ["query_id", "h1", "h2", "vec_id", "score"])

    every = pairs.mapInArrow(found, "query_id long, h1 long, h2 long, vec_id long, score double")
    order = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(own, own.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op11_nearest": op11_nearest}
ORACLE_SQL: dict[str, str] = {}
