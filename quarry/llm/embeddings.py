"""Embedding near-duplicates with one hierarchical navigable small-world graph per shard.

1. Vectors are dealt to shards by hash; a shard holds at most ``SHARD_ROWS`` of them.
2. A shard builds a graph.  A vector within ``JOIN`` (cosine) of a node becomes a member of
   that node instead of a node, so that thousands of copies are one node of the graph.
   Nodes and searches advance in batches, in lockstep.
3. Every vector queries every shard for all nodes whose members it might link with (by the
   triangle inequality of angles); its own node is always among them.  A beam that comes back
   full is widened for its query.  Before that, an audit measures recall in each task, with
   probes at the limiting angle from known nodes and with queries against all nodes; the beam
   doubles until it passes.  The least recall of all tasks is logged.
4. Candidates are verified by cosine in double precision; members are skipped only where
   the triangle inequality proves the link.
   Queries come in blocks of ``QUERY_BYTES``, as many bytes as a shard's graph has at least, so
   that graphs travel no more than vectors do; both travel in the precision of the table.
5. Links are counted; for the components each query gives one edge for each node it links
   with, which is enough because a node's members link with the node.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
have n_links 0 and are components of their own; vectors of unlike length never link; rows
are vectors of their own even where vec_id repeats (they share the component); a null
vec_id counts in others' links and has a null component; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

log = logging.getLogger(__name__)

LEAST, JOIN = 0.95, 0.97
SHARDS, SHARD_ROWS, QUERY_BYTES = 6, 100_000, 64 << 20
NEIGHBOURS, BUILD_BEAM, BEAM, TOP_BEAM = 16, 48, 24, 4
AUDIT, RECALL = 128, 0.999
EXPAND, LOCKSTEP, BLOB = 4, 512, 4 << 20


class Graph:
    """Navigable layers over the nodes; layer k covers the first size[k] nodes, and layer 0 all."""

    def __init__(self, dimensions: int):
        self.x = np.zeros((0, dimensions), np.float32)
        self.layers: list[np.ndarray] = []  # of the top layer first: neighbours, -1 for none

    def search(self, q: np.ndarray, beam: int, layers: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of about the beam nearest nodes of each query, best first; -1 pads."""
        nodes, cosines = [], []
        for at in range(0, len(q), LOCKSTEP):
            part = q[at : at + LOCKSTEP]
            entry = np.zeros((len(part), 1), np.int64)
            used = self.layers if layers is None else self.layers[:layers]
            for k, adjacent in enumerate(used):
                found = self._layer(part, entry, beam if k == len(used) - 1 else TOP_BEAM, adjacent)
                entry = found[0]
            nodes.append(found[0])
            cosines.append(found[1])
        return np.concatenate(nodes), np.concatenate(cosines)

    def _layer(self, q: np.ndarray, entry: np.ndarray, beam: int, adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, n, b = self.x, len(adjacent), len(q)
        seen = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1)
        cos = np.full((b, beam), -np.inf, np.float32)
        entry = entry[:, :beam]
        ids[:, : entry.shape[1]] = entry
        row, col = np.nonzero(ids >= 0)
        seen[row, ids[row, col]] = True
        cos[row, col] = np.einsum("kd,kd->k", x[ids[row, col]], q[row])
        done = ids < 0
        live = np.arange(b)
        expand = min(EXPAND, beam)
        while len(live):
            open_cos = np.where(done[live], -np.inf, cos[live])
            pick = np.argpartition(-open_cos, expand - 1, axis=1)[:, :expand]
            value = np.take_along_axis(open_cos, pick, 1)
            going = (value > -np.inf).any(1)
            live, pick, value = live[going], pick[going], value[going]
            if not len(live):
                break
            done[live[:, None], pick] = True
            chosen = ids[live[:, None], pick]
            near = np.where((value > -np.inf)[:, :, None], adjacent[chosen], -1).reshape(len(live), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[live[:, None], near]
            r, c = np.nonzero(new)
            if not len(r):
                continue
            to = near[r, c]
            seen[live[r], to] = True
            got = np.einsum("kd,kd->k", x[to], q[live[r]])
            width = int(new.sum(1).max())
            place = np.cumsum(new, 1)[r, c] - 1
            more_id, more_cos = np.full((len(live), width), -1), np.full((len(live), width), -np.inf, np.float32)
            more_id[r, place], more_cos[r, place] = to, got
            all_id = np.concatenate([ids[live], more_id], 1)
            all_cos = np.concatenate([cos[live], more_cos], 1)
            all_done = np.concatenate([done[live], more_id < 0], 1)
            top = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            ids[live], cos[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_id, all_cos, all_done))
        order = np.argsort(-cos, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)

    def _select(self, ids: np.ndarray, cos: np.ndarray, keep: int) -> np.ndarray:
        """Up to keep diverse neighbours of each row: nearer to the row than to any kept one; the nearest others fill up."""
        order = np.argsort(-cos, axis=1, kind="stable")[:, : 4 * keep]
        ids, cos = np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)
        v = self.x[ids]
        between = v @ v.transpose(0, 2, 1)
        rows, width = ids.shape
        kept = np.zeros((rows, width), bool)
        worst = np.full((rows, width), -np.inf, np.float32)
        for j in range(width):
            take = (ids[:, j] >= 0) & (worst[:, j] < cos[:, j]) & (kept.sum(1) < keep)
            kept[:, j] = take
            worst = np.where(take[:, None], np.maximum(worst, between[:, :, j]), worst)
        rank = np.where(ids < 0, 2, np.where(kept, 0, 1)) * width + np.arange(width)
        best = np.argsort(rank, axis=1)[:, :keep]
        out = np.full((rows, keep), -1)
        out[:, : best.shape[1]] = np.take_along_axis(ids, best, 1)
        return out

    def _connect(self, adjacent: np.ndarray, start: int, ids: np.ndarray, cos: np.ndarray) -> None:
        """Gives nodes start.. their neighbours among the candidates, and the neighbours edges back."""
        width = adjacent.shape[1]
        chosen = self._select(ids, cos, width // 2)
        fresh = np.arange(start, start + len(chosen))
        adjacent[fresh, : chosen.shape[1]] = chosen
        r, c = np.nonzero(chosen >= 0)
        to, back = chosen[r, c], fresh[r]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(nodes), width + int(count.max(initial=0))), -1)
        wide[:, :width] = adjacent[nodes]
        slot = np.arange(len(to)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(nodes)), count), width + slot] = back
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        for at in range(0, len(nodes), LOCKSTEP):
            own = wide[at : at + LOCKSTEP]
            cosine = np.where(own >= 0, np.einsum("rcd,rd->rc", self.x[own], self.x[nodes[at : at + LOCKSTEP]]), -np.inf)
            full = (own >= 0).sum(1) > width
            packed = np.sort(own, axis=1)[:, ::-1][:, :width]
            if full.any():
                packed = packed.copy()
                packed[full] = self._select(own[full], cosine[full].astype(np.float32), width)
            adjacent[nodes[at : at + LOCKSTEP]] = packed


def build(x: np.ndarray, seed: int = 3) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph over unit vectors, the row of each node, and the node of each row."""
    n = len(x)
    draw = np.random.default_rng(seed)
    level = np.minimum((-np.log(draw.random(n)) / np.log(NEIGHBOURS)).astype(int), 6)
    graph = Graph(x.shape[1])
    row_of: list[int] = []
    node_of = np.full(n, -1)
    x32 = x.astype(np.float32)
    for k in range(int(level.max(initial=0)), -1, -1):
        capacity = len(row_of) + int((level == k).sum())
        adjacent = np.full((capacity, NEIGHBOURS * (2 if k == 0 else 1)), -1)
        size = len(row_of)
        if size:  # nodes of the layer above start with their neighbours there
            above = graph.layers[-1]
            adjacent[:size, : above.shape[1]] = above
        graph.layers.append(adjacent[:size])
        items, at = np.flatnonzero(level == k), 0
        while at < len(items):
            batch = items[at : at + max(32, min(size, LOCKSTEP))]
            at += len(batch)
            q = x32[batch]
            if size:
                ids, cos = graph.search(q, BUILD_BEAM)
            else:
                ids, cos = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
            within = q @ q.T
            fresh: list[int] = []  # places in the batch that become nodes
            for i in range(len(batch)):
                if cos.shape[1] and cos[i, 0] >= JOIN:
                    node_of[batch[i]] = ids[i, 0]
                elif fresh and within[i, fresh].max() >= JOIN:
                    node_of[batch[i]] = size + int(within[i, fresh].argmax())
                else:
                    node_of[batch[i]] = size + len(fresh)
                    fresh.append(i)
            if not fresh:
                continue
            row_of += batch[fresh].tolist()
            ids, cos, within = ids[fresh], cos[fresh], within[np.ix_(fresh, fresh)]
            graph.x = np.concatenate([graph.x, q[fresh]])
            own = np.arange(size, size + len(fresh))
            others = np.where(np.eye(len(own), dtype=bool), -1, own[None, :])
            ids = np.concatenate([ids, others], 1)
            cos = np.where(ids >= 0, np.concatenate([cos, within], 1), -np.inf).astype(np.float32)
            size += len(own)
            graph.layers[-1] = adjacent[:size]
            graph._connect(adjacent, int(own[0]), ids, cos)
        graph.layers[-1] = adjacent[:size].copy()
    return graph, np.array(row_of, np.int64), node_of


class Shard:
    """A shard's vectors and graph; members of a node in order of their angle to it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, uids: np.ndarray):
        self.kind = x.dtype
        x = unit(x.astype(np.float64))
        self.graph, row_of, node_of = build(x)
        nodes = x[row_of]
        angle = np.arccos(np.clip(np.einsum("kd,kd->k", x, nodes[node_of]), -1, 1))
        angle[row_of] = -1  # a node comes before its members
        order = np.lexsort((angle, node_of))
        angle[row_of] = 0
        self.x, self.angle, self.ids = x[order], angle[order], ids[row_of]
        self.edge = np.searchsorted(node_of[order], np.arange(len(nodes) + 1))
        self.nodes = nodes
        by_uid = np.argsort(uids)
        self.uid, self.place = uids[by_uid], node_of[by_uid]
        # float32 vectors in the graph and copies within a build batch may put a member slightly farther than JOIN
        self.reach = float(angle.max(initial=0)) if len(angle) else 0.0

    def limit(self, least: float) -> float:
        return float(np.cos(min(np.pi, np.arccos(least) + self.reach))) - 1e-5

    def __getstate__(self) -> dict:
        """What can be derived again doesn't travel: vectors in the table's precision, edges as 32-bit numbers."""
        layers = [x.astype(np.int32) for x in self.graph.layers]
        return {"x": self.x.astype(self.kind), "layers": layers, "angle": self.angle, "ids": self.ids, "edge": self.edge, "uid": self.uid, "place": self.place, "kind": self.kind}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.x = unit(self.x.astype(np.float64))
        self.nodes = self.x[self.edge[:-1]]
        self.graph = Graph(self.x.shape[1])
        self.graph.x, self.graph.layers = self.nodes.astype(np.float32), [x.astype(np.int64) for x in self.__dict__.pop("layers")]
        self.reach = float(self.angle.max(initial=0))

    def node_of(self, uids: np.ndarray) -> np.ndarray:
        """The node of each row, -1 for rows of other shards."""
        if not len(self.uid):
            return np.full(len(uids), -1)
        at = np.minimum(np.searchsorted(self.uid, uids), len(self.uid) - 1)
        return np.where(self.uid[at] == uids, self.place[at], -1)

    def audited_beam(self, q: np.ndarray, least: float) -> tuple[int, float]:
        """The beam at which probes at the limiting angle and queries find what they must, and the recall there."""
        limit, n = self.limit(least), len(self.nodes)
        draw = np.random.default_rng(n)
        known = draw.permutation(n)[:AUDIT]
        base = self.nodes[known]
        side = draw.standard_normal(base.shape)
        side -= np.einsum("kd,kd->k", side, base)[:, None] * base
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
        probes = base * (limit + 1e-4) + side * np.sqrt(max(0.0, 1 - (limit + 1e-4) ** 2))
        probes = np.concatenate([probes, q]).astype(np.float32)
        truth = probes @ self.graph.x.T >= limit
        beam, recall = BEAM, 1.0
        while beam < n:
            hit = np.zeros_like(truth)
            for row, (ids, _) in self.found(probes, beam, limit):
                hit[row, ids] = True
            recall = float((hit & truth).sum() / max(1, truth.sum())) if truth.any() else 1.0
            if recall >= RECALL:
                break
            beam *= 2
        return min(beam, n), recall if beam < n else 1.0

    def found(self, q: np.ndarray, beam: int, limit: float) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        """The nodes within the limit of each query; a full beam is widened."""
        todo = np.arange(len(q))
        while len(todo):
            beam = min(beam, len(self.nodes))
            ids, cos = self.graph.search(q[todo], beam)
            full = (cos[:, -1] >= limit) & (beam < len(self.nodes))
            for k in np.flatnonzero(~full):
                near = cos[k] >= limit
                yield int(todo[k]), (ids[k][near], cos[k][near])
            todo, beam = todo[full], beam * 4

    def links(self, q: np.ndarray, audit: np.ndarray, least: float, uids: np.ndarray) -> tuple[np.ndarray, list[list[int]], float]:
        """For each query: how many of the shard's other vectors it links with, and the ids of the nodes whose members they are; the audited recall."""
        count, linked = np.zeros(len(q), np.int64), [[] for _ in range(len(q))]
        if not len(q):
            return count, linked, 1.0
        q32, own = q.astype(np.float32), self.node_of(uids)
        beam, recall = self.audited_beam(q32[audit][:AUDIT], least)
        by_node: dict[int, list[int]] = {}
        for row, (ids, _) in self.found(q32, beam, self.limit(least)):
            for node in {*ids.tolist(), int(own[row])} - {-1}:
                by_node.setdefault(node, []).append(row)
        theta = np.arccos(least)
        for node, rows in by_node.items():
            a, b = int(self.edge[node]), int(self.edge[node + 1])
            for at in range(0, len(rows), 4096):
                part = np.array(rows[at : at + 4096])
                to_node = np.arccos(np.clip(q[part] @ self.nodes[node], -1, 1))
                sure = np.searchsorted(self.angle[a:b], theta - to_node - 1e-9, side="right")
                n = sure.astype(np.int64)
                low = int(sure.min())
                for c in range(a + low, b, 4096):
                    d = min(b, c + 4096)
                    n += ((q[part] @ self.x[c:d].T >= least) & (np.arange(c, d)[None, :] - a >= sure[:, None])).sum(1)
                count[part] += n
                for r in part[n > 0].tolist():
                    linked[r].append(int(self.ids[node]))
        return count - (own >= 0), linked, recall  # a vector links with itself


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, which keeps the norm of huge and tiny vectors finite."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as they are in the table."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def near_duplicates(rows: DataFrame, least: float = LEAST, shards: int = SHARDS) -> DataFrame:
    """vec_id, n_links, component_id for every row of (vec_id, embedding)."""
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.monotonically_increasing_id().alias("uid"))
    if dict(kept.dtypes)["v"] != "array<float>":
        kept = kept.withColumn("v", F.col("v").cast("array<double>"))
    top = F.array_max(F.transform("v", F.abs))
    good = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (top > 0)
    kept = common.materialize(kept.withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    known = kept.where("good").select("uid", F.coalesce("vec_id", F.lit(-(1 << 63))).alias("vec_id"), "v", F.size("v").alias("dim"))
    size = known.agg(F.count("*").alias("n"), F.sum(F.lit(4).cast("long") * F.col("dim")).alias("bytes")).first()
    shards = max(shards, -(-size["n"] // SHARD_ROWS))
    blocks = max(1, -(-(size["bytes"] or 0) // QUERY_BYTES))
    home = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")

    def make(key: tuple, t: pa.Table) -> pa.Table:
        data = pickle.dumps(Shard(t.column("vec_id").to_numpy(), _matrix(t.column("v")), t.column("uid").to_numpy()), 5)
        parts = [data[k : k + BLOB] for k in range(0, len(data), BLOB)]
        return pa.table({"dim": pa.array([key[0].as_py()] * len(parts), pa.int32()), "shard": pa.array([key[1].as_py()] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})

    graphs = known.withColumn("shard", home).groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, part int, data binary")
    graphs = common.materialize(graphs, "graphs")
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = known.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def ask(key: tuple, graph: pa.Table, t: pa.Table) -> pa.Table:
        if graph.num_rows and t.num_rows:
            parts = sorted(zip(graph.column("part").to_pylist(), graph.column("data").to_pylist(), strict=True))
            shard = pickle.loads(b"".join(p for _, p in parts))
            audit = np.flatnonzero(t.column("vec_id").to_numpy() % 100 == 0)
            count, linked, recall = shard.links(unit(_matrix(t.column("v")).astype(np.float64)), audit, least, t.column("uid").to_numpy())
        else:
            count, linked, recall = np.zeros(t.num_rows, np.int64), [[]] * t.num_rows, 1.0
        return pa.table({"uid": t.column("uid"), "vec_id": t.column("vec_id"), "n": pa.array(count, pa.int64()), "nodes": pa.array(linked, pa.list_(pa.int64())), "recall": pa.array(np.full(t.num_rows, recall))})

    pairs = spread.groupBy("dim", "shard", "block").cogroup(queries.groupBy("dim", "shard", "block"))
    answers = common.materialize(pairs.applyInArrow(ask, "uid long, vec_id long, n long, nodes array<long>, recall double"), "answers")
    log.info("%d shards, %d blocks of queries, least recall of an audit %s", shards, blocks, answers.agg(F.min("recall")).first()[0])
    none = F.lit(-(1 << 63))
    edges = answers.select(F.col("vec_id").alias("a"), F.explode("nodes").alias("b")).where((F.col("a") != F.col("b")) & (F.col("a") != none) & (F.col("b") != none))
    found = common.components(edges.distinct(), "vector-cc")
    counts = answers.groupBy("uid").agg(F.sum("n").alias("n_links"))
    out = kept.select("uid", "vec_id").join(counts, "uid", "left").join(found, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links and component of every vector."""
    found = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))  # a null vec_id is in no component


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
