"""Embedding near-duplicates by NN-descent.

Vectors of one label (and length) are compared by cosine.  Equal vectors form
one node, so copies are never paired.

1. A first graph joins each node to its neighbours in a few orders: random
   hyperplanes cut a label into cells, a random direction orders each cell.
2. Rounds of NN-descent: at every node its neighbours (and those it is a
   neighbour of) are compared with each other; the best ``K`` per node stay.
   Pairs at or above the threshold are links and always kept.  A node whose list
   is saturated with links gets a longer list (``ENLARGE`` times as long).
3. After each round an audit compares a bounded set of nodes with all nodes by
   brute force; rounds go on until the recall of their links is ``RECALL`` or
   ``ROUNDS`` are done.
4. The graph only says which vectors are alike; what it missed is found exactly.
   All vectors of a label, those of a component side by side, are cut into tiles;
   the angle between two tiles' centres and their radii decide whether all, none
   or some of their pairs link, and only in the last case are cosines computed.
   Tiles meet in bounded blocks, every block with every other of its label.  Only
   counts and links between components leave a block, never pairs.

Defined results.  Null label, null or zero vectors, vectors with null or
non-finite components: no links, component = own id, kept.  Repeated ids: rows
are kept, the smallest id of the component is reported; null ids never name a
component unless all are null.  Ties of similarity go to the smaller node.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, pair_components

THRESHOLD = 0.93
K = 8                    # neighbours kept per node
ENLARGE = 3              # a saturated list may hold K * ENLARGE
ORDERS = 8               # orders of the first graph
NEXT = 4                 # neighbours taken in each order
CELL = 64                # vectors aimed at per cell
ROUNDS = 5
AUDIT = 256              # nodes of the audit
RECALL = 0.98
TILE = 256
BLOCK = 32               # tiles of a block
SEED = 0x4E4E


def unit(raw: list[bytes] | pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision of equally long packed vectors."""
    x = np.frombuffer(b"".join(v if isinstance(v, bytes) else v.as_py() for v in raw), kind).astype(np.float64)
    x = x.reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nodes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame, str]:
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    e = F.col(embedding)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(label).isNotNull() & e.isNotNull() & ~odd & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("id"),
                          F.when(F.coalesce(ok, F.lit(False)), F.xxhash64(F.col(label).cast("string"), e)).alias("node"),
                          e.alias("e"), F.col(label).cast("string").alias("label"))

    def pack(batches):
        for b in batches:
            dim = [len(x) for x in b.column("e").to_pylist()]
            vec = [np.array(x, kind).tobytes() for x in b.column("e").to_pylist()]
            part = [f"{n}:{x}" for n, x in zip(dim, b.column("label").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("id"), b.column("copies"), pa.array(part, pa.string()),
                                              pa.array(vec, pa.binary())], names=["node", "id", "copies", "part", "vec"])

    id_type = rows.schema["id"].dataType.simpleString()
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"),
                                                               F.first("label").alias("label"), F.first("e").alias("e")) \
        .mapInArrow(pack, f"node long, id {id_type}, copies long, part string, vec binary")
    return rows.select("id", "node"), cut(nodes, "vectors"), kind


def _first_graph(nodes: DataFrame, kind: str, per_part: int) -> DataFrame:
    """``(u, v, sim)``: neighbours in the cells of a few random orders."""
    planes = max(0, int(np.ceil(np.log2(max(1, per_part / CELL)))))

    def cells(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.array([len(v.as_py()) for v in b.column("vec")])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = b.take(pa.array(at))
                x = unit(part.column("vec"), kind)
                rng = np.random.default_rng(SEED)
                for t in range(ORDERS):
                    w = rng.standard_normal((x.shape[1], planes + 1))
                    y = x @ w
                    cell = ((y[:, :planes] > 0) @ (1 << np.arange(planes))).astype(np.int64) if planes else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("part"), pa.array(cell * ORDERS + t), pa.array(y[:, planes]), part.column("node"),
                         part.column("vec")], names=["part", "cell", "place", "node", "vec"])

    def neighbours(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            n = len(t)
            part, cell, node = t["part"].to_pylist(), t["cell"].to_numpy(), t["node"].to_numpy()
            fresh = 0 if held is None else len(held)
            out = []
            same = np.array([0] + [part[i] != part[i - 1] or cell[i] != cell[i - 1] for i in range(1, n)]).cumsum()
            raw = [v.as_py() for v in t["vec"].combine_chunks()]
            sizes = np.array([len(v) for v in raw])
            for size in np.unique(sizes):
                idx = np.flatnonzero(sizes == size)
                x = unit([raw[i] for i in idx], kind)
                for d in range(1, NEXT + 1):
                    i, j = np.arange(len(idx) - d), np.arange(d, len(idx))
                    ok = (same[idx[i]] == same[idx[j]]) & (idx[j] >= fresh) & (idx[j] - idx[i] == d)
                    i, j = i[ok], j[ok]
                    out.append((node[idx[i]], node[idx[j]], (x[i] * x[j]).sum(1)))
            u, v, s = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "sim"])
            held = t.slice(max(0, n - NEXT)).combine_chunks().to_batches()[0]

    spread = nodes.select("part", "node", "vec").mapInArrow(cells, "part string, cell long, place double, node long, vec binary")
    return spread.repartition("part", "cell").sortWithinPartitions("part", "cell", "place", "node") \
        .mapInArrow(neighbours, "u long, v long, sim double")


def _best(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The best ``k`` per node in both directions; up to ``k * ENLARGE`` where links fill the list."""
    both = edges.select("u", "v", "sim").union(edges.select("v", "u", "sim"))

    def top(batches):
        u_last, seen = None, 0
        for b in batches:
            u, v, s = (b.column(c).to_numpy() for c in ("u", "v", "sim"))
            if not len(u):
                continue
            start = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
            if u[0] == u_last:
                first = start[1] if len(start) > 1 else len(u)
                rank[:first] += seen
            u_last, seen = u[-1], int(rank[-1]) + 1
            keep = (rank < k) | ((rank < k * ENLARGE) & (s >= threshold))
            yield b.filter(pa.array(keep))

    return both.groupBy("u", "v").agg(F.max("sim").alias("sim")).repartition("u") \
        .sortWithinPartitions("u", F.desc("sim"), "v").mapInArrow(top, "u long, v long, sim double")


def _local_join(graph: DataFrame, nodes: DataFrame, kind: str, threshold: float, k: int) -> DataFrame:
    """Compare the neighbours of every node with each other; a node's own best finds and all links come out."""
    vec = nodes.select(F.col("node").alias("v"), "vec")
    around = graph.select("u", "v").unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"))) \
        .unionByName(graph.select("u", F.col("u").alias("v"))).distinct()
    held = around.join(vec, "v").repartition("u").sortWithinPartitions("u", "v")

    def groups(batches) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        last, ids, vecs = None, [], []
        for b in batches:
            for u, v, x in zip(b.column("u").to_numpy(), b.column("v").to_numpy(), b.column("vec")):
                if u != last and ids:
                    yield np.array(ids), vecs
                    ids, vecs = [], []
                last = u
                if len(ids) < 4 * k * ENLARGE:       # a hub is compared with the first of those that list it, in hash order
                    ids.append(v)
                    vecs.append(x.as_py())
        if ids:
            yield np.array(ids), vecs

    def compare(batches):
        out, size = [], 0
        for ids, vecs in groups(batches):
            x = unit(vecs, kind)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            near = np.argsort(-s, 1)[:, :3]
            i = np.repeat(np.arange(len(ids)), near.shape[1])
            j = near.ravel()
            a, b = np.nonzero(np.triu(s >= threshold))
            i, j = np.concatenate([i, a]), np.concatenate([j, b])
            ok = i != j
            i, j = i[ok], j[ok]
            lo, hi = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            out.append((lo, hi, s[i, j]))
            size += len(lo)
            if size > 1 << 18:
                yield flush(out)
                out, size = [], 0
        if out:
            yield flush(out)

    def flush(out):
        u, v, s = (np.concatenate(c) for c in zip(*out))
        pair = np.unique(np.stack([u, v], 1), axis=0, return_index=True)[1]
        return pa.RecordBatch.from_arrays([pa.array(u[pair]), pa.array(v[pair]), pa.array(s[pair])], names=["u", "v", "sim"])

    return held.select("u", "v", "vec").mapInArrow(compare, "u long, v long, sim double")


def audit(nodes: DataFrame, kind: str, threshold: float, size: int = AUDIT) -> DataFrame:
    """``(u, v)``: all links of ``size`` nodes, by brute force against every node."""
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select("node", "part", "vec").collect()
    shared = nodes.sparkSession.sparkContext.broadcast([(r.node, r.part, bytes(r.vec)) for r in asked])   # at most `size` vectors

    def run(batches):
        by_part: dict[str, list] = {}
        for n, p, v in shared.value:
            by_part.setdefault(p, []).append((n, v))
        sets = {p: (np.array([n for n, _ in x]), unit([v for _, v in x], kind)) for p, x in by_part.items()}
        for b in batches:
            part, node = np.array(b.column("part").to_pylist(), object), b.column("node").to_numpy()
            for p, (q, x) in sets.items():
                at = np.flatnonzero(part == p)
                if len(at):
                    s = unit(b.column("vec").take(pa.array(at)), kind) @ x.T
                    i, j = np.nonzero(s >= threshold)
                    ok = node[at[i]] != q[j]
                    yield pa.RecordBatch.from_arrays([pa.array(q[j[ok]]), pa.array(node[at[i[ok]]])], names=["u", "v"])

    return nodes.select("node", "part", "vec").mapInArrow(run, "u long, v long")


def _count_links(groups: DataFrame, kind: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(node, n, other)``: copies of other nodes linked to each node; with ``other``, two components that a link joins.

    ``groups``: (part, run, component, node, copies, vec, place) of all nodes; the run
    is the component, null for a node without a known link; ``place``
    puts similar vectors of a component side by side, and a run of up to ``TILE`` is
    one tile.  All tiles of a part are compared.
    """
    theta = float(np.arccos(threshold))

    def tiles(batches):
        names = ["part", "tile", "nodes", "components", "copies", "vecs", "dim"]
        held: list[tuple] = []
        number, last = 0, None

        def flush():
            nonlocal number
            number += 1
            nodes, comps, copies = (np.array([h[k] for h in held], np.int64).tobytes() for k in range(3))
            return pa.RecordBatch.from_arrays([
                pa.array([last[0]], pa.string()), pa.array([base + number], pa.int64()), pa.array([nodes]), pa.array([comps]),
                pa.array([copies]), pa.array([b"".join(h[3] for h in held)]), pa.array([len(held[0][3])], pa.int64())], names=names)

        base = TaskContext.get().partitionId() << 32
        for b in batches:
            for p, c, n, m, v in zip(*(b.column(x) for x in ("part", "component", "node", "copies", "vec"))):
                now = (p.as_py(), c.as_py())
                if held and (now[0] != last[0] or len(held) == TILE or (now != last and len(held) >= TILE // 2)):
                    yield flush()
                    held = []
                last = now
                held.append((n.as_py(), now[1], m.as_py(), v.as_py()))
        if held:
            yield flush()

    cut_up = groups.repartitionByRange("part", "run", "place", "node").sortWithinPartitions("part", "run", "place", "node") \
        .select("part", "component", "node", "copies", "vec") \
        .mapInArrow(tiles, "part string, tile long, nodes binary, components binary, copies binary, vecs binary, dim long")
    cut_up = cut(cut_up, "tiles")
    blocks = cut_up.groupBy("part").agg(F.ceil(F.count("*") / block).alias("blocks"))
    met = cut_up.join(blocks, "part").withColumn("own", F.pmod(F.xxhash64("tile"), "blocks")) \
        .withColumn("met", F.explode(F.expr("sequence(0L, blocks - 1)"))) \
        .withColumn("x", F.least("own", "met")).withColumn("y", F.greatest("own", "met")).drop("blocks", "met")

    def compare(t: pa.Table) -> pa.Table:
        size, whole = t["dim"][0].as_py(), t["x"][0].as_py() == t["y"][0].as_py()
        own = t["own"].to_pylist()
        raw = [[np.frombuffer(x.as_py(), np.int64) for x in t[c]] for c in ("nodes", "components", "copies")]
        vecs = [unit([v[i:i + size] for i in range(0, len(v), size)], kind) for v in (x.as_py() for x in t["vecs"])]
        balls = [_ball(x) for x in vecs]
        counts = [np.zeros(len(x), np.int64) for x in raw[0]]
        joined = [np.zeros((0, 2), np.int64)]
        for a in range(len(vecs)):
            for b in range(a if whole else a + 1, len(vecs)):
                if not whole and own[a] == own[b]:
                    continue
                same = a == b
                (za, ra), (zb, rb) = balls[a], balls[b]
                apart = float(np.arccos(np.clip(za @ zb, -1, 1)))
                if not same and apart - ra - rb > theta + 1e-9:
                    continue
                ca, cb = raw[2][a], raw[2][b]
                if apart + ra + rb < theta - 1e-9:
                    to_a, to_b = np.full(len(ca), cb.sum()), np.full(len(cb), ca.sum())
                    if same:
                        to_a = to_a - ca
                    comps = np.unique(np.concatenate([raw[1][a], raw[1][b]]))
                    joined.append(np.stack([np.full(len(comps) - 1, comps[0]), comps[1:]], 1))
                else:
                    s = vecs[a] @ vecs[b].T >= threshold
                    if same:
                        np.fill_diagonal(s, False)
                    i, j = np.nonzero(s)
                    to_a, to_b = s @ cb, ca @ s
                    u, v = raw[1][a][i], raw[1][b][j]
                    if (u != v).any():
                        joined.append(np.unique(np.stack([u, v], 1)[u != v], axis=0))
                counts[a] += to_a
                if not same:
                    counts[b] += to_b
        node, n, pairs = np.concatenate(raw[0]), np.concatenate(counts), np.unique(np.concatenate(joined), axis=0)
        node, n = node[n > 0], n[n > 0]
        return pa.table({"node": np.concatenate([node, pairs[:, 0]]), "n": np.concatenate([n, np.zeros(len(pairs), np.int64)]),
                         "other": pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(pairs[:, 1])])})

    return cut(met.groupBy("part", "x", "y").applyInArrow(compare, "node long, n long, other long"), "counted")


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of unit vectors and the widest angle to it."""
    c = x.sum(0)
    norm = np.sqrt(c @ c)
    if norm < 1e-9:
        return x[0], float(np.pi)
    c = c / norm
    return c, float(np.arccos(np.clip((x @ c).min(), -1, 1)))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, k: int = K, report: dict | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every vector.

    ``report`` receives the rounds taken and the recall measured by the audit, both
    of the graph before the exact comparison of tiles.
    """
    rows, nodes, kind = _nodes(vectors, vec_id, embedding, label)
    sizes = nodes.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    edges = _first_graph(nodes, kind, sizes)
    graph = cut(_best(edges, k, threshold), "graph")
    truth = cut(audit(nodes, kind, threshold), "audit")
    asked = truth.count()
    links = graph.where(F.col("sim") >= threshold).select("u", "v")
    recall, done = 1.0, 0
    comps = None
    while asked or done == 0:
        done += 1
        found = cut(_local_join(graph, nodes, kind, threshold, k), "found")
        links = cut(links.union(found.where(F.col("sim") >= threshold).select("u", "v"))
                    .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
        comps = pair_components(links, "u", "v")
        if asked:
            c = comps.select("node", "component")
            hit = truth.join(c.withColumnsRenamed({"node": "u", "component": "cu"}), "u") \
                .join(c.withColumnsRenamed({"node": "v", "component": "cv"}), "v").where("cu = cv").count()
            recall = hit / asked
        if recall >= RECALL or done == ROUNDS:
            break
        graph = cut(_best(graph.unionByName(found), k, threshold), "graph")
    if report is not None:
        report.update(rounds=done, recall=recall, audited_links=asked)

    def place(batches):
        ways: dict[int, np.ndarray] = {}
        for b in batches:
            y = np.zeros(b.num_rows)
            raw = [v.as_py() for v in b.column("vec")]
            sizes = np.array([len(v) for v in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit([raw[i] for i in at], kind)
                w = ways.setdefault(x.shape[1], np.random.default_rng(SEED + 2).standard_normal(x.shape[1]))
                y[at] = x @ w
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "run", "component", "node", "copies", "vec")), pa.array(y)],
                                             names=["part", "run", "component", "node", "copies", "vec", "place"])

    grouped = nodes.select("part", "node", "copies", "vec").join(comps, "node", "left") \
        .select("part", F.col("component").alias("run"), F.coalesce("component", "node").alias("component"), "node", "copies", "vec") \
        .mapInArrow(place, "part string, run long, component long, node long, copies long, vec binary, place double")
    met = _count_links(grouped, kind, threshold)
    counted = met.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    joined = pair_components(met.where("other is not null"), "node", "other").select(F.col("node").alias("found"), F.col("component").alias("whole"))
    named = nodes.select("node", "id", "copies").join(comps, "node", "left").withColumn("found", F.coalesce("component", "node")) \
        .join(joined, "found", "left").join(counted, "node", "left") \
        .select("node", F.coalesce("whole", "found").alias("component"), "id",
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_node = named.join(ids, "component").select("node", "n_links", "component_id")
    linked = rows.where("node is not null").join(by_node, "node").select("id", "n_links", "component_id")
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(vec_id), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
