"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors of a label become one class first. The classes of a label are cut into tiles, and each pair of tiles of the same
label and dimension is one row of work: the unit vectors of both are rounded to int8 with a scale of their own, and one
matrix product of the tiles gives all approximate cosines at once (integers below 2^24, so exact in single precision). With x =
s q + d, where d is what rounding left of the unit vector x, two cosines differ by at most |d_x| + |d_y| + |d_x| |d_y|. Only pairs
that this bound leaves possibly at the threshold or above are worked out in double precision.

A pair of tiles gives back, for each vector with links, how many vectors it links with (counting equal ones), and as links no
more than a spanning forest of those it found; so a label or group of any size sends at most a tile's size of rows per pair
of tiles. All rows of a label are compared, as the contract asks: the number of tile pairs grows with the square of a
label's classes, spread over all tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, link
with nothing and are their own component; vectors of different dimensions do not link; a null id is never the smallest while
there is another one; repeated rows are vectors of their own, equal to each other; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.components import components
from chronoweave.llm.text import table
from chronoweave.session import cut_lineage

THRESHOLD = 0.98
#: Vectors of one tile.
TILE = 1024
#: Added to the bound for rounding in its own arithmetic.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, the scale of each row, and the length of what rounding left of it."""
    scale = np.abs(units).max(1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((units - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-12)


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs with a cosine of at least ``threshold``."""
    (p, s, d), (q, t, e) = quantised(left), quantised(right)
    near = (p.astype(np.float32) @ q.astype(np.float32).T).astype(np.float64) * s[:, None] * t[None, :]
    bound = d[:, None] + e[None, :] + d[:, None] * e[None, :] + SLACK
    x, y = np.nonzero(near + bound >= threshold)
    exact = np.concatenate([np.empty(0), *((left[x[i:i + TILE]] * right[y[i:i + TILE]]).sum(1) for i in range(0, len(x), TILE))])
    chosen = exact >= threshold
    return x[chosen], y[chosen]


def _forest(x: np.ndarray, y: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of links between numbers below ``size``."""
    parent = list(range(size))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for a, b in zip(x.tolist(), y.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _compare(threshold: float):
    def run(batches):
        for batch in batches:
            for classes_x, counts_x, left, classes_y, counts_y, right, same in zip(*(batch.column(i).to_pylist() for i in range(7))):
                ids = [np.frombuffer(c, np.int64) for c in (classes_x, classes_y)]
                times = [np.frombuffer(c, np.int64) for c in (counts_x, counts_y)]
                x, y = linked(*(unit(np.frombuffer(v, np.float64).reshape(len(i), -1)) for v, i in zip((left, right), ids)), threshold)
                if same:
                    x, y = x[x != y], y[x != y]
                rows = [(int(i), int(n), None) for i, n in zip(ids[0], np.bincount(x, times[1][y], len(ids[0])).astype(np.int64)) if n]
                if not same:
                    rows += [(int(i), int(n), None) for i, n in zip(ids[1], np.bincount(y, times[0][x], len(ids[1])).astype(np.int64)) if n]
                shift = 0 if same else len(ids[0])
                every = ids[0] if same else np.concatenate(ids)
                rows += [(int(every[a]), 0, int(every[b])) for a, b in _forest(x, y + shift, len(every))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [(), (), ()])], ["a", "n", "b"])

    return run


def _packed(batches):
    """Rows of one tile after another, in order, to a row per tile with its vectors as bytes; tiles may come in parts."""
    for batch in batches:
        tiles = list(zip(batch.column("grp").to_pylist(), batch.column("tile").to_pylist()))
        cuts = [0, *(i for i in range(1, len(tiles)) if tiles[i] != tiles[i - 1]), len(tiles)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            vectors = np.array(part.column("v").to_pylist(), np.float64)
            yield pa.RecordBatch.from_arrays([
                part.column("grp").slice(0, 1), part.column("tile").slice(0, 1), pa.array([int(part.column("cls")[0].as_py())], pa.int64()),
                pa.array([part.column("cls").to_numpy().astype(np.int64).tobytes()]), pa.array([part.column("times").to_numpy().astype(np.int64).tobytes()]),
                pa.array([vectors.tobytes()])], ["grp", "tile", "part", "classes", "counts", "vectors"])


def similar_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec id, n_links, component_id), one row per row of ``vectors``."""
    held = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("lab").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("lab"), held.alias("v")).withColumn("ok", usable)
    rows = rows.withColumn("key", F.when(F.col("ok"), F.struct("lab", "v")))
    classes = rows.filter("ok").groupBy("lab", "v").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("times"))
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()))

    # dense tile numbers by hash: tiles of TILE vectors on average, decided by one count per label and dimension
    groups = classes.groupBy("lab", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    tiled = (
        classes.withColumn("dim", F.size("v")).join(cut_lineage(groups), ["lab", "dim"])
        .withColumn("tile", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / TILE)).cast("long")).withColumn("grp", F.struct("lab", "dim"))
    )
    order = tiled.select(F.to_json("grp").alias("grp"), "tile", "cls", "times", "v").repartition("grp", "tile").sortWithinPartitions("grp", "tile", "cls")
    tiles = cut_lineage(order.mapInArrow(_packed, "grp string, tile bigint, part bigint, classes binary, counts binary, vectors binary"))
    named = {x: tiles.select("grp", F.struct("tile", "part").alias(f"p_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("classes", "counts", "vectors"))) for x in "xy"}
    work = named["x"].join(named["y"], "grp").filter("p_x <= p_y").select(
        "classes_x", "counts_x", "vectors_x", "classes_y", "counts_y", "vectors_y", (F.col("p_x") == F.col("p_y")).alias("same"))
    found = cut_lineage(work.repartition(F.xxhash64("classes_x", "classes_y")).mapInArrow(_compare(threshold), "a bigint, n bigint, b bigint"))

    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    known = classes.join(counts, "cls", "left").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    firsts = cut_lineage(known.groupBy("component").agg(F.min("first").alias("component_id")))
    result = cut_lineage(known.join(firsts, "component").select("lab", "v", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"))
    joined = rows.filter("ok").join(result, ["lab", "v"]).select("_id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return joined.unionByName(alone).withColumnRenamed("_id", vec_id)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; of a component, the smallest id is kept."""
    found = similar_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT s.a, l.b FROM reach s JOIN links l ON l.a = s.b),
least AS (SELECT s.a, min(v.vec_id) AS component_id FROM reach s JOIN v ON v.r = s.b GROUP BY s.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least.component_id, coalesce(v.vec_id = least.component_id, false) AS kept
FROM v JOIN least ON least.a = v.r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.r
"""
