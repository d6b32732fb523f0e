"""Near-duplicate vectors by cross-polytope hashing: fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import staged
from reposift.llm.components import connected_components, local_roots

ROTATIONS = 3
HOMES_PER_PART = 2048


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


def bucket_codes(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """Bucket codes of unit vectors, shape (rows, tables, probes); the first probe is the home.

    A hash is the signed axis nearest to the rotated vector.  Probes are the
    combinations of next-nearest axes whose loss, the sum of squared gaps to
    the nearest ones, is smallest.
    """
    n, dim = unit.shape
    width = max(4, 1 << (dim - 1).bit_length())
    if (2 * width) ** hashes > 1 << 31:
        raise ValueError("bucket codes of so many hashes over such long vectors don't fit 31 bits")
    padded = np.pad(unit, ((0, 0), (0, width - dim)))
    reach = min(width, probes)
    choices = sorted(product(range(reach), repeat=hashes), key=sum)
    codes = np.empty((n, tables, probes), np.int32)
    for table in range(tables):
        axes, losses = [], []
        for i in range(hashes):
            rng, turned = np.random.default_rng([seed, table, i, width]), padded
            for _ in range(ROTATIONS):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
            size = np.abs(turned)
            order = np.argsort(-size, axis=1, kind="stable")[:, :reach]
            top = np.take_along_axis(size, order, axis=1)
            axes.append(2 * order + (np.take_along_axis(turned, order, axis=1) < 0))
            losses.append((top[:, :1] - top) ** 2)
        loss = np.stack([sum(losses[i][:, c[i]] for i in range(hashes)) for c in choices], axis=1)
        code = np.stack([sum(axes[i][:, c[i]] * (2 * width) ** i for i in range(hashes)) for c in choices], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        codes[:, table] = np.take_along_axis(code, best, axis=1)
    return codes


def _unit(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def _first_meeting(mine, theirs, table: int, bucket: int) -> np.ndarray:
    """Do the pairs of rows of two code arrays, which meet in ``bucket`` of ``table``, meet nowhere earlier?"""
    at_mine = (mine[:, :, :1] == theirs).any(axis=2)
    at_theirs = (theirs[:, :, :1] == mine).any(axis=2)
    earlier = (at_mine | at_theirs)[:, :table].any(axis=1)
    return ~(earlier | at_theirs[:, table] & (theirs[:, table, 0] < bucket))


def _grid(codes: pa.Array, tables: int, probes: int) -> np.ndarray:
    return codes.flatten().to_numpy(zero_copy_only=False).reshape(-1, tables, probes)


def bucket_links(vectors: DataFrame, least: float, tables: int, hashes: int, probes: int, seed: int = 7) -> DataFrame:
    """``u, v, links`` from distinct vectors (node, label, vec, copies): a row per linked vector and bucket.

    ``links`` counts the rows linked with ``u`` that no earlier bucket counts,
    ``v`` is the smallest vector of its component in the bucket.  A vector is
    sent to its home and to its other probes in every table, and the vectors at
    home are compared with all that were sent; a pair never leaves the task.
    Buckets with many homes are split into parts that each see all members.
    """
    kind = vectors.schema["vec"].dataType.simpleString()

    def send(with_vectors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    every = np.flatnonzero(dims == dim)
                    for at in range(0, len(every), 1024):
                        rows = every[at : at + 1024]
                        codes = bucket_codes(_unit(batch.column("vec"), rows, int(dim)), tables, hashes, probes, seed)
                        used = probes if with_vectors else 1
                        who = np.repeat(np.arange(len(rows)), tables * used)
                        sent = batch.take(pa.array(rows[who]))
                        grid = pa.array(np.arange(0, (len(rows) + 1) * tables * probes, tables * probes, dtype=np.int32))
                        arrays = {
                            "label": sent.column("label"), "dim": sent.column("dim"),
                            "tab": pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), used), len(rows))),
                            "bucket": pa.array(codes[:, :, :used].reshape(-1)),
                        }
                        if with_vectors:
                            arrays |= {
                                "home": pa.array(np.tile(np.arange(probes) == 0, len(rows) * tables)),
                                "node": sent.column("node"), "copies": sent.column("copies"), "vec": sent.column("vec"),
                                "codes": pa.ListArray.from_arrays(grid, pa.array(codes.reshape(-1))).take(pa.array(who)),
                            }
                        yield pa.RecordBatch.from_pydict(arrays)

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "dim", "tab", "bucket", "part")])
            own, home, node, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "home", "node", "copies"))
            first = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1]
            last = np.r_[first[1:], batch.num_rows]
            out = []
            for a, b in zip(first, last):
                goes_on = a == 0 and key == tuple(keys[:, 0])
                if not goes_on:
                    kept = None
                    if not own[a] or b - a == 1 and b < batch.num_rows:
                        continue
                dim, table, bucket = (int(x) for x in keys[1:4, a])
                unit = _unit(batch.column("vec"), np.arange(a, b), dim)
                codes = _grid(batch.column("codes").slice(a, b - a), tables, probes)
                n = int(own[a:b].sum())  # they come first
                mine = [unit[:n], codes[:n], node[a : a + n], copies[a : a + n]]
                kept = [np.concatenate(x) for x in zip(kept, mine)] if kept else mine
                if not len(kept[2]):
                    continue
                for at in range(0, len(kept[2]), 512):
                    some = [x[at : at + 512] for x in kept]
                    i, j = np.nonzero(some[0] @ unit.T >= least)
                    there = node[a + j]
                    use = (some[2][i] != there) & (~home[a + j] | (some[2][i] < there))
                    i, j = i[use], j[use]
                    counts = _first_meeting(some[1][i], codes[j], table, bucket)
                    out.append(_stars(some[2][i], node[a + j], some[3][i] * counts, copies[a + j] * counts))
            key = tuple(keys[:, -1])
            u, v, links = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(links)], ["u", "v", "links"])

    spot = ["label", "dim", "tab", "bucket"]
    here = vectors.withColumn("dim", F.size("vec")).select("node", F.col("label").cast("long"), "dim", "vec", "copies")
    homes = here.mapInArrow(send(False), "label long, dim int, tab int, bucket int")
    full = (
        homes.groupBy(*spot).count().where(F.col("count") > HOMES_PER_PART)
        .select(*spot, F.ceil(F.col("count") / HOMES_PER_PART).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    sent = here.mapInArrow(
        send(True),
        f"label long, dim int, tab int, bucket int, home boolean, node long, copies long, vec {kind}, codes array<int>",
    )
    return (
        sent.join(staged(full, "full-buckets"), spot, "left")
        .select(*spot, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "home", "node", "copies", "vec", "codes",
                F.pmod(F.xxhash64("node"), parts).cast("int").alias("mine"))
        .withColumn("own", F.col("home") & (F.col("part") == F.col("mine"))).drop("mine")
        .repartition(*spot, "part").sortWithinPartitions(*spot, "part", F.desc("own"), "node")
        .mapInArrow(compare, "u long, v long, links long")
    )


def _stars(a: np.ndarray, b: np.ndarray, of_b: np.ndarray, of_a: np.ndarray) -> np.ndarray:
    """Linked vectors, the smallest one of their component here, and the rows each is linked with."""
    nodes, left, right, root = local_roots(a, b)
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, left, of_a)
    np.add.at(links, right, of_b)
    return np.stack([nodes, nodes[root], links])


def near_vectors(
    rows: DataFrame, least: float = 0.98, tables: int = 4, hashes: int = 2, probes: int = 4, seed: int = 7
) -> DataFrame:
    """Links between vectors of one label: ``vec_id, n_links, component_id, kept``, a row per row of (vec_id, embedding, label).

    Candidates share a bucket; a link is a candidate pair whose cosine, in
    double precision, is ``least`` or more.  Equal vectors of a label are one
    node with a number of copies, so they are always linked and never paired.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows without label, link with nothing.  Vectors of different lengths
    don't link.  Repeated rows are copies of each other.  A null vec_id takes
    part but names a component only if nothing else can.  An empty table gives
    no row.  Other columns are ignored.
    """
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").alias("vec"))
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists(
        "vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    digest = F.when(sound, F.sha2(F.concat_ws(",", F.transform("vec", lambda x: (x + F.lit(0).cast("float")).cast("string"))), 256))
    marked = staged(own.withColumn("digest", digest).withColumn("sound", sound), "vectors")
    nodes = staged(
        marked.where("sound").groupBy("label", "digest")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    found = staged(bucket_links(nodes, least, tables, hashes, probes, seed), "bucket-links")
    roots = connected_components(found.select("u", "v")).withColumnRenamed("root", "top")
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "label", "digest", "rep", "copies").join(staged(counts, "counts"), "node", "left")
    known = known.join(staged(roots, "roots"), "node", "left").withColumn("top", F.coalesce("top", "node"))
    known = staged(known, "known")
    least_id = staged(known.groupBy("top").agg(F.min("rep").alias("component_id")), "least")
    told = staged(known.join(least_id, "top").select(
        F.col("label").alias("_label"), F.col("digest").alias("_digest"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "told")
    joined = marked.join(told, (F.col("label") == F.col("_label")) & (F.col("digest") == F.col("_digest")), "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))
