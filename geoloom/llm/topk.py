"""Exact top-k inner products by columnar branch and bound.

Vectors are packed where they lie into groups of bounded size in vertical layout (dimensions by rows), the queries
likewise into blocks. For a query, products are accumulated dimension block by dimension block; after each block a
candidate's remaining mass (the product of both vectors' norms over the dimensions left, by Cauchy and Schwarz)
bounds its final score, and candidates that can't reach the k-th best lower bound are compacted away. A first round
of each block against one group gives every query a lower bound to begin with. Each group yields its k best for each
query; these are merged.

Queries in blocks of at most `query_block` meet all groups: by an equi-join of packed rows on (dimension
count, block, a salt of the groups), so no task holds more than a group and a block at a time, whatever the number of rows.

Components are floor(1024 * x) as exact integers of any size: rows with a component beyond 2**22 lie in groups of
their own, whose products are taken with whole Python numbers. Cases: a score that doesn't fit a long is ranked by
its exact value and returned as null; vectors null or with null, NaN or infinite components take no part; vectors
meet only vectors of their length; empty vectors score 0; ties go to smaller vec_ids; rows that repeat a query's
vec_id aren't its candidates, and a repeated query row is answered once; with fewer than k candidates all are
returned; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise, release, table

PACKED = "d int, wide boolean, n int, ids binary, cells binary"
RESULT = "query_id long, vec_id long, score long, beyond string"
#: Components up to this lie in 32-bit groups; others in wide ones.
NARROW, MOST_DIMENSIONS, MOST_CELLS = 1 << 22, 1 << 18, 1 << 22
FITS, DIGITS = "m", 640


def _pack(group_rows: int):
    """Rows of up to group_rows vectors of one dimension count (fewer if they are long), components by dimension."""

    def run(batches):
        import pyarrow as pa

        waiting: dict[tuple[int, bool], list] = {}

        def out(key):
            ids, rows = zip(*waiting.pop(key), strict=True)
            cells = np.array(rows, np.float64).reshape(len(rows), key[0]).T  # wide groups keep x itself
            cells = cells if key[1] else np.floor(cells * 1024).astype(np.int32)
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.ascontiguousarray(cells).tobytes()])]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            ends = ends - ends[0]
            for i, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                row = flat[a:b].copy()
                key = (int(b - a), bool(b > a and (b - a > MOST_DIMENSIONS or np.abs(row).max() >= NARROW / 1024)))
                waiting.setdefault(key, []).append((i, row))
                if len(waiting[key]) >= min(group_rows, max(1, MOST_CELLS // max(1, key[0]))):
                    yield out(key)
        for key in list(waiting):
            yield out(key)

    return run


def search(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, own: int, k: int, block: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best of columns (dims, n) for query; rest: (blocks + 1, n) norms of the dimensions left.

    Candidates that score under floor need not be found.
    """
    dims = len(query)
    alive = np.flatnonzero(ids != own)
    part = np.zeros(len(alive), columns.dtype)
    for b, at in enumerate(range(0, dims, block)):
        part = part + query[at : at + block] @ columns[at : at + block, alive]
        if not len(alive):
            break
        mass = float(np.sqrt((query[at + block :].astype(float) ** 2).sum())) * rest[b + 1, alive] * (1 + 1e-9) + 1
        low = max(floor, np.partition(part - mass, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf)
        keep = part + mass >= low
        if not keep.all():
            alive, part = alive[keep], part[keep]
    if len(alive) > k:
        least = np.partition(part, len(part) - k)[len(part) - k]
        alive, part = alive[part >= least], part[part >= least]
    order = np.lexsort((ids[alive], -part))[:k]
    return ids[alive][order], part[order].astype(np.int64)


def _whole(x: float) -> int:
    return int(x) * 1024 if abs(x) >= 2.0**52 else int(np.floor(x * 1024))


def _beyond(score: int) -> str:
    """FITS for a long; else text that sorts as the number does, before or after FITS."""
    if -(1 << 63) <= score < 1 << 63:
        return FITS
    return f"p{score:0{DIGITS}d}" if score > 0 else f"a{10**DIGITS + score:0{DIGITS}d}"


def search_exact(query: list[int], vectors: list[list[int]], ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """As search, with numbers of any size."""
    scores = [(-sum(a * b for a, b in zip(query, v, strict=True)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def _unpack(wide: bool, d: int, n: int, cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, np.float64 if wide else np.int32).reshape(d, n)


def _search_pairs(k: int, block: int):
    """Rows of (group, block of queries with their floors)."""

    def pair(r):
        ids, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
        group, queries = _unpack(r["wide"], r["d"], r["n"], r["cells"]), _unpack(r["q_wide"], r["d"], r["q_n"], r["q_cells"])
        if r["wide"] or r["q_wide"]:
            whole = lambda wide, x: [[_whole(v) for v in row] if wide else [int(v) for v in row] for row in x.T.tolist()]
            vectors = whole(r["wide"], group)
            for q, v in zip(asked.tolist(), whole(r["q_wide"], queries), strict=True):
                yield [(q, i, s if _beyond(s) == FITS else None, _beyond(s)) for i, s in search_exact(v, vectors, ids, q, k)]
            return
        squares = group.astype(float) ** 2
        order = np.argsort(-squares.sum(1), kind="stable")  # heavy dimensions first
        squares = squares[order]
        # Doubles hold all sums exactly below 2**53, and multiply faster.
        top = lambda x: int(np.abs(x).max(initial=0))
        kind = np.float64 if r["d"] * top(group) * top(queries) < 1 << 53 else np.int64
        columns, rows = np.ascontiguousarray(group[order].astype(kind)), np.ascontiguousarray(queries[order].T.astype(kind))
        cuts = [*range(0, r["d"], block), r["d"]]
        rest = np.sqrt(np.array([squares[c:].sum(0) for c in cuts])) if r["d"] else np.zeros((1, len(ids)))
        floors = np.frombuffer(r["floors"], np.float64) if r.get("floors") else np.full(len(asked), -np.inf)
        for q, v, floor in zip(asked.tolist(), rows, floors, strict=True):
            found, scores = search(v, columns, rest, ids, q, k, block, floor)
            yield [(q, i, s, FITS) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                rows = [x for found in pair(batch.slice(i, 1).to_pylist()[0]) for x in found]
                if rows:
                    q, v, s, over = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64()), pa.array(over, pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _with_floors(floors: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks with the floors of their queries, in order; queries without one have none."""

    def run(key, block, found):
        import pandas as pd

        known = dict(zip(found["query_id"], found["floor"], strict=True))
        out = []
        for r in block.to_dict("records"):
            ids = np.frombuffer(r["q_ids"], np.int64)
            out.append(r | {"floors": np.array([known.get(int(i), -np.inf) for i in ids], np.float64).tobytes()})
        return pd.DataFrame(out, columns=[*block.columns, "floors"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + ", floors binary"
    return blocks.groupBy("b").cogroup(floors.groupBy("b")).applyInPandas(run, schema)


def top_k(embeddings: DataFrame, is_query, k: int = 10, group_rows: int = 8192, query_block: int = 1024, dimension_block: int = 8, together: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query; is_query: condition on vec_id."""
    x = F.col("embedding")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    taking_part = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    vectors = taking_part.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("v"))
    asked = vectors.where(is_query).dropDuplicates(["vec_id", "v"])
    groups = materialise(vectors.mapInArrow(_pack(group_rows), PACKED).withColumn("g", F.monotonically_increasing_id()), "groups")
    blocks = asked.mapInArrow(_pack(query_block), PACKED).toDF("d", "q_wide", "q_n", "q_ids", "q_cells")
    blocks = materialise(blocks.withColumn("b", F.monotonically_increasing_id()), "blocks")
    run = _search_pairs(k, dimension_block)
    names = ["d", "wide", "n", "ids", "cells", "q_wide", "q_n", "q_ids", "q_cells"]

    # Each block against the largest group of its dimension count; the k-th best score there is a floor of the k-th best of all.
    first = groups.where("NOT wide").groupBy("d").agg(F.max_by("g", F.struct("n", "g")).alias("g"))
    seeds = groups.join(F.broadcast(first), ["d", "g"], "left_semi")  # one row for each dimension count
    tried = blocks.where("NOT q_wide").join(seeds.drop("g"), "d").select(*names).mapInArrow(run, RESULT)
    kth = _best(tried, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    floors = materialise(kth, "floors")
    members = blocks.select("b", "q_ids").mapInArrow(_members, "b long, query_id long")
    repeated = members.groupBy("query_id").agg(F.count(F.lit(1)).alias("times"))  # ids with several vectors share no floor
    safe = members.join(floors, "query_id").join(repeated.where("times = 1").select("query_id"), "query_id", "left_semi").select("b", "query_id", "floor")
    floored = materialise(_with_floors(safe, blocks), "floored")

    # Keys of a block and `together` groups: a task holds one pair at a time, and there are as many keys as work asks for.
    light = blocks.select("b", "d").withColumn("at", F.row_number().over(Window.partitionBy("d").orderBy("b")) - 1)  # a row for each block
    salts = max(1, -(-groups.count() // together))
    many = light.groupBy("d").agg(F.count(F.lit(1)).cast("int").alias("many"))
    dealt = groups.withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(salts)).cast("int")).join(F.broadcast(many), "d").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    facing = floored.join(light.select("b", "at"), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = materialise(dealt.join(facing, ["d", "at", "salt"]).select(*names, "floors").mapInArrow(run, RESULT), "near")
    release(groups, blocks, floors, floored)
    return _best(near, k).select("query_id", "rank", "vec_id", "score")


def _members(batches):
    import pyarrow as pa

    for batch in batches:
        for b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), b, np.int64)), pa.array(held)], ["b", "query_id"])


def op8(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
