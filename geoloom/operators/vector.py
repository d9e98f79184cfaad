"""Scanline rasterisation, intersection, buffers and footprints, on rings in pixel space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(features: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, columns to keep, xa, ya, xb, yb of all rings; open rings are closed."""
    rings = features.select(key, *keep, F.explode("rings").alias("r")).select(key, *keep, F.when(F.col("r")[0] == F.element_at("r", -1), F.col("r")).otherwise(F.concat("r", F.slice("r", 1, 1))).alias("r"))
    pairs = rings.where(F.size("r") > 1).select(key, *keep, F.explode(F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("e"))
    return pairs.select(key, *keep, F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb"))


def spans(features: DataFrame, key: str = "zone_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, columns to keep, prow, first and last column whose centres lie inside, by even-odd crossings of pixel rows' centres.

    Features are dealt out by key, so that their many crossings are sorted where they arise.
    """
    dealt = features.select(key, *keep, "rings").repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    low, high = F.ceil(F.least("ya", "yb") - 0.5).cast("int"), (F.ceil(F.greatest("ya", "yb") - 0.5) - 1).cast("int")
    crossed = edges(dealt, key, keep).withColumns({"low": low, "high": high}).where("low <= high").withColumn("prow", F.explode(F.sequence("low", "high")))
    at = F.col("xa") + (F.col("prow") + 0.5 - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    sorted_ = Window.partitionBy(key, "prow").orderBy("cx")
    paired = crossed.select(key, *keep, "prow", at.alias("cx")).select(key, *keep, "prow", "cx", F.lead("cx").over(sorted_).alias("to"), F.row_number().over(sorted_).alias("n")).where("n % 2 = 1 AND to IS NOT NULL")
    return paired.select(key, *keep, "prow", F.floor(F.col("cx") + 0.5).cast("int").alias("first"), (F.floor(F.col("to") + 0.5) - 1).cast("int").alias("last")).where("first <= last")


def clipped_spans(features: DataFrame, key: str, cols: int | None, rows: int | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """spans, within cols and rows if given."""
    s = spans(features, key, keep)
    if cols is None:
        return s
    return s.where(F.col("prow").between(0, rows - 1)).withColumns({"first": F.greatest("first", F.lit(0)), "last": F.least("last", F.lit(cols - 1))}).where("first <= last")


def rasterize(features: DataFrame, key: str = "zone_id", cols: int | None = None, rows: int | None = None) -> DataFrame:
    """key, prow, pcol of covered pixels, within cols and rows if given; a key is one feature."""
    # Spans of one key and row never overlap, so no pixel comes twice.
    return clipped_spans(features, key, cols, rows).select(key, "prow", F.explode(F.sequence("first", "last")).alias("pcol"))


def _cross(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def intersecting(candidates: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Of candidate pairs those whose polygons meet: edges cross or touch, or a corner of one lies within the other."""
    collected = lambda d, k, n: edges(d, k).groupBy(k).agg(F.collect_list(F.struct("xa", "ya", "xb", "yb")).alias(n))
    # Spark's guess of the left side's exploded rows is far too low: it must not be broadcast.
    pairs = candidates.select(left_key, right_key).distinct()
    both = pairs.join(collected(right, right_key, "b"), right_key).join(collected(left, left_key, "a").hint("merge"), left_key)
    low, high = lambda e, c: F.least(e[f"{c}a"], e[f"{c}b"]), lambda e, c: F.greatest(e[f"{c}a"], e[f"{c}b"])

    def meet(e, f):
        near = (low(e, "x") <= high(f, "x")) & (low(f, "x") <= high(e, "x")) & (low(e, "y") <= high(f, "y")) & (low(f, "y") <= high(e, "y"))
        of = lambda s, t, n: _cross(s["xa"], s["ya"], s["xb"], s["yb"], t[f"x{n}"], t[f"y{n}"])
        return near & (of(e, f, "a") * of(e, f, "b") <= 0) & (of(f, e, "a") * of(f, e, "b") <= 0)

    # Even-odd parity of a ray from the other polygon's points, counted by edges.
    ray = lambda p, e: ((e["ya"] > p["ya"]) != (e["yb"] > p["ya"])) & (p["xa"] < e["xa"] + (p["ya"] - e["ya"]) * (e["xb"] - e["xa"]) / F.when(e["yb"] != e["ya"], e["yb"] - e["ya"]))
    some_inside = lambda points, of: F.exists(points, lambda p: F.size(F.filter(of, lambda e: ray(p, e))) % 2 == 1)
    cut = F.exists("a", lambda e: F.exists("b", lambda f: meet(e, f)))
    return both.where(cut | some_inside("b", F.col("a")) | some_inside("a", F.col("b"))).select(left_key, right_key)


def buffer_lines(lines: DataFrame, distance: float, key: str = "line_id") -> DataFrame:
    """key, prow, pcol of pixels whose centres are within distance of a line, with flat ends and round joins.

    lines: key and `points`, an array of x, y. A segment counts where the centre projects onto it; inner points count all round.
    """
    n = F.size("points")
    segments = lines.where(n > 1).select(key, F.posexplode(F.arrays_zip(F.slice("points", F.lit(1), n - 1).alias("a"), F.slice("points", F.lit(2), n - 1).alias("b"))).alias("k", "e"))
    parts = segments.select(key, "k", F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb"))
    low = lambda a, b: F.floor(F.least(a, b) - distance - 0.5).cast("int")
    high = lambda a, b: F.ceil(F.greatest(a, b) + distance).cast("int")
    near = parts.withColumn("prow", F.explode(F.sequence(low("ya", "yb"), high("ya", "yb")))).withColumn("pcol", F.explode(F.sequence(low("xa", "xb"), high("xa", "xb"))))
    dx, dy, px, py = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"), F.col("pcol") + 0.5 - F.col("xa"), F.col("prow") + 0.5 - F.col("ya")
    length = dx * dx + dy * dy
    t = (px * dx + py * dy) / F.when(length > 0, length)
    side = px * dy - py * dx
    along = (t >= 0) & (t <= 1) & (side * side <= length * distance * distance)
    joint = (F.col("k") > 0) & (px * px + py * py <= distance * distance)
    return near.where(F.coalesce(along, F.lit(False)) | joint).select(key, "prow", "pcol").distinct()


def footprint_boxes(pixels: DataFrame, key: str, x0: float, dx: float, y0: float, dy: float, nodata: int = 255) -> DataFrame:
    """key and the box of valid pixels in world coordinates."""
    valid = pixels.where(F.col("value") != nodata)
    box = valid.groupBy(key).agg(F.min("pcol").alias("a"), F.max("pcol").alias("b"), F.min("prow").alias("c"), F.max("prow").alias("d"))
    return box.select(key, (x0 + F.col("a") * dx).alias("xmin"), (x0 + (F.col("b") + 1) * dx).alias("xmax"), (y0 + (F.col("d") + 1) * dy).alias("ymin"), (y0 + F.col("c") * dy).alias("ymax"))


def _traced(key, block, group, prow, pcol, cols: int, rows: int):
    """One batch of valid_rings: what morphology.trace finds, for whole groups at once. key and block: Arrow columns of a row a group."""
    import numpy as np
    import pyarrow as pa

    wide, tall = cols + 2, rows + 2
    cells = np.unique(group * (wide * tall) + prow * wide + pcol)
    at = lambda k: np.minimum(np.searchsorted(cells, k), len(cells) - 1)
    free = lambda step: cells[at(cells + step)] != cells + step
    g, y, x = cells // (wide * tall), cells // wide % tall, cells % wide
    # Edges keep their cell on the right: east, south, west, north.
    sides = [(free(-wide), 0, 0, 1, 0), (free(1) | (x == cols - 1), 1, 0, 1, 1), (free(wide), 1, 1, 0, 1), (free(-1) | (x == 0), 0, 1, 0, 0)]
    vertex = lambda f, dx, dy: g[f] * (wide * tall) + (x[f] + dx) * tall + y[f] + dy
    start, end = (np.concatenate([vertex(s[0], *s[k : k + 2]) for s in sides]) for k in (1, 3))
    heading = np.concatenate([np.full(int(s[0].sum()), d, np.int8) for d, s in enumerate(sides)])
    order = np.argsort(start, kind="stable")
    start, end, heading = start[order], end[order], heading[order]
    # Where two edges leave a corner that cells touch at, the right turn keeps to the own cell.
    after = np.searchsorted(start, end)
    other = np.minimum(after + 1, len(start) - 1)
    after = np.where((start[other] == end) & (other != after) & (heading[after] != (heading + 1) % 4), other, after)
    before = np.empty_like(heading)
    before[after] = heading
    to, seen, way, first = after.tolist(), bytearray(len(start)), [], []
    for e in range(len(to)):
        if not seen[e]:
            first.append(len(way))
            while not seen[e]:
                seen[e] = 1
                way.append(e)
                e = to[e]
    way, first = np.array(way), np.array(first)
    turns = (heading != before)[way]
    corners, n = start[way[turns]], np.add.reduceat(turns.astype(np.int64), first)
    ends = np.cumsum(n)
    # Each ring's first corner comes again at its end.
    closed = np.insert(corners, ends, corners[ends - n])
    per_group = np.bincount(start[way[first]] // (wide * tall), minlength=len(key))
    point = pa.StructArray.from_arrays([pa.array((closed // tall % wide).astype(float)), pa.array((closed % tall).astype(float))], ["x", "y"])
    ring = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32)), point)
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_group)]).astype(np.int32)), ring)
    return pa.RecordBatch.from_arrays([key, block, rings], ["key", "block_id", "rings"])


def valid_rings(pixels: DataFrame, key: str, cols: int, rows: int, block: int = 1024, nodata: float = 255) -> DataFrame:
    """key, block_id and rings (pixel space) around the pixels with data, holes among them, cut at block edges.

    Pixels come sorted by key and block; whole groups of a batch are traced together, since most are small.
    """
    across = -(-cols // block)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def differs(c):
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

        def traced(table):
            k, b, r, c = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in table.columns)
            new = np.concatenate([[True], differs(k) | differs(b)])
            at = pa.array(np.flatnonzero(new))
            out = _traced(k.take(at), b.take(at), np.cumsum(new) - 1, r.to_numpy().astype(np.int64), c.to_numpy().astype(np.int64), cols, rows)
            return pa.RecordBatch.from_arrays(out.columns, [key, "block_id", "rings"])

        held = []  # batches whose last group may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = pa.Table.from_batches([x.slice(x.num_rows - 1) for x in held[-2:]] if len(held) > 1 else [batch.slice(0, 1), batch.slice(batch.num_rows - 1)])
            k, b = (c.combine_chunks() for c in last.columns[:2])
            if not (differs(k) | differs(b)).any():
                continue
            k, b = batch.column(0), batch.column(1)
            breaks = np.flatnonzero(differs(k) | differs(b))
            cut = int(breaks[-1]) + 1 if len(breaks) else 0
            held[-1] = batch.slice(0, cut)
            yield traced(pa.Table.from_batches(held))
            held = [batch.slice(cut)]
        if held:
            yield traced(pa.Table.from_batches(held))

    kind = pixels.schema[key].dataType.simpleString()
    placed = pixels.where(F.col("value") != nodata).select(key, F.expr(f"cast((prow div {block}) * {across} + pcol div {block} as int)").alias("block_id"), F.col("prow").cast("int").alias("prow"), F.col("pcol").cast("int").alias("pcol"))
    dealt = placed.repartition(key, "block_id").sortWithinPartitions(key, "block_id")
    return dealt.mapInArrow(run, f"{key} {kind}, block_id int, rings array<array<struct<x:double,y:double>>>")
