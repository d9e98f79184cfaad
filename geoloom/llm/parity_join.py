"""Exact Jaccard join of word n-gram sets by parity sketches.

The hashes of a set's shingles are dealt over k blocks; a block's parity word is the XOR of its hashes. Each element
that two sets do not share changes one block at most, so the number of differing blocks is a lower bound of their
symmetric difference. For J >= t the smaller set, of m shingles, has a partner that differs in at most m(1-t)/t
elements, so with more blocks than that some block agrees (pigeonhole). k is taken from a coarse grid by size band; a
set joins with the k of every m that its partners may have. Blocks without elements agree for no reason: k leaves
slack for them, and only sets with more empty blocks than the slack are also joined on these.

1. Sets that are equal form a class; its smallest doc_id stands for it, and only its text gets join keys.
2. Representatives that share a parity word are linked to the smallest of them (a star), not to each other.
3. Star pairs whose sizes and parity sketches allow J >= t are verified on the texts; links make components. A
   sketch has two bits or more for each shingle, so that it also tells long sets apart; of two lengths the longer is
   folded.
4. Within a star whose members lie in several components, pairs across components are compared by sketches in tiles
   and verified: first the nearest for each member and component, then all that are left. A pair that shares a
   parity word lies in one star, so no link between components is lost.

Rows are written once into the shared folder with a number of their own; everything else goes by that number and by
classes, never by doc_id. So rows may repeat, doc_ids may repeat with other texts or be null.

Cases: null, empty and wordless texts have no shingles and link with nothing; texts with fewer words than a shingle
are one shingle; very long texts are whole sets, their sketches exclude fewer pairs; a similarity equal to the bound
links; repeated rows are one class and each get a row; null doc_ids take part, and a component without any other id
has a null id; of rows with a component's smallest doc_id drop_near_duplicates keeps one, and every row without
shingles; an empty table gives an empty result; further columns, of any name, are not carried by link_documents and
kept by drop_near_duplicates.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .runtime import materialise, modest_batches, release, table
from .tokens import forget_encoders, text_slices

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: Bits of the shortest and the longest sketch. Beyond, a sketch only excludes fewer pairs; its distance stays a lower bound.
SKETCH_BITS = (256, 65536)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _M[3]
    h = h ^ (h >> np.uint64(29))
    h = h * _M[0]
    return h ^ (h >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of text's word n-grams; bytes.split and bytes.lower know ASCII alone."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mix(h * _M[1] + w[i : len(w) - size + 1 + i])
    return np.unique(h)


class Bands:
    """Block counts for Jaccard num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.grid = [2]
        while self.grid[-1] < 1 << 40:
            self.grid.append(self.grid[-1] + max(1, self.grid[-1] // 2))
        self.known: dict[int, list[tuple[int, int]]] = {}

    def most(self, m: int) -> int:
        return m * (self.den - self.num) // self.num

    def blocks(self, m: int) -> int:
        d = self.most(m)
        return self.grid[bisect.bisect_left(self.grid, d + 3 + d // 16)] if d else 0

    def of(self, n: int) -> list[tuple[int, int]]:
        """(k, blocks that agree at least) for all smaller sizes m of pairs that a set of n shingles may be in."""
        if n not in self.known:
            low = -(-n * self.num // self.den)
            found = []
            m = n
            while m >= low and (k := self.blocks(m)):
                top = self._largest(k)
                found.append((k, k - self.most(top)))
                m = self._smallest(k, low, m) - 1
            self.known[n] = found
        return self.known[n]

    def _largest(self, k: int) -> int:
        a, b = 1, 2
        while self.blocks(b) <= k:
            b *= 2
        while b - a > 1:
            c = (a + b) // 2
            a, b = (c, b) if self.blocks(c) <= k else (a, c)
        return a

    def _smallest(self, k: int, a: int, b: int) -> int:
        while a < b:
            c = (a + b) // 2
            a, b = (a, c) if self.blocks(c) >= k else (c + 1, b)
        return a


def parity_keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: (k, block, parity word) mixed into 64 bits."""
    out = []
    for k, agree in bands.of(len(h)):
        block = ((h >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        held, first = np.unique(block[order], return_index=True)
        words = np.bitwise_xor.reduceat(h[order], first)
        base = held.astype(np.uint64) * _M[4] + np.array([k], np.uint64) * _M[5]
        out.append(_mix(_mix(words) + base))
        if k - len(held) >= agree:
            empty = np.setdiff1d(np.arange(k), held).astype(np.uint64)
            out.append(_mix(empty * _M[6] + np.array([k], np.uint64) * _M[7]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities in 64-bit words: a Hamming distance never exceeds the sets' symmetric difference."""
    bits = min(max(SKETCH_BITS[0], 1 << (2 * len(h)).bit_length()), SKETCH_BITS[1])
    odd = np.bincount(((h * _M[2]) >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def fold(s: np.ndarray) -> np.ndarray:
    """Sketches (in the last axis) of half as many bits."""
    half = s.shape[-1] // 2
    return s[..., :half] ^ s[..., half:]


def _folded(long: str, short: str):
    """Column `long`, folded if it is longer than column `short`."""
    half = (F.size(long) / 2).cast("int")
    return F.when(F.size(long) > F.size(short), F.zip_with(F.slice(long, F.lit(1), half), F.slice(long, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(long))


def _sets(words: int):
    """(row, size, two hashes of the set, sketch) of every document; row holds doc_id and text."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        forget_encoders()
        for batch in batches:
            rows = batch.column(0)
            texts_only = pa.RecordBatch.from_arrays([pc.struct_field(rows, "text")], ["text"])
            for first, last, texts in text_slices(texts_only):
                found = [shingles(t, words) for t in texts]
                a = [int(np.bitwise_xor.reduce(h)) if len(h) else 0 for h in found]
                b = [int(_mix(h + _M[6]).sum(dtype=np.uint64)) if len(h) else 0 for h in found]
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([rows.slice(first, last - first), pa.array([len(h) for h in found], pa.int64()), *hashes, _lists([sketch(h) for h in found])], ["row", "n", "a", "b", "sketch"])

    return run


def _keys(words: int, bands: Bands):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in text_slices(batch):
                keys = [parity_keys(shingles(t, words), bands).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), _lists(keys)], ["rep", "keys"])

    return run


def _lists(rows: list[np.ndarray]):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows), pa.int64()))


def _verify(words: int, num: int, den: int):
    """Rows (hub, part, v, text) in order: of each hub and part the hub's own text, without v, and then its partners."""

    def run(batches):
        import pyarrow as pa

        forget_encoders()
        key, one = None, None
        for batch in batches:
            hubs, parts, partners = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for first, last, texts in text_slices(batch):
                for u, c, v, t in zip(hubs[first:last], parts[first:last], partners[first:last], texts, strict=True):
                    two = shingles(t, words)
                    if v is None:
                        key, one = (u, c), two
                    elif key == (u, c):
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        if den * both >= num * (len(one) + len(two) - both):
                            out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["u", "v"])

    return run


def verified(pairs: DataFrame, rows: DataFrame, words: int, num: int, den: int, chunk: int = 200_000, task: int = 2_000_000) -> DataFrame:
    """The pairs (u, v) of row numbers whose texts link. pairs: u, v, n (shingles of v); rows: rid, row.

    The partners of each u are dealt over parts of `chunk` shingles or so, and these over tasks of `task`; a task
    reads its rows one after the other.
    """
    pairs = materialise(pairs.select("u", "v", "n"), "pairs")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    work = pairs.groupBy("u").agg(F.sum("n").alias("work"))
    parts = F.ceil(F.col("work") / chunk)
    dealt = materialise(pairs.join(work, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.greatest(parts, F.lit(1))).alias("c")), "dealt")
    ids = materialise(dealt.select(F.explode(F.array("u", "v")).alias("rid")).distinct(), "ids")
    held = _keep_matching(rows.select("rid", F.col("row.text").alias("text")), ids, "left_semi")
    hubs = dealt.select("u", "c").distinct()
    left = hubs.join(held.withColumnRenamed("rid", "u"), "u").select("u", "c", F.lit(None).cast("long").alias("v"), "text")
    right = dealt.join(held.withColumnRenamed("rid", "v"), "v").select("u", "c", "v", "text")
    ordered = left.unionByName(right).repartition(max(1, -(-total // task)), "u", "c").sortWithinPartitions("u", "c", F.col("v").asc_nulls_first())
    out = materialise(ordered.mapInArrow(_verify(words, num, den), "u long, v long"), "links")
    release(pairs, dealt, ids)
    return out


def _crossing(most_num: int, most_den: int, num: int, den: int, nearest: bool):
    """Pairs of two tiles of a star, in different components, that sizes and sketches allow."""

    def run(key, rows):
        import pandas as pd

        _, i, j = key
        left = rows[rows["tile"] == i]
        right = rows[rows["tile"] == j]
        one = [np.array(x, np.int64).view(np.uint64) for x in left["sketch"]]
        lengths = right["sketch"].map(len).to_numpy()
        classes = {}
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            two = np.array(right["sketch"].iloc[at].tolist(), np.int64).view(np.uint64)
            classes[int(size)] = (at, two, fold(two))
        ids, n, comp = ([x[c].to_numpy() for x in (left, right)] for c in ("x", "n", "component"))
        found = []
        for r in range(len(left)):
            apart = np.full(len(right), np.iinfo(np.int64).max // (2 * most_den))  # sets of other sizes don't link
            for size, (at, two, halved) in classes.items():
                mine = len(one[r])
                if mine in (size, size // 2, 2 * size):
                    apart[at] = np.bitwise_count((one[r] if mine <= size else fold(one[r])) ^ (two if mine >= size else halved)).sum(1)
            small, large = np.minimum(n[0][r], n[1]), np.maximum(n[0][r], n[1])
            ok = (comp[0][r] != comp[1]) & (apart * most_den <= (small + large) * most_num) & (den * small >= num * large)
            at = np.flatnonzero(ok)
            left_over = 0
            if nearest and len(at):
                order = np.lexsort((ids[1][at], apart[at], comp[1][at]))
                best = at[order]
                best = best[np.r_[True, comp[1][best][1:] != comp[1][best][:-1]]]
                left_over, at = int(len(best) < len(at)), best
            found += [(min(ids[0][r], y), max(ids[0][r], y), key[0], left_over, n[1][k] if ids[0][r] < y else n[0][r]) for k, y in zip(at, ids[1][at], strict=True)]
        return pd.DataFrame(found, columns=["u", "v", "hub", "left_over", "n"], dtype="int64")

    return run


def _keep_matching(rows: DataFrame, ids: DataFrame, how: str, key: str = "rid", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Semi- or anti-join with ids, which are sent to all executors only if they are few; else both are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, how)


def _stars(own: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(hub, x): representatives that share a parity word with a smaller one, which is the least of that word's."""
    keyed = materialise(own.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")).mapInArrow(_keys(words, bands), "rep long, keys array<long>"), "keys")
    each = keyed.select("rep", F.explode("keys").alias("key"))
    # Aggregated before the join: a word that very many sets share is one row of each task, and its join can be split.
    # The join is by shuffle at every size: how many words are shared grows with the documents.
    shared = materialise(each.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "hub"), "shared")
    out = materialise(each.join(shared.hint("merge"), "key").where("rep <> hub").select("hub", F.col("rep").alias("x")).distinct(), "stars")
    release(keyed, shared)
    return out


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links)
    out = materialise(found, "components")
    release(found)
    return out


def _links(docs: DataFrame, words: int, num: int, den: int, tile: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (rid, row, n, a, b), classes (n, a, b, rep, low: smallest doc_id) and components (node, component) of reps."""
    bands = Bands(num, den)
    most_num, most_den = den - num, den + num  # |A xor B| <= (|A| + |B|) (1 - t) / (1 + t)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    sets = packed.mapInArrow(_sets(words), f"row {packed.schema['row'].dataType.simpleString()}, n long, a long, b long, sketch array<long>")
    rows = materialise(sets.withColumn("rid", F.monotonically_increasing_id()), "rows")
    classes = materialise(rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("rid").alias("rep"), F.min("row.doc_id").alias("low")), "classes")
    copies = materialise(rows.where("n > 0").select("rid", "n", "a", "b").join(classes.select("n", "a", "b", "rep"), ["n", "a", "b"]).where("rid <> rep").select("rid"), "copies")
    own = _keep_matching(rows.where("n > 0"), copies, "left_anti")
    sized = materialise(own.select(F.col("rid").alias("rep"), "n", "sketch"), "sized")
    stars = _stars(own, words, bands)
    apart = F.aggregate(F.zip_with(_folded("hub_sketch", "sketch"), _folded("sketch", "hub_sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    small, large = F.least("hub_n", "n"), F.greatest("hub_n", "n")
    first = (
        stars.join(sized.withColumnRenamed("rep", "x"), "x")
        .join(sized.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub")
        .where((den * small >= num * large) & (apart * most_den <= (small + large) * most_num))
        .select(F.col("hub").alias("u"), F.col("x").alias("v"), "n")
    )
    links, again = verified(first, rows, words, num, den), None
    for nearest in (True, False):
        found = _components(links)
        groups = stars if again is None else stars.join(F.broadcast(again) if again.count() <= 1_000_000 else again, "hub", "left_semi")
        members = groups.select("hub", "x").unionByName(groups.select("hub", F.col("hub").alias("x")).distinct())
        placed = materialise(members.join(found.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x")), "placed")
        counted = placed.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high")
        mixed = materialise(counted.select("hub", F.ceil(F.col("many") / tile).cast("int").alias("tiles")), "mixed")
        held = placed.join(F.broadcast(mixed) if mixed.count() <= 1_000_000 else mixed, "hub").join(sized.withColumnRenamed("rep", "x"), "x")
        tiled = held.withColumn("tile", F.pmod(F.xxhash64("x"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
        crossing = tiled.groupBy("hub", "i", "j").applyInPandas(_crossing(most_num, most_den, num, den, nearest), "u long, v long, hub long, left_over long, n long")
        more = materialise(crossing.distinct(), "crossing")
        release(placed, mixed)
        if more.isEmpty():
            release(more)
            break
        fresh = verified(more.select("u", "v", "n").distinct(), rows, words, num, den)
        both = materialise(links.unionByName(fresh), "links")
        release(links, fresh, found)
        links, found = both, None
        again = materialise(more.where("left_over = 1").select("hub").distinct(), "again")  # stars of which not all pairs were tried
        release(more)
        if again.isEmpty():
            break
    if again is not None:
        release(again)
    components = found if found is not None else _components(links)
    release(copies, sized, stars, links)
    return rows, classes, components


def _named(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Rows; classes (n, a, b) with the root and the smallest doc_id of their component; tables to let go of later."""
    rows, classes, components = _links(docs, words, num, den)
    rooted = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", "low", F.coalesce("component", "rep").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, materialise(rooted.drop("low").join(lows, "root"), "named"), (classes, components)


def link_documents(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; documents link when J >= num / den."""
    rows, named, held = _named(docs.select("doc_id", "text"), words, num, den)
    joined = rows.select("row.doc_id", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    out = materialise(joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "linked")
    release(rows, named, *held)
    return out


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of docs with the smallest doc_id of each component, with all columns; it reads a table of the shared folder."""
    rows, named, held = _named(docs, words, num, den)
    placed = rows.where("n > 0").select("rid", "row.doc_id", "n", "a", "b").join(named, ["n", "a", "b"]).select("rid", "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("least"))
    winners = placed.where("least").groupBy("root").agg(F.min("rid").alias("winner"))
    lost = materialise(placed.join(winners, "root").where("rid <> winner").select("rid"), "lost")
    release(named, *held)
    out = _keep_matching(rows, lost, "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    out._geoloom_path = rows._geoloom_path
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(modest_batches(spark), sf_dir, "documents"), words=4, num=85, den=100)
