"""Packing along a space-filling curve.

Each document's text is hashed into a vector of byte 3-gram counts, projected with fixed random signs to three
dimensions, and given the Hilbert index of its cell. The curve is cut into ranges of about `partition_bytes` of text
by an exact histogram of bytes along it, and each range is sorted, so neighbours on the curve are packed together.
Within a range the token streams are laid end to end and cut at every 2048 ids; the tail of a range is cut into
powers of two, which need no padding.

Cases: null and empty texts are the end id alone; very long texts are cut over many sequences; repeated rows are
packed each; ties on the curve are ordered by doc_id and a hash of the text; a place on the curve that holds more
than a range's bytes (a large group of copies) is dealt over several ranges by that hash; an empty table gives no
pieces; further columns of docs are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import modest_batches, table
from .tokens import encoder, text_slices

DIMENSIONS, BITS, BUCKETS = 3, 10, 512
#: Leading bits of the curve by which its bytes are counted: a bounded number of counts.
HISTOGRAM_BITS = 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (n, dims) in 0..2**bits-1 (Skilling's transpose method)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[dims - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _projection() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))


def document_keys(column, projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of the whole texts of an Arrow string column without nulls, read from its buffers."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    points = np.zeros((len(column), DIMENSIONS))
    b = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint16) if data is not None else np.zeros(0, np.uint16)
    ends = ends - ends[0]
    grams = (b[:-2] * np.uint16(31321) + b[1:-1] * np.uint16(2777) + b[2:] * np.uint16(40503)) >> np.uint16(7)
    for i, (first, last) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if last - first >= 3:
            counts = np.sqrt(np.bincount(grams[first : last - 2], minlength=BUCKETS))
            counts -= counts.mean()
            points[i] = counts @ projection / (np.linalg.norm(counts) or 1.0)
    cells = np.clip(((np.tanh(points) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_index(cells, BITS)


def _add_keys(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    projection = _projection()
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.string()), "")
        keys = [document_keys(texts.slice(at, 512), projection) for at in range(0, len(texts), 512)]
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), ids, texts], ["curve", "doc_id", "text"])


class _Packer:
    """Cuts one partition's stream; rows: (doc_id, start, ids, doc_tokens, sequence, offset, sequence length)."""

    def __init__(self, partition: int, size: int):
        self.size, self.next, self.open, self.filled = size, partition << 40, [], 0

    def _close(self, pieces, size):
        rows, at = [], 0
        for doc, start, ids, n in pieces:
            rows.append((doc, start, ids, n, self.next, at, size))
            at += len(ids)
        self.next += 1
        return rows

    def add(self, doc, ids):
        rows, start = [], 0
        while start < len(ids):
            part = ids[start : start + self.size - self.filled]
            self.open.append((doc, start, part, len(ids)))
            start += len(part)
            self.filled += len(part)
            if self.filled == self.size:
                rows += self._close(self.open, self.size)
                self.open, self.filled = [], 0
        return rows

    def finish(self):
        rows, left = [], self.filled
        while left:
            size, pieces, got = 1 << (left.bit_length() - 1), [], 0
            while got < size:
                doc, start, ids, n = self.open.pop(0)
                part = ids[: size - got]
                pieces.append((doc, start, part, n))
                got += len(part)
                if len(part) < len(ids):
                    self.open.insert(0, (doc, start + len(part), ids[len(part) :], n))
            rows += self._close(pieces, size)
            left -= size
        return rows


def _pack(path, size, with_ids):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer = _Packer(TaskContext.get().partitionId(), size)

        def out(rows):
            doc, start, ids, n, sequence, offset, length = zip(*rows, strict=True)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            columns = [pa.array(x, pa.int64()) for x in (doc, start, [len(x) for x in ids], crc, n, sequence, offset, length)]
            names = [x.split()[0] for x in PIECE.split(", ")]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in text_slices(batch):
                rows = []
                for doc, ids in zip(docs.slice(first, last - first).to_pylist(), encoder(path).encode(texts), strict=True):
                    rows += packer.add(doc, ids)
                if rows:
                    yield out(rows)
        if rows := packer.finish():
            yield out(rows)

    return run


def cut_curve(sizes: dict[int, int], partition_bytes: int) -> tuple[int, list[tuple[int, int, int]]]:
    """How many ranges, and (place, first range, ranges that it is dealt over) of each place along the curve."""
    total = sum(sizes.values())
    n = max(1, -(-total // partition_bytes))
    out, seen = [], 0
    for place in sorted(sizes):
        first, last = seen * n // total, (seen + sizes[place] - 1) * n // total
        out.append((place, first, last - first + 1 if sizes[place] * 4 > partition_bytes else 1))
        seen += sizes[place]
    return n, out


def pack_documents(docs: DataFrame, sequence_length: int = 2048, tokenizer: str | None = None, with_ids: bool = True, partition_bytes: int = 12 << 20) -> DataFrame:
    """Pieces of sequences: PIECE columns and, with_ids, `ids`; each id of each document lies in exactly one piece.

    sequence_length must be a power of two. Sequence ids are unique; they follow the curve.
    """
    if sequence_length & (sequence_length - 1):
        raise ValueError("sequence_length must be a power of two")
    keyed = docs.select("doc_id", "text").mapInArrow(_add_keys, "curve long, doc_id long, text string")
    place = F.shiftright("curve", DIMENSIONS * BITS - HISTOGRAM_BITS).cast("int").alias("place")
    sizes = dict(map(tuple, keyed.groupBy(place).agg(F.sum(F.octet_length("text") + 16)).collect()))  # 2**HISTOGRAM_BITS rows at most
    n, ranges = cut_curve(sizes, partition_bytes)
    tie = F.xxhash64("doc_id", "text")
    cuts = F.broadcast(docs.sparkSession.createDataFrame(ranges, "place int, first int, many int"))
    dealt = keyed.withColumn("place", place).join(cuts, "place", "left")
    dealt = dealt.select("curve", "doc_id", "text", F.coalesce(F.col("first") + F.pmod(tie, F.col("many")).cast("int"), F.lit(0)).alias("range"))
    ordered = dealt.repartitionById(n, "range").sortWithinPartitions("curve", "doc_id", tie).select("curve", "doc_id", "text")
    return ordered.mapInArrow(_pack(tokenizer, sequence_length, with_ids), PIECE + (", ids array<int>" if with_ids else ""))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(modest_batches(spark), sf_dir, "documents"), with_ids=False)
