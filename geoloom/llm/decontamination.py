"""Benchmark decontamination: rare word pairs of test items seed Smith-Waterman alignments in the documents.

An alignment's score (match +2, mismatch -1, gap -1) is divided by that of a perfect copy; copies with edited,
dropped and added words stay above `threshold`. An alignment must also be worth `least` words, or the whole item.

Seeds are gapped 2-grams: two words at most two apart in the item, found at most two apart in the text. Of two words
matched one after the other, a larger distance costs 2 or more, so an alignment that reaches the threshold t on an
item of n words holds at least t * n - 1 such pairs, whatever was edited. Pairs are counted over all documents, and
the commonest of an item, all but RARE of that number, are left out: every copy still holds RARE of the rest. A
document is aligned where so many seeds of an item lie as close as a copy's words.

Items are taken in blocks of about `block_items` and `block_bytes` of text, each held by every task; documents are read twice a block.

Cases: null, empty and very short items (under 3 words) have no seeds and match nothing; null and empty documents match nothing; very
long documents are aligned around their seeds only; repeated documents or items give their rows each; ties in score
go to the first place in the text; empty tables give empty results; further columns are not carried by find_leaks and
kept by drop_leaks, which judges each row by its own text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import modest_batches, table
from .tokens import forget_encoders, text_slices

WORD = re.compile(r"\w+")
#: Latin-1 letters, digits and _ in lower case, all else a blank: what WORD finds in the lower-cased text, by bytes.
_LATIN = bytes(ord(chr(c).lower()) if WORD.fullmatch(chr(c)) else 32 for c in range(256))
#: Seeds that a passage must hold, where an alignment at the threshold has as many pairs.
RARE = 4
FOUND = "doc_id long, item_id long, score double, start int, end int"


class Items:
    """A block of items: their words' numbers, and which of them hold which word pairs."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, least: int):
        self.ids = [i for i, _ in rows]
        words = [WORD.findall((t or "").lower()) for _, t in rows]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for x in words for w in x}))}
        self.latin = {w.encode("latin-1"): n for w, n in self.vocabulary.items() if all(ord(c) < 256 for c in w)}
        self.words = [np.array([self.vocabulary[w] for w in x], np.int64) for x in words]
        self.needs = [Counter(x.tolist()) for x in self.words]
        self.thresholds = [max(threshold, min(len(x), least) / max(1, len(x))) for x in self.words]
        #: Pairs that an alignment at the threshold holds at least.
        self.least = [math.ceil(t * len(x) - 1 - 1e-9) if len(x) > 2 else 0 for x, t in zip(self.words, self.thresholds, strict=True)]
        self.base = len(self.vocabulary) + 1
        self.pairs = [self.codes(x)[0] if k else np.zeros(0, np.int64) for x, k in zip(self.words, self.least, strict=True)]
        self.all_pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *self.pairs]))

    def codes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs of known words at most two apart, and the places of their first words."""
        found, at = [], []
        for gap in (1, 2):
            full = np.flatnonzero((numbers[:-gap] >= 0) & (numbers[gap:] >= 0))
            found.append(numbers[full] * self.base + numbers[full + gap])
            at.append(full)
        return np.concatenate(found), np.concatenate(at)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts (-1: not in any item), where each text's begin, places of items' pairs, and which these are."""
        numbers, begins = [], []
        for t in texts:
            begins.append(len(numbers))
            try:
                known, words = self.latin, t.encode("latin-1").translate(_LATIN).split()
            except UnicodeEncodeError:
                known, words = self.vocabulary, WORD.findall(t.lower())
            numbers += [known.get(w, -1) for w in words]
            numbers += (-1, -1)  # no pair goes from one text to the next
        numbers = np.array(numbers, np.int64)
        codes, places = self.codes(numbers)
        at = np.searchsorted(self.all_pairs, codes)
        at[at == len(self.all_pairs)] = 0
        hit = self.all_pairs[at] == codes if len(self.all_pairs) else np.zeros(len(codes), bool)
        return numbers, np.array([*begins, len(numbers)]), places[hit], at[hit]

    def choose_seeds(self, documents: dict[int, int]) -> None:
        """documents: in how many each pair is. Of an item's places all but RARE of an alignment's least are left out."""
        seeds = []
        self.rare = [min(RARE, k) for k in self.least]  # seeds that an alignment holds at least
        for i, pairs in enumerate(self.pairs):
            times = Counter(np.searchsorted(self.all_pairs, pairs).tolist())
            spare = self.least[i] - self.rare[i]
            for pair in sorted(times, key=lambda p: (-documents.get(p, 0), p)):
                if spare >= times[pair]:
                    spare -= times[pair]
                else:
                    spare = -1  # from here on all are rare enough
                    seeds.append((pair, i))
        pair, item = np.array(sorted(seeds), np.int64).reshape(-1, 2).T
        self.owners, self.first = item, np.searchsorted(pair, np.arange(len(self.all_pairs) + 1))
        #: Words of a copy at most, from its first to its last.
        self.spans = np.array([int((3 - 2 * t) * len(x)) + 2 for x, t in zip(self.words, self.thresholds, strict=True)], np.int64)
        self.rare = np.array(self.rare, np.int64)

    def seeded(self, begins: np.ndarray, places: np.ndarray, which: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(text, item, places) where as many seeds of the item lie within a copy's span as an alignment holds."""
        many = self.first[which + 1] - self.first[which]
        seed = np.repeat(np.arange(len(which)), many)
        item = self.owners[np.arange(len(seed)) - np.repeat(np.cumsum(many) - many, many) + self.first[which][seed]]
        at = places[seed]
        text = np.searchsorted(begins, at, "right") - 1
        order = np.lexsort((at, item, text))
        text, item, at = text[order], item[order], at[order]
        out: list[tuple[int, int, list[int]]] = []
        for need in np.unique(self.rare[item]) if len(item) else ():
            ahead = np.arange(len(item) - need + 1)
            last = ahead + need - 1
            good = (self.rare[item[ahead]] == need) & (text[last] == text[ahead]) & (item[last] == item[ahead]) & (at[last] - at[ahead] <= self.spans[item[ahead]])
            k = ahead[good]
            for t, i, a in zip(text[k].tolist(), item[k].tolist(), at[k].tolist(), strict=True):
                if out and out[-1][:2] == (t, i):
                    out[-1][2].append(a)
                else:
                    out.append((t, i, [a]))
        return sorted(out)


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment's score over a perfect copy's, and its first and last + 1 place in window."""
    h = np.zeros(len(window) + 1)
    begin = np.arange(len(window) + 1)
    best, where, along = 0.0, (0, 0), np.arange(len(window) + 1)
    for word in item:
        diagonal, came = np.zeros_like(h), along.copy()
        diagonal[1:] = h[:-1] + np.where(window == word, 2.0, -1.0)
        came[1:] = np.where(h[:-1] > 0, begin[:-1], along[:-1])
        up = h - 1
        came = np.where(up > diagonal, begin, came)
        here = np.maximum(np.maximum(diagonal, up), 0.0)
        shifted = here + along  # a gap along the window costs 1 a word
        top = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted >= top, along, 0))
        begin = came[source]
        h = np.maximum(top - along, 0.0)
        begin = np.where(h > 0, begin, along)
        if (k := int(h.argmax())) and h[k] > best:
            best, where = float(h[k]), (int(begin[k]), k)
    return best / (2.0 * len(item)), *where


def leaks(items: Items, texts: list[str]):
    """(number of the text, item, score, first and last + 1 code point) of the items that texts hold copies of."""
    numbers, begins, places, which = items.places(texts)
    spans: tuple[int, list] = (-1, [])
    for t, i, starts in items.seeded(begins, places, which):
        item, threshold, span, best = items.words[i], items.thresholds[i], int(items.spans[i]), (0.0, 0, 0)
        edges: list[list[int]] = []
        for s in starts:
            a, b = max(int(begins[t]), s - span), min(int(begins[t + 1]) - 2, s + 2 * span + 1)
            if edges and a <= edges[-1][1] and b - edges[-1][0] <= 8 * span:
                edges[-1][1] = b
            else:
                edges.append([a, b])
        for a, b in edges:
            window = numbers[a:b]
            held = Counter(window.tolist())
            if sum(min(n, held[w]) for w, n in items.needs[i].items()) < threshold * len(item):
                continue  # too few of the item's words to reach the threshold
            score, x, y = align(item, window)
            if score > best[0]:
                best = (score, a + x, a + y)
        if best[0] >= threshold:
            if spans[0] != t:
                spans = (t, [m.span() for m in WORD.finditer(texts[t].lower())])
            first, last = best[1] - int(begins[t]), best[2] - 1 - int(begins[t])
            yield t, i, best[0], spans[1][first][0], spans[1][last][1]


def _count(items: Items):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        total = np.zeros(len(items.all_pairs), np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch):
                _, begins, places, which = items.places(texts)
                text = np.searchsorted(begins, places, "right") - 1
                total += np.bincount(np.unique(text * len(total) + which) % max(1, len(total)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return run


def _find(items: Items):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in text_slices(batch):
                known = ids.slice(first, last - first).to_pylist()
                rows = [(known[t], items.ids[i], *rest) for t, i, *rest in leaks(items, texts)]
                if rows:
                    d, i, s, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "item_id", "score", "start", "end"])

    return run


def _keep(items: Items):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, _, texts in text_slices(batch):
                keep[[first + t for t, *_ in leaks(items, texts)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float, least: int, block_items: int, block_bytes: int):
    """Blocks of items with their seeds."""
    many, size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-many // block_items), -(-size // block_bytes))
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        items = Items([(r[0], r[1]) for r in part.select("item_id", "text").collect()], threshold, least)  # a block of items
        counts = docs.select("text").mapInArrow(_count(items), "pair long, n long").groupBy("pair").agg(F.sum("n"))
        items.choose_seeds(dict(map(tuple, counts.collect())))  # at most two for each word of the block
        yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 6, block_items: int = 100_000, block_bytes: int = 32 << 20) -> DataFrame:
    """FOUND columns: document, item, alignment score and the leaked passage's code points in the lower-cased text."""
    docs, found = docs.select("doc_id", "text"), None
    for items in _blocks(docs, benchmark, threshold, least, block_items, block_bytes):
        part = docs.mapInArrow(_find(items), FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 6, block_items: int = 100_000, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs whose text holds no copy of an item, with all their columns."""
    kept = docs
    for items in _blocks(docs, benchmark, threshold, least, block_items, block_bytes):
        kept = kept.mapInArrow(_keep(items), docs.schema)
    return kept


def op7(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(modest_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
