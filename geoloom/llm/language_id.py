"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed greedily into the longest
phrases that occur in that text; the language needing fewest phrases wins. NumPy parses all documents side by side,
and long ones in segments of SEGMENT characters, whose parses are then joined into that of the whole text.

The labelled text is that of at most `max_docs` rows of each language (those with the smallest hash of doc_id and
text), whole rows while they fit into `max_chars` characters; of a language with longer rows alone, the beginnings of
these. Every letter of the samples counts: the ALPHABET commonest have dense tables, others are searched.

Cases: very long texts are parsed whole; null, empty and letterless texts are `und` with score 0; null labels are not learnt from; without labelled
rows all is `und`; equal phrase counts go to the language first in order; repeated rows each get a row; an empty
table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import crc_of_id, table
from .tokens import text_slices

SEGMENT, ALPHABET = 2048, 64


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of text (Blumer et al., 1985); state 0 begins."""
    step, link, longest, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def normalise(text: str) -> str:
    """Lower case; runs of anything but letters are one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class CrossParser:
    """samples: language -> labelled text, normalised."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = [c for c, _ in sorted(Counter("".join(samples.values())).items(), key=lambda x: (-x[1], x[0])) if c != " "]
        self.classes = np.array([not chr(code).isalpha() for code in range(0x110000)], np.int32)  # 0: a letter in no sample; 1: no letter
        for i, c in enumerate(letters):
            self.classes[ord(c)] = i + 2
        self.size = len(letters) + 2
        tables, rare, self.roots, at = [], [], [], 0
        for language in self.languages:
            codes = self.classes[np.frombuffer(samples[language].encode("utf-32-le"), np.uint32)]
            steps = suffix_automaton([int(c) or -1 for c in codes])
            t = np.full((len(steps), ALPHABET), -1, np.int32)
            for s, after in enumerate(steps):
                for c, to in after.items():
                    if c >= ALPHABET:
                        rare.append(((at + s) * self.size + c, at + to))
                    elif c >= 0:
                        t[s, c] = at + to
            tables.append(t)
            self.roots.append(at)
            at += len(steps)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        #: After a phrase's first letter, or at the root again where a language doesn't know it.
        self.first = np.repeat(np.array(self.roots, np.int32)[:, None], self.size, 1)
        for k, (t, root) in enumerate(zip(tables, self.roots, strict=True)):
            known = np.flatnonzero(t[0] >= 0)
            self.first[k, known] = t[0, known]
            for key, to in rare:
                if key // self.size == root:
                    self.first[k, key % self.size] = to
        rare.sort()
        self.rare_keys, self.rare_to = np.array([k for k, _ in rare], np.int64), np.array([to for _, to in rare], np.int32)

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """States after classes c, -1 where there are none: by table for the commonest letters, by search for others."""
        rare = np.flatnonzero(c >= ALPHABET)
        if not len(rare):
            return self.table[state * ALPHABET + c]
        out = self.table[state * ALPHABET + np.minimum(c, ALPHABET - 1)]
        keys = state[:, rare].astype(np.int64) * self.size + c[rare]
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        out[:, rare] = np.where(self.rare_keys[at] == keys, self.rare_to[at], -1)
        return out

    def _advance(self, state: np.ndarray, c: np.ndarray, language) -> tuple[np.ndarray, np.ndarray]:
        """States after classes c, and where a new phrase begins."""
        s = self._step(state, c)
        if (miss := s < 0).any():
            s = np.where(miss, self.first[language, c], s)
        return s, miss

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(languages, texts): phrases that each text needs."""
        segments, owner = [], []
        for i, t in enumerate(texts):
            c = self.classes[np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)]
            c = c[np.concatenate([c[:1] != 1, (c[1:] != 1) | (c[:-1] != 1)])]
            for a in range(0, len(c), SEGMENT):
                segments.append(c[a : a + SEGMENT])
                owner.append(i)
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        if not segments:
            return out
        order = np.argsort([-len(s) for s in segments], kind="stable")
        sizes = np.array([len(segments[i]) for i in order])
        lanes = np.zeros((sizes[0], len(order)), np.int32)
        for lane, i in enumerate(order):
            lanes[: sizes[lane], lane] = segments[i]
        owner = np.array(owner)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.full(len(order), -1)  # lane of the segment after a lane's, in the same text
        more = np.flatnonzero(owner[1:] == owner[:-1])
        follows[place[more]] = place[more + 1]
        root = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(root, len(order), 1)
        every = np.arange(len(root))[:, None]
        begins = np.zeros((sizes[0], len(root), len(order)), bool)
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        for t in range(sizes[0]):
            m = live[t]
            state[:, :m], begins[t, :, :m] = self._advance(state[:, :m], lanes[t, :m], every)
        firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[:, owner[firsts]] = 1 + begins[:, :, place[firsts]].sum(0)
        self._join(out, owner[firsts], place[firsts], follows, sizes, lanes, state, begins)
        return out

    def _join(self, out, texts, first, follows, sizes, lanes, state, begins) -> None:
        """Adds to out the phrases of each text's later segments. A text's parse goes on beyond a segment's end until
        it begins a phrase where the next segment's own parse began one: from there on both are the same."""
        k, lane = (x.ravel() for x in np.meshgrid(np.arange(len(out)), first, indexing="ij"))
        text = np.tile(texts, len(out))
        at, now = follows[lane], state[k, lane]
        keep = at >= 0
        k, text, at, now, t = k[keep], text[keep], at[keep], now[keep], np.zeros(keep.sum(), np.int64)
        while len(k):
            now, miss = (x[0] for x in self._advance(now[None], lanes[t, at], k[None]))
            np.add.at(out, (k[miss], text[miss]), 1)
            met = miss & begins[t, k, at]
            for j in np.flatnonzero(met):
                out[k[j], text[j]] += int(begins[t[j] + 1 : sizes[at[j]], k[j], at[j]].sum())
                now[j] = state[k[j], at[j]]
            t = np.where(met, 0, t + 1)
            over = met | (t == sizes[at])
            at, t = np.where(over, follows[at], at), np.where(over, 0, t)
            if (at < 0).any():
                keep = at >= 0
                k, text, at, now, t = k[keep], text[keep], at[keep], now[keep], t[keep]


_PARSERS: dict[int, CrossParser] = {}


def _predict(samples: dict[str, str]):
    key = hash(tuple(sorted(samples.items())))

    def run(batches):
        import pyarrow as pa

        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = CrossParser(samples)
        parser = _PARSERS[key]
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in text_slices(batch, rows=2048, chars=max(250_000, 16_000_000 // max(1, len(parser.languages)))):
                phrases = parser.phrases(texts)
                best, phrases = (phrases.argmin(0), np.sort(phrases, 0)) if parser.languages else (None, None)
                names, scores = [], []
                for i, t in enumerate(texts):
                    if not parser.languages or not any(c.isalpha() for c in t):
                        names.append("und")
                        scores.append(0.0)
                    else:
                        names.append(parser.languages[best[i]])
                        scores.append(float(1 - phrases[0, i] / phrases[1, i]) if len(parser.languages) > 1 else 1.0)
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def labelled_samples(docs: DataFrame, max_docs: int, max_chars: int) -> dict[str, str]:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc_of_id(), F.lit(4)) != 2))
    short = (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)), F.count_if(short)).collect()
    counts = {lang: n or every for lang, every, n in found}
    if not counts:
        return {}
    # Keep a language's rows whose hash lies in the fraction that makes about 2 * max_docs of them.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * max_docs / n))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    cut = [lang for lang, _, n in found if not n]  # these have long rows alone
    near = rows.where((place < share[F.col("lang")] * (1 << 30)) & (short | F.col("lang").isin(cut))).select("lang", place.alias("place"), F.substring("text", 1, max_chars).alias("text")).dropDuplicates(["lang", "place"])  # repeated rows are one
    out: dict[str, str] = {}
    taken: Counter = Counter()
    for lang, _, text in sorted(near.collect(), key=lambda r: (r[0], r[1], r[2])):  # 2 * max_docs rows of a language or so
        text = normalise(text)[:max_chars]
        if text and taken[lang] < max_docs and len(text) + len(out.get(lang, "")) <= max_chars:
            out[lang] = f"{out[lang]} {text}" if lang in out else text
            taken[lang] += 1
    return out


def identify_language(docs: DataFrame, max_docs: int = 60, max_chars: int = 40_000) -> DataFrame:
    """doc_id, lang_pred and score (how much fewer phrases than the second language) of every row."""
    samples = labelled_samples(docs, max_docs, max_chars)
    return docs.select("doc_id", "text").mapInArrow(_predict(samples), "doc_id long, lang_pred string, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    found = identify_language(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.pmod(crc_of_id(), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")
