"""Toxicity of restored text: a noisy-channel decoder undoes leetspeak, spacing and repetition, then words are scored.

A character trigram model over all documents is the source; the channel replaces letters by look-alikes, repeats
them or puts signs between them. For each odd token, of any length, the lattice of readings is decoded by Viterbi;
that of a run of spaced letters holds word boundaries. The scorer is a
boosted sum of abstaining rules on words and word stems of the restored text, fit on at most `max_train` labelled
rows (those with the smallest hash of doc_id), each whole; exact copies teach once.

Cases: null and empty texts have no words and get the base score; very long texts are scored whole; equal readings:
the one met first, equal rules: the one with the smaller hash; rows without a label are only scored; of several
labels of one doc_id the largest counts; repeated rows each get a row; without both kinds of labels every score is
0 and nothing is rejected; an empty table gives an empty result; further columns are not carried by score_toxicity
and kept by reject_toxic.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import crc_of_id, materialise, modest_batches, release, table
from .tokens import forget_encoders, text_slices

#: Letters that a sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}

CLASSES = 60  # 0: word boundary, 1-26: a-z, 27-58: Latin-1 letters, 59: any other letter
_SIGNS = re.escape("".join(c for c in LOOK_ALIKES if not c.isalnum()))
#: Three or more single letters, digits or look-alikes with one or two signs between them, also beside punctuation.
_SPACED = re.compile(rf"(?<![^\W_])(?<![@$])(?:(?:[^\W_]|[{_SIGNS}])[ ._*-]{{1,2}}){{2,}}(?:[^\W_]|[@$])(?![^\W_])(?![@$])")
#: Of words in spaced runs; a run is read as one word whatever its length.
LONGEST, NEAR = 24, 8.0
#: Rows of label 1 that a rule needs.
SUPPORT = 8
_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")


def _class_table() -> np.ndarray:
    t = np.zeros(0x10000, np.int64)
    for code in range(0x10000):
        if chr(code).isalpha():
            t[code] = code - 96 if 97 <= code <= 122 else 27 + code - 0xDF if 0xDF <= code <= 0xFE else 59
    return t


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)


def _count_trigrams(batches):
    import pyarrow as pa

    forget_encoders()
    classes, total = _class_table(), np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for _, _, texts in text_slices(batch):
            c = classes[_codes("  " + "  ".join(texts).lower() + "  ")]
            keep = (c[2:] > 0) | (c[1:-1] > 0)
            total += np.bincount((c[:-2] * CLASSES + c[1:-1])[keep] * CLASSES + c[2:][keep], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """-log p(c | two before), from counts over all whole texts; its size is fixed by the alphabet."""
    counts = np.zeros(CLASSES**3)
    for gram, n in docs.select("text").mapInArrow(_count_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    two = counts.sum(0)
    one = (two.sum(0) + 1) / (two.sum() + CLASSES)
    bi = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    tri = (counts + 5 * bi[None]) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(tri).astype(np.float32)


def _text(chain: tuple | None) -> str:
    letters = []
    while chain:
        chain, last = chain
        letters.append(last)
    return "".join(reversed(letters))


class Restorer:
    """Most likely plain reading of odd tokens."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.classes = costs.tolist(), _class_table()

    def _letter(self, c: str) -> int:
        return int(self.classes[min(ord(c), 0xFFFF)])

    def _readings(self, c: str, n: int, literal: bool) -> list[tuple[str, float]]:
        if c.isalpha():
            return [(c * n, 0.0)] if literal or n == 1 else [(c * 2, 0.0), (c, 1.0)] if n == 2 else [(c, 0.5), (c * 2, 1.0)]
        if literal and c in LOOK_ALIKES:
            return [(letter * n, 0.5) for letter in LOOK_ALIKES[c]]
        readings = [("", 4.0 if n == 1 and c in LOOK_ALIKES else 0.3)]
        for letter in LOOK_ALIKES.get(c, ""):
            readings += [(letter, 0.5)] if n == 1 else [(letter * 2, 0.7), (letter, 1.0)]
        return readings

    def _step(self, states: dict, readings: list[tuple[str, float]]) -> dict:
        after: dict = {}
        for (a, b), (cost, out) in states.items():
            for letters, price in readings:
                x, y, total = a, b, cost + price
                for letter in letters:
                    z = self._letter(letter)
                    total += self.costs[x][y][z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (out, letters) if letters else out)
        return after

    def _end(self, states: dict) -> tuple[float, tuple | None]:
        return min(((cost + self.costs[a][b][0], out) for (a, b), (cost, out) in states.items()), key=lambda s: s[0])

    def decode(self, token: str, literal: bool = False) -> str:
        """Viterbi over the lattice of token's readings; a state is the last two letters' classes.

        literal: each look-alike is a letter, none is left out and none repeats another.
        """
        token = _RUN.sub(r"\1\1\1", token)  # three or more of a kind are read alike
        states, at = {(0, 0): (0.0, None)}, 0
        while at < len(token):
            n = 1
            while at + n < len(token) and token[at + n] == token[at]:
                n += 1
            states = self._step(states, self._readings(token[at], n, literal))
            at += n
        return _text(self._end(states)[1])

    def spaced_words(self, run: str) -> set[str]:
        """Readings of a spaced run: as one word, and each word of up to LONGEST signs on a way through the lattice of
        words that costs at most NEAR more than the best way."""
        signs = re.sub(r"[ ._*-]", "", run)
        short = _RUN.sub(r"\1\1\1", signs)
        words: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for first in range(len(short)):
            states, at, stop = {(0, 0): (0.0, None)}, first, min(len(short), first + LONGEST)
            while at < stop:
                n = 1
                while at + n < stop and short[at + n] == short[at]:
                    n += 1
                for m in range(1, n + 1):  # a word may end within a run of a letter
                    after = self._step(states, self._readings(short[at], m, False))
                    words[first, at + m] = self._end(after)
                states, at = after, at + n
        ahead, behind = [0.0, *[np.inf] * len(short)], [*[np.inf] * len(short), 0.0]
        for (a, b), (cost, _) in sorted(words.items()):
            ahead[b] = min(ahead[b], ahead[a] + cost + 1)
        for (a, b), (cost, _) in sorted(words.items(), reverse=True):
            behind[a] = min(behind[a], behind[b] + cost + 1)
        near = {_text(out) for (a, b), (cost, out) in words.items() if b - a > 2 and ahead[a] + cost + 1 + behind[b] <= ahead[-1] + NEAR}
        return {w for w in {self.decode(signs), self.decode(signs, literal=True), *near} if w}

    def words(self, token: str) -> set[str]:
        """Readings of one lower-case token: its letters as they stand and, where it looks odd, as decoded."""
        bare = token.strip(".,;:?!\"'()[]{}#%&*$|-_…«»“”")
        if bare.isalpha() and not _LONG_RUN.search(bare) and not re.search(r"^[$|(!]\w|\w[$|]$", token):
            return {bare}
        if not any(c.isalpha() for c in token):
            core = token.rstrip(".,;:?")
            return {w for w in (bare, self.decode(core), self.decode(core.rstrip("!)"), literal=True)) if w} if any(c in LOOK_ALIKES for c in token) else {bare} - {""}
        core = re.sub(r"^([^\w\s])\1+|([^\w\s])\2+$", "", token).rstrip(".,;:?")
        return {w for w in (bare, self.decode(core)) if w}


def _features(word: str) -> list[int]:
    """Of a word: itself and its stems of 4, 5 and 6 letters."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(b"^" + word[:n].encode()) for n in (4, 5, 6) if len(word) >= n)]


def _tokens(text: str) -> tuple[set[str], list[str]]:
    text = text.lower()
    return set(text.split()), _SPACED.findall(text)


def _train_rows(costs):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        restorer = Restorer(costs)
        for batch in batches:
            labels = batch.column(batch.schema.get_field_index("toxic"))
            for first, last, texts in text_slices(batch):
                rows = []
                for t in texts:
                    whole, spaced = _tokens(t)
                    words = {w for x in whole for w in restorer.words(x)} | {w for s in spaced for w in restorer.spaced_words(s)}
                    rows.append(np.array(sorted({f for w in words for f in _features(w)}), "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([labels.slice(first, last - first), pa.array(rows, pa.binary())], ["toxic", "features"])

    return run


def _each_feature(batches):
    import pyarrow as pa

    for batch in batches:
        held = [np.frombuffer(f, "<u4").astype(np.int64) for f in batch.column(1).to_pylist()]
        toxic = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32), list(map(len, held)))
        yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["toxic", "feature"])


def _only(able: np.ndarray):
    """Rows with these features alone."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held = (np.frombuffer(f, "<u4") for f in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[np.isin(f, able)].tobytes() for f in held], pa.binary())], ["toxic", "features"])

    return run


def boost(rows: list[tuple[int, bytes]], rounds: int = 60, support: int = SUPPORT) -> tuple[float, dict[int, float]]:
    """Boosting (Schapire and Singer, 1999; logistic weights) of rules that vote for label 1 where a feature is present.

    Labels are noisy: a rule needs `support` rows of label 1, and odds of e**2 over those of all rows. A row's
    features are distinct unsigned 32-bit numbers, little-endian.
    """
    y = np.array([1.0 if t else -1.0 for t, _ in rows])
    if len(set(y)) < 2:
        return -20.0, {}
    features = [np.frombuffer(f, "<u4") for _, f in rows]
    found, times = np.unique(np.concatenate([f for f, t in zip(features, y, strict=True) if t > 0]), return_counts=True)
    features = [f[np.isin(f, found[times >= support], assume_unique=True)] for f in features]  # others can't be rules
    owner = np.repeat(np.arange(len(rows)), list(map(len, features)))
    names, column = np.unique(np.concatenate(features), return_inverse=True)
    positive = np.bincount(column, weights=y[owner] > 0, minlength=len(names))
    other = np.bincount(column, minlength=len(names)) - positive
    base = (y > 0).sum() / (y < 0).sum()
    able = (positive >= support) & ((positive + 0.5) / (other + 0.5) >= np.exp(2) * base)
    keep = able[column]
    owner, (names, column) = owner[keep], (names[able], (np.cumsum(able) - 1)[column[keep]])
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    first = np.searchsorted(column, np.arange(len(names) + 1))
    bias = 0.5 * np.log(base)
    total, rules, slack = np.full(len(y), bias), {}, 2.0 / len(y)
    for _ in range(rounds if len(names) else 0):
        w = 1 / (1 + np.exp(2 * y * total))
        w /= w.sum()
        up = np.bincount(column, weights=np.where(y > 0, w, 0)[owner], minlength=len(names))
        down = np.bincount(column, weights=np.where(y < 0, w, 0)[owner], minlength=len(names))
        gain = np.where(up > down, np.sqrt(up) - np.sqrt(down), 0)
        best = int(gain.argmax())
        if gain[best] <= 0.1:
            break
        vote = 0.5 * np.log((up[best] + slack) / (down[best] + slack))
        rules[int(names[best])] = rules.get(int(names[best]), 0.0) + vote
        total[owner[first[best] : first[best + 1]]] += vote
        w = 1 / (1 + np.exp(2 * y * total))
        shift = min(0.0, 0.25 * np.log((w[y > 0].sum() + slack) / (w[y < 0].sum() + slack)))
        bias, total = bias + shift, total + shift
    if not rules:
        return min(float(bias), -0.1), {}
    # Votes are fit together, since the rules of one word's stems share its evidence.
    chosen = np.array([np.searchsorted(names, r) for r in rules], np.int64)
    x = np.ones((len(y), len(chosen) + 1))
    x[:, 1:] = 0
    for k, c in enumerate(chosen):
        x[owner[first[c] : first[c + 1]], k + 1] = 1
    votes, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.1] * len(chosen)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ votes))
        votes += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ ((y > 0) - p) - ridge @ votes)
    return float(votes[0]) / 2, {r: float(v) / 2 for r, v in zip(rules, votes[1:], strict=True)}


class Scorer:
    """Scores of whole texts; remembers up to `memo` tokens in which no rule is met."""

    def __init__(self, costs: np.ndarray, bias: float, rules: dict[int, float], memo: int = 250_000):
        self.restorer, self.bias, self.rules, self.memo, self.clean = Restorer(costs), bias, rules, memo, set()

    def score(self, text: str) -> float:
        whole, spaced = _tokens(text)
        hits = {f for s in spaced for w in self.restorer.spaced_words(s) for f in _features(w) if f in self.rules}
        for token in whole - self.clean:
            if found := [f for w in self.restorer.words(token) for f in _features(w) if f in self.rules]:
                hits.update(found)
            else:
                self.clean.add(token)
        if len(self.clean) > self.memo:
            self.clean.clear()
        x = self.bias + sum(self.rules[f] for f in sorted(hits))
        return 1 / (1 + np.exp(-2 * max(-30.0, min(30.0, x))))


def _score(*model):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        scorer = Scorer(*model)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(list(map(scorer.score, texts)), pa.float64())], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> tuple[np.ndarray, float, dict[int, float]]:
    """Character costs, base score and rules; rows held out are not learnt from."""
    docs = docs.select("doc_id", "text")
    costs = character_model(docs)
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(5)) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    labelled = docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # max_train ids at most
    found = labelled.mapInArrow(_train_rows(costs), "toxic int, features binary").distinct()  # exact copies teach once
    rows = materialise(found.orderBy(F.xxhash64("toxic", "features"), "features").limit(max_train), "training")
    # Only features that may become rules reach the driver, not whole rows, which are as long as the texts.
    positive = F.col("toxic") > 0
    yes, no = rows.agg(F.count_if(positive), F.count_if(~positive)).first()
    counts = rows.mapInArrow(_each_feature, "toxic int, feature long").groupBy("feature").agg(F.count_if(positive).alias("yes"), F.count_if(~positive).alias("no"))
    able = []
    if yes and no:
        base = float(np.exp(2) * yes / no)
        able = [r[0] for r in counts.where((F.col("yes") >= SUPPORT) & ((F.col("yes") + 0.5) / (F.col("no") + 0.5) >= base)).select("feature").collect()]
    known = sorted((toxic, bytes(features)) for toxic, features in rows.mapInArrow(_only(np.array(sorted(able), np.int64)), "toxic int, features binary").collect())
    release(rows)
    return (costs, *(boost(known) if known else (-20.0, {})))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> DataFrame:
    """doc_id and score of every row. docs: doc_id, text; labels: doc_id, toxic."""
    return docs.select("doc_id", "text").mapInArrow(_score(*fit(docs, labels, max_train)), "doc_id long, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(modest_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 8000) -> DataFrame:
    """The rows of docs whose own text scores below threshold, with all their columns."""
    return docs.mapInArrow(_keep(*fit(docs, labels, max_train), threshold), docs.schema)


def _keep(costs, bias, rules, threshold):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        scorer = Scorer(costs, bias, rules)
        for batch in batches:
            keep = [scorer.score(t) < threshold for _, _, texts in text_slices(batch) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
