"""Exact, memoised encoding with the `tokenizers` library.

The word-level BPE file normalises (NFC, white space, lower case), cuts a text into matches of its split pattern,
none of which spans white space, and encodes each match by itself. So a text's ids are the ids of its matches in
order, and each distinct match needs the library only once. Matches of Latin-1 text, on which NFC does nothing and
Python's lower() is the library's, are found here; any other white-space separated chunk goes to the library whole.
Ids of all known pieces lie in one flat array, from which NumPy gathers whole documents. The memo is emptied when
it is full, which bounds memory and changes no result.
"""

from __future__ import annotations

import re

import numpy as np

END_ID = 1
DEFAULT_TOKENIZER = "word_bpe_49k.json"

_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's split pattern on lower-case Latin-1 text.
_PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+|[{_NUMBERS}]")
_CHUNKS = re.compile(r"[^ \t\n\r\f\v]+")
#: Python's \s holds these, the tokenizer's does not; and the mark of special tokens.
_ODD = re.compile("[\x1c-\x1f]|<\\|")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def _plain(text: str) -> bool:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not _ODD.search(text)


class _Index(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        return at


class ChunkEncoder:
    def __init__(self, path: str | None = None, max_pieces: int = 900_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_path())
        self.library.model._resize_cache(0)  # this class remembers words itself
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith("</w>")
        self.max_pieces = max_pieces
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # of each piece's ids in flat

    def _cut(self, text: str) -> list[str]:
        if _plain(text):
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for chunk in _CHUNKS.findall(text):
            if _plain(chunk):
                out += _PIECES.findall(chunk.lower())
            else:
                out.append("\0" + chunk)
        return out

    def _library(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, size of each piece's ids) of runs of pieces that the memo lacks."""
        out = []
        for at in range(0, len(pieces), 64):
            group = pieces[at : at + 64]
            ids = np.array(self.library.encode(" ".join(group), add_special_tokens=False).ids, np.int32) if not any(p[0] == "\0" for p in group) else np.zeros(0, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                out.append((ids, np.diff(ends, prepend=0)))
            else:
                alone = [np.array(self.library.encode(p.removeprefix("\0"), add_special_tokens=False).ids, np.int32) for p in group]
                out.append((np.concatenate(alone), np.array([len(x) for x in alone], np.int64)))
        return out

    def _learn(self, known: int) -> None:
        fresh = [p for p, _ in zip(reversed(self.index), range(len(self.index) - known), strict=False)][::-1]
        found = self._library(fresh)
        sizes, ids = np.concatenate([s for _, s in found]), np.concatenate([i for i, _ in found])
        while len(self.ends) < len(self.index):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        used = int(self.ends[known - 1]) if known else 0
        while len(self.flat) < used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.ends[known : known + len(sizes)] = used + np.cumsum(sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text with END_ID after them, as int32 arrays."""
        if len(self.index) > self.max_pieces:
            self._forget()
        known, look = len(self.index), self.index.__getitem__
        places = [np.fromiter(map(look, p), np.int64, len(p)) for p in map(self._cut, texts)]
        if len(self.index) > known:
            self._learn(known)
        out = []
        for at in places:
            first = np.where(at > 0, self.ends[at - 1], 0)
            sizes = self.ends[at] - first
            total = np.cumsum(sizes)
            n = int(total[-1]) if len(total) else 0
            ids = np.empty(n + 1, np.int32)
            ids[:n] = self.flat[np.repeat(first - total + sizes, sizes) + np.arange(n)]
            ids[n] = END_ID
            out.append(ids)
        return out


_ENCODERS: dict[str | None, ChunkEncoder] = {}


def encoder(path: str | None) -> ChunkEncoder:
    """One encoder for each worker process, whose memo lasts over batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Other operators call this in a reused worker, which then no longer holds the memo of an earlier packing."""
    _ENCODERS.clear()


def text_slices(batch, rows: int = 256, chars: int = 4_000_000):
    """(first, last, texts) over a record batch's text column, null as empty, in bounded slices."""
    texts = batch.column(batch.schema.get_field_index("text"))
    first = 0
    while first < len(texts):
        part = [t or "" for t in texts.slice(first, rows).to_pylist()]
        last, total = 0, 0
        while last < len(part) and (last == 0 or total + len(part[last]) <= chars):
            total += len(part[last])
            last += 1
        yield first, first + last, part[:last]
        first += last
