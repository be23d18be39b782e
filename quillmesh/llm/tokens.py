"""Token ids by the tokenizers library, with a bounded cache of encoded pieces."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from .common import ragged

#: Pieces that a worker keeps; beyond it, the cache starts anew.
CACHE = 1_800_000

#: A space in byte-level vocabularies, and what parts pieces in others (texts that hold it are encoded in one piece).
SPACE, MARK = "Ġ", "\x00"

#: Letters that composing and lower-casing leave letters, and marks that are no part of a contraction.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ", r"!-&(-/:-@\[-`{-~"

#: One pre-token, or one of each digit.
SIMPLE = re.compile(f" ?(?:[{LETTERS}]+|[{MARKS}]+|[0-9]+)")

#: Kinds of bytes; those beyond ASCII are letters if the pair that they begin is one of LETTERS.
LETTER, SIGN, DIGIT, LINE, BLANK, ODD = range(6)
KINDS = np.full(256, ODD, np.uint8)
KINDS[128:] = LETTER
for _kind, _class in (LETTER, LETTERS), (SIGN, MARKS), (DIGIT, "0-9"), (LINE, "\n"), (BLANK, " "):
    KINDS[[c for c in range(128) if re.match(f"[{_class}]", chr(c))]] = _kind
PAIRS = np.zeros(1 << 16, bool)
PAIRS[[int.from_bytes(chr(c).encode()) for c in range(128, 1 << 11) if re.match(f"[{LETTERS}]", chr(c))]] = True

#: A vocabulary that doesn't give this text the ids of its pieces has its texts encoded in one piece.
PROBE = "Az9-À\nbc.12 c%%%D é7_ (x) it's 10,5 -- Жё."

_WORKER: dict[int, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes texts chunk by chunk, a chunk being what stands between spaces (with the space before it), and chunks of
    plain characters piece by piece.

    A space between two characters other than white space always begins a new pre-token, both in byte-level
    vocabularies and in those that drop white space, so the chunks' ids in a row are the text's. Runs of letters, of
    digits (or each digit) and of marks other than apostrophes are pre-tokens of their own in both, too, and a line end
    between two of them parts them, so that a chunk of nothing else has its pieces' ids; a corpus has far fewer pieces
    than chunks. A text for which that isn't so (a chunk begins or ends with white space, or is empty and white space
    isn't dropped) is encoded in one piece.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        # Texts that hold a token added to the vocabulary are encoded in one piece, as the library does.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        two = self._ids(["a b"])[0]
        spaced = len(two) == 2 and self.tokenizer.id_to_token(two[1]).startswith(SPACE)
        self.begins = self._tokens_that(lambda t: t.startswith(SPACE)) if spaced else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = self._tokens_that(lambda t: t.endswith(suffix)) if suffix and not spaced else None
        alone = self._ids([MARK])[0]
        self.mark = alone[0] if len(alone) == 1 and self._ids([f"a {MARK} b"])[0].count(alone[0]) == 1 else None
        self.digits = self._ids(["12"])[0] == self._ids(["1"])[0] + self._ids(["2"])[0]  # each by itself
        self.lowers = self._ids([PROBE]) == self._ids([PROBE.lower()])
        self.kinds = KINDS.copy()
        if self._ids([" \n\t\r"]) == [[]]:  # white space is dropped
            self.kinds[list(b" \n\t\r")] = BLANK
        self.known: dict[str, bytes | None] = {}
        self.sure = True
        self.sure = self.encode([PROBE])[0].tolist() == self._ids([PROBE])[0]

    def _tokens_that(self, fits) -> np.ndarray:
        out = np.zeros(self.tokenizer.get_vocab_size(), bool)
        out[[i for t, i in self.tokenizer.get_vocab().items() if fits(t)]] = True
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, self.dtype).tobytes() for x in self._ids(texts)]

    def _in_a_row(self, pieces: list[str], simple: bool) -> list[bytes]:
        """The ids of each piece. Many in one text, told apart by the ids that begin with a space, or that end a word
        (if the pieces are words, simple), or else by a mark between them: that is faster than a text each."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 256):
            some = pieces[i : i + 256]
            if self.begins is not None:  # a space begins each of them
                ids = np.array(self._ids(["".join(some)])[0], self.dtype)
                starts = np.flatnonzero(self.begins[ids])
                ends = np.append(starts[1:], len(ids))
            elif simple and self.ends is not None:
                ids = np.array(self._ids([" ".join(some)])[0], self.dtype)
                ends = np.flatnonzero(self.ends[ids]) + 1
                starts = np.append(0, ends[:-1])
            elif self.mark is not None:
                ids = np.array(self._ids([f" {MARK} ".join(some)])[0], self.dtype)
                at = np.flatnonzero(ids == self.mark)
                starts, ends = np.append(0, at + 1), np.append(at, len(ids))
            else:
                starts = ends = np.empty(0, int)
            if len(starts) != len(some):
                out += self._plain(some)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            out += [raw[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        known, simple, others = self.known, {}, []
        for p in pieces:
            if p in known:
                continue
            if SIMPLE.fullmatch(p):
                simple[p] = p.lower() if self.lowers else p
            elif len(p) == 1 and p.isascii() and self.kinds[ord(p)] in (LINE, BLANK):
                known[p] = self._plain([p])[0]
            else:
                c = p.removeprefix(" ")
                if not c or c[0].isspace() or c[-1].isspace() or MARK in c:
                    known[p] = None
                else:
                    others.append(p)
        for some, plain in (list(set(simple.values()).difference(known)), True), (others, False):
            rows = some if self.begins is None else [p for p in some if p[0] == " "]
            known.update(zip(rows, self._in_a_row(rows, plain), strict=True))
            if self.begins is not None:
                first = [p for p in some if p[0] != " "]
                known.update(zip(first, self._plain(first), strict=True))
        for p, low in simple.items():
            known[p] = known[low]

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of texts in a row, at which bytes they begin (and the last ends) -> where pieces begin, and bytes of
        texts with an empty chunk, if that matters."""
        n, kind = len(data), self.kinds[data]
        lead = np.flatnonzero(data >= 0xC0)
        kind[lead[~PAIRS[data[lead].astype(np.int32) << 8 | data[lead + 1]]]] = ODD
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        around = np.full(n + 2, BLANK, np.uint8)  # the kind of byte i stands at i + 1
        around[1:-1] = kind
        gap = (around == BLANK) | (around == LINE)
        line = np.flatnonzero(kind == LINE)
        kind[line[edge[line] | edge[line + 1] | gap[line] | gap[line + 2]]] = ODD
        begin = np.append(True, kind[1:] != kind[:-1]) | (kind == BLANK) | (kind == LINE)
        if self.digits:
            begin |= kind == DIGIT
        blank, empty = np.flatnonzero(kind == BLANK), at[:0]
        if self.begins is not None:  # a space belongs to what follows, and there has to be something
            begin[1:][(kind[:-1] == BLANK) & (kind[1:] != BLANK)] = False
            empty = blank[edge[blank] | edge[blank + 1] | (around[blank + 2] == BLANK)]
        begin[at[at < n]] = True
        odd = np.flatnonzero(kind == ODD)
        if len(odd):  # their chunks stay whole
            bounds = np.union1d(blank, at)
            chunk = np.unique(np.searchsorted(bounds, odd, side="right"))
            inside = np.zeros(n + 2, np.int8)
            inside[bounds[chunk - 1] + 1 + (around[bounds[chunk - 1] + 1] == BLANK) * (self.begins is None)] += 1
            inside[bounds[chunk]] -= 1
            begin &= np.cumsum(inside[:n], dtype=np.int8) < 1
        return np.flatnonzero(begin), empty

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known = {}
        column = pa.array(texts, pa.large_string())
        _, places, content = column.buffers()
        at = np.frombuffer(places, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if not self.sure or not at[-1]:
            return [np.frombuffer(raw, self.dtype) for raw in self._plain(texts)]
        starts, empty = self._cut(np.frombuffer(content, np.uint8)[: at[-1]], at)
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, at[-1])), content).dictionary_encode()
        pieces, codes = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy()
        self._learn(pieces)
        raw = list(map(self.known.get, pieces))
        unsure = np.append(empty, starts[np.array([r is None for r in raw])[codes]])
        whole = {*np.searchsorted(at, unsure, side="right").tolist()}
        sizes = np.array([len(r or b"") for r in raw]) // self.dtype.itemsize
        each = sizes[codes]
        ids = ragged(np.frombuffer(b"".join(filter(None, raw)), self.dtype), (np.cumsum(sizes) - sizes)[codes], each)
        ends = np.append(0, np.cumsum(each))[np.searchsorted(starts, at)].tolist()
        out = []
        for i, text in enumerate(texts):
            if i + 1 in whole or (self.added and self.added.search(text)):
                out.append(np.frombuffer(self._plain([text])[0], self.dtype))
            else:
                out.append(ids[ends[i] : ends[i + 1]])
        return out


def encoder(vocabulary: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file's content."""
    key = hash(vocabulary)
    if key not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER[key] = ChunkEncoder(vocabulary)
    return _WORKER[key]
