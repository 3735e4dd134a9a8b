"""Byte-level BPE of whole texts through a memo of their pieces.

A byte-level pre-tokenizer never joins characters across the point where ASCII
white space follows something else, so a text may be cut there and each piece
(white space, then characters up to the next white space) encoded by itself.
Pieces repeat far more than texts, and a worker keeps a bounded memo of them;
a batch's others go to the tokenizers library as one text, cut at the same places.  Texts for which the cut
isn't safe (other white space, special strings) go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import Counter

import numpy as np

from cairn.llm.common import held_by_worker

PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
# White space beyond space, tab, line feed and carriage return.
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MEMO_ENTRIES = 500_000
LONG_PIECE = 200
HOT_ENTRIES = 20_000
HOT_AFTER = 500_000  # pieces
SPACE = " \n\t\r"


class PieceEncoder:
    """Encodes texts to what the library's encode(add_special_tokens=False) gives."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = self.tokenizer.normalizer is None and "ByteLevel" in repr(self.tokenizer.pre_tokenizer)[:40]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the memo before the last time it was full
        self.hot: dict[str, bytes] = {}
        self.seen: Counter[str] = Counter()
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)  # a character of the byte alphabet is a byte

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()  # four bytes each, little-endian on Spark's platforms
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't known.  Those that begin with white space and hold
        more go to the library as one text, whose ids are cut where the pieces end."""
        joined = [p for p in pieces if p[0] in SPACE and p[-1] not in SPACE]
        alone = [p for p in pieces if p[0] not in SPACE or p[-1] in SPACE]
        found = dict(zip(alone, self._library(alone), strict=True))
        if joined:
            ids = self._library(["".join(joined)])[0]
            stops = np.cumsum(self.bytes_of[np.frombuffer(ids, "<u4")])
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in joined])
            cuts = np.searchsorted(stops, ends) + 1
            if not np.array_equal(stops[cuts - 1], ends):
                raise ValueError("the vocabulary doesn't cut texts at white space")
            cuts = [0, *(cuts * 4).tolist()]
            found.update(zip(joined, map(ids.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
        return found

    def _safe(self, text: str) -> bool:
        return self.cuts and not OTHER_SPACE.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        parts: list[list[bytes]] = []  # of each text, the ids of its pieces
        gaps: list[tuple[list, int, str]] = []  # pieces that aren't known yet, and where they belong
        new: dict[str, bytes] = {}
        whole = {}
        hot, memo, older = self.hot.get, self.memo.get, self.older.get
        for n, text in enumerate(texts):
            text = text or ""
            own = PIECE.findall(text) if self._safe(text) else []
            if text and not own:
                whole[n] = text
            got = list(map(hot, own))
            for i in [i for i, ids in enumerate(got) if ids is None]:
                piece = own[i]
                ids = memo(piece)
                if ids is None:
                    if (ids := older(piece)) is None:
                        gaps.append((got, i, piece))
                        continue
                    new[piece] = ids  # used again: it goes on to the newer memo
                got[i] = ids
            parts.append(got)
            if not self.hot:
                self.seen.update(own)
        learned = self._learn(list(dict.fromkeys([piece for _, _, piece in gaps])))
        for got, i, piece in gaps:
            got[i] = learned[piece]
        out = list(map(b"".join, parts))
        for n, ids in zip(whole, self._library(list(whole.values())), strict=True):
            out[n] = ids
        self._remember(new | learned)
        return out

    def _remember(self, new: dict[str, bytes]) -> None:
        """Two generations of a memo; the most frequent pieces move to a small table that stays in cache."""
        for p in [p for p in new if len(p) > LONG_PIECE]:
            del new[p]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, new
        else:
            self.memo.update(new)
        if not self.hot and self.seen.total() > HOT_AFTER:
            self.hot = {p: self.memo[p] for p, _ in self.seen.most_common(HOT_ENTRIES) if p in self.memo}
            self.seen.clear()


def encoder_of(spec: str) -> PieceEncoder:
    """One encoder a worker and vocabulary."""
    key = "pieces", hashlib.sha256(spec.encode()).hexdigest()
    return held_by_worker(key, lambda: PieceEncoder(spec))
