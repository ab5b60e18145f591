"""BPE encoding by per-prefix dynamic programming, and decoding (operator 2).

For each prefix of a pre-token the last token of its encoding is unique.  Candidates are the vocabulary
entries that end there (an automaton with suffix links finds them); a candidate is the last token when
the pair it makes with the last token of the prefix before it is compatible, that is, when no merge across
their border would come before the merges that build them.  Back-pointers then give the exact ids.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import texts
from tidelog.llm.library_ids import WordIds

#: Splits text before the merges: the fixed pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabulary files: bytes that print stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [of[b] for b in range(256)]


class PrefixBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, model = data["model"]["vocab"], data["model"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self._letters = {b: c for b, c in enumerate(letters)}
        self._special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(self._special, key=len, reverse=True))) if self._special else None
        self._split = regex.compile(PATTERN)
        self._bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self._bytes |= {i: s.encode() for s, i in self._special.items()}
        # rank of the merge that makes a token, and its two parts; tokens that no merge makes can't come out of one
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[a + b]
            self._merge[vocab[a], vocab[b]] = (rank, whole)
            parts.setdefault(whole, (rank, vocab[a], vocab[b]))
        self._parts = parts
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._auto = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(t) == 1 or (i in parts and self._made_whole(i)):
                self._auto.add_word(t, (len(t), i))
        self._auto.make_automaton()
        self._words = WordIds(lambda texts: [self._whole(t) for t in texts], True)

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(piece, made, swallowed): the pieces that lie at one end of ``token`` while it is built, with merge ranks."""
        kept = (self._left, self._right)[side]
        if token not in kept:
            out, until = [], NEVER
            while True:
                rank, *pair = self._parts.get(token, (-1, None, None))
                out.append((token, rank, until))
                if rank < 0:
                    break
                token, until = pair[side], rank
            kept[out[0][0]] = out
            token = out[0][0]
        return kept[token]

    def _made_whole(self, token: int) -> bool:
        """Whether the merges of a token's text end in the token itself: its two parts must be compatible till its own merge."""
        rank, a, b = self._parts[token]
        return self._compatible(a, b, rank)

    def _compatible(self, a: int, b: int, before: int = NEVER) -> bool:
        """No merge across the border of a and b happens earlier than rank ``before``."""
        for x, x_made, x_until in self._spine(a, 1):
            for y, y_made, y_until in self._spine(b, 0):
                found = self._merge.get((x, y))
                # Of equal ranks the leftmost pair merges first: before the right piece is swallowed, after the left one is.
                if found and max(x_made, y_made) < found[0] < before and found[0] < x_until and found[0] <= y_until:
                    return False
        return True

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self._fits:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = self._compatible(a, b)
        return self._fits[key]

    def _token_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token: the last token of every prefix, then the way back."""
        shown = "".join([self._letters[b] for b in piece.encode("utf-8")])
        n = len(shown)
        last, size = [0] * (n + 1), [0] * (n + 1)
        fits, test = self._fits, self._fit
        for end, (length, token) in self._auto.iter(shown):  # at each end, longer entries come first
            end += 1
            if size[end]:
                continue
            start = end - length
            if start == 0:
                last[end], size[end] = token, length
            elif size[start]:
                ok = fits.get((last[start], token))
                if ok or (ok is None and test(last[start], token)):
                    last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def _plain(self, text: str) -> list[int]:
        return [i for piece in self._split.findall(text) for i in self._token_ids(piece)]

    def _whole(self, text: str) -> bytes:
        """Ids of a text; the strings of special tokens in it give their ids."""
        out: list[int] = []
        at = 0
        if self._cut is not None:
            for m in self._cut.finditer(text):
                out += self._plain(text[at:m.start()])
                out.append(self._special[m[0]])
                at = m.end()
        return array("I", out + self._plain(text[at:] if at else text)).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        return self._words.bytes_of(texts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def prefix_bpe(path: str) -> PrefixBpe:
    """One per worker and vocabulary."""
    return PrefixBpe(path)


def encode_decode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit ids), decoded (text): one row for each row of ``docs``.

    Null or empty text: no ids, empty text.  Repeated rows and ids are each encoded; null doc_id stays null;
    other columns of ``docs`` are not read.  ``vocab_path`` must be readable by every worker.
    """

    def run(batches):
        bpe = prefix_bpe(vocab_path)
        for batch in batches:
            ids = bpe.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")
