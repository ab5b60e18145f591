"""Token ids of whole texts from those of their words: each distinct word is encoded once per worker.

Both vocabularies split text before any merge, at the border of white space, letters and punctuation, so the
ids of a text are those of its words one after another.  Words of a batch are found and numbered by Arrow, looked up
once each, and their ids put in place by numpy.  The words kept are bounded by ``KEPT``; others are encoded each time.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidelog.llm.common import word_cache

#: Words kept by one worker, and the longest that is kept.
KEPT = 1_200_000
KEPT_CHARS = 40
#: Begins a word that has no blank before it.
CLOSE = "\x01"

# Texts with more than single blanks and line feeds between words are encoded whole.
_GAPS = "  | \\n|\\n |\\n\\n|[\\x01\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
# Outside these letters, lower case and composition may depend on more than the character.
_NOT_LATIN = "[^\\x00-\\x{24f}]|\\x{130}"
# A comma or stop that doesn't follow a letter or digit; behind one it is a piece of its own.  Not so behind U+0130: in lower
# case it ends with a combining dot.
_STOP_IN_RUN = "[^a-zA-Z0-9\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}][.,](?: |\\n|$)"


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def _joined(a, b) -> pa.Array:
    return pc.binary_join_element_wise(a, b, _text(""))


class WordIds:
    """``encode`` gives the little-endian unsigned 32-bit ids of each text of a list, whatever it holds.

    ``spaces_kept``: byte-level vocabularies join one blank to the word behind it; word vocabularies
    ignore case and drop white space.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], spaces_kept: bool, name: str = ""):
        self._encode = encode
        self._spaces = spaces_kept
        self._name = f"ids of {name}"

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another (uint32), and where each begins, with the end of the last."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        stops = pc.match_substring_regex(texts, _STOP_IN_RUN)
        if self._spaces:
            whole = pc.match_substring_regex(texts, _GAPS)
            ready = _joined(_text(CLOSE), pc.replace_substring(texts, "\n", f" {CLOSE}\n {CLOSE}"))
            apart = f" {CLOSE}"
        else:
            whole = pa.array(np.zeros(len(texts), bool))
            ready = pc.if_else(pc.match_substring_regex(texts, _NOT_LATIN), texts, pc.utf8_lower(texts))
            ready = _joined(pc.replace_substring(ready, "\n", " "), _text(" "))
            apart = " "
        split = ready
        for stop in ",.":
            split = pc.replace_substring(split, f"{stop} ", f"{apart}{stop} ")
        lists = pc.split_pattern(pc.if_else(whole, _text(""), pc.if_else(stops, ready, split)), " ")
        words = lists.flatten().dictionary_encode()
        # By way of numpy, as Arrow makes a scalar of each string for a list.
        table = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        values = np.frombuffer(b"".join(table), "<u4")
        codes = words.indices.to_numpy(zero_copy_only=False)
        count = size[codes]
        ends = np.cumsum(count)
        ids = values[np.repeat((np.cumsum(size) - size)[codes] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        begins = np.append(0, ends)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        odd = np.nonzero(whole.to_numpy(zero_copy_only=False))[0]
        if not len(odd):
            return ids, begins
        own = dict(zip(odd.tolist(), self._encode(texts.take(pa.array(odd)).to_pylist()), strict=True))
        parts = [np.frombuffer(own[k], "<u4") if k in own else ids[begins[k]:begins[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _look_up(self, words: list[str]) -> list[bytes]:
        kept = word_cache(self._name)
        out = list(map(kept.get, words))
        missed = [k for k, x in enumerate(out) if x is None]
        if missed:
            if self._spaces:
                plain = [words[k][1:] if words[k].startswith(CLOSE) else " " + words[k] for k in missed]
            else:
                plain = [words[k] for k in missed]
            for k, ids in zip(missed, self._encode(plain), strict=True):
                out[k] = ids
                if len(kept) < KEPT and len(words[k]) <= KEPT_CHARS:
                    kept[words[k]] = ids
        return out

    def bytes_of(self, texts: pa.Array) -> list[bytes]:
        ids, begins = self.many(texts)
        data = ids.tobytes()
        return [data[4 * a:4 * b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


@functools.cache
def library_ids(path: str, spaces_kept: bool) -> WordIds:
    """Ids by the tokenizers library; one per worker and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    border, mark = max(((i, t.content) for i, t in library.get_added_tokens_decoder().items()), default=(None, None))

    def one_by_one(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        """Many words in one call, with a special token's string as the border between them."""
        if mark is None:
            return one_by_one(texts)
        out: list[bytes | None] = [None] * len(texts)
        odd = [k for k, c in enumerate(texts) if "<|" in c or "|>" in c or len(c) > 200]
        for k, ids in zip(odd, one_by_one([texts[k] for k in odd]) if odd else [], strict=True):
            out[k] = ids
        plain = [k for k, x in enumerate(out) if x is None]
        for first in range(0, len(plain), 256):
            part = plain[first:first + 256]
            ids = np.array(library.encode_batch_fast([mark.join([texts[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.nonzero(ids == border)[0], len(ids)).tolist()
            data, start = ids.tobytes(), 0
            for k, end in zip(part, ends, strict=True):
                out[k] = data[4 * start:4 * end]
                start = end + 1
        return out

    return WordIds(encode, spaces_kept, path)
