"""Exact ids of the public word-level BPE vocabulary, for packing and token files.

The vocabulary file gives normalisation, pre-tokenisation, merges and ids; the
tokenizers library is the definition. Most texts need none of its generality:
over plain Latin and Cyrillic letters its normaliser only lower-cases, and a
word's merges can run in tiktoken's core, with each word closed by a zero byte
that stands for the end-of-word mark (pairs of last byte and mark merge first,
then the file's merges in their order). Every other text, and every text with a
special token's string, goes to the library itself. Of many texts at once, each
different word is merged once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters whose NFC form is themselves and whose lower case is one such character.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-įĴ-ňŊ-ſЀ-џ]*")
_LATIN1 = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-įĴ-ňŊ-ſЀ-џ]*")
#: Letters and lone marks: here white space and the marks alone separate words.
_PROSE = re.compile(r"[A-Za-zÀ-ÖØ-öø-įĴ-ňŊ-ſ \n.,;:!?|]*")
_TWO_MARKS = re.compile(r"[.,;:!?|]{2}")
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_WORDS_EXACT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END = "</w>"
#: Characters of text whose words are counted at once.
TOGETHER = 4 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _is_prose(text: str) -> bool:
    return bool(_PROSE.fullmatch(text)) and not _TWO_MARKS.search(text)


def _prose_words(text: str) -> str:
    """Lower-case words and marks of prose, apart by white space."""
    text = text.lower()
    for mark in ".,;:!?|":
        if mark in text:
            text = text.replace(mark, f" {mark} ")
    return text


class TextEncoder:
    """ids(text): the library's ids with add_special_tokens=False, as an array of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in alphabet.items()}
        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(token: bytes, name: str) -> None:
            ranks[token] = len(ids)
            ids.append(vocab[name])

        for b in range(1, 256):
            add(bytes([b, 0]), alphabet[b] + _END)
        for b in range(256):
            add(bytes([b]), alphabet[b])
        for merge in merges:
            name = "".join(merge if isinstance(merge, list) else merge.split(" "))
            end = name.endswith(_END)
            add(bytes(byte_of[c] for c in name.removesuffix(_END)) + b"\0" * end, name)
        self.ids_of = np.array(ids, "<u4")
        self.closes = np.array([t.endswith(b"\0") for t in ranks])  # ranks in their order
        self.core = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(self, text: str) -> np.ndarray:
        if _is_prose(text):
            found = _prose_words(text).split()
        elif (found := self._words(text)) is None:
            return self._of_library(text)
        if not found:
            return np.zeros(0, "<u4")
        return self.ids_of[np.array(self.core.encode_ordinary("\0".join(found) + "\0"))]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a word that repeats among them is merged once."""
        out: list[np.ndarray] = []
        first = size = 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= TOGETHER or k == len(texts):
                out += self._together(texts[first:k])
                first, size = k, 0
        return out

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.zeros(0, "<u4")] * len(texts)
        prose, plain, words, n = [], [], [], []
        for k, text in enumerate(texts):
            if _is_prose(text):
                if text := _prose_words(text).strip(" \n"):
                    prose.append((k, text))
            elif (found := self._words(text)) is None:
                out[k] = self._of_library(text)
            elif found:
                plain.append(k)
                words += found
                n.append(len(found))
        if not prose and not plain:
            return out
        split = pc.ascii_split_whitespace(pa.array([t for _, t in prose], pa.large_string()))
        every = pa.chunked_array([split.flatten(), pa.array(words, pa.large_string())]).combine_chunks().dictionary_encode()
        ids, ends = self._gathered(every.dictionary, every.indices.to_numpy())
        last = ends[np.cumsum([*pc.list_value_length(split).to_numpy(), *n]) - 1]  # where the last word of each text ends
        for k, a, b in zip([*(k for k, _ in prose), *plain], [0, *last[:-1].tolist()], last.tolist(), strict=True):
            out[k] = ids[a:b]
        return out

    def _words(self, text: str) -> list[str] | None:
        """The words of a text that needs no library, else null."""
        words = _WORDS if _PLAIN.fullmatch(text) else _WORDS_EXACT if _LATIN1.fullmatch(text) else None
        return None if words is None or any(s in text for s in self.special) else words.findall(text.lower())

    def _of_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _gathered(self, words: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words[at], one after another, and where those of each end."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), "\0")[0].as_py()
        found = np.array(self.core.encode_ordinary(joined + "\0"))
        flat, stop = self.ids_of[found], np.flatnonzero(self.closes[found]) + 1
        size = np.diff(stop, prepend=0)
        begin, size = (stop - size)[at], size[at]
        ends = np.cumsum(size)
        return flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1])], ends


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
