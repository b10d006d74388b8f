"""Byte-level BPE: a backtracking encoder of linear time, and a decoder by offset table.

Encoding takes the longest token at each position (from one Aho-Corasick pass
over the piece) and accepts it if it is compatible with the token before it:
two neighbours are compatible if no merge of the vocabulary, at the rank where
it would have run, joins across their border. If no token fits, the last one is
taken back and its next shorter prefix tried; a position once left this way is
never entered again, so the work stays linear. Sequences whose neighbours are
all compatible are the ones that merging by rank gives.

Decoding gathers each id's bytes from one blob by an offset table.

Defined results: a null text is empty and gives no ids. Special tokens' strings
in a text are their ids, as in the library. Texts are encoded whole whatever
their length; the memory of pieces seen before is bounded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts
from .tokens import byte_alphabet, tokenizer_path

#: The pre-tokenisation pattern of the byte-level vocabularies; white space by the Unicode property.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space beside a blank or line feed, at either end, or of another kind: then the pattern decides.
_ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")


def _is_text(data: bytes) -> bool:
    try:
        return bool(data.decode())
    except UnicodeDecodeError:
        return False


class ByteBPE:
    """Encoder and decoder of one vocabulary file; `limit` bounds the remembered pieces."""

    def __init__(self, path: str, limit: int = 1_000_000):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in alphabet.items()}
        raw = {i: bytes(byte_of[c] for c in name) for name, i in vocab.items() if all(c in byte_of for c in name)}
        # Work in the order of the merges: single bytes first, then one number for each merge.
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        singles = [vocab[alphabet[b]] for b in range(256)]
        number = {i: k for k, i in enumerate(singles)}
        self.split: list[tuple[int, int]] = [(k, k) for k in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right, k = number[vocab[a]], number[vocab[b]], len(self.split)
            self.pair[left, right] = k
            self.split.append((left, right))
            number[vocab[a + b]] = k
        self.id_of = np.zeros(len(self.split), "<u4")
        for i, k in number.items():
            self.id_of[k] = i
        content = {k: raw[i] for i, k in number.items()}
        by_content = {c: k for k, c in content.items()}
        self.length = [len(content[k]) for k in range(len(self.split))]
        self.prefix = [-1] * len(self.split)
        for k, c in content.items():
            self.prefix[k] = next((by_content[c[:n]] for n in range(len(c) - 1, 0, -1) if c[:n] in by_content), -1)
        self.matcher = ahocorasick.Automaton()
        for k, c in content.items():
            self.matcher.add_word(c.decode("latin-1"), k)
        self.matcher.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.limit, self.alone, self.spaced = limit, {}, {}
        self.fits: dict[int, bool] = {}
        self.id_bytes = [int(i).to_bytes(4, "little") for i in self.id_of]
        table = dict(raw) | {i: s.encode() for s, i in self.special.items()}
        top = max(table) + 1
        self.sizes = np.array([len(table.get(i, b"")) for i in range(top)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(table.get(i, b"") for i in range(top)), np.uint8)
        # a piece that is a token merges to that token
        self.whole = {c.decode(): self.id_bytes[k] for k, c in content.items() if _is_text(c)}
        self.line_feed = self.piece("\n")

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave `left` and `right` side by side."""
        known = self.fits.get(left << 32 | right)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' last merges, again and again: the parts now at the
        # border stood there while that merge was still to come, so any merge across the border
        # with a smaller number would have run first.
        bound = len(self.split)
        while True:
            if self.pair.get((a, b), bound) < bound:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                bound, a = a, self.split[a][1]
            else:
                # between equal merges the left one runs first, so one across the border with b's number would have run
                bound, b = b + 1, self.split[b][0]

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token, as little-endian 32-bit bytes."""
        data = text.encode().decode("latin-1")
        n, longest = len(data), [-1] * len(data)
        length, prefix, fits = self.length, self.prefix, self.fits
        for end, k in self.matcher.iter(data):
            longest[end - length[k] + 1] = k  # ends come in order, so the last is the longest
        if length[longest[0]] == n if n else True:
            return self.id_bytes[longest[0]] if n else b""
        out: list[int] = []
        open_ = [True] * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if open_[end] and (last < 0 or (fits.get(last << 32 | token) or self.compatible(last, token))):
                    break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_[at] = False
                at -= length[out.pop()]
                token = last
        return b"".join(map(self.id_bytes.__getitem__, out))

    def _pieces(self, text: str) -> bytes:
        """The ids of a text that the pattern cuts."""
        whole = self.whole
        return b"".join([whole.get(p) or self.piece(p) for p in _PIECES.findall(text)])

    def _learn(self, seen: dict[str, bytes], words: list[str], lead: str) -> None:
        if len(seen) > self.limit:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = self._pieces(lead + w)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if len(text) > 1 << 20 or _ODD_SPACE.search(text):
            return self._pieces(text)
        # Between other characters a blank always starts a piece and a line feed always is one.
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            try:
                out.append(self.alone[first] + b"".join(map(self.spaced.__getitem__, rest)))
            except KeyError:
                self._learn(self.alone, [first], "")
                self._learn(self.spaced, rest, " ")
                out.append(self.alone[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.line_feed.join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.cut.split(text)
        return np.frombuffer(b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_CODERS: dict[str, ByteBPE] = {}


def coder(path: str) -> ByteBPE:
    """One coder for each worker process and vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = ByteBPE(path)
    return _CODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and token_ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, 64):
            ids = [bpe.encode(t) for t in texts(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [id_col, "token_ids"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) `{id_col}`", f"cast(`{text_col}` as string) t").mapInArrow(run, f"`{id_col}` long, token_ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id and text of rows with token_ids, as the library's decode with skip_special_tokens=False."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, 64):
            text = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], [id_col, "text"])

    return tokens.select(id_col, "token_ids").mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: id, n_tokens and the digests of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        decimal = [str(i) for i in range(len(bpe.sizes))]
        for batch in slices(batches):
            counts, of_ids, of_text = [], [], []
            for t in texts(batch.column(1)):
                ids = bpe.encode(t)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) `{id_col}`", f"cast(`{text_col}` as string) t").mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
