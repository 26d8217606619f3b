"""SentencePiece BPE encoding and decoding through a merge-type prefix table.

For merge-type vocabularies the encoding of every prefix of a text ends in exactly one token.
An automaton yields the vocabulary pieces that end at each place; of these, the one whose pair
with the last token of the prefix before it stays apart under the merge rules is the prefix's last
token. The table of last tokens is filled left to right, then read backwards to get the ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Texts that normalizers, prefixes and model types treat in different ways.
PROBES = ["a", " a", "a  b ", "  ", "\t\n", "ﬁ①Ａ", "e\u0301 é", "\u3000x\xa0y", "▁a▁ b", "日本語 naïve 🙂", "<s></s>", "the lower lowest lowers", "0123456789" * 3]
#: A worker forgets its known chunks beyond this many, and pairs beyond twice as many; chunks over 64 characters are not kept.
KNOWN = 400_000


class PrefixTable:
    """Encoder and decoder for one sentencepiece BPE model with the identity normalizer."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.byte = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[bytes] = []
        for i, piece in enumerate(self.piece):
            if model.is_control(i):
                self.text.append(b"")
            elif model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i):
                self.text.append(b" \xe2\x81\x87 ")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.text.append(piece.replace(MARK, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known = _Known(self)
        self.inner = _Inner(self)
        self.check(model)

    def check(self, model: sentencepiece.SentencePieceProcessor) -> None:
        """Raise if the model isn't of the kind that the table stands for, in its pieces or on texts that would show it."""
        if len(self.byte) < 256:
            raise ValueError("the model has no piece for every byte")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces with a mark behind other characters")
        for text in PROBES:
            if np.frombuffer(self.encode(text, False, False), "<u4").tolist() != model.encode(text):
                raise ValueError(f"the model encodes {text!r} in another way: its normalizer, prefix or type is another one")
        self.forget()

    def merged(self, text: str) -> list[str]:
        """The merge rules by definition: best score first, leftmost among equals. For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.apart.get(key)
        if found is None:
            x, y = self.piece[a], self.piece[b]
            found = self.apart[key] = self.merged(x + y) == [x, y]
        return found

    def stays_whole(self, a: int) -> bool:
        found = self.whole.get(a)
        if found is None:
            found = self.whole[a] = self.merged(self.piece[a]) == [self.piece[a]]
        return found

    def run(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - length
                if self.stays_whole(token) if not start else self.stays_apart(last[start], token):
                    last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk as little-endian unsigned 32-bit integers; unknown characters become byte pieces."""
        single, out, start = self.single, [], 0
        for k, c in enumerate(text):
            if c not in single:
                if k > start:
                    out += self.run(text[start:k])
                out += [self.byte[b] for b in c.encode()]
                start = k + 1
        if start < len(text):
            out += self.run(text[start:])
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Pieces hold the mark only at their start, so no merge crosses from a character to a later mark."""
        head = np.uint32(self.bos).tobytes() if bos else b""
        tail = np.uint32(self.eos).tobytes() if eos else b""
        if not text:
            return head + tail
        text = text.replace(" ", MARK)
        if MARK + MARK in text or text[0] == MARK or text[-1] == MARK:
            body = b"".join(map(self.known.__getitem__, CHUNK.findall(MARK + text)))
        else:
            body = b"".join(map(self.inner.__getitem__, text.split(MARK)))
        if len(self.known) + len(self.inner) > KNOWN:
            self.known.clear()
            self.inner.clear()
        if len(self.apart) > 2 * KNOWN:
            self.apart.clear()
        return head + body + tail

    def forget(self) -> None:
        self.known.clear()
        self.inner.clear()
        self.apart.clear()

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ``ids`` stand for; the mark put before the text goes again."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text[1:] if text[:1] == b" " else text


class _Known(dict):
    def __init__(self, table: PrefixTable):
        self.table = table

    def __missing__(self, chunk: str) -> bytes:
        out = self.table.chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


class _Inner(_Known):
    """The same for chunks without their one leading mark."""

    def __missing__(self, chunk: str) -> bytes:
        out = self.table.chunk(MARK + chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


@lru_cache(maxsize=4)
def table(path: str) -> PrefixTable:
    return PrefixTable(path)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, bos: bool = True, eos: bool = True, digests: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns (id, n_tokens, ids array<int>, decoded string), or with ``digests`` (id, n_tokens,
    ids_sha256, decoded_sha256), the hashes of the little-endian 32-bit ids and of the decoded UTF-8.
    A null text counts as empty (only the begin and end ids). One row out per row in, repeated and
    null ids included; other columns are not read; an empty table gives no rows. A narrow map: no
    shuffle, memory bounded by an Arrow batch and the worker's table of known chunks.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = df.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = table(path)
        for batch in batches:
            ids = [coder.encode(t or "", bos, eos) for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                more = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids])]
            else:
                more = [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array([coder.decode(x).decode("utf-8", "replace") for x in ids], pa.string())]
            names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *more], names=names)
        coder.forget()
        tidy()

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(work, out)
