"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as a protobuf message; normaliser, metaspace marker, scores (unigram) or
merges (BPE, ordered by score) and byte fallback are rebuilt from it. Batches are encoded by the
library's threads, and all that is encoded is compared with the sentencepiece library.

Where no piece goes on after a word's end, texts are cut there, which changes no id in either
library; the words of a batch that the worker does not remember are encoded, and compared, together.
What it remembers, over all its tasks, is bounded in bytes. Other models encode and compare whole
texts.

Defined cases: a null text has no ids and decodes to the empty text; rows with equal ids are
encoded one by one; an unknown piece without byte fallback becomes the unknown id, as in the
source library.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm.common import arrow_map, texts

MARKER = "▁"
#: Bytes of words with their ids that a worker remembers in each of two halves, and what it encodes together.
REMEMBERED_BYTES, TOGETHER, TOGETHER_CHARS = 96 << 20, 256, 1 << 20
_ENTRY = 180  # bytes of a remembered word besides its characters and ids
# Message numbers of the public model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def message(data: bytes) -> dict[int, list]:
    """Fields of one protobuf message: whole numbers, 4-byte and length-delimited values."""
    found: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + size]
            at += size
        found.setdefault(key >> 3, []).append(value)
    return found


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @staticmethod
    def parse(data: bytes) -> Model:
        top = message(data)
        trainer = message(top.get(2, [b""])[0])
        norm = message(top.get(3, [b""])[0])
        pieces = []
        for raw in top.get(1, []):
            piece = message(raw)
            score = float(np.frombuffer(piece[2][0], "<f4")[0]) if 2 in piece else 0.0
            pieces.append((piece[1][0].decode(), score, piece.get(3, [NORMAL])[0]))
        unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        return Model(
            pieces, trainer.get(3, [UNIGRAM])[0], bool(trainer.get(35, [0])[0]), unknown,
            norm.get(2, [b""])[0], bool(norm.get(3, [1])[0]), bool(norm.get(4, [1])[0]),
            bool(norm.get(5, [1])[0]))

    def spans_words(self) -> bool:
        """Whether a piece has the marker, or a line end, after other characters."""
        return any(
            "\n" in piece or MARKER in piece.lstrip(MARKER) for piece, _, kind in self.pieces if kind in (NORMAL, USER))


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first: the order in which the source merges."""
    scores = {piece: score for piece, score, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in scores and piece[cut:] in scores:
                found.append((-score, scores[piece[:cut]], scores[piece[cut:]], piece[:cut], piece[cut:]))
    found.sort(key=lambda x: (x[0], -x[1], -x[2]))
    return [(a, b) for *_, a, b in found]


def tokenizer(model: Model):
    """The tokenizers object that gives the source library's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        vocabulary = [(piece, score) for piece, score, _ in model.pieces]
        core = models.Unigram(vocabulary, unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {piece: i for i, (piece, _, _) in enumerate(model.pieces)}, merges(model),
            unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are known")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    out.normalizer = normalizers.Sequence(steps)
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence(
        [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    out.encode_special_tokens = True
    return out


class Codec:
    """Encoder and decoder of one model file; ids are packed as 4-byte little-endian numbers."""

    def __init__(self, data: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = Model.parse(data)
        self.tokenizer = tokenizer(self.model)
        self.by_word = self.model.kind == BPE and self.model.byte_fallback and not self.model.spans_words()
        self.core = Tokenizer(self.tokenizer.model)
        self.words = re.compile(f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the newer half, about
        self.unlike: set[str] = set()
        self.bytes = [self._shown(piece, kind) for piece, _, kind in self.model.pieces]
        self.source = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.opening = self.source.encode("\n")

    def _shown(self, piece: str, kind: int) -> bytes:
        """What a piece stands for in the decoded text."""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARKER, " ").encode()

    def normal(self, text: str) -> str:
        model = self.model
        if model.charsmap or model.squeeze:
            return self.tokenizer.normalizer.normalize_str(text)
        text = f" {text}" if model.dummy_prefix else text
        return text.replace(" ", MARKER) if model.escape else text

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered, all together."""
        if self.held > REMEMBERED_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        fresh = []
        for word in words - self.known.keys():
            if word in self.older:
                self._keep(word, self.older[word])
            else:
                fresh.append(word)
        # after a line end, which ends words, the source library gives a word's ids in any text
        wanted = self.source.encode([f"\n{word.replace(MARKER, ' ')}" for word in fresh], num_threads=1)
        for word, x, y in zip(fresh, self.core.encode_batch_fast(fresh, add_special_tokens=False), wanted):
            ids = x.ids
            if y != self.opening + ids:
                self.unlike.add(word)
            self._keep(word, struct.pack(f"<{len(ids)}i", *ids))

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += _ENTRY + (len(word) if word.isascii() else 4 * len(word)) + len(ids)

    def encode(self, batch: list[str]) -> list[tuple[bytes, bool]]:
        """Packed ids of each text, and whether they are the source library's."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            ids = [np.array(x.ids if text else [], "<i4").tobytes() for x, text in zip(found, batch)]
            return [(x, x == y) for x, y in zip(ids, self.expected(batch))]
        lists = [self.words.findall(self.normal(text)) if text else [] for text in batch]
        self.learn(set(chain.from_iterable(lists)))
        ids = self.known.__getitem__
        return [(b"".join(map(ids, words)), self.unlike.isdisjoint(words)) if self.unlike
                else (b"".join(map(ids, words)), True) for words in lists]

    def decode(self, batch: list[bytes]) -> list[str]:
        """Texts of packed ids, from the pieces of the model: markers, bytes and the first space."""
        shown, prefix = self.bytes.__getitem__, self.model.dummy_prefix
        out = []
        for ids in batch:
            text = b"".join(map(shown, np.frombuffer(ids, "<i4").tolist())).decode(errors="replace")
            out.append(text[1:] if prefix and text.startswith(" ") else text)
        return out

    def expected(self, batch: list[str]) -> list[bytes]:
        """Packed ids of the source library."""
        return [np.array(x, "<i4").tobytes() for x in self.source.encode(batch, num_threads=1)]


SCHEMA = (
    "doc_id bigint, n_tokens bigint, ids_sha256 string, parity boolean, round_trip boolean, "
    "decoded_chars bigint")


def _codec(path: str, threads: int) -> Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    if path not in _READY:
        with open(path, "rb") as file:
            _READY[path] = Codec(file.read())
    return _READY[path]


_READY: dict[str, Codec] = {}


def _forget() -> None:
    """A task's end: the codec stays for the worker's next task, the older half of its words goes."""
    for codec in _READY.values():
        codec.older = {}


def _slices(given: list[str]) -> Iterator[list[str]]:
    """Texts in turn, few or short enough to be encoded together; a longer one alone."""
    first, size = 0, 0
    for i, text in enumerate(given):
        if i > first and (i - first == TOGETHER or size + len(text) > TOGETHER_CHARS):
            yield given[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(given):
        yield given[first:]


def encoded(documents: DataFrame, model_path: str, threads: int = 2, with_ids: bool = True) -> DataFrame:
    """Ids of every row's whole text with the digest, parity and round trip of each.

    `model_path` is a file that every executor has, like an installed package's. ids_sha256 is the
    digest of the ids as 4-byte little-endian numbers. round_trip compares the decoded text with
    the text that went in. parity is the comparison with the source library's ids.
    """

    def some(codec: Codec, given: list[str]) -> list[tuple]:
        found = codec.encode(given)
        return [
            (len(x) // 4, hashlib.sha256(x).hexdigest(), same, text == back, len(back), x)
            for text, (x, same), back in zip(given, found, codec.decode([x for x, _ in found]))]

    def work(batch: pa.RecordBatch) -> dict:
        codec = _codec(model_path, threads)
        given = [x or "" for x in batch.column("text").to_pylist()]
        rows = [row for part in _slices(given) for row in some(codec, part)]
        names = ("n_tokens", "ids_sha256", "parity", "round_trip", "decoded_chars")
        out = {"doc_id": batch.column("doc_id")} | {name: [row[i] for row in rows] for i, name in enumerate(names)}
        if with_ids:
            flat = pa.py_buffer(b"".join(row[5] for row in rows))
            ends = pa.array([0, *accumulate(row[0] for row in rows)], pa.int32())
            out["ids"] = pa.ListArray.from_arrays(
                ends, pa.Array.from_buffers(pa.int32(), flat.size // 4, [None, flat]))
        return out

    columns = SCHEMA + (", ids array<int>" if with_ids else "")
    return arrow_map(texts(documents), work, columns, done=_forget)
