"""Encoding of whole corpora by a public byte-level BPE, by longest matches with backtracking."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tracemill.runtime import spread

TOKENIZER_DIR = "/opt/tokenizers"
#: A vocabulary file larger than this is refused, as it is broadcast.
MAX_VOCAB_BYTES = 32 << 20
#: Pieces remembered in a worker; when full the memory starts afresh.
MEMO_PIECES = 200_000
#: How the byte-level tokenizer cuts a text before merging (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where visible, else 256 and up in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {chr(b if b in visible else next(spare)): b for b in range(256)}


class Encoder:
    """Exact BPE in linear time.

    Tokens are Latin-1 strings of their bytes in an Aho-Corasick automaton. From each place the longest token is tried, then its
    ever shorter prefixes, then one token back; a token is accepted if BPE would leave it next to the token before it as two,
    which is decided from the two tokens alone and remembered. Places found to lead nowhere are not tried twice.
    """

    def __init__(self, tokenizer_json: bytes) -> None:
        model = json.loads(tokenizer_json)["model"]
        letters = _byte_alphabet()
        raw = lambda s: "".join(chr(letters[c]) for c in s)
        vocab = model["vocab"]
        self.rank: dict[str, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.ids: list[int] = []
        for s, i in sorted(vocab.items(), key=lambda x: x[1]):
            if len(s) == 1 and s in letters:
                self._add(raw(s), i)
        for m in model["merges"]:
            left, right = m.split(" ") if isinstance(m, str) else m
            x, y = self.rank[raw(left)], self.rank[raw(right)]
            new = self.rank.get(raw(left + right))
            if new is None:
                new = self._add(raw(left + right), vocab[left + right])
                self.parts[new] = (x, y)
            self.merged[x, y] = new
        self.length = [0] * len(self.ids)
        self.text = [""] * len(self.ids)
        auto = ahocorasick.Automaton()
        for s, r in self.rank.items():
            self.length[r], self.text[r] = len(s), s
            auto.add_word(s, r)
        auto.make_automaton()
        self.automaton = auto
        self.shorter: dict[int, int] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _add(self, s: str, i: int) -> int:
        """Tokens get their rank in the order of merging; ids may differ from it."""
        self.rank[s] = len(self.ids)
        self.parts[len(self.ids)] = (len(self.ids), len(self.ids))
        self.ids.append(i)
        return len(self.ids) - 1

    def _next_prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, -1 if none."""
        got = self.shorter.get(token)
        if got is None:
            s = self.text[token]
            got = next((r for n in range(len(s) - 1, 0, -1) if (r := self.rank.get(s[:n])) is not None), -1)
            self.shorter[token] = got
        return got

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just these two: no merge across the seam comes before theirs."""
        key = (left, right)
        known = self.beside.get(key)
        if known is not None:
            return known
        a, b, limit, ok = left, right, len(self.ids) + 1, None
        while ok is None:
            over = self.merged.get((a, b))
            if over is not None and over < limit:
                ok = False
            elif a > b:
                limit = a
                a = self.parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 == limit:
                        ok = True
            else:
                limit = b + 1
                b = self.parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.parts[a][1]
                    if a == limit:
                        ok = True
        if len(self.beside) > 1_000_000:
            self.beside.clear()
        self.beside[key] = ok
        return ok

    def encode_bytes(self, s: str) -> list[int]:
        """Ranks of one piece, given as Latin-1 string of its bytes."""
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        for end, r in self.automaton.iter(s):
            longest[end + 1 - self.length[r]] = r
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + self.length[token]
                if alive[end] and (last < 0 or self._compatible(last, token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at]
                    break
                token_shorter = self._next_prefix(token)
                if token_shorter >= 0:
                    token = token_shorter
                    continue
                alive[at] = 0
                out.pop()
                at -= self.length[last]
                token = last
                break

    def piece(self, piece: str) -> tuple[int, ...]:
        got = self.memo.get(piece)
        if got is None:
            s = piece.encode("utf-8", "replace").decode("latin-1")
            got = tuple(self.ids[r] for r in self.encode_bytes(s))
            if len(piece) <= 64:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, piece = self.memo, self.piece
        return list(chain.from_iterable(memo.get(p) or piece(p) for p in _CUT.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo, piece = self.memo, self.piece
        return sum(len(memo.get(p) or piece(p)) for p in _CUT.findall(text))


_CUT = regex.compile(PIECES)
_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_json: bytes) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hashlib.sha1(tokenizer_json).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The vocabulary file as a broadcast; its size is checked first, and the path is the driver's only."""
    path = Path(folder, f"{name}.json")
    if path.stat().st_size > MAX_VOCAB_BYTES:
        raise ValueError(f"{path}: larger than {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(path.read_bytes())


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): every row's text as token ids, without special tokens; strings like special tokens are ordinary text.

    Null and empty texts give an empty list. Repeated rows come out repeated; other columns are ignored. Texts are encoded whole,
    however long: a piece's cost is linear in its length. Lone surrogates are encoded as '?'. Narrow for inputs of enough partitions.
    """
    vocab = vocabulary(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = [enc.encode(t) for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    source = spread(documents.select(id_col, text_col))
    return source.mapInArrow(run, f"{id_col} {source.schema[id_col].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, text_col: str = "text") -> DataFrame:
    """The kept columns and ``n_tokens`` of each row's text."""
    vocab = vocabulary(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for batch in batches:
            n = pa.array([enc.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    source = spread(documents.select(*keep, text_col))
    types = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{types}, n_tokens bigint")


