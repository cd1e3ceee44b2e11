"""Byte-level BPE by prefix dynamic programming: every byte prefix of a piece stores its one valid last token.

A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair is, taken alone, encoded as
that pair. So a piece needs no merge queue: for each prefix, longest token first, the token that ends there is the
last one if it may follow the last token of the prefix before it; exactly one may. An automaton of all tokens names those that end at each byte. ``PrefixTable`` keeps the last
tokens: bytes are appended by going on from the end, and after an edit only the entries near it are computed again,
until they repeat the former ones for as many positions as the longest token has bytes.

Which pairs may follow each other is found once per pair by merging the two tokens' bytes by rank, and remembered.

Defined results: a null text is encoded as an empty one (no tokens). Texts are cut into pieces by the given pattern;
what it doesn't match has no tokens, and no string is special. Repeated rows are encoded row by row; texts of any length are encoded whole. Extra
columns are kept; a former column of the result's name is replaced.

Scale: one pass of Arrow batches, no shuffle; the vocabulary (checked to be small) is broadcast. Each worker keeps one
encoder over its tasks, with bounded memories of words and pairs that are emptied when full.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strideframe.llm.common import map_batches, quoted

#: Entries of each memory of a worker: about 150 bytes each.
MEMORY = 1 << 18
#: A vocabulary file larger than this isn't broadcast.
VOCABULARY_BYTES = 16 << 20

#: The pattern for which single words may be cut by themselves, and by re where they are plain; any other goes to regex.
_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Within these characters re's classes are those of the pattern; all others go to the regex module.
_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]")
_PLAIN_PIECE = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Vocabulary:
    """Tokens by bytes and by id, and which pairs of tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        import ahocorasick

        self.ranks, self.memory = ranks, memory
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.token[rank] = token
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.longest = max(map(len, ranks), default=1)
        self.names = [str(i) for i in range(len(self.token))]
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the neighbours of lowest rank until none are left. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _is_alone(self, token: int) -> bool:
        known = self._alone[token] = self.merge(self.token[token]) == [token]
        return known

    def _are_apart(self, a: int, b: int) -> bool:
        if len(self._pairs) >= self.memory:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def fill(self, line: str, last: list[int], begin: int) -> None:
        """Set the last tokens of line[begin:], bytes as characters; borders before pieces are BORDER, with last -1.

        The automaton names the tokens that end at each byte, and the first of them that may follow what stands before
        it is the last token there.
        """
        pairs, alone = self._pairs, self._alone
        for end, (token, size) in self.ends.iter(line, max(0, begin - self.longest)):
            if last[end] != UNKNOWN or end < begin:
                continue
            before = last[end - size]
            if before >= 0:
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = self._are_apart(before, token)
            else:
                fits = alone.get(token)
                if fits is None:
                    fits = self._is_alone(token)
            if fits:
                last[end] = token


#: A character that no token has, the last token of nothing, and that of a byte not reached yet.
BORDER, NOTHING, UNKNOWN = "\u0100", -1, -2


class PrefixTable:
    """The last token of every prefix of one piece; ``last[0]`` stands for the empty one."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [NOTHING]
        self.append(data)

    def append(self, data: bytes) -> PrefixTable:
        """Go on from the end; nothing before it changes."""
        begin, self.data = len(self.last), self.data + data
        self.last += [UNKNOWN] * len(data)
        self.vocabulary.fill(BORDER + self.data.decode("latin-1"), self.last, begin)
        return self

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes start to stop; returns how many entries were computed."""
        former, shift, step = self.last, len(data) - (stop - start), self.vocabulary.longest
        whole = self.data[:start] + data + self.data[stop:]
        line, self.data, self.last = BORDER + whole.decode("latin-1"), whole, former[: start + 1]
        while (n := len(self.last)) <= len(whole):
            upto = min(len(whole) + 1, max(n, start + len(data) + 1) + step)
            self.last += [UNKNOWN] * (upto - n)
            self.vocabulary.fill(line[:upto], self.last, n)
            if upto - step > start + len(data) and self.last[-step:] == former[upto - step - shift : upto - shift]:
                self.last += former[upto - shift :]
                return upto - 1 - start
        return len(whole) - start

    def ids(self) -> list[int]:
        """Back from the end, token by token."""
        return _walk(self.last, 0, len(self.data), self.vocabulary.token)


def _walk(last: list[int], border: int, end: int, tokens: list[bytes]) -> list[int]:
    out = []
    while end > border:
        out.append(token := last[end])
        end -= len(tokens[token])
    return out[::-1]


class Encoder:
    """Texts to token ids and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern, self.known = vocabulary, regex.compile(pattern), pattern == _KNOWN
        self._words: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        """What the pattern cuts a text into."""
        if self.known and not _PLAIN.search(text):
            return _PLAIN_PIECE.findall(text)
        return self.pattern.findall(text) if self.known else [m.group() for m in self.pattern.finditer(text)]

    def _learn(self, pieces: set[str]) -> None:
        """Fill the prefix tables of pieces, one behind the other in one line."""
        new = [p for p in pieces if p not in self._pieces]
        if not new:
            return
        data = [p.encode() for p in new]
        line = BORDER + BORDER.join(d.decode("latin-1") for d in data)
        last = [UNKNOWN] * len(line)
        at = 0
        for d in data:
            last[at] = NOTHING
            at += len(d) + 1
        self.vocabulary.fill(line, last, 0)
        at = 0
        for piece, d in zip(new, data, strict=True):
            self._pieces[piece] = tuple(_walk(last, at, at + len(d), self.vocabulary.token))
            at += len(d) + 1

    def _forget(self) -> None:
        for kept in (self._words, self._pieces):
            if len(kept) >= self.vocabulary.memory:
                kept.clear()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text. The known pattern cuts words between single spaces, with the space before them, each by itself."""
        if not text:
            return []
        self._forget()
        first, *rest = text.split(" ")
        new = set(rest).difference(self._words) if self.known else set()
        if not self.known or first == "" or first[-1:].isspace() or any(w == "" or w[0].isspace() or w[-1].isspace() for w in new):
            pieces = self.pieces(text)
            self._learn(own := set(pieces))
            out = list(chain.from_iterable(map(self._pieces.__getitem__, pieces)))
        else:
            cut = {w: self.pieces(" " + w) for w in new}
            head = self.pieces(first)
            self._learn(own := set(chain(head, *cut.values())))
            for word, pieces in cut.items():
                self._words[word] = tuple(chain.from_iterable(map(self._pieces.__getitem__, pieces)))
            out = list(chain(*map(self._pieces.__getitem__, head), chain.from_iterable(map(self._words.__getitem__, rest))))
        for kept, seen in ((self._words, new), (self._pieces, own)):
            for long in [x for x in seen if len(x) > 64]:
                kept.pop(long, None)
        return out

    def decode(self, ids) -> bytes:
        """The bytes of the tokens, one after another."""
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One per worker process, kept over its tasks: functions that come by value have no module to keep it in."""
    kept = sys.modules.setdefault("_strideframe_worker", types.ModuleType("_strideframe_worker")).__dict__
    key = hashlib.md5(data + pattern.encode()).hexdigest()
    if kept.get("bpe_key") != key:
        kept.update(bpe_key=key, bpe=Encoder(Vocabulary(read_ranks(data)), pattern))
    return kept["bpe"]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def _replaced(df: DataFrame, columns: dict[str, T.DataType]) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name not in columns]
    return [f.name for f in kept], T.StructType([*kept, *(T.StructField(n, t) for n, t in columns.items())])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids, an array of int. path: a vocabulary file that the driver can read."""
    data = _vocabulary(docs, path)
    names, schema = _replaced(docs, {out: T.ArrayType(T.IntegerType(), False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(data.value, pattern)
        for batch in batches:
            ids = [np.fromiter(coder.encode(t), np.int32) for t in batch.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, out])

    return map_batches(docs, run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with a binary column of the decoded bytes; null ids give null."""
    data = _vocabulary(tokens, path)
    names, schema = _replaced(tokens, {out: T.BinaryType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(data.value, pattern)
        for batch in batches:
            values = [None if i is None else coder.decode(i) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, pa.binary())], names=[*names, out])

    return map_batches(tokens, run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids decoded, and both are digested."""
    data = _vocabulary(docs, path)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(data.value, pattern)
        names = coder.vocabulary.names.__getitem__
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch.column("text"):
                ids = coder.encode(text.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
