"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts and items are lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII characters. An item of ten or
more words gives every window of ten consecutive words, a shorter one with words gives one window of all its words.
The automaton holds each window with a border on both sides and walks a document's normalised text once; what it finds
is mapped back to word numbers and, for reports, to character offsets of the original text.

Defined results: a null or empty text has no words and no hits; an item without words never occurs. Repeated
documents are scanned each by itself; repeated item ids count once. Null item ids are left out. Texts of any length
are scanned whole. Extra columns are kept; of the result's own names a former column is replaced.

Scale: documents never move: one pass of Arrow batches, no shuffle. The benchmark is measured first. While it is
within ``block_bytes`` it makes one automaton, collected and broadcast. A larger one is dealt by hash into blocks, each
within the bound (but for a single longer item), and a worker never holds more than one: the documents are numbered in a
table in the shared folder, each block in turn reads their texts and writes the hits alone, and at last the hits meet
the documents by number. So memory is that of one block, texts are written once, and read once per block.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strideframe.llm.common import Scratch, fresh, map_batches, quoted

WINDOW = 10
#: Bytes of benchmark text for one automaton (about 50 bytes of memory for each in a worker).
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """The lower-cased words as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every word in the original text, in code points. Lower-casing moves nothing."""
    return [m.span() for m in re.finditer(_WORD, text.translate({c: c + 32 for c in range(65, 91)}))]


def windows_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, tuple[int, set[str]]]:
    """Bordered window -> (number of words, items that have it)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            own = words[i : i + window]
            found.setdefault((b" " + b" ".join(own) + b" ").decode("latin-1"), (len(own), set()))[1].add(item)
    return found


class Automaton:
    """Built once per worker from the windows of one block."""

    def __init__(self, windows: dict[str, tuple[int, set[str]]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for key, (n, items) in windows.items():
            self.auto.add_word(key, (n, tuple(sorted(items))))
        self.empty = not windows
        if windows:
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, word after the last, items) of every occurrence."""
        if self.empty or not words:
            return []
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.auto.iter(line))
        if not found:
            return []
        borders = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        ends = np.searchsorted(borders, [at for at, _ in found])
        return [(int(end) - n, int(end), items) for end, (_, (n, items)) in zip(ends, found, strict=True)]


_HIT = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType()))]))
_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("items", pa.list_(pa.string()))]))


_LEAK = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())),
    ("contaminated", pa.bool_()), ("spans", _SPANS),
])


def _merged(hits: list) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for first, after in sorted((h[0], h[1]) for h in hits):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], after)
        else:
            runs.append([first, after])
    return [(a, b) for a, b in runs]


def _finish(text: str | None, words: list[bytes], hits: list) -> dict:
    runs = _merged(hits)
    items = sorted({i for h in hits for i in h[2]})
    spans = word_spans(text) if runs else []
    return {
        "n_words": len(words), "n_hit": sum(b - a for a, b in runs), "n_items": len(items), "items": items, "contaminated": bool(runs),
        "spans": [{"start": spans[a][0], "end": spans[b - 1][1]} for a, b in runs],
    }


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    out: str = "leak", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with a struct column ``out``: n_words, n_hit, n_items, items (sorted as strings), contaminated, spans."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(quoted(item_col)).cast("string").alias("i"), F.col(quoted(item_text_col)).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n_blocks = max(1, math.ceil(total * 1.5 / block_bytes)) if total > block_bytes else 1
    # Each block is within the bound (hashes spread items evenly; one item alone may be larger).
    block_of = lambda k: windows_of([(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == k).toLocalIterator()])
    own = docs.drop(out)
    if n_blocks == 1:
        only = spark.sparkContext.broadcast(block_of(0))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(only.value)
            for batch in batches:
                rows = []
                for text in batch.column(text_col):
                    words = normal_words(text := text.as_py())
                    rows.append(_finish(text, words, automaton.scan(words)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _LEAK)], names=[*batch.schema.names, out])

        return map_batches(own, whole, T.StructType([*own.schema.fields, T.StructField(out, _RESULT)]))

    scratch = Scratch(spark, "decontaminate")
    number, found = fresh(own, "number", "hits")
    kept = scratch.keep(own.withColumn(number, F.monotonically_increasing_id()))
    hits = []
    for k in range(n_blocks):
        block = spark.sparkContext.broadcast(block_of(k))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(block.value)
            for batch in batches:
                rows = [automaton.scan(normal_words(t.as_py())) for t in batch.column("text")]
                some = [i for i, h in enumerate(rows) if h]
                values = pa.array([[{"first": a, "after": b, "items": list(i)} for a, b, i in rows[k]] for k in some], _HITS)
                yield pa.RecordBatch.from_arrays([batch.column("number").take(pa.array(some, pa.int64())), values], names=["number", "hits"])

        texts = kept.select(F.col(number).alias("number"), F.col(quoted(text_col)).alias("text"))
        hits.append(scratch.keep(texts.mapInArrow(run, T.StructType([T.StructField("number", T.LongType()), T.StructField("hits", _HIT)]))))
        block.unpersist()
    joined = reduce(DataFrame.union, hits).groupBy(F.col("number").alias(number)).agg(F.flatten(F.collect_list("hits")).alias(found))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own_hits in zip(batch.column(text_col), batch.column(found), strict=True):
                text = text.as_py()
                rows.append(_finish(text, normal_words(text), [(h["first"], h["after"], h["items"]) for h in own_hits.as_py() or []]))
            names = [n for n in batch.schema.names if n not in (number, found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, _LEAK)], names=[*names, out])

    return map_batches(kept.join(joined, number, "left"), finish, T.StructType([*own.schema.fields, T.StructField(out, _RESULT)]))


def items_digest(items: list[str]) -> str:
    """Digest of the sorted, comma-joined ids: the brute-force twin of the query's column."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a hit, with their own columns only."""
    (leak,) = fresh(docs, "leak")
    return scan(docs, benchmark, text_col, out=leak).filter(~F.col(leak)["contaminated"]).drop(leak)
