"""MinHash near-dedup with tensored banding; links are confirmed on full shingle sets.

A text's set holds its distinct 5-word shingles (A-Z lower-cased; with fewer words, the whole sequence as one). Two
collections of ``tables`` half keys are made per set, each of ``rows`` minhashes; the key of table (i, j) is the pair
of half key i of the first and half key j of the second collection, so 2 * tables * rows minhashes serve tables squared
tables. Texts with a key in common are candidates, and are linked if 100 * intersection >= 75 * union of their sets.
A pair at similarity s is missed with a chance of at most 2 * (1 - s ** rows) ** tables: 3e-4 at 0.75, 2e-6 at 0.85.

Texts with equal sets are one class from the start, so copies are never paired. Links are found in steps:

* The diagonal tables come first: in each bucket one class, the leader, is compared with all others. The leader is the
  class whose half keys most others share, likely what the others were copied from. Most groups are connected after that.
* Then only half keys matter that classes of different components share; their pairs give the keys of all tables, and the
  classes that stand in a bucket of several components are left.
* Paired off by bucket, these would grow with the square of a loose group (texts that are alike, but not enough). An exact
  filter on their full sets lists only pairs that can be links: shingles are ordered by the number of left classes that
  have them, rarest first. Two sets linked at 0.75 share a shingle among the first quarter of each, and the first one they
  share stands early enough in both to leave room for the overlap that their sizes ask for. What such texts have in common
  comes last, so that a loose group has few pairs to list.
* In each list, each component that meets another has one class compared with one of the largest component there, another
  one each turn, while that connects components: one link is enough for all their classes. Then the classes of all
  components but the largest, a growing number at a time, meet the other classes of the list that pass the filter.

So every pair of classes with a key in common is compared, ruled out by the filter, or already connected.

Defined results: null and empty texts have empty sets, are linked with nothing and are their own component. Rows that
repeat an id and text are in one class. A null id is the largest. Component ids are the smallest ids that can be reached.
Extra columns of any name are not read, and kept by ``keep_one``. An empty table stays empty.

Scale: hashes move, texts don't, but for the sets of classes that are candidates. Buckets are aggregated where they are
read; a hot bucket costs its leader's comparisons, dealt by member. Each step's tables are written to the shared
folder and removed when the next ones stand. Components are found by star contraction over links, never on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strideframe.llm.common import BROADCAST_BYTES, LOWER_TABLE, Scratch, fresh, map_batches, own_columns, quoted

SHINGLE, TABLES, ROWS, PERCENT = 5, 16, 3, 75
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORDS = 1 << 18


class _WordHashes(dict):
    """Word -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = text.encode().translate(LOWER_TABLE).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    if len(w) < shingle:
        acc = np.full(1, len(w), np.uint64)
        for x in w:
            acc = _mixed(acc) + x
    else:
        acc = w[:n]
        for k in range(1, shingle):
            acc = _mixed(acc) + w[k : k + n]
    return np.unique(_mixed(acc))


def half_keys(own: np.ndarray, tables: int = TABLES, rows: int = ROWS) -> np.ndarray:
    """2 * tables half keys, those of the first collection first. Minima over odd multiples of well-mixed hashes."""
    count = 2 * tables * rows
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        block = own[at : at + 1024, None] * factor
        np.minimum(low, (block ^ (block >> np.uint64(32))).min(axis=0), out=low)
    keys = np.arange(2 * tables, dtype=np.uint64)
    for k in range(rows):
        keys = _mixed(keys) + low.reshape(2 * tables, rows)[:, k]
    return _mixed(keys)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, tables: int = TABLES, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, cls, a, b): set size, 16-byte name of the set, and both collections of half keys."""
    chosen = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sizes, names, halves = [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), hashes)
                sizes.append(len(own))
                names.append(_digest(own))
                halves.append(half_keys(own, tables, rows).view(np.int64))
            flat = np.concatenate(halves).reshape(-1, 2, tables) if halves else np.empty((0, 2, tables), np.int64)
            ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables)
            lists = [pa.ListArray.from_arrays(ends, pa.array(flat[:, side].ravel())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), *lists], names=["doc_id", "n", "cls", "a", "b"])

    return chosen.mapInArrow(run, f"doc_id {kind}, n long, cls binary, a array<long>, b array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
    """(cls, elements) of the wanted classes, (cls, rep): the full sets as bytes of sorted hashes."""
    few = wanted.count() * 96 <= broadcast_bytes
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    mine = wanted.select(F.col("rep").alias("rep"), F.col("cls"))
    chosen = rows.join(F.broadcast(mine) if few else mine, rows["doc_id"].eqNullSafe(F.col("rep"))).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            names, sets = [], []
            for name, text in zip(batch.column("cls").to_pylist(), batch.column("text"), strict=True):
                own = shingle_set(text.as_py(), hashes)
                if _digest(own) == name:  # ids may repeat with other texts
                    names.append(name)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "elements"])

    return chosen.mapInArrow(run, "cls binary, elements binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough. Each member's set meets its pair first, then the leader's."""
    met = pairs.join(sets.select(F.col("cls").alias("y"), F.col("elements").alias("ys")), "y")
    met = met.join(sets.select(F.col("cls").alias("x"), F.col("elements").alias("xs")), "x").select("x", "y", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (xs, ys) in enumerate(zip(batch.column("xs"), batch.column("ys"), strict=True)):
                x, y = np.frombuffer(xs.as_buffer(), np.uint64), np.frombuffer(ys.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int32()))

    return met.mapInArrow(run, "x binary, y binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, root) of all linked classes: alternating large-star and small-star steps until nothing changes."""
    edges = scratch.keep(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())
    print_of = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = print_of(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m"))).filter("u <> v").distinct()
        new = scratch.keep(small)
        scratch.drop(edges)
        edges, now = new, print_of(new)
        if now == before:
            break
        before = now
    found = scratch.keep(edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct()))
    scratch.drop(edges)
    return found


def _rooted(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _differing(rows: DataFrame, key: str) -> DataFrame:
    """The keys under which more than one component stands."""
    return rows.groupBy(key).agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l <> _h").select(key)


def _listed(sets: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """(cls, e, n) for every shingle of the sets (cls, elements)."""
    def flat(names: list, own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths = [len(o) for o in own]
        at, e, n = np.repeat(np.arange(len(own)), lengths), np.concatenate(own), np.repeat(lengths, lengths)
        kept = pa.array(names, pa.binary())
        for i in range(0, len(e), rows):
            yield pa.RecordBatch.from_arrays([kept.take(pa.array(at[i : i + rows])), pa.array(e[i : i + rows]), pa.array(n[i : i + rows].astype(np.int64))], names=["cls", "e", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, own, held = [], [], 0
            for name, elements in zip(batch.column("cls"), batch.column("elements"), strict=True):
                names.append(name.as_py())
                own.append(np.frombuffer(elements.as_buffer(), np.int64))
                held += len(own[-1])
                if held >= rows:
                    yield from flat(names, own)
                    names, own, held = [], [], 0
            if held:
                yield from flat(names, own)

    return sets.mapInArrow(run, "cls binary, e long, n long")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, cls, pos, n): the shingles, rarest first, among which each set shares one with any set it is linked with.

    pos counts all shingles of the set, also those that no other set has.
    """
    listed = _listed(sets)
    again = listed.groupBy("e").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = listed.join(again, "e").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("es"))
    last = F.col("n") - F.ceil(F.col("n") * percent / 100)
    first = F.col("n") - F.size("es")
    cut = ranked.filter(first <= last).select("cls", "n", first.alias("first"), F.posexplode(F.slice("es", F.lit(1), (last - first + 1).cast("int"))).alias("i", "x"))
    return cut.select(F.col("x.e").alias("key"), "cls", (F.col("first") + F.col("i")).alias("pos"), "n")


def _room(n: Column, pos: Column, other: Column, percent: int) -> Column:
    """Whether a set of size n whose first shared shingle is at pos can overlap enough with one of the other size."""
    return (((100 + percent) * (n - pos)) >= percent * (n + other)) & (100 * F.least(n, other) >= percent * F.greatest(n, other))


def _reachable(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (key, cls, pos, n, root, ...) that some size of another component's class in their list leaves room for.

    The smallest size in the list, or the set's own least partner size, asks for the least overlap.
    """
    low = rows.groupBy("key").agg(F.min(F.struct("n", "root")).alias("l"))
    marked = rows.join(low, "key")
    second = marked.groupBy("key").agg(F.min(F.when(F.col("root") != F.col("l.root"), F.col("n"))).alias("s"))
    other = F.when(F.col("root") != F.col("l.root"), F.col("l.n")).otherwise(F.col("s"))
    partner = F.greatest(other, F.ceil(F.col("n") * percent / 100))
    return marked.join(second, "key").filter(((100 + percent) * (F.col("n") - F.col("pos"))) >= percent * (F.col("n") + partner)).drop("l", "s")


class _Finder:
    """Links and components so far, and the tables of the shared folder that hold them."""

    def __init__(self, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, scratch: Scratch, percent: int, broadcast_bytes: int):
        self.docs, self.reps, self.id_col, self.text_col = docs, reps, id_col, text_col
        self.scratch, self.percent, self.broadcast_bytes = scratch, percent, broadcast_bytes
        self.seen: list[DataFrame] = []
        self.comps, self.linked = docs.sparkSession.createDataFrame([], "cls binary, root binary"), False

    def sets_of(self, classes: DataFrame) -> DataFrame:
        """(cls, elements) of the classes (cls)."""
        wanted = self.reps.join(classes, "cls", "left_semi")
        return self.scratch.keep(_sets_of(self.docs, wanted, self.id_col, self.text_col, self.broadcast_bytes).dropDuplicates(["cls"]))

    def compare(self, pairs: DataFrame, sets: DataFrame | None = None) -> tuple[int, int]:
        """Confirm the new ones of the pairs (x, y), x being the leader; how many were compared, and linked."""
        scratch, percent = self.scratch, self.percent
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.col("x").alias("leader")).filter("x <> y")
        pairs = pairs.groupBy("x", "y").agg(F.min("leader").alias("leader"))
        if self.seen:
            pairs = pairs.join(reduce(DataFrame.union, [s.select("x", "y") for s in self.seen]), ["x", "y"], "left_anti")
        size = lambda c: self.reps.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"))
        # J >= p needs sizes within p of each other.
        sized = pairs.join(size("x"), "x").join(size("y"), "y").filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        sized = scratch.keep(sized.select("x", "y", "leader"))
        tested = sized.count()
        if not tested:
            scratch.drop(sized)
            return 0, 0
        self.seen.append(sized)
        used = sized.select(F.col("x").alias("cls")).union(sized.select("y")).distinct()
        # Of the sets that are there only those of a few pairs move.
        own = self.sets_of(used) if sets is None else sets.join(F.broadcast(used) if tested * 64 <= self.broadcast_bytes else used, "cls", "left_semi")
        turned = sized.select(F.col("leader").alias("x"), F.when(F.col("x") == F.col("leader"), F.col("y")).otherwise(F.col("x")).alias("y"))
        found = scratch.keep(_confirmed(turned, own, percent))
        if sets is None:
            scratch.drop(own)
        linked = found.count()
        if linked:
            self.merge(found)
        scratch.drop(found)
        return tested, linked

    def merge(self, links: DataFrame) -> None:
        """Components with the links (x, y) added: they connect the roots there are, few next to all links so far."""
        scratch, former = self.scratch, self.comps
        if not self.linked:
            self.comps, self.linked = components(links, scratch), True
            return
        place = lambda c: former.select(F.col("cls").alias(c), F.col("root").alias(f"r{c}"))
        between = links.join(place("x"), "x", "left").join(place("y"), "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
        joined = components(between, scratch)
        moved = joined.select(F.col("cls").alias("root"), F.col("root").alias("new"))
        self.comps = scratch.keep(
            former.join(moved, "root", "left").select("cls", F.coalesce("new", "root").alias("root")).union(joined.join(former.select("cls"), "cls", "left_anti"))
        )
        scratch.drop(former, joined)

    def refresh(self, rows: DataFrame, former: DataFrame | None = None) -> DataFrame:
        """The rows (key, cls, ...) that stand under more than one component, with their root; the former ones are removed."""
        rooted = _rooted(rows.drop("root"), self.comps)
        new = self.scratch.keep(rooted.join(_differing(rooted, "key"), "key", "left_semi"))
        self.scratch.drop(former)
        return new

    def take_turns(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Compare one class of each component with one of the largest it meets, while that connects one in twenty."""
        turn = 0
        while not rows.isEmpty():
            mix = F.xxhash64("key", "cls", F.lit(turn))
            x = F.max_by("cls", F.struct("p", "cls")) if turn == 0 else F.min_by("cls", F.struct(mix, "cls"))
            parts = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("p").alias("p"), x.alias("x"))
            centre = parts.groupBy("key").agg(F.max(F.struct("c", "root", "x", "p")).alias("m")).select("key", F.col("m.root").alias("other"), F.col("m.x").alias("y"), F.col("m.p").alias("py"))
            met = parts.join(centre, "key").filter("root <> other")
            rank = F.struct(F.col("py") if turn == 0 else F.lit(0), F.xxhash64("key", F.lit(turn)))
            tested, linked = self.compare(met.groupBy("root").agg(F.max_by(F.struct("x", "y"), rank).alias("m")).select(F.col("m.y").alias("x"), F.col("m.x").alias("y")), sets)
            if linked:
                rows = self.refresh(rows, rows)
            turn += 1
            if linked * 20 < max(tested, 1):
                break
        return rows

    def finish(self, rows: DataFrame, sets: DataFrame, most: int = 128) -> None:
        """Compare what is left in lists (key, cls, pos, n, root): classes outside the largest component with all others."""
        while not rows.isEmpty():
            parts = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
            sums = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all"))
            sums = sums.select("key", F.col("m.root").alias("largest"), (F.col("all") - F.col("m.c")).alias("few"))
            drawn = F.pmod(F.xxhash64("key", "cls", F.lit(most)), F.greatest(F.ceil(F.col("few") / most), F.lit(1).cast("long"))) == 0
            marked = self.scratch.keep(rows.join(sums, "key").select("key", "cls", "pos", "n", "root", ((F.col("root") != F.col("largest")) & drawn).alias("leads")))
            leaders = marked.filter("leads").select("key", F.col("cls").alias("x"), F.col("root").alias("own"), F.col("pos").alias("at"), F.col("n").alias("size"))
            room = _room(F.col("n"), F.col("pos"), F.col("size"), self.percent) & _room(F.col("size"), F.col("at"), F.col("n"), self.percent)
            self.compare(marked.join(leaders, "key").filter((F.col("root") != F.col("own")) & room).select("x", F.col("cls").alias("y")), sets)
            self.scratch.drop(rows)
            rows, most = self.refresh(marked.filter("NOT leads").drop("leads"), marked), most * 8
        self.scratch.drop(rows)


def find_links(docs: DataFrame, sig: DataFrame, id_col: str, text_col: str, scratch: Scratch, percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(classes: cls, rep, n, copies) and (cls, root) of the linked ones."""
    full = sig.filter("n > 0")
    reps = scratch.keep(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")))
    halves = scratch.keep(full.select("cls", "a", "b").dropDuplicates(["cls"]))

    def shared(side: str, rows: DataFrame) -> DataFrame:
        listed = rows.select("cls", F.explode(side).alias("k"))
        again = listed.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1")
        return scratch.keep(listed.join(again, "k").select("cls", "k", "c"))

    in_a = shared("a", halves)
    near = scratch.keep(halves.join(in_a.select("cls").distinct(), "cls", "left_semi"))
    scratch.drop(halves)
    in_b = shared("b", near)
    # How many others share a class's half keys: the text that a group was copied from shares most, and links most.
    popular = in_a.union(in_b).groupBy("cls").agg(F.sum("c").alias("p"))
    popular = scratch.keep(popular.join(in_b.select("cls").distinct(), "cls", "left_semi"))

    finder = _Finder(docs, reps, id_col, text_col, scratch, percent, broadcast_bytes)
    diagonal = near.join(popular, "cls").select("cls", "p", F.explode(F.zip_with("a", "b", lambda x, y: F.xxhash64(x, y))).alias("key"))
    leaders = diagonal.groupBy("key").agg(F.max(F.struct("p", "cls")).alias("m"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("m.cls").alias("x"))
    finder.compare(diagonal.join(leaders, "key").select("x", F.col("cls").alias("y")))
    scratch.drop(near)

    left = []
    for side in (in_a, in_b):
        rooted = _rooted(side, finder.comps)
        left.append(rooted.join(_differing(rooted, "k"), "k", "left_semi").groupBy("cls").agg(F.collect_list("k").alias("ks")))
    halved = left[0].join(left[1].withColumnRenamed("ks", "kb"), "cls").select("cls", F.explode("ks").alias("ka"), "kb").select("cls", "ka", F.explode("kb").alias("kb"))
    keyed = _rooted(halved.select("cls", F.xxhash64("ka", "kb").alias("key")), finder.comps)
    classes = scratch.keep(keyed.join(_differing(keyed, "key"), "key", "left_semi").select("cls").distinct())
    scratch.drop(in_a, in_b)
    if not classes.isEmpty():
        sets = finder.sets_of(classes)
        lists = scratch.keep(_prefixes(sets, percent).join(popular, "cls"))
        rooted = finder.refresh(lists, lists)
        reachable = scratch.keep(_reachable(rooted, percent))
        scratch.drop(rooted)
        finder.finish(finder.take_turns(finder.refresh(reachable, reachable), sets), sets)
        scratch.drop(sets)
    scratch.drop(classes, popular, *finder.seen)
    return reps, finder.comps


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int, broadcast_bytes: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n, cls, component_id, lead) for every row; lead, the class that holds the smallest id, is null for rows without copies."""
    sig = scratch.keep(signatures(docs, id_col, text_col))
    reps, comps = find_links(docs, sig, id_col, text_col, scratch, percent, broadcast_bytes)
    rooted = _rooted(reps, comps)
    first = F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "cls"))
    grouped = rooted.groupBy("root").agg(first.alias("m"), F.sum("copies").alias("members")).filter("members > 1")
    named = scratch.keep(rooted.join(grouped, "root").select("cls", F.col("m.rep").alias("component_id"), F.col("m.cls").alias("lead")))
    return sig.select("doc_id", "n", "cls").join(named, "cls", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    out = _placed(docs, id_col, text_col, percent, broadcast_bytes, Scratch(docs.sparkSession, "minhash"))
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _with_class(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """docs with the name of each row's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            names = [_digest(shingle_set(t.as_py(), hashes)) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], names=[*batch.schema.names, out])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (a null only if there is no other), with its own columns only.

    Rows whose id occurs once are told by it; those with a repeated or null id by id and set. Of rows equal in both, the
    one with the smallest text stays. Rows with empty sets all stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    placed = scratch.keep(_placed(docs, id_col, text_col, PERCENT, BROADCAST_BYTES, scratch))
    leads = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("cls") == F.col("lead"))
    out, which, more, own, row = fresh(docs, "gone", "set", "again", "cls", "row")
    gone = placed.filter(F.col("lead").isNotNull() & ~leads).select(F.col("doc_id").alias(out), F.col("cls").alias(which)).distinct()
    again = scratch.keep(placed.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias(more)))
    key = F.col(quoted(id_col))
    if again.isEmpty():
        return docs.join(gone, key.eqNullSafe(F.col(out)), "left_anti")
    repeated = key.eqNullSafe(F.col(more))
    once = docs.join(again, repeated, "left_anti").join(gone, key.eqNullSafe(F.col(out)), "left_anti")
    told = _with_class(docs.join(again, repeated, "left_semi"), text_col, own)
    left = told.join(gone, key.eqNullSafe(F.col(out)) & (F.col(own) == F.col(which)), "left_anti")
    void = F.lit(_digest(np.empty(0, np.uint64)))
    one = left.filter(F.col(own) != void).groupBy(key, own).agg(F.min_by(F.struct(*own_columns(docs)), F.col(quoted(text_col))).alias(row))
    one = one.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
    return once.union(left.filter(F.col(own) == void).drop(own)).union(one)
