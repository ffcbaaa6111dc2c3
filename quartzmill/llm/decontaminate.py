"""Benchmark decontamination by SimHash of item-sized windows (operator 7).

A text's alphanumeric words are cut into 5-word shingles.  Windows of the size of
a benchmark item slide over the text word by word; a window's weighted SimHash
is looked up in a multi-index of the items of that size: eight blocks of eight bits, each
posted under all values within ``FLIPS`` bits.  Fingerprints that differ in up
to ``RADIUS`` bits (at most 8 * (FLIPS + 1) - 1 = 23) agree in some block up to
``FLIPS`` bits, so the lookup finds all of them.  Candidates are verified by the exact weighted
similarity of the shingle multisets, sum of minima over sum of maxima, a shingle's weight being
ln(1 + its bytes); ``THRESHOLD`` or more is a match.

A window without any shingle of an item has similarity zero to it, so windows of a
size are fingerprinted only where a shingle of an item of that size occurs; this
skips no match.

A benchmark of at most ``MAX_ITEMS`` items and ``MAX_CHARS`` characters goes to the workers whole. A larger
one never does, nor to the driver: its items are dealt into parts of that size, each part's index
becomes a file of the shared folder, and of each item the shingles in fewest items, which weigh more than a match may
lack, a table of (shingle, part): a text with none of them has no match, so what many items share moves nothing. A bit
map of these shingles, of at most ``MAP_BITS`` bits whatever the benchmark, lets most texts' shingles
go; the others meet the table in an equality join, which says which texts to hold against which part. Only these
texts move, once for each such part, and a task holds one part at a time. Both ways
compare the same windows with the same items, so results are the same.

RADIUS and similarity: of windows at a similarity of 0.8 or more, nearly all are within 20 bits (the README
has the figure); the multi-index loses none of these.

Defined cases: null and empty texts match nothing; an item without words is
never matched, one of fewer than five words is one shingle; a text shorter than
an item is one window; texts of any length are searched whole, in blocks; null ids and repeated rows keep their rows; an empty
benchmark matches nothing; an empty table gives no rows; other columns of the
benchmark are not read.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Room, delete, new_path, ready, released, saved, table
from .words import alnum_blocks

WORDS = 5
THRESHOLD = 0.8
RADIUS = 20
FLIPS = 2
MAX_ITEMS = 4096
MAX_CHARS = 16 << 20
MAP_BITS = 27
#: A part's texts are dealt over so many tasks at most.
PART_TASKS = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in itertools.combinations(range(8), n)], np.uint8)
_MATCHES = "array<struct<item_id: long, first_word: long, n_words: long, similarity: double>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Of all runs of ``k`` words, from the words' hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += hashes[i : i + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(30)
    return out


def shingle_weights(sizes: np.ndarray, k: int) -> np.ndarray:
    """ln(1 + bytes) of each shingle of ``k`` words, blanks included."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.log(1.0 + total[k:] - total[:-k] + (k - 1)) if len(sizes) >= k else np.zeros(0)


def window_simhashes(hashes: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of ``width`` shingles."""
    out = np.empty(len(hashes) - width + 1, np.uint64)
    for at in range(0, len(out), 4096):
        h, w = hashes[at : at + 4096 + width - 1], weights[at : at + 4096 + width - 1]
        signs = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * 2.0 - 1.0
        total = np.zeros((len(h) + 1, 64))
        np.cumsum(signs * w[:, None], axis=0, out=total[1:])
        out[at : at + 4096] = np.packbits(total[width:] - total[:-width] > 1e-9, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def multiset(words: list[bytes], k: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(k)), strict=False))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted similarity of two shingle multisets."""
    low = high = 0.0
    for s in a.keys() | b.keys():
        w = math.log(1 + sum(map(len, s)) + len(s) - 1)
        x, y = a.get(s, 0), b.get(s, 0)
        low += w * min(x, y)
        high += w * max(x, y)
    return low / high if high else 0.0


@dataclass
class SizeIndex:
    """The items of one size in words: fingerprints, and for each block the items by block value."""

    fps: np.ndarray
    shingles: np.ndarray  #: sorted hashes of all the items' shingles
    starts: list[np.ndarray] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)

    def post(self) -> None:
        blocks = self.fps.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            values = (blocks[:, b][:, None] ^ _MASKS).ravel()
            order = np.argsort(values, kind="stable")
            self.items.append(np.repeat(np.arange(len(self.fps)), len(_MASKS))[order])
            self.starts.append(np.searchsorted(values[order], np.arange(257)))

    def near(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
        """(query, item) within ``radius`` bits."""
        blocks = fps.view(np.uint8).reshape(-1, 8)
        met = []
        for b in range(8):
            first, n = self.starts[b][blocks[:, b]], np.diff(self.starts[b])[blocks[:, b]]
            q = np.repeat(np.arange(len(fps)), n)
            at = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            i = self.items[b][at]
            ok = np.bitwise_count(fps[q] ^ self.fps[i]) <= radius
            met.append(q[ok] * len(self.fps) + i[ok])
        for pair in np.unique(np.concatenate(met)).tolist():
            yield divmod(pair, len(self.fps))


@dataclass
class Benchmark:
    """Items by size; for each shingle length the sorted hashes of all shingles and a bit map of them."""

    ids: dict[int, list]
    sets: dict[int, list[Counter]]
    sizes: dict[int, SizeIndex]
    shingles: dict[int, np.ndarray]
    maps: dict[int, np.ndarray]
    radius: int = RADIUS
    threshold: float = THRESHOLD


def build(items: list[tuple[int, bytes]], radius: int = RADIUS, threshold: float = THRESHOLD) -> Benchmark:
    if radius > 8 * (FLIPS + 1) - 1:
        raise ValueError("eight blocks cannot guarantee that radius")
    ids, sets, fps, own, seen = (defaultdict(list) for _ in range(5))
    for item, text in items:
        words = [w for _, part, _ in alnum_blocks(text, 0) for w in part]
        if not words:
            continue
        n, k = len(words), min(WORDS, len(words))
        hashes = shingle_hashes(word_hashes(words), k)
        ids[n].append(item)
        sets[n].append(multiset(words, k))
        fps[n].append(window_simhashes(hashes, shingle_weights(np.array([len(w) for w in words]), k), len(hashes))[0])
        own[n].append(hashes)
        seen[k].append(hashes)
    sizes = {n: SizeIndex(np.array(f, np.uint64), np.unique(np.concatenate(own[n]))) for n, f in fps.items()}
    for s in sizes.values():
        s.post()
    known = {k: np.unique(np.concatenate(v)) for k, v in seen.items()}
    maps = {}
    for k, v in known.items():
        maps[k] = np.zeros(1 << 22, bool)
        maps[k][v >> np.uint64(42)] = True
    return Benchmark(dict(ids), dict(sets), sizes, known, maps, radius, threshold)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``, which is not empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def search(b: Benchmark, data: bytes | None) -> list[dict]:
    """The best window of each item that matches somewhere in the text."""
    longest = max(b.sizes, default=0)
    best: dict[tuple[int, int], tuple] = {}
    if not data or not longest:
        return []
    for at, words, _ in alnum_blocks(data, longest):
        hashes = word_hashes(words)
        hits, rows, weights = {}, {}, {}
        for k in b.shingles:
            rows[k] = shingle_hashes(hashes, k)
            maybe = np.flatnonzero(b.maps[k][rows[k] >> np.uint64(42)])
            if len(maybe):
                maybe = maybe[_among(rows[k][maybe], b.shingles[k])]
            if len(maybe):
                hits[k] = maybe
        if not hits:
            continue
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for n, index in b.sizes.items():
            k = min(WORDS, n)
            if k not in hits or len(words) < k:
                continue
            if k not in weights:
                weights[k] = shingle_weights(lens, k)
            size = min(n, len(words))
            width = size - k + 1
            hit = hits[k][_among(rows[k][hits[k]], index.shingles)]
            if not len(hit):
                continue
            # starts whose window holds a hit, as runs
            low, high = np.maximum(hit - width + 1, 0), np.minimum(hit, len(words) - size)
            cut = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1] + 1) + 1
            for s, e in zip(low[np.r_[0, cut]], np.maximum.accumulate(high)[np.r_[cut - 1, len(high) - 1]], strict=True):
                if e < s:
                    continue
                part = slice(s, e + width)
                fps = window_simhashes(rows[k][part], weights[k][part], width)
                for q, i in index.near(fps, b.radius):
                    start = int(s) + q
                    sim = similarity(multiset(words[start : start + size], k), b.sets[n][i])
                    if sim >= b.threshold - 1e-12:
                        now = (sim, -(at + start))
                        if now > best.get((n, i), (0.0, 0))[:2] or (n, i) not in best:
                            best[n, i] = (*now, size)
    return sorted(({"item_id": b.ids[n][i], "first_word": -v[1], "n_words": v[2], "similarity": min(1.0, v[0])} for (n, i), v in best.items()), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["first_word"]))


def _matches(batches: Iterator[pa.RecordBatch], b: Benchmark) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [search(b, t.as_py()) for t in batch.column(batch.num_columns - 1)]
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(found, _KIND)], [*batch.schema.names[:-1], "matches"])


def item_shingles(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Words a shingle, the different shingles of an item and their weights, repeats added up; of fewer words than a shingle, all words as one."""
    words = [w for _, part, _ in alnum_blocks(text, 0) for w in part]
    k = min(WORDS, len(words))
    if not k:
        return 0, np.zeros(0, np.uint64), np.zeros(0)
    found, place = np.unique(shingle_hashes(word_hashes(words), k), return_inverse=True)
    return k, found, np.bincount(place, weights=shingle_weights(np.array([len(w) for w in words]), k))


def rarest_shingles(shingles: DataFrame, threshold: float) -> DataFrame:
    """``(item, part, k, hash, weight)``, different hashes an item -> those of which a window of similarity ``threshold`` holds one at least.

    Such a window holds that share of the item's weight, so it cannot lack shingles of more weight than the rest:
    of each item, those in fewest items are taken until they weigh more.
    """
    counts = shingles.groupBy("hash").agg(F.count("*").alias("n"))
    own = Window.partitionBy("item")
    before = F.sum("weight").over(own.orderBy("n", "hash").rowsBetween(Window.unboundedPreceding, -1))
    ranked = shingles.join(counts, "hash").withColumns({"before": F.coalesce(before, F.lit(0.0)), "total": F.sum("weight").over(own)})
    return ranked.where(F.col("before") <= (1 - threshold) * F.col("total") + 1e-9).select("item", "part", "k", "hash")


def text_shingles(data: bytes, bits: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The different shingles of a text, of the ``lengths`` that items have, that pass the bit map."""
    found = []
    for _, words, _ in alnum_blocks(data, WORDS - 1):
        hashes = word_hashes(words)
        for k in lengths:
            rows = shingle_hashes(hashes, k)
            at = rows >> np.uint64(64 - int(len(bits) * 8 - 1).bit_length())
            found.append(rows[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _far(docs: DataFrame, items: DataFrame, many: int, radius: int, threshold: float) -> DataFrame:
    """``docs(mark, text)`` and ``items(id, text)`` in ``many`` parts -> ``(mark, matches)`` of texts with a match, as a table."""
    spark = docs.sparkSession
    with Room(spark) as room:
        folder = new_path(spark, "parts")
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        dealt = room.saved(items.withColumns({"part": F.pmod(F.xxhash64("id", "text"), F.lit(many)).cast("int"), "item": F.monotonically_increasing_id()}), "items")

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, t, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    k, found, weight = item_shingles(t)
                    same = [pa.array(np.full(len(found), v), kind) for v, kind in ((item, pa.int64()), (part, pa.int32()), (k, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(found.view(np.int64)), pa.array(weight)], ["item", "part", "k", "hash", "weight"])

        every = room.saved(dealt.select("part", "text", "item").mapInArrow(shingles, "item long, part int, k int, hash long, weight double"), "weights")
        known = room.saved(rarest_shingles(every, threshold).select("hash", "part", "k").distinct(), "shingles")
        lengths = sorted(r.k for r in known.select("k").distinct().collect())  # at most WORDS numbers
        width = max(10, min(MAP_BITS, int(known.count() * 16).bit_length()))
        place = F.shiftrightunsigned("hash", 64 - width)
        word = known.groupBy(F.shiftrightunsigned(place, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int"))).alias("b"))
        bits = np.zeros(1 << (width - 5), np.uint32)
        for r in word.toLocalIterator():  # at most 2 ** (MAP_BITS - 5) rows of two numbers
            bits[r.w] = r.b
        bits = bits.view(np.uint8)

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [text_shingles(t.as_py() or b"", bits, lengths).view(np.int64) for t in batch.column(1)]
                marks = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(marks)), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], ["mark", "hash"])

        hits = room.saved(docs.mapInArrow(lambda it: released(passing(it)), "mark string, hash long"), "hits")
        wanted = room.saved(hits.join(known.select("hash", "part").distinct(), "hash").select("mark", "part").distinct(), "wanted")

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held = None, []
            for batch in batches:
                for p, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    if p != part and held:
                        write(part, held)
                        held = []
                    part = p
                    held.append((i, t))
            if held:
                write(part, held)
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["part"])

        def write(part: int, held: list) -> None:
            own = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            with fs.FileSystem.from_uri(folder)[0].open_output_stream(f"{base}/{part}", compression=None) as f:
                f.write(pickle.dumps(build(own, radius, threshold)))

        dealt.select("part", "id", "text").repartition("part").sortWithinPartitions("part").mapInArrow(indexed, "part int").collect()  # no rows

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, own = None, None
            for batch in batches:
                found = []
                for p, t in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                    if p != part:
                        part = p
                        with fs.FileSystem.from_uri(folder)[0].open_input_file(f"{base}/{p}") as f:
                            own = pickle.loads(f.read())
                    found.append(search(own, t.as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, _KIND)], ["mark", "matches"])

        texts = docs.join(wanted.select("mark").distinct(), "mark", "left_semi").dropDuplicates(["mark"])
        pairs = wanted.join(texts, "mark").select("part", F.pmod(F.xxhash64("mark"), F.lit(PART_TASKS)).cast("int").alias("salt"), "mark", "text")
        ordered = pairs.repartition("part", "salt").sortWithinPartitions("part", "salt")
        matched = ordered.mapInArrow(lambda it: released(compared(it)), f"mark string, matches {_MATCHES}").where(F.size("matches") > 0)
        out = saved(matched.groupBy("mark").agg(F.flatten(F.collect_list("matches")).alias("matches")), "matches")
        delete(spark, folder)
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``' columns ``keep`` and ``matches``: items found, each with its best window, in order of ids."""
    ready(docs.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    nothing = F.array().cast(_MATCHES)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return docs.select(*keep, nothing.alias("matches"))
    text = F.col(text_col).cast("binary")
    if n <= MAX_ITEMS and size <= MAX_CHARS:
        own = sorted(((r.id, bytes(r.text)) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        b = build(own, radius, threshold)
        fed = docs.select(*keep, text.alias("__text"))
        return fed.mapInArrow(lambda it: released(_matches(it, b)), f"{kept}, matches {_MATCHES}")
    many = 2 * max(-(-n // MAX_ITEMS), -(-size // MAX_CHARS))
    mark = F.md5(F.coalesce(text, F.lit(b"")))
    found = _far(docs.select(mark.alias("mark"), text.alias("text")), items, many, radius, threshold)
    ordered = F.array_sort("matches", lambda x, y: F.when(x["item_id"].isNull() & y["item_id"].isNull(), 0).when(x["item_id"].isNull(), 1).when(y["item_id"].isNull(), -1).when(x["item_id"] != y["item_id"], F.when(x["item_id"] < y["item_id"], -1).otherwise(1)).otherwise(F.signum(x["first_word"] - y["first_word"]).cast("int")))
    found = found.select(F.col("mark").alias("__mark"), ordered.alias("__found"))
    joined = docs.select(*keep, mark.alias("__own")).join(found, F.col("__own") == F.col("__mark"), "left")
    return joined.select(*keep, F.coalesce("__found", nothing).alias("matches"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
