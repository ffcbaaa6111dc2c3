"""Near copies by word shingles: operator 10's SimHash index, and its deletion variants on a shingle sketch for what SimHash misses.

Two texts are near copies if their sets of five-word shingles have a similarity
(shared shingles by all shingles) of 0.8 or more.

First the SimHash fingerprints of these shingles are linked as operator 10 does, by one-wildcard variants, within three differing
bits; texts of one fingerprint meet the least of them.  Each such link is held against the exact sets.  Of pairs at 0.8,
fingerprints find only some, so all texts go through a second index too.  A text's signature holds its least
shingle hashes under ``SEGMENTS * ROWS`` permutations, cut into ``SEGMENTS`` segments.
The index is that of ``simhash_dedup``: each segment is posted once for every row
left out (a one-wildcard variant), so two texts meet by an equality join if some
segment differs in one row at most.  A row agrees with chance s, the similarity;
a pair is missed with chance (1 - s**R - R * (1 - s) * s**(R - 1))**SEGMENTS, R = ``ROWS``:
0.00008 at 0.8, and less above.

The texts of a bucket are never paired with each other at once:

1. each text is held against the least text of its buckets, and the SimHash links are verified with them, on the exact sets;
   what is verified gives classes;
2. the least texts of its other buckets follow, where the classes still differ;
3. the texts of buckets of three or more that still hold several classes are searched by
   rare shingles.  Of two similar sets, the first common shingle in order of frequency (among these
   texts) lies in the prefix of both, the rarest fifth of each.  If that shingle is in ``RARE``
   texts at most, the two meet under it, whatever else they share, and are verified on the exact sets;
4. else all they share is frequent, such as a template, and must alone make them similar.  Only where a
   bucket has a text nearly all of whose shingles are frequent (eight ninths, at the threshold 0.8) do such texts remain, and
   texts large and frequent enough to be similar to it; they are met in blocks of ``GROUP`` texts: all outside the
   bucket's main class against all of it.  Texts of one template that differ in more than that never come here,
   so they cost as many rows as they have shingles.

So a class is joined only by verified links, a candidate alone joins nothing, and no
link between texts that meet in a bucket is lost.  Equal texts (words, letter case of
A-Z aside) collapse before all that.

Defined cases: null and blank texts are copies of each other; fewer than five words form
one shingle; rows that repeat id and text give one row; a null id is kept only if its class
has no other; texts of any length are read whole, in blocks; an empty table gives
no rows; all columns pass unchanged.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .decontaminate import shingle_hashes, word_hashes
from .scratch import Room, ready, released, saved
from .simhash_dedup import fingerprint, links as simhash_links
from .words import word_blocks

WORDS, SIMILARITY = 5, 0.8
SEGMENTS, ROWS = 11, 7
GROUP, GROUP_SHINGLES = 4096, 1 << 20
#: A shingle of more texts than this is frequent; so many texts meet under a rare one at most.
RARE = 64
#: A text's own set goes to at most so many tasks as the centre of its links.
CENTRE_TASKS = 1024
_ODD = np.random.default_rng(42).integers(0, 2**64, (SEGMENTS * ROWS, 1), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another hash of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_rows(text: bytes, n: int = WORDS) -> Iterator[np.ndarray]:
    """The shingles' hashes, a block at a time; fewer words than a shingle form one."""
    some, words = False, []
    for words in word_blocks(text, n - 1):
        rows = shingle_hashes(word_hashes(words), n)
        some |= len(rows) > 0
        yield rows
    if words and not some:
        yield shingle_hashes(word_hashes(words), len(words))


def shingle_set(text: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted hashes of the set of shingles."""
    found = [np.unique(rows) for rows in shingle_rows(text, n)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def variant_keys(text: bytes, n: int = WORDS) -> np.ndarray:
    """The one-wildcard variants of the segments of the signature; none without words."""
    least, some = np.full(len(_ODD), 2**64 - 1, np.uint64), False
    for rows in shingle_rows(text, n):
        some |= len(rows) > 0
        for at in range(0, len(rows), 2048):
            np.minimum(least, (_ODD * rows[at : at + 2048]).min(axis=1), out=least)
    if not some:
        return np.zeros(0, np.int64)
    # a row's part in the segment's sum; a variant is the sum without one part, marked by segment and place
    parts = _mixed(least ^ _ODD[:, 0]).reshape(SEGMENTS, ROWS)
    sums = parts.sum(axis=1, keepdims=True, dtype=np.uint64) - parts
    return _mixed(sums + _ODD[:, 0].reshape(SEGMENTS, ROWS)).ravel().view(np.int64)


def words_hash(text: Column) -> Column:
    """Hash of the words, in the JVM: A-Z lower-cased, runs of white space as one blank."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.xxhash64(F.trim(F.regexp_replace(low, "[\\t-\\r ]+", " ")))


def similar_forest(sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the pairs of sets, by place, with a similarity of ``threshold`` or more."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    coded, owner = codes[order], np.repeat(np.arange(n), sizes)[order]
    begin = np.r_[0, np.bincount(coded, minlength=len(distinct)).cumsum()]
    left, right, rest, held = [], [], np.ones(n, bool), n
    for first in range(n):
        if not rest[first]:
            continue
        rest[first], front = False, [first]
        while front and rest.any():
            i = front.pop()
            own = codes[ends[i] - sizes[i] : ends[i]]
            start, many = begin[own], begin[own + 1] - begin[own]
            places = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(owner[places], minlength=n)
            new = np.flatnonzero(rest & (common / np.maximum(sizes + sizes[i] - common, 1) >= threshold))
            left += [i] * len(new)
            right += new.tolist()
            front += new.tolist()
            rest[new] = False
            if 2 * rest.sum() < held:  # what is linked need not be met again
                held, kept = int(rest.sum()), rest[owner]
                coded, owner = coded[kept], owner[kept]
                begin = np.r_[0, np.bincount(coded, minlength=len(distinct)).cumsum()]
    return left, right


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _spokes(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (centre, salt, spoke, shingles), a centre's own set first -> the (a, b) that are similar."""
    centre, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for c, spoke, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            found = np.frombuffer(data.as_buffer(), np.uint64)
            if spoke is None:
                centre, own = c, found.copy()
                continue
            if c != centre:
                raise RuntimeError("a centre's set is missing")
            small, large = (found, own) if len(found) <= len(own) else (own, found)
            if len(small) / max(len(large), 1) < threshold:
                continue
            common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(large) else 0
            if common / max(len(small) + len(large) - common, 1) >= threshold:
                a.append(spoke)
                b.append(c)
        if a:
            yield _pairs(a, b)


def verified(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``edges(a, b)`` whose sets are similar; a ``b`` of many edges is dealt over ``CENTRE_TASKS`` tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(CENTRE_TASKS)).cast("int"))
    spokes = salted.join(sets, F.col("a") == F.col("th")).select(F.col("b").alias("centre"), "salt", F.col("a").alias("spoke"), "shingles")
    centres = salted.select("b", "salt").distinct().join(sets, F.col("b") == F.col("th")).select(F.col("b").alias("centre"), "salt", F.lit(None).cast("long").alias("spoke"), "shingles")
    order = ["centre", "salt", "spoke"]  # nulls come first
    met = centres.union(spokes).repartition("centre", "salt").sortWithinPartitions(*order)
    return met.mapInArrow(lambda it: released(_spokes(it, threshold)), "a long, b long")


def _forests(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, th, shingles), blocks together -> (a, b): a spanning forest of each block's links."""

    def links() -> pa.RecordBatch:
        left, right = similar_forest(sets, threshold)
        return _pairs([ths[i] for i in left], [ths[i] for i in right])

    key, ths, sets = None, [], []
    for batch in batches:
        for k, block, th, own in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if (k, block) != key:
                if len(ths) > 1:
                    yield links()
                key, ths, sets = (k, block), [], []
            ths.append(th)
            sets.append(np.frombuffer(own.as_buffer(), np.uint64).copy())
    if len(ths) > 1:
        yield links()


def _labelled(rows: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """``rows`` with the class of ``column`` under the name ``<column>_class``."""
    named = classes.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return rows.join(named, F.col(column) == F.col("__n"), "left").withColumn(f"{column}_class", F.coalesce("__r", column)).drop("__n", "__r")


def _open_buckets(members: DataFrame, classes: DataFrame, least: int = 3) -> DataFrame:
    """``(key, th, main)`` of buckets of ``least`` or more texts in several classes; of buckets with the same texts, one."""
    rows = _labelled(members, classes, "th")
    parts = rows.groupBy("key", "th_class").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("th")).alias("mark"))
    buckets = parts.groupBy("key").agg(F.max_by("th_class", F.struct("n", "th_class")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("classes"), F.bit_xor("mark").alias("mark"))
    once = buckets.where((F.col("classes") > 1) & (F.col("n") >= least)).groupBy("n", "mark").agg(F.min(F.struct("key", "main")).alias("k")).select("k.key", "k.main")
    return rows.join(once, "key").select("key", "th", (F.col("th_class") == F.col("main")).alias("main"))


def _postings(batches: Iterator[pa.RecordBatch], step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(th, th_class, shingles) -> a row (th, th_class, size, s) for each shingle."""
    for batch in batches:
        for th, own, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            found = np.frombuffer(data.as_buffer(), np.int64)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                same = [pa.array(np.full(len(part), v), pa.int64()) for v in (th.as_py(), own.as_py(), len(found))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part)], ["th", "th_class", "size", "s"])


def rare_meetings(rare: DataFrame, threshold: float) -> DataFrame:
    """``rare(th, th_class, size, s, n)``, the postings of shingles of ``RARE`` texts at most -> different ``(a, b)`` that
    share one within the prefix of both, are in different classes, and whose sizes allow the threshold."""
    least = F.ceil(F.col("size") * threshold - 1e-9)
    order = Window.partitionBy("th").orderBy("n", "s")
    prefix = rare.withColumn("place", F.row_number().over(order)).where((F.col("place") <= F.col("size") - least + 1) & (F.col("n") > 1))
    met = prefix.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("th", "th_class", "size"))).alias("g")).where("size(g) > 1")
    each = met.select(F.posexplode("g").alias("i", "x"), "g")
    pairs = each.select("x", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("y"))
    sizes = (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * threshold - 1e-9) & (F.col("x.th_class") != F.col("y.th_class"))
    return pairs.where(sizes).select(F.col("x.th").alias("a"), F.col("y.th").alias("b")).distinct()


def frequent_rows(left: DataFrame, frequent: DataFrame, threshold: float, room: Room) -> DataFrame | None:
    """``left(key, th, main)`` and ``frequent(th, size, f)``, sizes and numbers of frequent shingles -> those ``(key, th)`` that frequent shingles alone
    can make similar to a text of another class; None if there are none.

    A similarity t needs t / (1 + t) of both sizes together in common, so with f frequent ones a text reaches partners of
    size f (1 + t) / t - size at most; the smaller of a pair must reach its own size. Every pair has a text outside the
    main class, so only buckets with such a text count.
    """
    reaching = frequent.withColumn("reach", F.col("f") * ((1 + threshold) / threshold) - F.col("size") + 1e-6)
    least = reaching.where("reach >= size").agg(F.min("size")).first()[0]
    if least is None:
        return None
    possible = room.saved(reaching.where(F.col("reach") >= least).select("th", "size", "reach"), "possible")
    others = room.saved(left.where("not main").select("key", "th").join(possible, "th"), "others")
    if others.isEmpty():
        return None
    mains = left.where("main").select("key", "th").join(others.select("key").distinct(), "key", "left_semi").join(possible, "th")
    rows = others.unionByName(mains)
    smallest = rows.where("reach >= size").groupBy("key").agg(F.min("size").alias("smallest"))
    return room.saved(rows.join(smallest, "key").where("reach >= smallest").select("key", "th"), "frequent")


def blocked(rows: DataFrame, group: int) -> DataFrame:
    """``rows(key, th, main, shingles)`` dealt to ``(key, block)``: all pairs meet but those within the main class."""
    size = F.octet_length("shingles") / 8
    many = lambda of: F.greatest(F.ceil(F.count_if(of) / group), F.ceil(F.sum(F.when(of, size).otherwise(0)) / GROUP_SHINGLES)).cast("long")
    counts = rows.groupBy("key").agg(many(~F.col("main")).alias("others"), many(F.col("main")).alias("mains"))
    own = F.pmod(F.xxhash64("th"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")))
    dealt = rows.join(counts, "key").withColumn("own", own).withColumn("width", F.col("others") + F.col("mains"))
    i, width = F.col("own"), F.col("width")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    to_main = F.transform(upto(F.col("mains")), lambda m: i * width + F.col("others") + m)
    each_other = F.transform(upto(F.col("others")), lambda j: F.least(i, j) * width + F.greatest(i, j))
    from_main = F.transform(upto(F.col("others")), lambda j: j * width + F.col("others") + i)
    to = F.when(F.col("main"), from_main).otherwise(F.concat(to_main, each_other))
    return dealt.select("key", F.explode(to).alias("block"), "th", "shingles")


def simhash_edges(nodes: DataFrame, room: Room) -> DataFrame:
    """``nodes(th, fp)`` -> ``(a, b)`` of texts: each with the least text of its fingerprint, and those of fingerprints that operator 10 links."""
    least = room.saved(nodes.groupBy("fp").agg(F.min("th").alias("least")), "fingerprints")
    own = nodes.join(least, "fp").where("th <> least").select(F.col("th").alias("a"), F.col("least").alias("b"))
    linked = simhash_links(least.select("fp"), room).distinct()
    named = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_th"))
    return own.union(linked.join(named("a"), "a").join(named("b"), "b").select(F.greatest("a_th", "b_th"), F.least("a_th", "b_th")))


def _joined(classes: DataFrame, edges: DataFrame, sets: DataFrame, room: Room, threshold: float) -> DataFrame:
    """``classes`` joined by those of the saved ``edges(a, b)`` that are similar; the same frame if none is. The classes are stars already, so few rounds follow."""
    if edges.isEmpty():
        return classes
    links = room.saved(verified(edges, sets, threshold), "links")
    return classes if links.isEmpty() else components(classes.union(links).toDF("a", "b"), room)


def near_classes(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], room: Room, threshold: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """``nodes(th, keys, fp)`` -> ``(node, root)`` of the texts that have a near copy.

    ``sets_of`` turns a table ``(th)`` into ``(th, shingles)``.
    """
    near = room.saved(simhash_edges(nodes.select("th", "fp"), room), "near")
    keys = nodes.select("th", F.explode(F.array_distinct("keys")).alias("key"))
    # both sides of the next join are tables, so that adaptive execution can split a hot bucket
    shared = room.saved(keys.groupBy("key").agg(F.min("th").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "shared")
    members = room.saved(keys.join(shared, "key"), "members")
    spokes = members.where("th <> least")
    sets = room.saved(sets_of(members.select("th").union(near.select("a")).union(near.select("b")).distinct()), "sets")
    first = room.saved(spokes.groupBy(F.col("th").alias("a")).agg(F.min("least").alias("b")).union(near).distinct(), "edges")
    classes = components(room.saved(verified(first, sets, threshold), "links"), room)
    others = spokes.select(F.col("th").alias("a"), F.col("least").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    apart = _labelled(_labelled(others, classes, "a"), classes, "b").where("a_class <> b_class").select("a", "b")
    classes = _joined(classes, room.saved(apart, "edges"), sets, room, threshold)
    left = room.saved(_open_buckets(members, classes), "open")
    if left.isEmpty():
        return classes
    texts = room.saved(_labelled(left.select("th").distinct(), classes, "th"), "open_texts")
    postings = room.saved(texts.join(sets, "th").select("th", "th_class", "shingles").mapInArrow(lambda it: released(_postings(it)), "th long, th_class long, size long, s long"), "postings")
    few = room.saved(postings.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") <= RARE), "few")
    rare = room.saved(postings.join(few, "s"), "rare")
    joined = _joined(classes, room.saved(rare_meetings(rare, threshold), "edges"), sets, room, threshold)
    if joined is not classes:
        classes = joined
        left = room.saved(_open_buckets(left.select("key", "th"), classes, 2), "open")
    sizes = postings.groupBy("th").agg(F.first("size").alias("size"))
    own = rare.groupBy("th").agg(F.count("*").alias("r"))
    frequent = room.saved(sizes.join(own, "th", "left").select("th", "size", (F.col("size") - F.coalesce("r", F.lit(0))).alias("f")), "sizes")
    some = frequent_rows(left, frequent, threshold, room)
    if some is None:
        return classes
    hard = room.saved(_open_buckets(some, classes, 2), "open")
    if hard.isEmpty():
        return classes
    rows = room.saved(hard.join(sets, "th").select("key", "th", "main", "shingles"), "blocks")
    dealt = blocked(rows, group).repartition("key", "block").sortWithinPartitions("key", "block")
    last = room.saved(dealt.mapInArrow(lambda it: released(_forests(it, threshold)), "a long, b long"), "links")
    return classes if last.isEmpty() else components(classes.union(last).toDF("a", "b"), room)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the least id (of a null id only if there is no other)."""
    spark = docs.sparkSession
    ready(spark)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [variant_keys(t.as_py() or b"", n) for t in batch.column(2)]
            marks = [fingerprint(t.as_py() or b"", n) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(marks, pa.int64())], ["id", "th", "keys", "fp"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py() or b"", n).tobytes() for t in batch.column(1)], pa.binary())], ["th", "shingles"])

    fed = docs.select(F.col(id_col).cast("long").alias("id"), words_hash(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        where = nodes.select(F.col("th").alias("__th"), "least").join(wanted.withColumnRenamed("th", "__w"), F.col("__th") == F.col("__w")).select("__th", "least")
        texts = fed.join(where, (F.col("th") == F.col("__th")) & F.col("id").eqNullSafe(F.col("least"))).select("th", "text")
        return texts.mapInArrow(lambda it: released(exact(it)), "th long, shingles binary").dropDuplicates(["th"])

    with Room(spark) as room:
        rows = room.saved(fed.mapInArrow(lambda it: released(signed(it)), "id long, th long, keys array<long>, fp long"), "signatures")
        nodes = room.saved(rows.groupBy("th").agg(F.min("id").alias("least"), F.first("keys").alias("keys"), F.min("fp").alias("fp")), "texts")
        classes = near_classes(nodes, sets_of, room, threshold, group)
        named = _labelled(nodes.select("th", "least"), classes, "th")
        best = named.groupBy("th_class").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "th")).alias("k"))
        repeated = rows.groupBy("th", "id").agg((F.count("*") > 1).alias("repeated"))
        chosen = best.select(F.col("k.th").alias("__kt"), F.col("k.least").alias("__ki"))
        found = (F.col("th") == F.col("__kt")) & F.col("id").eqNullSafe(F.col("__ki"))
        keep = saved(chosen.join(repeated, found).select("__kt", "__ki", "repeated"), "kept")
    hashed = docs.withColumn("__th", words_hash(F.col(text_col))).withColumn("__id", F.col(id_col).cast("long"))
    same = (F.col("__th") == F.col("__kt")) & F.col("__id").eqNullSafe(F.col("__ki"))
    kept = hashed.join(keep.where("not repeated"), same, "left_semi")
    again = keep.where("repeated")
    if not again.isEmpty():  # rows that repeat id and text
        kept = kept.unionByName(hashed.join(again, same, "left_semi").dropDuplicates(["__th", "__id"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
