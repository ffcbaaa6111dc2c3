"""SimHash near-duplicates by deletion-variant signatures (operator 10).

A 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints
that differ in at most three bits, one segment differs in at most one bit, so
the pair shares a *one-wildcard variant*: that segment with one bit cleared,
tagged with the bit's place.  Each distinct fingerprint is indexed under its 64
variants; equal variants meet by one hash exchange, and each meeting is verified
on all 64 bits.

Within a variant's bucket a breadth-first sweep keeps a spanning forest of the
links, never all pairs, so a bucket's output is smaller than the bucket.  Exact
copies share a fingerprint and collapse before the index is built; a bucket of
more than ``HOT_BUCKET`` different fingerprints is indexed again in the same way by
the bits outside its segment, which loses no link.  Each level settles all
bits of a segment but one, so the number of fingerprints that can still share a bucket
shrinks to some thousands by itself.  The same index holds for n segments and
up to 2n - 1 differing bits.

``near_copies`` applies the same index to a signature of shingle hashes.

Defined cases: a null or blank text has fingerprint zero and links like any
other; fewer words than a shingle form one shingle; repeated rows and repeated
ids each keep their row; a null id takes part but is never a component's name
(a component of null ids only has a null name); an empty table gives no rows;
long texts are read whole, a block of words at a time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Room, ready, released, saved, table
from .words import shingles, word_blocks

SEED = 42
WORDS = 3
RADIUS, SEGMENTS = 3, 2
HOT_BUCKET = 4096


def fingerprint(text: bytes, n: int = WORDS, block: int = 1 << 20) -> int:
    """The signed 64-bit SimHash of the whole text; zero without words."""
    ones, total, first = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text, n - 1, block):
        count = len(words) - n + 1
        first = words
        if count <= 0:
            continue
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles(words, n), repeat(SEED)), np.uint64, count)
        total += count
        for at in range(0, count, 8192):
            part = hashes[at : at + 8192]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    if not total:
        if not first:
            return 0
        ones, total = np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(first), SEED)], np.uint64).view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        found = pa.array([fingerprint(t.as_py() or b"", n) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``."""
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(lambda it: _fingerprints(it, n), "doc_id long, fp long")


def forest(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Spanning forest of the links within ``radius`` bits among different fingerprints."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            for one in front.pop():
                near = np.bitwise_count(rest ^ one) <= radius
                if near.any():
                    new = rest[near]
                    left.append(np.full(len(new), one))
                    right.append(new)
                    front.append(new)
                    rest = rest[~near]
                    if not len(rest):
                        break
    return left, right


def _links(batches: Iterator[pa.RecordBatch], radius: int, hot: int | None) -> Iterator[pa.RecordBatch]:
    """Batches (key, fp) in order of key -> (key, a, b): links, or the members of a hot bucket with b null."""

    def out(key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array(a, pa.int64()), b], ["key", "a", "b"])

    def links(a: list, b: list) -> Iterator[pa.RecordBatch]:
        if a:
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield out(pa.nulls(len(x), pa.int64()), x, pa.array(y, pa.int64()))

    def flush(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs only."""
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
        ends = np.append(starts[1:], len(keys))
        sizes = ends - starts
        two = starts[sizes == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
        a, b = [fps[two][near]], [fps[two + 1][near]]
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            x, y = forest(np.unique(fps[s:e]), radius)
            a += x
            b += y
        yield from links(a, b)

    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held, passing = 0, None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        if passing is not None:  # the hot bucket goes on
            cut = int(np.searchsorted(keys, passing, side="right"))
            if cut:
                yield out(pa.array(keys[:cut]), fps[:cut].view(np.int64), pa.nulls(cut, pa.int64()))
            keys, fps = keys[cut:], fps[cut:]
            if not len(keys):
                continue
            passing = None
        kept.append((keys, fps))
        held += len(keys)
        if len(kept) > 1 and kept[0][0][-1] == keys[-1] and (hot is None or held <= hot):
            continue  # one unfinished run so far, still to be kept whole
        keys, fps = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
        last = int(np.searchsorted(keys, keys[-1]))
        head_k, head_f, tail_k, tail_f = keys[:last], fps[:last], keys[last:], fps[last:]
        if hot is not None and len(head_k):
            starts = np.flatnonzero(np.diff(head_k, prepend=head_k[0] - 1))
            large = np.repeat(np.diff(np.append(starts, len(head_k))) > hot, np.diff(np.append(starts, len(head_k))))
            if large.any():
                yield out(pa.array(head_k[large]), head_f[large].view(np.int64), pa.nulls(int(large.sum()), pa.int64()))
                head_k, head_f = head_k[~large], head_f[~large]
        if len(head_k):
            yield from flush(head_k, head_f)
        if hot is not None and len(tail_k) > hot:
            yield out(pa.array(tail_k), tail_f.view(np.int64), pa.nulls(len(tail_k), pa.int64()))
            kept, held, passing = [], 0, tail_k[0]
        else:
            kept, held = [(tail_k, tail_f)], len(tail_k)
    if kept:
        yield from flush(*(np.concatenate([k[i] for k in kept]) for i in (0, 1)))


def _bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and end of each segment."""
    return [(64 * i // segments, 64 * (i + 1) // segments) for i in range(segments)]


def _bits(start: int, end: int) -> Column:
    return F.shiftrightunsigned("fp", start).bitwiseAND((1 << (end - start)) - 1)


def variants(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``(fp)`` -> ``(key, fp)``: 64 one-wildcard variants, keyed by place and remaining bits."""
    keys = [F.lit(i << 32).bitwiseOR(_bits(s, e).bitwiseAND(((1 << (e - s)) - 1) ^ (1 << (i - s)))) for s, e in _bounds(segments) for i in range(s, e)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _others(segments: int) -> Column:
    """The bits of ``fp`` outside the segment of ``key``, put together."""
    found = F.lit(None).cast("long")
    for s, e in reversed(_bounds(segments)):
        below = _bits(0, s) if s else F.lit(0)
        found = F.when(F.col("key") < (e << 32), F.shiftleft(_bits(e, 64), s).bitwiseOR(below) if e < 64 else below).otherwise(found)
    return found


def _again(crowded: DataFrame, width: int, segments: int) -> tuple[DataFrame, int]:
    """``(key, rest, fp)`` of hot buckets -> the same one level on: variants of the ``width`` bits ``rest`` that the key leaves open."""
    made, rest = [], F.col("rest")
    cuts = [(width * i // segments, width * (i + 1) // segments) for i in range(segments)]
    for s, e in cuts:
        own = F.shiftrightunsigned(rest, s).bitwiseAND((1 << (e - s)) - 1)
        left = F.shiftleft(F.shiftrightunsigned(rest, e), s).bitwiseOR(rest.bitwiseAND((1 << s) - 1))
        for i in range(s, e):
            made.append(F.struct(F.xxhash64("key", F.lit(i), own.bitwiseAND(((1 << (e - s)) - 1) ^ (1 << (i - s)))).alias("key"), left.alias("rest")))
    return crowded.select(F.explode(F.array(*made)).alias("v"), "fp").select("v.key", "v.rest", "fp"), width - min(e - s for s, e in cuts)


def links(fps: DataFrame, room: Room, radius: int = RADIUS, hot: int = HOT_BUCKET, segments: int = SEGMENTS) -> DataFrame:
    """Distinct ``(fp)`` -> ``(a, b)``: links that connect just what all links within ``radius`` connect."""
    if not 2 <= segments <= 8 or radius > 2 * segments - 1:
        raise ValueError("n segments (2 to 8) with one wildcard guarantee 2n - 1 differing bits at most")

    def met(rows: DataFrame, limit: int | None) -> DataFrame:
        together = rows.select("key", "fp").repartition("key").sortWithinPartitions("key")
        return room.saved(together.mapInArrow(lambda it: released(_links(it, radius, limit)), "key long, a long, b long"), "links")

    dealt, width = variants(fps, segments).withColumn("rest", _others(segments)), max(64 - (e - s) for s, e in _bounds(segments))
    found = met(dealt, hot)
    out = found.where("b is not null").select("a", "b")
    while not (crowded := found.where("b is null").select("key").distinct()).isEmpty():
        dealt, width = _again(room.saved(dealt.join(crowded, "key", "left_semi"), "hot"), width, segments)
        found = met(dealt, hot if width >= 2 * segments else None)
        out = out.union(found.where("b is not null").select("a", "b"))
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``."""
    rows = saved(fingerprints(docs, id_col, text_col, n), "fingerprints")
    with Room(docs.sparkSession) as room:
        nodes = room.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        roots = components(links(nodes.select("fp"), room, radius, hot), room)
        named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        named = room.saved(named, "roots")
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        of = saved(named.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
