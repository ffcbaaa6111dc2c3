"""Ranked lexical search, a score at a time (operator 11).

A first pass over the documents counts the queries' terms in each (the forward form, one table),
and aggregates give the corpus statistics, over all documents.  The second pass deals with
some ``SHARD_POSTINGS`` postings of documents at a time: they are grouped by term and exact impact,
impacts descending; for a query, the groups of its terms are taken in descending order of what they add,
and each adds to the scores of its documents.  After each stretch of groups, twice as long as
the one before, the sum over the terms of what their next group would add bounds
what a document can still gain.  When that is below the k-th best partial score so far (or the k-th
score of an earlier shard of the same task), no document not met yet can enter; the documents that still can are
completed exactly from the forward form, and the k best of the task stay.  Tasks give k rows a query,
which two windows reduce to the k best of all: the first within groups of documents, so that none is large.

Documents never move between tasks, so a frequent term is spread over all shards.  Queries come in blocks of about
``BLOCK_ITEMS`` and ``BLOCK_BYTES``, which bound the driver, the broadcast and a worker's tables; each block is one such pair of passes.

Scores are whole numbers: with N documents that hold a term, L terms in all of them, n in the document,
m = 100 - 90 + (90 n N) div L, the impact of tf occurrences is (1e9 tf) div (1000 tf + 8 m), the
weight of a term floor(1000 ln((2N + 2) / (2 df + 1))), and the score the sum of weight times impact
over the query's different terms.

Defined cases: null and empty texts have no terms and are never found; a query without terms, or
whose terms are in no document, gives no rows; each row of a table is a document or a query of its
own, so repeated rows and ids keep their rows, and ranks are unique; of equal scores the smaller doc_id
comes first, null ids last, repeated ids in any order; texts of any length are read whole, a block of words at a time;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Room, ready, released, saved, table
from .words import alnum_blocks

TOP = 10
SHARD_POSTINGS = 1 << 20
FIRST_STRETCH = 2048
BLOCK_ITEMS, BLOCK_BYTES = 4096, 8 << 20
SALT = 64


def term_counts(data: bytes) -> tuple[int, Counter]:
    """Number of terms, and occurrences of each."""
    total, found = 0, Counter()
    for _, words, _ in alnum_blocks(data, 0):
        total += len(words)
        found.update(words)
    return total, found


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Exact impacts; where the product could leave 64 bits, by Python's whole numbers."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 62:
        m = 10 + (90 * n * documents) // max(1, terms)
    else:
        m = np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Shard:
    """Postings of some documents, grouped by term and exact impact, impacts descending; and their forward form."""

    def __init__(self, sizes: np.ndarray, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, documents: int, total: int):
        self.sizes, self.starts, self.terms = sizes, np.cumsum(sizes) - sizes, terms
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.impact = impacts(tf, n[doc], documents, total)
        order = np.lexsort((-self.impact, terms))
        self.posting = doc[order]
        term, impact = terms[order], self.impact[order]
        new = np.ones(len(order), bool)
        new[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        self.group_start = np.flatnonzero(new)
        self.group_size = np.diff(np.append(self.group_start, len(order)))
        self.group_term, self.group_impact = term[self.group_start], impact[self.group_start]
        self.added = 0  # postings that were taken, for tests and reports

    def top(self, query: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the k best with a score of at least ``floor``, and their exact scores."""
        first, last = np.searchsorted(self.group_term, query), np.searchsorted(self.group_term, query, side="right")
        groups = _ranges(first, last - first)
        gain = weights[self.group_term[groups]] * self.group_impact[groups]
        by_gain = np.argsort(-gain, kind="stable")
        groups, gain = groups[by_gain], gain[by_gain]
        owner = np.repeat(np.arange(len(query)), last - first)[by_gain]
        own = np.argsort(owner, kind="stable")  # places of each term's groups, in order
        bounds = np.cumsum(last - first)
        upto = np.cumsum(self.group_size[groups])
        score = np.zeros(len(self.sizes), np.int64)
        at, target, rest, least = 0, FIRST_STRETCH, 0, max(floor, 1)
        while at < len(groups):
            end = max(at + 1, int(np.searchsorted(upto, target, side="right")))
            taken = groups[at:end]
            sizes = self.group_size[taken]
            np.add.at(score, self.posting[_ranges(self.group_start[taken], sizes)], np.repeat(gain[at:end], sizes))
            self.added += int(sizes.sum())
            at, target = end, 2 * target
            rest = 0
            for lo, hi in zip(bounds - (last - first), bounds, strict=True):
                following = lo + int(np.searchsorted(own[lo:hi], at))
                if following < hi:
                    rest += int(gain[own[following]])
            if len(score) >= k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
            if rest < least:
                break
        found = np.flatnonzero((score > 0) & (score + rest >= least))
        return found, self._complete(found, query, weights) if at < len(groups) else score[found]

    def _complete(self, docs: np.ndarray, query: np.ndarray, weights: np.ndarray) -> np.ndarray:
        own = np.zeros(len(weights), np.int64)
        own[query] = weights[query]
        sizes = self.sizes[docs]
        cells = _ranges(self.starts[docs], sizes)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), sizes), own[self.terms[cells]] * self.impact[cells])
        return out


class Best:
    """The k best documents of each query so far; null ids last."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(queries)]

    def floor(self, query: int) -> int:
        score = self.rows[query][0]
        return int(score[-1]) if len(score) == self.k else 0

    def add(self, query: int, score: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> None:
        score, ids, gone = (np.concatenate(x) for x in zip(self.rows[query], (score, ids, gone), strict=True))
        keep = np.lexsort((ids, gone, -score))[: self.k]
        self.rows[query] = score[keep], ids[keep], gone[keep]


def _forward(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n, terms, tf) of documents with a term; ``terms`` are those of the queries."""
    number = {t: i for i, t in enumerate(known.value)}
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, found = term_counts(text.as_py() or b"")
            if n:
                own = sorted((number[t], c) for t, c in found.items() if t in number)
                rows.append((key, n, [t for t, _ in own], [c for _, c in own]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "n", "terms", "tf"])


def _ranked(batches: Iterator[pa.RecordBatch], sent, k: int, most: int) -> Iterator[pa.RecordBatch]:
    """Forward rows -> (query, doc_id, score): the k best of the task."""
    queries, weights, documents, total = sent.value
    best = Best(len(queries), k)

    def searched(parts: list[pa.RecordBatch]) -> None:
        held = pa.Table.from_batches(parts)
        lists = held.column("terms").combine_chunks()
        flat = lambda c: held.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = held.column("doc_id")
        gone = ids.is_null().to_numpy().astype(bool)
        ids, n = ids.fill_null(0).to_numpy().astype(np.int64), held.column("n").to_numpy().astype(np.int64)
        shard = Shard(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), n, flat("terms"), flat("tf"), documents, total)
        for q, query in enumerate(queries):
            docs, score = shard.top(query, weights, k, best.floor(q))
            best.add(q, score, ids[docs], gone[docs])

    parts, postings = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            postings += len(batch.column("terms").flatten()) + batch.num_rows
        if postings >= most:
            searched(parts)
            parts, postings = [], 0
    if parts:
        searched(parts)
    for q, (score, ids, gone) in enumerate(best.rows):
        if len(score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), pa.array(ids, mask=gone), pa.array(score)], ["query", "doc_id", "score"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(term_counts(t.as_py() or b"")[1]) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])


def _block(docs: DataFrame, items: list, k: int, room: Room, shard_postings: int) -> DataFrame:
    """``(query, doc_id, score)``, the k best of each task, for a block of queries ``(item_id, terms)``."""
    spark = docs.sparkSession
    known = sorted({bytes(t) for item in items for t in item.terms})
    number = {t: i for i, t in enumerate(known)}
    sent = spark.sparkContext.broadcast(known)  # a block's terms, so at most BLOCK_BYTES, or one query
    forward = room.saved(docs.mapInArrow(lambda it: released(_forward(it, sent)), "doc_id long, n long, terms array<int>, tf array<long>"), "forward")
    documents, total = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[r.t] = r["count"]
    weights = np.array([weight(documents, int(x)) for x in df], np.int64)
    queries = [np.array(sorted(number[bytes(t)] for t in item.terms), np.int64) for item in items]
    plan = spark.sparkContext.broadcast((queries, weights, documents, total))
    return forward.mapInArrow(lambda it: released(_ranked(it, plan, k, shard_postings)), "query long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each query with a score above 0."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-size // block_bytes))
    with Room(spark) as room:
        terms = asked.mapInArrow(lambda it: released(_query_terms(it)), "item_id long, terms array<binary>").where("size(terms) > 0")
        terms = room.saved(terms.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "queries")
        parts = []
        for b in range(blocks):
            own = terms.where(F.col("block") == b).select("item_id", "terms").collect()  # a block
            if own:
                names = spark.createDataFrame([(i, item.item_id) for i, item in enumerate(own)], "query long, item_id long")
                found = _block(docs, own, k, room, shard_postings)
                near = Window.partitionBy("query", "salt").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
                few = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k)
                every = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
                placed = few.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
                parts.append(saved(placed.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked"))  # a row a query of the block
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH dt AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
tf AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM dt GROUP BY ALL),
dn AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
st AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM dn),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY term),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN dn USING (row), st GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10"""
