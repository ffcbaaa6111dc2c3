"""Toxic passages by maximum-scoring segments of token log-odds (operator 2).

Every word gets the log-odds of occurring in toxic against clean documents,
smoothed by a Dirichlet prior (a flat part and a part in proportion to the
pooled frequency); a word too rare to be judged falls back on its longest judged
prefix of ``PREFIXES`` characters.  Words without a significant score share one
negative drift, so that the scores are log-likelihood ratios and a random clean
text drifts down.  A linear-time scan (Ruzzo and Tompa) gives all maximal
segments of the whole text.  The best segment of n clean words follows an
extreme-value law, P(S > x) = 1 - exp(-K n exp(-x)); K is estimated on clean
texts, E-values say which segments are significant, and a logistic curve over
these calibrated values gives the document's probability.

The model is learned from a bounded sample of labelled rows (``per_class``
documents of each label, chosen by a hash of the id; equal texts count once).  The
curve is fitted on scores from word counts of the other half of the sample.

Defined cases: null and empty texts score as texts of no words; words are
lower-cased runs of letters; several labels of a document count as toxic if one
is 1; null labels or ids teach nothing and a null id is not held out; if the
labels lack one of the two classes, every score is the share of toxic rows (0
without any); repeated rows each keep their row; texts of any length are
scanned whole, in blocks cut at white space, with memory in proportion to their hits; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ready, saved, table

PER_CLASS = 10_000
PREFIXES = (6, 5, 4)
FLAT, SHARE = 0.5, 0.01
LEAST_Z, LEAST_COUNT = 2.5, 3
#: Features that reach the driver at most, whatever the length of the sample's texts.
MOST_FEATURES = 1 << 18
SIGNIFICANT = 0.01
BLOCK_CHARS = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s")


@dataclass
class Segments:
    """Word and prefix scores, the drift of all other words, and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    drift: float = -0.01
    log_k: float = 0.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    quick: frozenset[str] = frozenset()

    def score(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            for n in PREFIXES:
                if len(word) > n and (found := self.prefixes.get(word[:n])) is not None:
                    return found
            return self.drift
        return found


def features(text: str) -> set[str]:
    """The words of a text and, marked by a trailing ``*``, their prefixes."""
    words = {w for part in _parts(text) for w in _WORD.findall(part.lower())}
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def _parts(text: str) -> Iterator[str]:
    """The text in blocks of about ``BLOCK_CHARS`` cut at white space."""
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + BLOCK_CHARS)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def build(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, words_per_text: float) -> Segments:
    """Scores from the numbers of toxic and clean texts that hold each feature."""
    m, judged = Segments(), {}
    ratio = n_clean / max(1, n_toxic)
    for f, (t, c) in counts.items():
        t, c = t * ratio, c  # as if both classes had as many texts
        prior = FLAT + SHARE * (t + c) / 2
        s = math.log((t + prior * ratio) / (c + prior)) - math.log((n_clean + prior * ratio) / (n_clean + prior))
        z = s / math.sqrt(1 / (t / ratio + FLAT) + 1 / (c + FLAT))
        judged[f] = (s, z, t / ratio)
    m.prefixes = {f[:-1]: s for f, (s, z, t) in judged.items() if f.endswith("*") and z >= LEAST_Z and t >= LEAST_COUNT}
    for f, (s, z, t) in judged.items():
        if f.endswith("*"):
            continue
        behind = any(f[:n] in m.prefixes for n in PREFIXES if len(f) > n)
        if z >= LEAST_Z and t >= LEAST_COUNT or behind and sum(counts[f]) >= LEAST_COUNT + 1:
            m.words[f] = s
    held = [(t / max(1, n_toxic), c / max(1, n_clean)) for f, (t, c) in counts.items() if m.words.get(f, 0) > 0]
    q, p = (min(0.5, sum(x) / max(1.0, words_per_text)) for x in (zip(*held, strict=True) if held else ((), ())))
    m.drift = min(-0.002, math.log((1 - q) / (1 - p)))
    m.words = {w: (s if s > 0 else m.drift) for w, s in m.words.items()}
    m.quick = frozenset(f[:4] for f in [*m.words, *m.prefixes])
    return m


def hits(m: Segments, text: str) -> tuple[int, list[tuple[int, float, int, int]]]:
    """Number of words, and (word index, score, first char, end char) of those above the drift."""
    total, found, offset = 0, [], 0
    quick = m.quick
    for part in _parts(text):
        low = part.lower()
        words = _WORD.findall(low)
        seen = [i for i, w in enumerate(words) if w[:4] in quick]
        if seen:
            same = len(low) == len(part)  # lower-casing may lengthen a character
            spans = None
            for i in seen:
                if (s := m.score(words[i])) > m.drift:
                    if spans is None:
                        spans = [x.span() for x in _WORD.finditer(part if same else low)]
                        same = same and len(spans) == len(words)
                    a, b = spans[i] if same else (0, len(part))
                    found.append((total + i, s, offset + a, offset + b))
        total += len(words)
        offset += len(part)
    return total, found


def segments(marks: list[tuple[int, float, int, int]], drift: float, steps: list[int] | None = None) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first hit, last hit), by the linear-time stack scan.

    Each candidate knows the nearest earlier one of a smaller left sum, so the search back
    jumps over those that cannot join; what a search passes is joined or jumped over from then on.
    ``steps[0]`` counts the jumps, if given.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first hit, last hit, nearest smaller
    total, last, jumps = 0.0, -1, 0
    for k, (i, s, _, _) in enumerate(marks):
        total += drift * (i - last - 1)
        last = i
        left, right, first = total, total + s, k
        total = right
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
                jumps += 1
            if j < 0 or stack[j][1] >= right:
                break
            left, _, first, _, before = stack[j]
            del stack[j:]
            j = before
            jumps += 1
        stack.append((left, right, first, k, j))
    if steps is not None:
        steps[0] += jumps
    return [(r - a, f, e) for a, r, f, e, _ in stack]


def statistics(m: Segments, text: str | None) -> tuple[tuple[float, float, float], list[tuple[int, int, float, float]]]:
    """Calibrated values of the best segment and of all, log of the words; passages (first char, end char, score, E)."""
    n, marks = hits(m, text or "")
    base = m.log_k + math.log(max(1, n))
    best, total, passages = 0.0, 0.0, []
    for s, first, last in segments(marks, m.drift):
        e = math.exp(min(50.0, base - s))
        p = -math.expm1(-e)
        best = max(best, -math.log(max(p, 1e-300)))
        total += max(0.0, s - base)
        if e <= SIGNIFICANT:
            passages.append((marks[first][2], marks[last][3], s, e))
    return (best, math.log1p(total), math.log(max(1, n))), passages


def probability(m: Segments, x: tuple[float, float, float]) -> float:
    v = m.curve[0] + sum(w * f for w, f in zip(m.curve[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, v))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6) -> tuple[float, ...]:
    """Weighted logistic regression with intercept by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * weight.sum() * np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, half, text) -> partial counts (feature, half, toxic, clean); the feature '' counts texts, ' ' words."""
    for batch in batches:
        found: Counter = Counter()
        for toxic, half, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = features(text or "")
            found.update((f, half, toxic) for f in own)
            found["", half, toxic] += 1
            found[" ", half, toxic] += len(own)
        keys = list(found)
        cols = [[k[0] for k in keys], [k[1] for k in keys], [found[k] * (k[2] == 1) for k in keys], [found[k] * (k[2] == 0) for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["feature", "half", "toxic", "clean"])


def strongest(sums: DataFrame, texts: tuple[int, int], most: int = MOST_FEATURES) -> DataFrame:
    """The ``most`` features whose shares of toxic and of clean texts differ most, in standard errors of their log-odds; of equal ones the first."""
    half = F.lit(0.5)
    odds = lambda n, total: (F.log((n + half) / (F.greatest(F.lit(total) - n, F.lit(0)) + half)), 1 / (n + half))
    (a, u), (b, v) = odds(F.col("toxic0") + F.col("toxic1"), texts[0]), odds(F.col("clean0") + F.col("clean1"), texts[1])
    return sums.orderBy(F.desc(F.abs(a - b) / F.sqrt(u + v)), "feature").limit(most)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Segments | None, float]:
    """The model (None if a class is missing) and the share of toxic rows; ``docs(doc_id, text)``, ``labels(doc_id, toxic)``."""
    spark = docs.sparkSession
    ready(spark)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    scale = 1 << 40
    rates = {k: min(1.0, per_class / c) for k, c in n.items()}
    rate = F.when(F.col("toxic") == 1, F.lit(int(scale * rates.get(1, 0)))).otherwise(F.lit(int(scale * rates.get(0, 0))))
    # at most about two times per_class rows of two numbers, whatever the input
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < rate)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    sample = saved(sample.dropDuplicates(["h", "toxic"]).select("toxic", F.pmod("h", F.lit(2)).alias("half"), "text"), "labelled")
    counted = sample.select("toxic", "half", "text").mapInArrow(_count, "feature string, half long, toxic long, clean long")
    sums = counted.groupBy("feature").agg(*[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "clean")])
    sums = saved(sums, "counts")
    of_all = sums.where("feature in ('', ' ')").collect()  # two rows
    kept = [*of_all, *strongest(sums.where(f"toxic0 + toxic1 >= {LEAST_COUNT} and feature not in ('', ' ')"), next(((r.toxic0 + r.toxic1, r.clean0 + r.clean1) for r in of_all if r.feature == ""), (0, 0))).collect()]
    by = {r.feature: (r.toxic0, r.clean0, r.toxic1, r.clean1) for r in kept}
    texts, words = by.pop("", (0, 0, 0, 0)), by.pop(" ", (0, 0, 0, 0))
    if not (texts[0] + texts[2] and texts[1] + texts[3]):
        return None, share

    def model(pick) -> Segments:
        t, c = pick(texts)
        return build({f: pick(v) for f, v in by.items()}, max(1, t), max(1, c), sum(pick(words)) / max(1, sum(pick(texts))))

    halves = [model(lambda v: v[2:]), model(lambda v: v[:2])]  # each half is judged by the other's counts
    whole = model(lambda v: (v[0] + v[2], v[1] + v[3]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, half = (batch.column(i) for i in (0, 1))
            rows = [(*statistics(halves[h.as_py()], t.as_py())[0], _peak(halves[h.as_py()], t.as_py())) for h, t in zip(half, batch.column(2), strict=True)]
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([toxic, half, *cols], ["toxic", "half", "best", "total", "size", "peak"])

    def measured() -> np.ndarray:
        got = sample.mapInArrow(measure, "toxic int, half long, best double, total double, size double, peak double").collect()
        return np.array(sorted(tuple(r) for r in got), float)

    first = measured()
    clean = first[first[:, 0] == 0]
    # E-values of one: the mean number of clean texts whose best segment passes S is K n exp(-S)
    log_k = float(np.log(max(1e-12, np.mean(np.exp(np.minimum(clean[:, 5], 8.0) - clean[:, 4])))))
    for m in (*halves, whole):
        m.log_k = log_k
    final = measured()
    weight = np.where(final[:, 0] == 1, 1 / rates.get(1, 1.0), 1 / rates.get(0, 1.0))
    whole.curve = logistic(final[:, 2:5], final[:, 0], weight)
    return whole, share


def _peak(m: Segments, text: str | None) -> float:
    return max([0.0, *(s for s, _, _ in segments(hits(m, text or "")[1], m.drift))])


def _score(batches: Iterator[pa.RecordBatch], m: Segments | None, share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, passages = [], []
        for t in batch.column(batch.num_columns - 1):
            if m is None:
                scores.append(share)
                passages.append([])
                continue
            x, found = statistics(m, t.as_py())
            scores.append(probability(m, x))
            passages.append([{"first": a, "end": b, "segment_score": s, "e_value": e} for a, b, s, e in found])
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("segment_score", pa.float64()), ("e_value", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64()), pa.array(passages, kind)], [*batch.schema.names[:-1], "score", "passages"])


def score(docs: DataFrame, model: Segments | None, share: float, keep: list[str], text_col: str = "text") -> DataFrame:
    """``docs``' columns ``keep`` with ``score`` and ``passages`` (significant segments by character)."""
    ready(docs.sparkSession)
    fed = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fed.schema.fields[:-1])
    return fed.mapInArrow(lambda it: _score(it, model, share), f"{kept}, score double, passages array<struct<first: long, end: long, segment_score: double, e_value: double>>")


def held_out(remainder: int, modulus: int):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return F.coalesce(fold == remainder, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(0, 5))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(0, 5))
    model, share = fit(docs.where("not held_out"), labels)
    out = score(docs, model, share, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
