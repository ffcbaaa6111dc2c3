"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

The network reads a text's UTF-8 bytes in windows of ``WINDOW`` bytes, once from
the left and once from the right, labels every position with a distribution
over the learned languages, and a document's distribution is the mean over the
positions that hold letters.  Windows cut the whole text; none is skipped.
It is trained in numpy by backpropagation through time on a bounded sample of
labelled documents (``per_lang`` texts a language, ``WINDOWS_PER_TEXT`` windows
from each, chosen by hash over the whole table and the whole text).

The recurrent step is ``z, r = hard_sigmoid(..)``, ``n = tanh(x + r * (U h))``,
``h = n + z * (h - n)``; hard_sigmoid(v) = clip(0.2 v + 0.5, 0, 1).

Defined cases: a null text, or one without a letter (categories L*), gives ``und`` with score 0;
so does every text if no labelled row can be learned from; with one language
every text with letters gets it with score 1; repeated rows each keep their
row; a null id is never learned from and is not held out; texts of any length are
labelled whole, ``BATCH`` windows at a time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ready, released, table

HIDDEN = 8
WINDOW = 64
BATCH = 2048
PER_LANG = 600
WINDOWS_PER_TEXT = 4
SAMPLE_CHARS = 72
STEPS = 500
MINIBATCH = 256
UNKNOWN = "und"

_WORDLIKE = re.compile(r"[^\W\d_]")
_ASCII_LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


@dataclass
class BiGRU:
    """Weights for both directions: inputs (2, 3H, 256), recurrent (2, 3H, H), outputs (K, 2H), bias (K,)."""

    langs: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.recurrent.shape[2]


def has_letter(text: str) -> bool:
    """Whether a character of the categories L* occurs; number forms such as a half or a circled one are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def letter_bytes(text: str) -> np.ndarray:
    """For each UTF-8 byte of a text, whether it is part of a letter."""
    if text.isascii():
        return _ASCII_LETTERS[np.frombuffer(text.encode(), np.uint8)]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    seen, place = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in seen.tolist()])
    width = 1 + (seen > 0x7F) + (seen > 0x7FF) + (seen > 0xFFFF)
    return np.repeat(letter[place], width[place])


def initial(langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> BiGRU:
    rng = np.random.default_rng(seed)
    k = len(langs)
    return BiGRU(
        langs,
        rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32),
        rng.normal(0, 0.3, (k, 2 * hidden)).astype(np.float32),
        np.zeros(k, np.float32),
    )


def _scan(m: BiGRU, d: int, steps: list[np.ndarray], keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, N); ``steps[t]`` holds the bytes of the windows still running, a prefix of N."""
    h = m.hidden
    # the gates' slope and offset go into the weights
    inputs, recurrent = m.inputs[d].copy(), m.recurrent[d].copy()
    inputs[: 2 * h] = 0.2 * inputs[: 2 * h] + 0.5
    recurrent[: 2 * h] *= 0.2
    states = np.zeros((len(steps), h, len(steps[0])), np.float32)
    now = np.zeros((h, len(steps[0])), np.float32)
    for t, x in enumerate(steps):
        n = len(x)
        now = now[:, :n] if now.shape[1] != n else now
        fed = inputs.take(x, axis=1)
        back = recurrent @ now
        gates = fed[: 2 * h]
        gates += back[: 2 * h]
        if keep is not None:
            inside = (gates > 0) & (gates < 1)
        np.clip(gates, 0, 1, out=gates)
        cand = back[2 * h :] * gates[h:]
        cand += fed[2 * h :]
        np.tanh(cand, out=cand)
        if keep is not None:
            keep.append((x, now, inside, gates, back[2 * h :], cand))
        now = now - cand
        now *= gates[:h]
        now += cand
        states[t, :, :n] = now
    return states


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over axis 0, in place."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _steps(windows: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bytes step by step from the left and from the right; windows (N, T) stand in order of size, longest first."""
    running = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]
    ahead = np.ascontiguousarray(windows.T)
    rows = np.arange(len(windows))
    left = [ahead[t, :n] for t, n in enumerate(running)]
    right = [windows[rows[:n], sizes[:n] - 1 - t] for t, n in enumerate(running)]
    return left, right


def positions(m: BiGRU, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probabilities (T, K, N) of each position of each window; beyond a window's size they mean nothing."""
    left, right = _steps(windows, sizes)
    a, b = _scan(m, 0, left), _scan(m, 1, right)
    h, top = m.hidden, len(left)
    back = np.empty_like(b)
    if sizes[-1] == top:
        back = b[::-1]
    else:
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            s = slice(own[0], own[-1] + 1)
            back[:n, :, s] = b[:n, :, s][::-1]
            back[n:, :, s] = 0
    logits = m.outputs[:, :h] @ a
    logits += m.outputs[:, h:] @ back
    logits += m.bias[:, None]
    logits = np.moveaxis(logits, 1, 0)
    return np.moveaxis(_softmax(logits), 0, 1)


def _gradients(m: BiGRU, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of equally long windows, and its gradients by BPTT."""
    size = np.full(len(windows), windows.shape[1])
    seqs = _steps(windows, size)
    kept: list[list] = [[], []]
    a, b = (_scan(m, d, seqs[d], kept[d]) for d in (0, 1))
    h, (steps, _, n) = m.hidden, a.shape
    both = np.concatenate([a, b[::-1]], axis=1)
    p = np.moveaxis(_softmax(np.moveaxis(m.outputs @ both + m.bias[:, None], 1, 0)), 0, 1)
    loss = float(-np.log(p[:, labels, np.arange(n)] + 1e-9).mean())
    p = p.copy()
    p[:, labels, np.arange(n)] -= 1
    p /= steps * n
    g_out = np.einsum("tkn,thn->kh", p, both, optimize=True)
    g_bias = p.sum(axis=(0, 2))
    g_both = m.outputs.T @ p
    g_in, g_rec = np.zeros_like(m.inputs), np.zeros_like(m.recurrent)
    for d in (0, 1):
        into = g_both[:, :h] if d == 0 else g_both[::-1, h:]
        carry = np.zeros((h, n), np.float32)
        for t in range(steps - 1, -1, -1):
            x, before, inside, gates, back_n, cand = kept[d][t]
            z, r = gates[:h], gates[h:]
            dh = carry + into[t]
            d_cand = dh * (1 - z) * (1 - cand * cand)
            d_z = dh * (before - cand) * 0.2 * inside[:h]
            d_r = d_cand * back_n * 0.2 * inside[h:]
            d_fed = np.concatenate([d_z, d_r, d_cand])
            d_back = np.concatenate([d_z, d_r, d_cand * r])
            g_rec[d] += d_back @ before.T
            hot = np.zeros((n, 256), np.float32)
            hot[np.arange(n), x] = 1
            g_in[d] += d_fed @ hot
            carry = dh * z + m.recurrent[d].T @ d_back
    return loss, [g_in, g_rec, g_out, g_bias]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> BiGRU:
    """Adam on minibatches drawn evenly over the languages; windows (N, WINDOW) of bytes."""
    m, rng = initial(langs, hidden, seed), np.random.default_rng(seed + 1)
    weights = [m.inputs, m.recurrent, m.outputs, m.bias]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    by = [np.flatnonzero(labels == k) for k in range(len(langs))]
    each = max(1, MINIBATCH // len(langs))
    for s in range(1, steps + 1):
        take = np.concatenate([rng.choice(own, each) for own in by])
        _, grads = _gradients(m, windows[take], labels[take])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - 0.9 * s / steps)
        for w, g, u, v in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            w -= rate * (u / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.99**s)) + 1e-8)
    return m


def label_texts(m: BiGRU | None, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """Language and pooled probability of each whole text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    plain = {i: t.decode("utf-8", "replace") for i, t in enumerate(texts) if t and m is not None}
    use = [i for i, t in plain.items() if has_letter(t)]
    if not use:
        return out
    sums, counts = np.zeros((len(use), len(m.langs))), np.zeros(len(use))
    whole = [plain[i].encode() for i in use]  # damaged bytes stand as the replacement character
    flat = np.frombuffer(b"".join(whole), np.uint8)
    letters = np.concatenate([*(letter_bytes(plain[i]) for i in use), np.zeros(WINDOW, bool)])
    lens = np.array([len(t) for t in whole])
    n_win = -(-lens // WINDOW)
    owner = np.repeat(np.arange(len(use)), n_win)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    starts = np.repeat(np.cumsum(lens) - lens, n_win) + nth * WINDOW
    sizes = np.minimum(WINDOW, np.repeat(lens, n_win) - nth * WINDOW)
    order = np.argsort(-sizes, kind="stable")
    padded = np.concatenate([flat, np.zeros(WINDOW, np.uint8)])
    for at in range(0, len(order), BATCH):
        own = order[at : at + BATCH]
        size = sizes[own]
        at_bytes = starts[own][:, None] + np.arange(WINDOW)
        windows = padded[at_bytes]
        counted = (letters[at_bytes] & (np.arange(WINDOW) < size[:, None])).T.astype(np.float32)[: size[0]]
        pooled = np.einsum("tkn,tn->nk", positions(m, windows, size), counted)
        np.add.at(sums, owner[own], pooled)
        np.add.at(counts, owner[own], counted.sum(axis=0))
    probs = sums / np.maximum(counts, 1)[:, None]
    best = probs.argmax(axis=1)
    for j, i in enumerate(use):
        out[i] = (m.langs[best[j]], float(min(1.0, probs[j, best[j]])))
    return out


def _portions(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, list]]:
    """Texts a few megabytes at a time, with the index of the first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or b"")
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _predict(batches: Iterator[pa.RecordBatch], m: BiGRU | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for _, part in _portions(batch.column(batch.num_columns - 1)) for x in label_texts(m, part)]
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, hidden: int = HIDDEN, steps: int = STEPS) -> BiGRU | None:
    """Train on at most ``per_lang`` different texts of each language of ``docs``, chosen by a hash of the text."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    # different texts, so that many copies of a few do not keep the others out
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return None
    scale = 1 << 40
    rate = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, int(scale * min(1.0, 2.0 * per_lang / c)))])
    picked = rows.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(scale)) < rate[F.col("lang")])
    span = F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)
    pieces = F.array(*[F.substring("text", (1 + F.pmod(F.xxhash64("h", F.lit(i)), span)).cast("int"), F.lit(SAMPLE_CHARS)) for i in range(WINDOWS_PER_TEXT)])
    sample = picked.select("lang", "h", pieces.alias("pieces")).dropDuplicates(["lang", "h"]).collect()
    langs = sorted(counts)
    windows, labels, seen = [], [], dict.fromkeys(langs, 0)
    for r in sorted(sample, key=lambda r: (r.lang, r.h)):
        if seen[r.lang] >= per_lang:
            continue
        seen[r.lang] += 1
        for piece in dict.fromkeys(r.pieces or []):
            data = (piece or "").encode()
            if data and has_letter(piece):
                windows.append(np.resize(np.frombuffer(data, np.uint8), WINDOW))
                labels.append(langs.index(r.lang))
    known = sorted(set(labels))
    if not known:
        return None
    labels = np.array([known.index(k) for k in labels])
    return train(np.array(windows), labels, [langs[k] for k in known], hidden, steps if len(known) > 1 else 0)


def predict(docs: DataFrame, model: BiGRU | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``docs``' columns ``keep`` with ``lang_pred`` and ``score``."""
    ready(docs.sparkSession)
    fed = docs.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fed.schema.fields[:-1])
    return fed.mapInArrow(lambda it: released(_predict(it, model)), f"{kept}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    marked = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text", "lang")
    model = fit(marked.where(fold != 2))
    return predict(marked, model, ["doc_id", "held_out"])
