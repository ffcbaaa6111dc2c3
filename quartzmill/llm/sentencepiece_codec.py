"""SentencePiece encoding and decoding on the tokenizers library (operator 5).

The model protobuf is read by a small wire-format parser; its normaliser
(character map, white-space rules, dummy prefix, metaspace marker), its unigram
scores or its scored merges, and its byte fallback are rebuilt as a
tokenizers pipeline, which encodes and decodes batches on several threads.
Where no piece holds a marker behind another character, no token can cross the
start of a word, so texts are first split there; tokens do not change.

``round_trip`` compares the decoded text with the normalised one.  ``verify`` holds ids and decoded texts against the sentencepiece library; the
model is accepted on the probes of ``PROBES``, and the tests compare whole tables.

Ids are the library's own; only unigram segmentations of exactly equal score may be broken another way, by
the order of rounding.

Defined cases: null and empty texts give no ids; the strings of control pieces
in a text are ordinary text; ``round_trip`` says whether decoding gives the text
back, the normaliser's own changes (a marker character in the text becomes a
space) apart; repeated rows and null ids keep their rows; texts of any length are
encoded whole, some ``PORTION`` characters of texts at a time; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ready, release, released, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
PORTION = 1 << 20
MARK = "▁"
MEMO, MEMO_CHARS, TOGETHER = 200_000, 64, 500

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

NEVER = "\uffff"
#: What the unigram library would take for a byte piece, though it is text.
_BYTE_TEXT = re.compile("<0x[0-9A-F]{2}>")
UNKNOWN_PENALTY = 10.0

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

PROBES = ["", " ", "a", " a  b ", "Hello world", "tabs\tand\nlines\r\n", "café üß 你好 \U0001f600", "<s></s><unk><0x0A>", "x" * 300, " " * 40 + "end", "a▁b ▁▁ c", "\x00\x01﻿​", "1234567890 3.14", "ẛ̣ ﬁ"]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("the model file ends within a number")
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        if wire not in (1, 2, 5):
            raise ValueError(f"wire type {wire} in a model file")
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        if at + size > len(data):
            raise ValueError("the model file ends within a field")
        yield key >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> Model:
    """Read a model file; fields that encoding does not need are skipped."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            m.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            m.kind, m.byte_fallback, m.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.trim, m.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    if m.suffix or not m.escape:
        raise ValueError("markers behind words and unescaped blanks are not supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best score first, then the longest left part."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-m.pieces[i][1], i, -cut, left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def tokenizer(m: Model):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == UNIGRAM:
        # control pieces and the unknown one are no text: behind a noncharacter, none can match them
        model = models.Unigram([(f"{NEVER}{p}" if kind in (UNKNOWN, CONTROL, UNUSED) else p, s) for p, s, kind in m.pieces], unknown, m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, merges(m), unk_token=None if unknown is None else m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t = Tokenizer(model)
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(_WORD.pattern), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    t.encode_special_tokens = True
    return t


def best_path(m: Model, normal: str) -> list[int]:
    """Ids of the best-scoring segmentation of a normalised text by unigram scores, one character at a time."""
    known = {p: (s, i) for i, (p, s, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    byte = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
    unknown = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
    lost = min(s for s, _ in known.values()) - UNKNOWN_PENALTY
    longest = max(map(len, known))
    best: list[tuple[float, int, int]] = [(0.0, 0, unknown)]  # score, start and id of the last piece
    for end in range(1, len(normal) + 1):
        found = (-float("inf"), 0, unknown)
        for start in range(max(0, end - longest), end):
            own = known.get(normal[start:end], (lost, unknown) if start == end - 1 else None)
            if own is not None and best[start][0] + own[0] > found[0]:
                found = (best[start][0] + own[0], start, own[1])
        best.append(found)
    ids, at = [], len(normal)
    while at:
        _, start, i = best[at]
        if i != unknown:
            ids.append(i)
        elif m.byte_fallback:
            ids += [byte[f"<0x{b:02X}>"] for b in reversed(normal[start:at].encode())]
        elif not ids or ids[-1] != unknown:  # unknown neighbours are one
            ids.append(unknown)
        at = start
    return ids[::-1]


def encoded(t, m: Model, texts: list[str]) -> list[list[int]]:
    """Ids of texts; ``t`` may be without a normaliser, if they are normalised."""
    ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if m.kind == UNIGRAM and m.byte_fallback:
        for i, x in enumerate(texts):
            if _BYTE_TEXT.search(x):
                ids[i] = best_path(m, t.normalizer.normalize_str(x) if t.normalizer is not None else x)
    return ids


def verify(t, m: Model, path: str, texts: list[str]) -> list[str]:
    """The texts on which ids or decoded texts differ from the sentencepiece library's."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = other.encode(texts, num_threads=1)
    own = encoded(t, m, texts)
    back = t.decode_batch(own, skip_special_tokens=False)
    return [x for x, a, b, c in zip(texts, ids, own, back, strict=True) if a != b or other.decode(a) != c]


def load(path: str = MODEL):
    """The verified tokenizer of a model file, and what was parsed of it."""
    with open(path, "rb") as f:
        m = parse(f.read())
    t = tokenizer(m)
    if wrong := verify(t, m, path, PROBES):
        raise ValueError(f"tokens differ from sentencepiece's on {wrong[:3]!r}")
    return t, m


_CODERS: dict[tuple[str, int], Encoder] = {}


def coder(path: str, threads: int) -> Encoder:
    """A worker's encoder of a model; it outlives the task, so a model is read and verified once a worker."""
    if (path, threads) not in _CODERS:
        _CODERS[path, threads] = Encoder(path, threads)
    return _CODERS[path, threads]


class Encoder:
    """Encodes and decodes lists of texts.

    Where words part exactly, each different word goes through the library once, and ids and decoded texts are joined from the words'; up to
    ``MEMO`` words of at most ``MEMO_CHARS`` characters are remembered.
    """

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read at the first batch
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.whole, self.model = load(path)
        #: whether the normaliser only adds the marker
        self.plain = not self.model.charsmap and not self.model.trim and self.model.dummy_prefix
        self.prefixed = self.model.dummy_prefix
        self.words = None
        if self.whole.pre_tokenizer is not None:
            # the normaliser is applied before the words are parted
            self.words = type(self.whole).from_str(self.whole.to_str())
            self.words.normalizer = None
            self.words.decoder = _pieces_decoder()
            self.words.encode_special_tokens = True
            self.begins = np.array([(self.words.id_to_token(i) or "").startswith(MARK) for i in range(self.words.get_vocab_size())])
        self.memo: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  #: words that decode to something else
        release()  # what parsing the model took

    def learn(self, words: list[str]) -> None:
        """Words with one marker, in front, go through the library ``TOGETHER`` to a text: markers part their ids again."""
        plain, other = [], []
        for w in words:
            (plain if w[0] == MARK and w.count(MARK) == 1 else other).append(w)
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        texts = ["".join(g) for g in groups]
        found = encoded(self.words, self.model, texts)
        back = self.words.decode_batch(found, skip_special_tokens=False)
        for group, text, ids, b in zip(groups, texts, found, back, strict=True):
            flat = np.array(ids, np.int32)
            starts = np.flatnonzero(self.begins[flat])
            if b != text or len(starts) != len(group):
                other += group
                continue
            data, ends = flat.tobytes(), np.append(starts[1:], len(flat)) * 4
            for w, s, e in zip(group, (starts * 4).tolist(), ends.tolist(), strict=True):
                self.memo[w] = data[s:e]
        found = encoded(self.words, self.model, other)
        for w, ids, b in zip(other, found, self.words.decode_batch(found, skip_special_tokens=False), strict=True):
            self.memo[w] = np.array(ids, np.int32).tobytes()
            if b != w:
                self.odd[w] = b

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[str]]:
        """Ids, whether they decode to the normalised text, and what they decode to."""
        normal = [_normal(self.whole, x, self.plain) for x in texts]
        if self.words is None:
            ids = encoded(self.whole, self.model, texts)
            back = self.whole.decode_batch(ids, skip_special_tokens=False)
            return [np.array(i, np.int32) for i in ids], [b == self.shown(n) for n, b in zip(normal, back, strict=True)], back
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.odd.clear()
        split = [_WORD.findall(n) for n in normal]
        new = {w for words in split for w in words if w not in self.memo}
        self.learn(sorted(new))
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32) for words in split]
        odd = self.odd
        back = ["".join([odd.get(w, w) for w in words] if odd else words) for words in split]
        same = [n == b for n, b in zip(normal, back, strict=True)]
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
                odd.pop(w, None)
        return out, same, [self.shown(b) for b in back]

    def shown(self, pieces: str) -> str:
        """Joined pieces as text: markers are blanks, the one in front goes if the normaliser put it there."""
        text = pieces.replace(MARK, " ")
        return text.removeprefix(" ") if self.prefixed else text


def _pieces_decoder():
    from tokenizers import decoders

    return decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])


def _encode(batches: Iterator[pa.RecordBatch], path: str, threads: int, decoded: bool) -> Iterator[pa.RecordBatch]:
    own = coder(path, threads)
    kind = pa.list_(pa.int32())
    for batch in batches:
        names, last = batch.schema.names[:-1], batch.num_columns - 1
        first, held, size = 0, [], 0
        for i, text in enumerate(batch.column(last)):
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size >= PORTION or i == batch.num_rows - 1:
                ids, same, back = own.encode(held)
                sizes = np.array([len(x) for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), type=kind)
                part = batch.slice(first, len(held))
                made = [pa.array(sizes), lists, pa.array(same), *([pa.array(back, pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(last)), *made], [*names, "n_tokens", "ids", "round_trip", "decoded"][: last + len(made)])
                first, held, size = i + 1, [], 0


def _normal(t, text: str, plain: bool) -> str:
    """What the normaliser makes of a text; nothing of an empty one."""
    if not text:
        return ""
    return MARK + text.replace(" ", MARK) if plain else t.normalizer.normalize_str(text)


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = MODEL, threads: int = THREADS, decoded: bool = False) -> DataFrame:
    """``docs``' columns ``keep`` with ``n_tokens``, ``ids``, ``round_trip`` and, if asked for, the ``decoded`` text."""
    ready(docs.sparkSession)
    fed = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fed.schema.fields[:-1])
    more = ", decoded string" if decoded else ""
    return fed.mapInArrow(lambda it: released(_encode(it, path, threads, decoded)), f"{kept}, n_tokens int, ids array<int>, round_trip boolean{more}")


def decode(tokens: DataFrame, keep: list[str], ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """``tokens``' columns ``keep`` with the decoded ``text``; null ids give a null text."""
    ready(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = coder(path, THREADS).whole
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            back = t.decode_batch([i or [] for i in ids], skip_special_tokens=False)
            text = pa.array([None if i is None else b for i, b in zip(ids, back, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), text], [*batch.schema.names[:-1], "text"])

    fed = tokens.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fed.schema.fields[:-1])
    return fed.mapInArrow(run, f"{kept}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"], decoded=True)
