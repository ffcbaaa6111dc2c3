"""Token ids as Simple-8b files (operator 13).

A 64-bit word holds a selector in its upper 4 bits and ``COUNTS[s]`` values of ``WIDTHS[s]`` bits
below, the first value lowest.  Selector 1 is a run of 120 zeros.  Selector 0 is the escape: one
value of more than 60 bits follows as a raw word of its own.  The last word of a block may hold fewer values than
its selector allows; the rest is zero.  Values are packed greedily, as many a word as fit, in blocks
of ``BLOCK`` values; all blocks of a stretch are packed in step, a word of each at a time, and
unpacked together, a selector at a time.

File, little-endian: magic; words of the ids; for each of two more streams, the documents' lengths
and the zigzag differences of their keys, its words; for each of the three streams the offset of
each block in words, and the stream's end; a bit for each document, 1 where its key is null; a
footer of the counts, and the magic again.  So a reader takes any stretch of ids by the block directory alone.

Documents are range-sorted by key; each task of the sort encodes its own and writes files of about
``FILE_IDS`` ids, in order, through pyarrow's file systems below ``spark.checkpoint.dir``.  Names are new for
each attempt of a task, and the manifest names the files of tasks that ended only, so a lost
executor leaves at most files that nothing reads.  A file's first place in the whole sequence comes from the manifest, a row a file.

Texts are encoded by the tokenizers library, words at a time; each different word
is given to the library once a worker (no token or rule of its pre-tokeniser crosses a blank; a tokenizer
whose rules do is to be used with ``by_word=False``).

Defined cases: a null or empty text has the end id only; null keys sort first; rows of one key are
ordered by a hash of the text, then as they were read, and each keeps its row; texts of any length are encoded a
portion at a time and never held as a whole of ids; an empty table gives no files and no rows; other
columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import new_path, ready, released, saved, table

END = 1
BLOCK = 4096
STRETCH = 1 << 20
FILE_IDS = 64 << 20
PORTION = 1 << 20
MEMO, MEMO_CHARS, TOGETHER = 700_000, 48, 64

#: Values a word and bits a value, by selector.
COUNTS = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"QMS8B\x00\x00\x01"
_FOOTER = struct.Struct("<9Q8s")


_SMALL = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if values.max(initial=0) < len(_SMALL):
        return _SMALL[values]
    out = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        more = high > 0
        out[more] += step
        rest = np.where(more, high, rest)
    return out + (rest > 0)


def _choices(bits: np.ndarray) -> np.ndarray:
    """(blocks, BLOCK) bits, 255 beyond a block's end -> the selector with most values at each place."""
    n = bits.shape[1]
    ends = np.where(bits == 255, 0, bits)  # what lies beyond the end fits anything
    best = np.zeros(bits.shape, np.uint8)
    reach, widest = 1, ends.copy()
    found = np.zeros(bits.shape, bool)
    tables = {1: widest}
    for size in sorted(set(COUNTS[1:].tolist())):
        while reach < size:  # running maxima of windows of growing sizes
            step = min(reach, size - reach)
            moved = np.zeros_like(widest)
            moved[:, : n - step] = widest[:, step:]
            widest = np.maximum(widest, moved)
            reach += step
        tables[size] = widest
    for s in range(1, 16):
        fits = (tables[int(COUNTS[s])] <= WIDTHS[s]) & ~found
        if s == 1:  # a run is whole
            fits[:, max(0, n - 119) :] = False
            fits &= ~(np.concatenate([bits[:, 119:], np.full((len(bits), min(119, n)), 255, np.uint8)], axis=1)[:, :n] == 255)
        best[fits] = s
        found |= fits
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 values -> words, and each block's number of words."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid.reshape(-1)[: len(values)] = values
    bits = np.full((blocks, BLOCK), 255, np.uint8)
    bits.reshape(-1)[: len(values)] = _widths(values)
    chosen = _choices(bits)
    size = np.full(blocks, BLOCK)
    size[-1] = len(values) - BLOCK * (blocks - 1)
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        place = at[live]
        s = chosen[live, place]
        steps.append((live, place, s))
        at[live] = place + np.where(s == 0, 1, COUNTS[s])
        live = live[at[live] < size[live]]
    own = np.bincount(np.concatenate([r for r, _, _ in steps]), minlength=blocks)  # a block's words are its first steps
    begin = np.cumsum(own) - own
    source, which = np.empty(own.sum(), np.int64), np.empty(own.sum(), np.uint8)
    wide = BLOCK + 120  # what a last word takes beyond its block is zero
    for nth, (row, place, s) in enumerate(steps):
        source[begin[row] + nth], which[begin[row] + nth] = row * wide + place, s
    padded = np.zeros((blocks, wide), np.uint64)
    padded[:, :BLOCK] = grid
    padded = padded.reshape(-1)
    words = which.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        those = np.flatnonzero(which == s)
        first = source[those]
        for i in range(int(COUNTS[s]) if len(those) else 0):
            words[those] |= padded[first + i] << np.uint64(i * int(WIDTHS[s]))
    escapes = np.flatnonzero(which == 0)
    words = np.insert(words, escapes + 1, padded[source[escapes]])
    return words, own + np.bincount(source[escapes] // wide, minlength=blocks)


def unpack(words: np.ndarray, per: np.ndarray, total: int) -> np.ndarray:
    """Words of whole blocks, the blocks' numbers of words, and the number of values -> the values."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # a word after an escape is raw, whatever its upper bits are: escapes are settled from left to right in each run of zeros
    zero = np.flatnonzero(selectors == 0)
    last = -2
    for z in zero.tolist():
        if z - 1 == last:
            continue
        if z + 1 < len(words):
            raw[z + 1] = True
        last = z
    counts = np.where(raw, 1, COUNTS[selectors])
    # the last word of a block may be short
    ends = np.cumsum(per)
    sizes = np.full(len(per), BLOCK)
    if len(per):
        sizes[-1] = total - BLOCK * (len(per) - 1)
    starts = np.cumsum(counts) - counts
    before = np.concatenate([[0], np.cumsum(counts)])[ends - per] if len(per) else np.zeros(0, np.int64)
    block = np.repeat(np.arange(len(per)), per)
    places = starts - before[block] + block * BLOCK
    out = np.zeros(len(per) * BLOCK + 128, np.uint64)
    if raw.any():
        out[places[raw]] = words[raw]
    limit = block * BLOCK + sizes[block]
    for s in range(2, 16):
        own = np.flatnonzero((selectors == s) & ~raw)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for i in range(int(COUNTS[s]) if len(own) else 0):
            inside = own[places[own] + i < limit[own]] if i else own
            out[places[inside] + i] = (words[inside] >> np.uint64(i * int(WIDTHS[s]))) & mask
    return out[:total]


def zigzag(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return ((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).view(np.int64)


class _Stream:
    """Values that come in pieces, packed as soon as whole blocks are there."""

    def __init__(self):
        self.pieces, self.held, self.total, self.words, self.per = [], 0, 0, [], []

    def add(self, values: np.ndarray) -> None:
        self.pieces.append(values)
        self.held += len(values)
        self.total += len(values)

    def take(self, all_of_it: bool = False) -> bytes:
        """The words of all whole blocks, or of everything."""
        if not self.held or not all_of_it and self.held < BLOCK:
            return b""
        values = np.concatenate(self.pieces)
        cut = len(values) if all_of_it else len(values) // BLOCK * BLOCK
        words, per = pack(values[:cut])
        self.pieces, self.held = [values[cut:]], len(values) - cut
        self.per.append(per)
        return words.astype("<u8").tobytes()

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.concatenate(self.per or [np.zeros(0, np.int64)]))]).astype("<u8")


class FileWriter:
    """One file; ids go out as blocks fill."""

    def __init__(self, out):
        self.out, self.ids, self.lengths, self.keys, self.nulls = out, _Stream(), [], [], []
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        """Ids of the document that is being written."""
        self.ids.add(ids.astype(np.uint64))
        if self.ids.held >= STRETCH:
            self.out.write(self.ids.take())

    def end(self, key: int | None, length: int) -> None:
        self.lengths.append(length)
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        self.out.write(self.ids.take(True))
        streams = [self.ids, _Stream(), _Stream()]
        keys = np.array(self.keys, np.int64)
        streams[1].add(np.array(self.lengths, np.uint64))
        streams[2].add(zigzag(np.diff(keys, prepend=np.int64(0))))
        for s in streams[1:]:
            self.out.write(s.take(True))
        for s in streams:
            self.out.write(s.offsets().tobytes())
        self.out.write(np.packbits(np.array(self.nulls, bool), bitorder="little").tobytes())
        sizes = [x for s in streams for x in (s.total, len(s.offsets()) - 1, int(s.offsets()[-1]))]
        self.out.write(_FOOTER.pack(*sizes, MAGIC))
        self.out.close()
        return len(self.keys), self.ids.total


class FileReader:
    """Random access to a file's ids by the block directory."""

    def __init__(self, source, size: int):
        self.source = source
        *sizes, magic = _FOOTER.unpack(source.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a file of token ids, or a damaged one")
        self.totals, blocks, words = sizes[0::3], sizes[1::3], sizes[2::3]
        self.starts, self.offsets = [], []
        at = 8
        for n in words:
            self.starts.append(at)
            at += 8 * n
        for n in blocks:
            self.offsets.append(np.frombuffer(source.read_at(8 * (n + 1), at), "<u8").astype(np.int64))
            at += 8 * (n + 1)
        self.nulls = np.unpackbits(np.frombuffer(source.read_at((self.totals[1] + 7) // 8, at), np.uint8), bitorder="little")[: self.totals[1]].astype(bool)

    def values(self, stream: int, first: int, last: int) -> np.ndarray:
        """The values of blocks ``first`` to ``last``, the end excluded."""
        offsets = self.offsets[stream]
        data = self.source.read_at(8 * int(offsets[last] - offsets[first]), self.starts[stream] + 8 * int(offsets[first]))
        total = min(self.totals[stream], last * BLOCK) - first * BLOCK
        return unpack(np.frombuffer(data, "<u8").astype(np.uint64), np.diff(offsets[first : last + 1]), total)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, the end excluded; only their blocks are read."""
        if not 0 <= start <= stop <= self.totals[0]:
            raise IndexError(f"ids {start} to {stop} of {self.totals[0]}")
        first, last = start // BLOCK, -(-stop // BLOCK)
        return self.values(0, first, last)[start - first * BLOCK : stop - first * BLOCK] if stop > start else np.zeros(0, np.uint64)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Keys and lengths."""
        n = len(self.offsets[1]) - 1
        keys = np.cumsum(unzigzag(self.values(2, 0, n))) if n else np.zeros(0, np.int64)
        lengths = self.values(1, 0, n).astype(np.int64) if n else np.zeros(0, np.int64)
        return [None if gone else int(k) for k, gone in zip(keys, self.nulls, strict=True)], lengths


_BLANK = re.compile(r"[ \n\t\r]")
#: Blanks of ``str.split`` that are none to the tokenizer's rules.
_NO_BLANKS = "\x1c\x1d\x1e\x1f"
_MARKS = tuple(".,;:!?")


def portions(text: str, size: int = PORTION) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut at blanks."""
    start = 0
    while len(text) - start > size:
        found = _BLANK.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def pre_tokens(word: str) -> int:
    """Pre-tokens of a word of letters, or of letters and one mark; 0 where this does not tell."""
    body = word[:-1] if word[-1:] in _MARKS else word
    return (1 + (body is not word)) if unicodedata.normalize("NFC", body).lower().isalpha() else 0


class Encoder:
    """Ids of texts by a tokenizers file; little-endian 32-bit ids of each different word are kept.

    New words of letters go to the library some at a time, and their ids are parted where pre-tokens end, as the model's suffix shows.
    """

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.own, self.by_word, self.memo = Tokenizer.from_file(path), by_word, {}
        suffix = getattr(self.own.model, "end_of_word_suffix", None)
        counts = [len(self.own.pre_tokenizer.pre_tokenize_str(w)) for w in ("ab", "ab,", "\xe9.", "a b! c")] if suffix and self.own.pre_tokenizer else []
        self.ends = None
        if counts == [1, 2, 2, 4]:
            self.ends = np.zeros(self.own.get_vocab_size(), bool)
            self.ends[[i for t, i in self.own.get_vocab().items() if t.endswith(suffix)]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> dict[str, bytes]:
        sizes = {w: n for w in words if (n := pre_tokens(w))} if self.ends is not None else {}
        easy, out = list(sizes), {}
        groups = [easy[i : i + TOGETHER] for i in range(0, len(easy), TOGETHER)]
        for group, data in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            places = 4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)
            last = np.cumsum([sizes[w] for w in group]) - 1
            if len(places) == last[-1] + 1:  # else the rules part these words in another way: one by one
                cuts = [0, *places[last].tolist()]
                out.update((w, data[x:y]) for w, x, y in zip(group, cuts, cuts[1:], strict=False))
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, self._encoded(rest), strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encoded(texts)
        split = [t.split() if not any(map(t.__contains__, _NO_BLANKS)) else _BLANK.split(t) for t in texts]
        known = [list(map(self.memo.get, words)) for words in split]
        gaps = [[j for j, i in enumerate(ids) if i is None] if None in ids else () for ids in known]
        found = self.words(list({words[j] for words, places in zip(split, gaps, strict=True) for j in places}))
        for words, ids, places in zip(split, known, gaps, strict=True):
            for j in places:
                ids[j] = found[words[j]]
        out = [b"".join(ids) for ids in known]
        self.memo.update(itertools.islice(((w, i) for w, i in found.items() if len(w) <= MEMO_CHARS), max(0, MEMO - len(self.memo))))
        return out


@functools.cache
def encoder_of(path: str, by_word: bool) -> Encoder:
    """One a worker, so that its words serve all tasks."""
    return Encoder(path, by_word)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int, by_word: bool, file_ids: int) -> Iterator[pa.RecordBatch]:
    """(key, text) in order -> files; a row a file."""
    encoder, (store, base) = encoder_of(path, by_word), fs.FileSystem.from_uri(folder)
    part, attempt, last = TaskContext.get().partitionId(), uuid.uuid4().hex, np.array([end], np.uint32)
    found, now, name = [], None, ""

    def closed() -> None:
        found.append((part, len(found), name, *now.close()))

    for batch in batches:
        keys, texts = (c.to_pylist() for c in batch.columns)
        short = [t if t and len(t) <= PORTION else "" for t in texts]
        for key, text, data in zip(keys, texts, encoder.batch(short), strict=True):
            if now is None:
                name = f"{part:06d}-{len(found):06d}-{attempt}.s8b"
                now = FileWriter(store.open_output_stream(f"{base}/{name}", compression=None))
            length = 1
            for piece in [data] if not text or len(text) <= PORTION else (encoder.batch([p])[0] for p in portions(text)):
                ids = np.frombuffer(piece, "<u4")
                now.add(ids)
                length += len(ids)
            now.add(last)
            now.end(key, length)
            if now.ids.total >= file_ids:
                closed()
                now = None
    if now is not None:
        closed()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["part", "nth", "name", "documents", "ids"])


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(name, base) -> a row a document."""
    store, at = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            path = f"{at}/{name}"
            with store.open_input_file(path) as f:
                yield from _documents(FileReader(f, f.size()), base, with_ids)


def _documents(file: FileReader, base: int, with_ids: bool, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A stretch of blocks at a time: a document's checksum goes on from one stretch to the next."""
    keys, lengths = file.documents()
    ends = np.cumsum(lengths)
    sums, whole, d, crc, left = [], [], 0, 0, []
    blocks, step = len(file.offsets[0]) - 1, STRETCH // BLOCK
    first_out = 0

    def out(upto: int) -> pa.RecordBatch:
        columns = [pa.array(keys[first_out:upto], pa.int64()), pa.array(base + ends[first_out:upto] - lengths[first_out:upto]), pa.array(lengths[first_out:upto]), pa.array(sums, pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(whole, pa.list_(pa.int64()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    for b in range(0, blocks, step):
        ids = file.values(0, b, min(blocks, b + step)).astype("<u4")
        at, stop = b * BLOCK, b * BLOCK + len(ids)
        while d < len(ends) and at < stop:
            upto = min(stop, int(ends[d]))
            piece = ids[at - b * BLOCK : upto - b * BLOCK]
            crc = zlib.crc32(piece, crc)
            if with_ids:
                left.append(piece)
            at = upto
            if at == ends[d]:
                sums.append(crc)
                if with_ids:
                    whole.append(np.concatenate(left).astype(np.int64))
                d, crc, left = d + 1, 0, []
        if len(sums) >= most or with_ids and sums:
            yield out(d)
            sums, whole, first_out = [], [], d
    if sums:
        yield out(d)


class TokenFiles:
    """Files below a shared folder and their manifest ``(part, nth, name, documents, ids)``, a row a file."""

    def __init__(self, spark: SparkSession, folder: str, manifest: DataFrame):
        self.spark, self.folder, self.manifest = spark, folder, manifest

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True, file_ids: int = FILE_IDS) -> TokenFiles:
        spark = docs.sparkSession
        ready(spark)
        folder = new_path(spark, "tokens")
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
        rows = rows.withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})  # so that rows of one key are dealt out too
        order = [F.col("key").asc_nulls_first(), "h", "nth"]
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
        written = placed.mapInArrow(lambda it: released(_write(it, folder, tokenizer, end, by_word, file_ids)), "part long, nth long, name string, documents long, ids long")
        return cls(spark, folder, saved(written, "manifest"))

    def placed(self) -> DataFrame:
        """``(name, base)``: each file and the number of ids before it."""
        before = Window.partitionBy(F.lit(1)).orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
        return self.manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def documents(self, with_ids: bool = False) -> DataFrame:
        """``(doc_id, start, n_tokens, ids_crc32)``, and ``ids`` if asked for, read from the files."""
        files = max(1, self.manifest.count())
        folder = self.folder
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
        return self.placed().repartition(min(files, 10_000)).mapInArrow(lambda it: released(_read(it, folder, with_ids)), schema)

    def open(self, name: str) -> FileReader:
        store, base = fs.FileSystem.from_uri(self.folder)
        f = store.open_input_file(f"{base}/{name}")
        return FileReader(f, f.size())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_token_binary(spark: SparkSession, sf_dir: str, tokenizer: Callable[[], str] = tokenizer_path) -> DataFrame:
    return TokenFiles.write(table(spark, sf_dir, "documents"), tokenizer()).documents()
