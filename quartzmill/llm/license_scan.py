"""Licence scan by a positional index of rare words (operator 9).

Templates are windows of public licence notices and their short titles; a
notice of many words is cut into windows of about ``WINDOW`` words, each a template of its own.
The ``ANCHORS`` rarest words of a template's mandatory phrases are its anchors,
rarity being the inverse document frequency of the template words over all files of the scan.  All anchors must
agree but for ``MISSING``, so one of the ``MISSING`` + 1 rarest must: only these are posted, with their
positions, and of a file's words only those are looked up, rarest first.  A word at position p posted for a template
at position q gives the start p - q; the other anchors are intersected there by relative position.  What
agrees is verified: every mandatory key phrase must stand in its place word for word, and the
agreeing words must carry ``AGREE`` of the template's weight.

The phrases of ``BASE`` are templates that are mandatory throughout, all of whose anchors must
agree, so every place where one stands is found by its rarest word.

Behind the words of ``TRIGGERS``, such as an SPDX line's, names of licences are read one after another, joined by and,
or, with; the longest name that fits counts, with "or later" or "only" behind it.

Defined cases: null counts as the empty text; no match gives zero places, null
first and last word, empty label strings and score 0; repeated rows and null ids
keep their rows; texts of any length are read whole, in blocks that overlap by the longest template;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ready, table
from .words import BLOCK_BYTES, alnum_blocks

ANCHORS = 3
MISSING = 1
AGREE = 0.8

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wordings of well-known public licence notices: label, text, mandatory key phrases.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["free of charge to any person obtaining a copy", "to deal in the software without restriction", "merge publish distribute sublicense and or sell"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "with or without modification"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted", "appear in all copies"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["terms of the gnu general public license", "either version 3 of the license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["terms of the gnu general public license", "either version 2 of the license"]),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 or at your option any later version", ["terms of the gnu general public license", "either version 3 or at your option"]),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 or at your option any later version", ["terms of the gnu general public license", "either version 2 or at your option"]),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["see the gnu general public license for more details"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["to any person or organization obtaining a copy", "covered by this license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable for any damages"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", ["creative commons attribution sharealike"]),
]

#: Short titles, mandatory throughout.
TITLES = {
    "apache license 2 0": "apache-2.0", "apache license version 2 0": "apache-2.0", "mit license": "mit", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "gnu gpl v3": "gpl-3.0", "gnu gpl v2": "gpl-2.0", "gplv3": "gpl-3.0", "gplv2": "gpl-2.0", "mozilla public license 2 0": "mpl-2.0", "boost software license": "boost",
}

#: Further titles and their labels.
TITLES |= {
    "artistic license 2 0": "artistic-2.0", "common development and distribution license": "cddl", "european union public licence": "eupl", "eclipse public license 2 0": "epl",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd", "creative commons attribution share alike": "cc-by-sa",
}
#: Families with versions; a title is family and version in any usual form.
FAMILIES = {"gpl": ("2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("3",)}
TITLES |= {
    form: "agpl" if f == "agpl" else "lgpl" if f == "lgpl" else f"gpl-{v[0]}.0"
    for f, versions in FAMILIES.items() for v in versions for form in (f"{f} v{v}", f"{f}v{v}", f"{f} version {v}", f"{f} {v}" if " " in v else f"{f} {v} 0")
}
TITLES |= {f"cc by {kind} {version} 0": f"cc-by-{kind.split()[0]}" for kind in ("sa", "nc", "nd", "nc sa", "nc nd") for version in "234"}
TITLES |= {f"{name} 1 {minor}": name for name in ("cddl", "eupl") for minor in "012"}

#: SPDX identifiers in words, and their labels.
SPDX = {
    "mit": "mit", "mit 0": "mit", "apache 2 0": "apache-2.0", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "isc": "isc", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0",
    "lgpl 2 0": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl", "epl 2 0": "epl", "cc by 3 0": "cc-by-3.0", "cc by 4 0": "cc-by-4.0",
    "cc by sa 3 0": "cc-by-sa", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nc sa 4 0": "cc-by-nc", "cc by nc nd 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd",
    "cc0 1 0": "cc0", "bsl 1 0": "boost", "zlib": "zlib", "unlicense": "unlicense", "artistic 2 0": "artistic-2.0", "cddl 1 0": "cddl", "cddl 1 1": "cddl", "eupl 1 1": "eupl", "eupl 1 2": "eupl",
}
#: What names of licences follow, the names' other forms, and the words a run of names may have.
TRIGGERS = ("spdx license identifier", "licensed under the", "licensed under", "license under the", "license under", "available under the")
NAMES = SPDX | {"apache license 2 0": "apache-2.0", "apache license version 2 0": "apache-2.0", "apache 2": "apache-2.0", "mit license": "mit", "bsd license": "bsd", "bsd": "bsd"} | {t: label for t, label in TITLES.items() if t.split()[0].rstrip("v23") in FAMILIES}
RUN = 40
WINDOW = 24


def windows(label: str, text: str, keys: list[str], size: int = WINDOW) -> list[tuple[str, str, list[str]]]:
    """A notice as templates of at most about ``size`` words; each mandatory phrase stays whole in one, a window without one is mandatory in its first five words."""
    words, out, at = text.split(), [], 0
    spans = []
    for key in keys:
        k = key.split()
        i = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        spans.append((i, i + len(k)))
    while at < len(words):
        end = len(words) if len(words) - at <= size + size // 3 else at + size
        end = max([end, *(e for s, e in spans if s < end < e)])
        own = [" ".join(words[s:e]) for s, e in spans if at <= s and e <= end]
        out.append((label, " ".join(words[at:end]), own or [" ".join(words[at : min(end, at + 5)])]))
        at = end
    return out


TEMPLATES = [w for n in NOTICES for w in windows(*n)] + [(label, t, [t]) for t, label in TITLES.items()]
_TRIGGERS = tuple(tuple(w.encode() for w in t.split()) for t in TRIGGERS)
_NAMES = sorted(((tuple(w.encode() for w in n.split()), label) for n, label in NAMES.items()), key=lambda x: -len(x[0]))

_MATCH = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("agreement", pa.float64())])
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, first_word: long, n_words: long, agreement: double>>"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    weights: tuple[float, ...]
    fixed: frozenset[int]  #: places of the key phrases' words
    anchors: tuple[int, ...]  #: places of the rarest of them, rarest first
    need: int  #: anchors that must agree
    base: bool


@dataclass(frozen=True)
class Index:
    templates: tuple[Template, ...]
    postings: dict[bytes, tuple[tuple[int, int], ...]]  #: word -> (template, place), of anchors of which one must agree
    idf: dict[bytes, float]
    longest: int
    named: int  #: the first of the names' templates


def vocabulary(base: dict[str, str] = BASE, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> list[bytes]:
    """All words of the templates."""
    return sorted({w.encode() for text in [*base, *(t for _, t, _ in templates)] for w in text.split()})


def build(counts: dict[bytes, int] | None = None, n: int = 0, base: dict[str, str] = BASE, templates: list[tuple[str, str, list[str]]] = TEMPLATES, anchors: int = ANCHORS) -> Index:
    """The index; ``counts`` says how many of ``n`` files hold a word."""
    rows = [(label, phrase.split(), [phrase.split()], True) for phrase, label in base.items()]
    rows += [(label, text.split(), [k.split() for k in keys], False) for label, text, keys in templates]
    idf = {w: math.log(1 + (n + 1) / ((counts or {}).get(w.encode(), 0) + 1)) for _, words, _, _ in rows for w in words}
    made, postings = [], {}
    for t, (label, words, keys, is_base) in enumerate(rows):
        fixed: set[int] = set()
        for key in keys:
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            fixed |= set(range(at, at + len(key)))
        # anchors stand in mandatory places, so that no accepted start lacks more than the votes allow
        rare = sorted(fixed, key=lambda i: (-idf[words[i]], i))[:anchors]
        need = len(rare) if is_base else max(1, len(rare) - MISSING)
        for i in rare[: len(rare) - need + 1]:
            postings.setdefault(words[i].encode(), []).append((t, i))
        made.append(Template(label, tuple(w.encode() for w in words), tuple(idf[w] for w in words), frozenset(fixed), tuple(rare), need, is_base))
    # names behind a trigger are templates without postings
    named = tuple(Template(label, words, (), frozenset(), (), 0, False) for words, label in _NAMES)
    return Index((*made, *named), {w: tuple(p) for w, p in postings.items()}, {w.encode(): v for w, v in idf.items()}, max(RUN, *(len(t.words) for t in made)), len(made))


def _present(batches: Iterator[pa.RecordBatch], known: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, files) over a batch; the empty word counts the files."""
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0):
            seen: set[bytes] = set()
            for _, words, _ in alnum_blocks(text.as_py() or b"", 0):
                seen |= known.intersection(words)
            found.update(seen)
        found[b""] = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "files"])


def corpus_index(docs: DataFrame, text_col: str = "text") -> Index:
    """The index with document frequencies over all rows of ``docs``; the driver gets a row a template word."""
    ready(docs.sparkSession)
    known = frozenset(vocabulary())
    sums = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(lambda it: _present(it, known), "word binary, files long").groupBy("word").agg(F.sum("files").alias("files"))
    counts = {bytes(r.word): r.files for r in sums.collect()}
    return build(counts, counts.pop(b"", 0))


def names_behind(index: Index, words: list[bytes], start: int) -> Iterator[tuple[int, int]]:
    """(template, start) of the names of licences that follow the trigger at ``start``, if one stands there."""
    trigger = next((t for t in _TRIGGERS if tuple(words[start : start + len(t)]) == t), None)
    if trigger is None:
        return
    at, end = start + len(trigger), min(len(words), start + RUN)
    while at < end:
        found = next((i for i, (name, _) in enumerate(_NAMES) if at + len(name) <= end and tuple(words[at : at + len(name)]) == name), None)
        if found is None:
            return
        yield index.named + found, at
        at += len(_NAMES[found][0])
        if words[at : at + 2] == [b"or", b"later"]:
            at += 2
        elif words[at : at + 1] == [b"only"]:
            at += 1
        if words[at : at + 1] == [b"with"]:  # an exception's name, up to the next join
            at = next((i for i in range(at + 1, end) if words[i] in (b"and", b"or")), end)
        if words[at : at + 1] not in ([b"and"], [b"or"]):
            return
        at += 1
        if words[at : at + 1] == [b"the"]:
            at += 1


def _places(index: Index, words: list[bytes]) -> Iterator[tuple[int, int, float, int]]:
    """(template, start, agreement, place that decides which block it belongs to)."""
    seen = [i for i, w in enumerate(words) if w in index.postings]
    tried = set()
    for p in sorted(seen, key=lambda i: (-index.idf[words[i]], i)):
        for t, q in index.postings[words[p]]:
            start, m = p - q, index.templates[t]
            if start < 0 or start + len(m.words) > len(words) or (t, start) in tried:
                continue
            tried.add((t, start))
            if sum(words[start + i] == m.words[i] for i in m.anchors) < m.need or any(words[start + i] != m.words[i] for i in m.fixed):
                continue
            agreement = sum(x for i, x in enumerate(m.weights) if words[start + i] == m.words[i]) / sum(m.weights)
            if agreement >= AGREE - 1e-12:
                yield t, start, min(1.0, agreement), start
    first = {t[0] for t in _TRIGGERS}
    given = set()
    for i, w in enumerate(words):
        if w in first:
            for t, start in names_behind(index, words, i):
                if (t, start) not in given:
                    given.add((t, start))
                    yield t, start, 1.0, i


def matches(index: Index, words: list[bytes]) -> list[tuple[int, int, float]]:
    """(template, start, agreement) of all accepted places in ``words``."""
    return sorted(((t, s, a) for t, s, a, _ in _places(index, words)), key=lambda f: (f[1], f[0]))


def scan(index: Index, data: bytes | None, block: int = BLOCK_BYTES) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words and all places, over the whole text in blocks."""
    n, found = 0, []
    for at, words, last in alnum_blocks(data or b"", index.longest - 1, block):
        n = at + len(words)
        own = n if last else n - index.longest + 1  # later starts belong to the next block
        found += sorted(((t, at + s, a) for t, s, a, place in _places(index, words) if at + place < own), key=lambda f: (f[1], f[0]))
    return n, found


def _rows(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1):
            n, found = scan(index, text.as_py())
            base = [(index.templates[t], s) for t, s, _ in found if index.templates[t].base]
            out.append({
                "n_words": n,
                "n_base": len(base),
                "first_word": min((s for _, s in base), default=None),
                "last_word": max((s for _, s in base), default=None),
                "base_labels": ",".join(sorted({m.label for m, _ in base})),
                "labels": ",".join(sorted({index.templates[t].label for t, _, _ in found})),
                "score": max((a for _, _, a in found), default=0.0),
                "matches": [{"label": index.templates[t].label, "first_word": s, "n_words": len(index.templates[t].words), "agreement": a} for t, s, a in found],
            })
        kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(_MATCH))]
        cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array([r[k] for r in out], kind) for k, kind in kinds]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], *(k for k, _ in kinds)])


def scan_licenses(docs: DataFrame, keep: list[str], text_col: str = "text", index: Index | None = None) -> DataFrame:
    """``docs``' columns ``keep`` with counts, labels, score and all matches."""
    ready(docs.sparkSession)
    index = index or corpus_index(docs, text_col)
    fed = docs.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fed.schema.fields[:-1])
    return fed.mapInArrow(lambda it: _rows(it, index), f"{kept}, {_SCHEMA}")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
