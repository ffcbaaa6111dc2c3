"""Operators 1-9 on odd rows and against plain versions."""

import datetime
import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from quartzmill.llm import cross_polytope, decontaminate, langid_bigru, license_scan, pii_pseudonyms, sentencepiece_codec, sharding, toxicity_segments, warc_index
from quartzmill.llm.words import alnum_blocks, word_blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, labels int"
ODD = [None, "", " \n", "\x00\x01", "12345 !!", "é" * 50, "word " * 3000, "same text here now ok", "same text here now ok"]


def odd_docs(spark, ids=True):
    return spark.createDataFrame([(i if ids and i != 5 else None, t, None if i % 2 else "en", None, None, "clash", 7) for i, t in enumerate(ODD)], DOCS)


# -- 1 WARC ----------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "x" * 1500 + "é", "y" * 1500
    rows = [(1, "http://a.com/x y", big), (2, "https://B.example.org:443/p?q#f", big), (3, None, other), (4, "not a url", "short"), (5, "http://a.com/z", "short"), (6, "http://[bad", None), (None, "http://a.com/n", big), (7, "http://c.com/", ""), (7, "http://c.com/", other), (7, "http://c.com/", other)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    archive = warc_index.Archive.write(df, block_lines=3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive.records().collect())
    largest = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            largest[p] = max(i, largest.get(p, i))
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = p in largest and largest[p] != i
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", largest[p] if revisit else None] += 1
    assert got == want
    found = list(archive.lookup("https://b.example.org/p?q"))
    assert [h["X-Page-ID"] for h, _ in found] == ["2"] and found[0][1] == big.encode()
    assert list(archive.lookup("http://nowhere.example/")) == []
    through = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive.find(df).collect())
    assert through == want
    asked = spark.createDataFrame([(None, "http://a.com/z"), (None, "http://a.com/z"), (None, "http://no.example/")], "page_id long, url string")
    one = archive.find(asked, payloads=True).collect()
    assert [(r.page_id, bytes(r.payload)) for r in one] == [(5, b"short")]
    assert warc_index.url_key("http://www.Example.com/a") == "com,example,www)/a"


def test_warc_bisection_reads_few_blocks(spark):
    rows = [(i, f"http://h{i % 50:02d}.example.com/{i:05d}", "x") for i in range(2000)] + [(5000 + i, "http://h07.example.com/hot", "y") for i in range(100)]
    archive = warc_index.Archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), block_lines=20)
    store, base = warc_index._opened(archive.folder)
    files = [warc_index.CaptureFile(store, base, *f[2:5]) for f in archive.files]
    firsts, lasts = [f[0] for f in archive.files], [f[1] for f in archive.files]

    def lines(url):
        key = warc_index.url_key(url)
        return [x for i in warc_index.holding(firsts, lasts, key) for x in files[i].find(key)]

    assert sum(len(f.blocks) for f in files) >= 105
    assert [x[1] for x in lines("http://h03.example.com/01003")] == ["1003"] and sum(f.reads for f in files) == 1
    assert sorted(int(x[1]) for x in lines("http://h07.example.com/hot")) == list(range(5000, 5100)) and sum(f.reads for f in files) <= 9
    assert archive.records().count() == 2100


def test_warc_large_payloads_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BATCH_BYTES", 5000)
    archive = warc_index.Archive.write(spark.createDataFrame([(i, "http://a.com/", chr(97 + i) * 4000) for i in range(9)], "page_id long, url string, html string"))
    store, base = warc_index._opened(archive.folder)
    lines = [x for f in archive.files for x in warc_index.CaptureFile(store, base, *f[2:5]).find("com,a)/")]
    assert [b.num_rows for b in warc_index._records(store, base, lines, True)] == [2, 2, 2, 2, 1]
    assert [b.num_rows for b in warc_index._records(store, base, lines, False)] == [9]


def test_warc_empty(spark):
    archive = warc_index.Archive.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archive.records().count() == 0


# -- 2 toxicity ------------------------------------------------------------------


def plain_segments(scores):
    """All maximal segments by recursion on the best one."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    return plain_segments(scores[:i]) + [(round(best, 9), i, j)] + [(s, a + j + 1, b + j + 1) for s, a, b in plain_segments(scores[j + 1 :])]


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(60):
        scores = [rng.choice([-1.0, -1.0, -1.0, rng.uniform(0.5, 4)]) for _ in range(rng.randrange(0, 30))]
        marks = [(i, s, 0, 0) for i, s in enumerate(scores) if s > 0]
        got = sum(s for s, _, _ in toxicity_segments.segments(marks, -1.0))
        want = plain_segments(scores)
        assert got == pytest.approx(sum(w[0] for w in want))
        assert max([s for s, _, _ in toxicity_segments.segments(marks, -1.0)], default=0) == pytest.approx(max([w[0] for w in want], default=0))


def test_segment_scan_is_linear():
    for gap in (1, 3, 50):
        for pattern in ([1.0], [1.0, 0.2], [3.0, 0.1, 0.1, 2.0]):
            marks = [(i * gap, pattern[i % len(pattern)], 0, 0) for i in range(100_000)]
            steps = [0]
            found = toxicity_segments.segments(marks, -0.3, steps)
            assert found and steps[0] <= 2 * len(marks)


def test_scores_against_plain_version():
    m = toxicity_segments.Segments(words={"bad": 2.0, "worse": 4.0}, prefixes={"hatef": 1.5}, drift=-0.05, log_k=-2.0, curve=(-3.0, 1.0, 0.5, -0.1), quick=frozenset({"bad", "wors", "hate"}))
    rng = random.Random(3)
    for _ in range(80):
        words = [rng.choice(["bad", "worse", "hatefully", "fine", "so", "9"]) for _ in range(rng.randrange(40))]
        text = rng.choice([" ", ", ", "\n"]).join(words)
        known = [w for w in words if w != "9"]
        scores = [2.0 if w == "bad" else 4.0 if w == "worse" else 1.5 if w == "hatefully" else -0.05 for w in known]
        n = max(1, len(known))
        found = [x[0] for x in plain_segments(scores)]
        p = [1 - np.exp(-np.exp(-2.0) * n * np.exp(-x)) for x in found]
        best = max([0.0, *(-np.log(max(x, 1e-300)) for x in p)])
        total = np.log1p(sum(max(0.0, x + 2.0 - np.log(n)) for x in found))
        want = 1 / (1 + np.exp(-(-3.0 + best + 0.5 * total - 0.1 * np.log(n))))
        got = toxicity_segments.probability(m, toxicity_segments.statistics(m, text)[0])
        assert got == pytest.approx(want, abs=1e-6)


def test_toxicity_learns_and_bears_odd_rows(spark):
    rng = random.Random(2)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[20:22] = ["nastyword", "badthing"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model, share = toxicity_segments.fit(docs.where("doc_id < 300"), marks.where("doc_id < 300 or doc_id is null"))
    out = {r.doc_id: r for r in toxicity_segments.score(docs, model, share, ["doc_id"]).collect()}
    assert np.mean([(out[i].score >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) > 0.97
    p = out[300].passages[0]
    assert "nastyword" in rows[300][1][p.first : p.end]
    odd = toxicity_segments.score(odd_docs(spark), model, share, ["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    none, share = toxicity_segments.fit(docs.where("false"), marks.where("false"))
    assert none is None and {r.score for r in toxicity_segments.score(docs, none, share, ["doc_id"]).collect()} == {0.0}


def test_strongest_features_are_kept(spark):
    rows = [("same", 50, 50, 50, 50), ("toxic", 40, 1, 40, 1), ("clean", 1, 40, 1, 40), ("rare", 2, 0, 1, 0), ("none", 0, 3, 0, 3)]
    df = spark.createDataFrame(rows, "feature string, toxic0 long, clean0 long, toxic1 long, clean1 long")
    z = lambda r: abs(math.log((r[1] + r[3] + 0.5) / (200.5 - r[1] - r[3])) - math.log((r[2] + r[4] + 0.5) / (200.5 - r[2] - r[4]))) / math.sqrt(1 / (r[1] + r[3] + 0.5) + 1 / (r[2] + r[4] + 0.5))
    want = [r[0] for r in sorted(rows, key=lambda r: (-z(r), r[0]))]
    for most in (1, 3, 5, 9):
        assert {r.feature for r in toxicity_segments.strongest(df, (200, 200), most).collect()} == set(want[:most])


def test_toxicity_held_out(spark, sf_dir):
    import os

    folder = sf_dir if os.environ.get("TEST_SF_DIR") else "/root/testdata/sf0.1"
    out = toxicity_segments.op2_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.95


# -- 3 language --------------------------------------------------------------------


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    m = langid_bigru.initial(["a", "b"], hidden=3, seed=1)
    for name in ("inputs", "recurrent", "outputs", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    x, y = rng.integers(97, 101, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = langid_bigru._gradients(m, x, y)
    for w, g in zip((m.inputs, m.recurrent, m.outputs, m.bias), grads, strict=True):
        for at in np.argwhere(np.abs(g) > 1e-4)[:6]:
            at, step = tuple(at), 1e-3
            old = w[at]
            w[at] = old + step
            up, _ = langid_bigru._gradients(m, x, y)
            w[at] = old - step
            down, _ = langid_bigru._gradients(m, x, y)
            w[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_language_windows_cover_whole_text():
    m = langid_bigru.initial(["a", "b"], hidden=4)
    text = ("abc " * 100).encode()
    whole = langid_bigru.label_texts(m, [text, b"x" + text])
    alone = [langid_bigru.label_texts(m, [t])[0] for t in (text, b"x" + text)]
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-5) for a, b in zip(whole, alone, strict=True))


def plain_network(m, data):
    """Distribution over the languages at each byte, one step at a time."""
    h = m.hidden
    hard = lambda v: np.clip(0.2 * v + 0.5, 0, 1)
    states = []
    for d, seq in ((0, data), (1, data[::-1])):
        now, own = np.zeros(h), []
        for b in seq:
            x, u = m.inputs[d][:, b].astype(float), m.recurrent[d].astype(float)
            z, r = hard(x[:h] + u[:h] @ now), hard(x[h : 2 * h] + u[h : 2 * h] @ now)
            n = np.tanh(x[2 * h :] + r * (u[2 * h :] @ now))
            now = n + z * (now - n)
            own.append(now)
        states.append(own if d == 0 else own[::-1])
    out = []
    for a, b in zip(*states, strict=True):
        e = m.outputs.astype(float) @ np.concatenate([a, b]) + m.bias
        out.append(np.exp(e - e.max()) / np.exp(e - e.max()).sum())
    return np.array(out)


def test_labels_against_plain_network():
    m = langid_bigru.initial(["a", "b", "c"], hidden=5, seed=3)
    texts = ["plain words here", "é½a²x ①z", "x", "word " * 40 + "ends", "日本 \U0001f600 ok 12"]
    got = langid_bigru.label_texts(m, [t.encode() for t in texts])
    for text, (lang, score) in zip(texts, got, strict=True):
        data = text.encode()
        probs = np.concatenate([plain_network(m, data[i : i + langid_bigru.WINDOW]) for i in range(0, len(data), langid_bigru.WINDOW)])
        letter = np.array([c.isalpha() for c in text for _ in c.encode()])
        mean = probs[letter].mean(axis=0)
        assert lang == m.langs[mean.argmax()] and score == pytest.approx(mean.max(), abs=1e-4)
    for none in ("½ ²", "①② Ⅷ", "12 ٣", "!", "😀"):
        assert langid_bigru.label_texts(m, [none.encode()]) == [("und", 0.0)], none


def test_language_held_out_and_odd(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid_bigru.fit(docs.where("doc_id % 4 <> 2"), steps=250)
    out = langid_bigru.predict(docs.where("doc_id % 4 = 2"), model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    odd = langid_bigru.predict(odd_docs(spark), model, ["doc_id"]).collect()
    assert [r.lang_pred for r in odd[:5]] == ["und"] * 5 and odd[5].lang_pred != "und"
    assert langid_bigru.fit(docs.where("false")) is None
    assert {r.lang_pred for r in langid_bigru.predict(odd_docs(spark), None, ["doc_id"]).collect()} == {"und"}


# -- 4 PII -------------------------------------------------------------------------


KEY = "a key of the tests"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    n = 7 * 11
    df = spark.range(n).select(pii_pseudonyms.feistel(F.lit("k"), F.lit("t"), F.floor(F.col("id") / 11), F.col("id") % 11, F.lit(7), F.lit(11)).alias("o"))
    assert len({(r.o.x, r.o.y) for r in df.collect()}) == n
    every = spark.range(1000).select(pii_pseudonyms.digits(F.lit("k"), "t", F.lpad(F.col("id").cast("string"), 3, "0"), 10).alias("o"))
    assert len({r.o for r in every.collect()}) == 1000


def test_pseudonyms_keep_formats(spark):
    text = "a EL.0x@Mail.example.com b 4316522678525456 c 4316522678525457 d 4316-5226-7852-5456 e +1 (743) 555-3824 f 2020-02-29 g 2021-02-30 h 123-45-6789 i 000-12-3456 j 97.51.17.173. k 999.1.1.1 l " + "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, text), (2, "x " + text), (3, None), (4, ""), (5, "no data 12 @ 3")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, value string")
    out = {r.doc_id: r for r in pii_pseudonyms.pseudonymise(df, KEY, report=True).collect()}
    new = out[1].text
    assert len(new) == len(text) and out[2].text == "x " + new and out[3].text is None and out[4].text == "" and out[5].text == rows[4][1]
    for gone in ("EL.0x@", "4316522678525456", "4316-5226-7852-5456", "555-3824", "2020-02-29", "123-45-6789", "97.51.17.173", "24be6443"):
        assert gone not in new
    for kept in ("4316522678525457", "2021-02-30", "000-12-3456", "999.1.1.1", "@Mail.example.com"):
        assert kept in new
    card = re.search(r"b (\d{16})", new)[1]
    assert luhn(card) and re.search(r"d (\d{4}-\d{4}-\d{4}-\d{4})", new)[1].replace("-", "") == card
    assert out[1].n_values == 8 and out[1].value == "clash"
    assert pii_pseudonyms.pseudonymise(df.where("false"), KEY).count() == 0


def mod97(iban):
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def test_further_formats(spark):
    finds = ["31/12/1980", "+49 30 1234567", "+44 20 7946 0958", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "2001:db8:85a3::8a2e:370:7334", "FE80:0:0:0:202:B3FF:FE1E:8329", "12/31/1980"]
    stay = ["31/13/1980", "GB29 NWBK 6016 1331 9268 18", "12:34:56", "a::b", "+12", "std::vector"]
    rows = [(i, f"on {x} it") for i, x in enumerate(finds + stay)] + [(100 + i, f"Again: {x}, {x}") for i, x in enumerate(finds)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii_pseudonyms.pseudonymise(df, KEY).collect()}
    for i, x in enumerate(finds):
        new = out[i][3:-3]
        assert new != x and len(new) == len(x) and re.sub("[0-9A-Fa-f]", "0", new) == re.sub("[0-9A-Fa-f]", "0", x), (x, new)
        assert out[100 + i] == f"Again: {new}, {new}"
    for i, x in enumerate(stay, len(finds)):
        assert out[i] == f"on {x} it"
    assert mod97(out[3][3:-3]) == 1 == mod97(out[4][3:-3]) and out[3][3:5] == "GB" and "NWBK" in out[3]
    d, mth, _ = map(int, out[0][3:-3].split("/"))
    assert 1 <= mth <= 12 and 1 <= d <= 31
    other = {r.doc_id: r.text for r in pii_pseudonyms.pseudonymise(df, "another").collect()}
    assert other[1] != out[1]
    with pytest.raises(ValueError):
        pii_pseudonyms.pseudonymise(df, "")


def plain_round(key, tweak, i, value):
    return int(hashlib.sha256(f"{key}|{tweak}|{i}|{value}".encode()).hexdigest()[:15], 16)


def test_digits_against_plain_feistel(spark):
    from pyspark.sql import functions as F

    cases = ["7", "42", "00123", "9" * 24, "1234567890" * 3]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r.o for r in df.select(pii_pseudonyms.digits(F.lit(KEY), "t", F.col("s"), 10).alias("o")).collect()]
    for case, new in zip(cases, got, strict=True):
        want = ""
        for at in range(0, len(case), pii_pseudonyms.PIECE):
            p = case[at : at + pii_pseudonyms.PIECE]
            tweak = f"t:{len(case)}:{at // pii_pseudonyms.PIECE}"
            if len(p) == 1:
                want += str(sorted(range(10), key=lambda v: plain_round(KEY, tweak, 0, v))[int(p)])
                continue
            left = len(p) // 2
            x, y, rx, ry = int(p[:left]), int(p[left:]), 10**left, 10 ** (len(p) - left)
            for i in range(1, pii_pseudonyms.ROUNDS + 1):
                if i % 2:
                    x = (x + plain_round(KEY, tweak, i, y) % rx) % rx
                else:
                    y = (y + plain_round(KEY, tweak, i, x) % ry) % ry
            want += f"{x:0{left}d}{y:0{len(p) - left}d}"
        assert new == want


def plain_pair(tweak, x, y, rx, ry):
    for i in range(1, pii_pseudonyms.ROUNDS + 1):
        if i % 2:
            x = (x + plain_round(KEY, tweak, i, y) % rx) % rx
        else:
            y = (y + plain_round(KEY, tweak, i, x) % ry) % ry
    return x, y


def plain_digits(kind, s, base=10):
    out, alphabet = "", "0123456789abcdefghijklmnopqrstuvwxyz"
    for at in range(0, len(s), pii_pseudonyms.PIECE):
        p, tweak = s[at : at + pii_pseudonyms.PIECE], f"{kind}:{len(s)}:{at // pii_pseudonyms.PIECE}"
        if len(p) == 1:
            out += alphabet[sorted(range(base), key=lambda v: plain_round(KEY, tweak, 0, v))[int(p, base)]]
            continue
        left = len(p) // 2
        for v, n in zip(plain_pair(tweak, int(p[:left], base), int(p[left:], base), base**left, base ** (len(p) - left)), (left, len(p) - left), strict=True):
            text = ""
            for _ in range(n):
                v, d = divmod(v, base)
                text = alphabet[d] + text
            out += text
    return out


def refill(shape, letters, numbers):
    take = {"d": iter(numbers), "l": iter(letters)}
    new = [next(take["d"]) if c in string.digits else (next(take["l"]) if c in string.ascii_letters else c) for c in shape]
    return "".join(n.upper() if c in string.ascii_uppercase else n for c, n in zip(shape, new, strict=True))


def plain_date(m, form):
    try:
        day = datetime.datetime.strptime(m, form).date()
    except ValueError:
        return None
    if not 1600 <= day.year <= 9599:
        return None
    era, within = divmod((day - datetime.date(1600, 1, 1)).days, 189 * 773)
    x, y = plain_pair(f"date:{era}", *divmod(within, 773), 189, 773)
    new = datetime.date(1600, 1, 1) + datetime.timedelta(days=era * 189 * 773 + x * 773 + y)
    return form.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")


def plain_pseudonym(m):
    """One find, or None if it is not valid."""
    every = re.sub("[^0-9]", "", m)
    if "@" in m:
        name = m.partition("@")[0]
        letters = re.sub("[^a-z]", "", name.lower())
        coded = plain_digits("email", "".join("0123456789abcdefghijklmnop"[ord(c) - 97] for c in letters), 26)
        return refill(name, "".join(chr(97 + "0123456789abcdefghijklmnop".index(c)) for c in coded), plain_digits("email", re.sub("[^0-9]", "", name))) + m[len(name) :]
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", m, re.A):
        return plain_date(m, "%Y-%m-%d")
    if re.fullmatch("[0-9A-Fa-f]*:[0-9A-Fa-f:]+", m):
        groups = [g for g in m.split(":") if g]
        if not any(c.isdigit() for c in m) or not (len(groups) == 8 or "::" in m and len(groups) < 8):
            return None
        take = iter(plain_digits("ipv6", m.lower().replace(":", ""), 16))
        new = "".join(next(take) if c != ":" else c for c in m)
        return new if m == m.lower() else new.upper()
    if re.fullmatch(r"\d{2}/\d{2}/\d{4}", m, re.A):
        return plain_date(m, "%m/%d/%Y") or plain_date(m, "%d/%m/%Y")
    if re.fullmatch(r"\d{2}\.\d{2}\.\d{4}", m, re.A):
        return plain_date(m, "%d.%m.%Y")
    if re.fullmatch(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", m, re.A):
        country, area, exchange, line = every[:-10], int(every[-10:-7]), int(every[-7:-4]), int(every[-4:])
        if area < 200 or exchange < 200:
            return refill(m, "", country + plain_digits("phone", every[-10:]))
        x, y = plain_pair("nanp", (area - 200) * 800 + exchange - 200, line, 640_000, 10_000)
        return refill(m, "", f"{country}{x // 800 + 200:03d}{x % 800 + 200:03d}{y:04d}")
    if m.startswith("+"):
        head = 1 if every[0] in "17" else 2 if every[:2] in pii_pseudonyms.CALLING else 3
        return refill(m, "", every[:head] + plain_digits("phone", every[head:])) if 8 <= len(every) <= 15 else None
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9 ]+", m, re.A):
        flat = m.replace(" ", "")
        if not 15 <= len(flat) <= 34 or mod97(flat) != 1 or not 2 <= int(flat[2:4]) <= 98:
            return None
        account = flat[4:]
        new = refill(account, re.sub("[^a-z]", "", account.lower()), plain_digits("iban", re.sub("[^0-9]", "", account)))
        check = 98 - mod97(flat[:2] + "00" + new)
        take = iter(f"{flat[:2]}{check:02d}{new}")
        return "".join(next(take) if c != " " else c for c in m)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m, re.A):
        a, g, n = (int(v) for v in m.split("-"))
        if not 0 < a < 900 or a == 666 or not g or not n:
            return None
        x, y = plain_pair("ssn", a - 1 - (a > 666), (g - 1) * 9999 + n - 1, 898, 99 * 9999)
        return f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if re.fullmatch(r"\d{13,19}|\d{4}[ -].*", m, re.A):
        if not luhn(every):
            return None
        new = plain_digits("card", every[:-1])
        return refill(m, "", next(new + c for c in string.digits if luhn(new + c)))
    if "." in m:
        octets = m.split(".")
        if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
            return None
        low, many = [{1: 0, 2: 10, 3: 100}[len(o)] for o in octets], [{1: 10, 2: 90, 3: 156}[len(o)] for o in octets]
        a, b, c, d = (int(o) - lo for o, lo in zip(octets, low, strict=True))
        x, y = plain_pair("ipv4:" + "".join(str(len(o)) for o in octets), a * many[1] + b, c * many[3] + d, many[0] * many[1], many[2] * many[3])
        return ".".join(str(v + lo) for v, lo in zip((x // many[1], x % many[1], y // many[3], y % many[3]), low, strict=True))
    new = plain_digits("secret", m.lower(), 16)
    return new if m == m.lower() else new.upper()


def test_pseudonyms_against_a_plain_version(spark, sf_dir):
    rng = random.Random(17)
    made = ["+372 5551234", "+3725551234", "+7 495 123 4567", "+39 06 1234 5678", "(415) 830-1636", "415-830-1636", "+1 415 830 1636", "011-22-3333", "(115) 030-1636", "1.2.3.4", "10.200.3.255", "01.2.3.4", "jo.e1@x.org", "A_B@ex.co.uk", "666-11-2222"]
    made += [f"{rng.randint(1, 99):02d}/{rng.randint(1, 31):02d}/{rng.randint(1500, 9999)}" for _ in range(60)] + [f"{rng.randint(1, 31):02d}.{rng.randint(1, 12):02d}.{rng.randint(1590, 2100)}" for _ in range(30)]
    made += [f"{rng.randint(0, 999):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}" for _ in range(40)] + [".".join(str(rng.randint(0, 300)) for _ in range(4)) for _ in range(40)]
    made += ["".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19))) for _ in range(60)] + ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(32, 64))) for _ in range(10)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.union(spark.createDataFrame([(-i - 1, f"see {x}, and ({x})") for i, x in enumerate(made)], "doc_id long, text string"))
    finder, finds = re.compile(pii_pseudonyms.ANY, re.A), 0
    got = {r.doc_id: r.text for r in pii_pseudonyms.pseudonymise(rows, KEY).collect()}
    for r in rows.collect():
        want = finder.sub(lambda m: plain_pseudonym(m[0]) or m[0], r.text)
        finds += want != r.text
        assert got[r.doc_id] == want, (r.doc_id, r.text[:200])
    assert finds > 100


def test_equal_numbers_stay_linked_and_the_key_stays_out_of_plans(spark):
    forms = ["+372 5551234", "+3725551234", "+372-555-1234", "(415) 830-1636", "415 830 1636", "+1 415.830.1636"]
    df = spark.createDataFrame([(i, f"call {f} now") for i, f in enumerate(forms)], "doc_id long, text string")
    out = pii_pseudonyms.pseudonymise(df, KEY)
    new = [re.sub("[^0-9]", "", r.text) for r in out.orderBy("doc_id").collect()]
    assert new[0] == new[1] == new[2] and new[0].startswith("372") and new[3] == new[4] == new[5][1:]
    assert int(new[3][:3]) >= 200 and int(new[3][3:6]) >= 200
    shown = out._jdf.queryExecution().toString()
    assert KEY not in shown and "__key" in shown
    spark.conf.set(pii_pseudonyms.KEY_SETTING, KEY)
    try:
        assert KEY not in spark._jsparkSession.sessionState().conf().redactOptions(spark._jsparkSession.sessionState().conf().getAllConfs()).toString()
    finally:
        spark.conf.unset(pii_pseudonyms.KEY_SETTING)


# -- 5 SentencePiece ------------------------------------------------------------------


def test_sentencepiece_parity_on_whole_table(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in sentencepiece_codec.encode(docs, ["doc_id"]).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(sp.encode(t) == got[i].ids and got[i].n_tokens == len(got[i].ids) and got[i].round_trip for i, t in texts.items())
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, ["doc_id"]), ["doc_id"])
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_sentencepiece_odd_texts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng, parts = random.Random(4), [" ", "▁", "  ", "a", "é", "the", "\n", "😀", "<s>", " " * 17, "x" * 90]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + [" " * i + "a" for i in range(40)]
    ids, same, back = sentencepiece_codec.Encoder(sentencepiece_codec.MODEL).encode(cases)
    assert all(sp.encode(t) == i.tolist() for t, i in zip(cases, ids, strict=True)) and all(same)
    assert back == [sp.decode(i.tolist()) for i in ids]
    odd = sentencepiece_codec.encode(odd_docs(spark), ["doc_id"]).collect()
    assert odd[0].ids == [] and odd[1].ids == [] and all(r.round_trip for r in odd)
    with pytest.raises(ValueError):
        sentencepiece_codec.parse(b"\x0a\xff")


def field(number, wire, data):
    key = bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 127 | 128, number >> 4])
    return key + (bytes([len(data) & 127 | 128, len(data) >> 7]) + data if wire == 2 else data)


def test_unigram_scores_against_the_library(spark, tmp_path):
    """A unigram model file written by hand: no tokenizer is trained."""
    import struct

    import sentencepiece

    rng = random.Random(5)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    seen = {"▁"} | set("abcdefgh") | {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(300)}
    seen |= {"▁" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) for _ in range(200)}
    pieces += [(p, -rng.uniform(2, 12), 1) for p in sorted(seen)]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([kind]))) for p, s, kind in pieces)
    trainer = field(3, 0, b"\x01") + field(35, 0, b"\x01")
    normal = field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01")
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(body + field(2, 2, trainer) + field(3, 2, normal))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sentencepiece_codec.parse(open(path, "rb").read()).kind == sentencepiece_codec.UNIGRAM
    cases = ["", "abc", "é!", "<0x41>a <s></s> <unk>", "ab<0x0A>"] + ["".join(rng.choice("abcdefgh  é1") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    ids, same, back = sentencepiece_codec.Encoder(path).encode(cases)
    m = sentencepiece_codec.parse(open(path, "rb").read())
    equal = 0
    for text, i in zip(cases, ids, strict=True):
        want, plain = sp.encode(text), sentencepiece_codec.best_path(m, "▁" + text.replace(" ", "▁") if text else "")
        # segmentations of equal score may differ by the order of rounding
        for other in (want, plain):
            assert sp.decode(other) == text and sum(pieces[k][1] for k in other) == pytest.approx(sum(pieces[k][1] for k in i), abs=1e-4)
        equal += want == i.tolist()
    assert all(same) and equal >= 0.97 * len(cases)
    assert back == [sp.decode(i.tolist()) for i in ids]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, ["doc_id"], path=path), ["doc_id"], path=path)
    assert {r.doc_id: r.text for r in out.collect()} == dict(enumerate(cases))


# -- 6 sharding ----------------------------------------------------------------------


def plain_fill(names, m):
    offset = [sharding._number(f"offset:{n}") % m for n in names]
    skip = [sharding._number(f"skip:{n}") % (m - 1) + 1 for n in names]
    prefer = [[(o + j * s) % m for j in range(m)] for o, s in zip(offset, skip, strict=True)]
    table, nxt = [-1] * m, [0] * len(names)
    while -1 in table:
        for i in range(len(names)):
            while nxt[i] < m and table[prefer[i][nxt[i]]] >= 0:
                nxt[i] += 1
            if nxt[i] < m and -1 in table:
                table[prefer[i][nxt[i]]] = i
    return table


def test_table_fill():
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill(dict.fromkeys(names, 1), 211)
    assert table == plain_fill(names, 211)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.fill({n: int(n != "n3") for n in names}, 211)
    assert sum(a != b for a, b in zip(table, less, strict=True) if a != 3) < 40 and 3 not in less
    assert Counter(sharding.fill({"a": 3, "b": 1}, 211))[0] > 150
    with pytest.raises(ValueError):
        sharding.fill({"a": 1}, 210)


def test_sharding_odd_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    placed = sharding.place(odd_docs(spark), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    assert placed.count() == len(ODD)
    sharding.write_shards(placed, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(ODD)


# -- 7 decontamination -------------------------------------------------------------


def test_decontamination_against_all_windows(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 20, 33])))) for i in range(30)] + [(90, ""), (91, None), (92, "Only Four Words here")]
    docs = []
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 30, 120]))]
        if d % 2:
            piece = rng.choice(items[:30])[1].split()
            for _ in range(d % 5):
                piece[rng.randrange(len(piece))] = "zzz" if d % 3 else piece[0]
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece
        docs.append((d, ", ".join(words)))
    b = decontaminate.build([(i, t.encode()) for i, t in items if t])
    for _, text in docs:
        words = [w for _, part, _ in alnum_blocks(text.encode(), 0) for w in part]
        want = {}
        for i, t in items:
            own = (t or "").lower().encode().split()
            if not own:
                continue
            k, n = min(5, len(own)), min(len(own), len(words))
            sims = [decontaminate.similarity(decontaminate.multiset(words[s : s + n], k), decontaminate.multiset(own, k)) for s in range(len(words) - n + 1)]
            if max(sims, default=0) >= 0.8:
                want[i] = max(sims)
        got = {r["item_id"]: r["similarity"] for r in decontaminate.search(b, text.encode())}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)
    df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = decontaminate.contaminated(odd_docs(spark), df, ["doc_id", "labels"]).collect()
    assert len(out) == len(ODD) and not any(r.matches for r in out)
    assert decontaminate.contaminated(odd_docs(spark), df.where("false"), ["doc_id"]).count() == len(ODD)


def test_rarest_shingles_are_in_every_match(spark):
    rng = random.Random(23)
    common = [f"c{i}" for i in range(60)]
    items = [[rng.choice(["a", "bb", "ccc"]) + str(rng.randrange(400)) for _ in range(rng.choice([3, 30, 60]))] + common[: rng.choice([0, 20, 60])] for _ in range(60)]
    rows = []
    for i, words in enumerate(items):
        k, found, weight = decontaminate.item_shingles(" ".join(words).encode())
        assert sum(weight) == pytest.approx(sum(math.log(1 + len(" ".join(words[j : j + k]))) for j in range(len(words) - k + 1)))
        rows += [(i, 0, k, int(h), float(w)) for h, w in zip(found.view(np.int64), weight, strict=True)]
    df = spark.createDataFrame(rows, "item long, part int, k int, hash long, weight double")
    kept = {}
    for r in decontaminate.rarest_shingles(df, 0.8).collect():
        kept.setdefault(r.item, set()).add(r.hash)
    for i, words in enumerate(items):
        k, own = min(5, len(words)), decontaminate.multiset([w.encode() for w in words], min(5, len(words)))
        for _ in range(40):
            near = list(words)
            for _ in range(rng.randrange(1 + len(words) // 15)):
                near[rng.randrange(len(near))] = "new"
            if decontaminate.similarity(own, decontaminate.multiset([w.encode() for w in near], k)) >= 0.8:
                assert kept[i] & set(decontaminate.item_shingles(" ".join(near).encode())[1].view(np.int64).tolist())
    shared = set(decontaminate.item_shingles(" ".join(common).encode())[1].view(np.int64).tolist())
    assert any(not (kept[i] & shared) for i, words in enumerate(items) if words[-1] == "c59") and len(kept) == 60


def test_large_benchmarks_by_a_join_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 4, 9, 14, 25])))) for i in range(60)] + [(None, "an item without id but with many words"), (70, "")]
    docs = [(i, " ".join([*rng.choices(words, k=20), *(rng.choice(items)[1].split() if i % 2 else []), *rng.choices(words, k=5)])) for i in range(60)]
    docs += [(100, docs[1][1]), (101, None), (102, ""), (None, docs[3][1]), (103, "word " * 30000 + items[3][1])]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, mark string")
    b = spark.createDataFrame(items, "item_id long, text string")
    pick = lambda out: sorted(((r.doc_id is None, r.doc_id or 0, [(m.item_id, m.first_word, m.n_words, round(m.similarity, 9)) for m in r.matches]) for r in out.collect()), key=repr)
    near = pick(decontaminate.contaminated(d, b, ["doc_id", "mark"]))
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 7)
    assert pick(decontaminate.contaminated(d, b, ["doc_id", "mark"])) == near and sum(len(x[2]) for x in near) > 30


def test_recall_of_the_simhash_radius():
    """Of windows with a similarity of 0.8 or more, the share within the radius."""
    rng = random.Random(8)
    found = total = 0
    for _ in range(1500):
        n = rng.choice([12, 20, 33, 60])
        words = [f"w{rng.randrange(10**6)}".encode() for _ in range(n)]
        other = list(words)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(n)] = b"changed"
        if decontaminate.similarity(decontaminate.multiset(words, 5), decontaminate.multiset(other, 5)) < 0.8:
            continue
        fps = [decontaminate.window_simhashes(decontaminate.shingle_hashes(decontaminate.word_hashes(w), 5), decontaminate.shingle_weights(np.array([len(x) for x in w]), 5), n - 4)[0] for w in (words, other)]
        found += int(np.bitwise_count(fps[0] ^ fps[1])) <= decontaminate.RADIUS
        total += 1
    print("recall of the radius", found, total)
    assert total > 150 and found / total > 0.985


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 40, dtype=np.uint64)
    index = decontaminate.SizeIndex(items, items)
    index.post()
    queries = []
    for f in items:
        for d in (0, 5, 12, 20):
            x = int(f)
            for bit in rng.choice(64, d, replace=False):
                x ^= 1 << int(bit)
            queries.append(x)
    queries = np.array(queries, np.uint64)
    want = {(q, i) for q, x in enumerate(queries) for i, y in enumerate(items) if (int(x) ^ int(y)).bit_count() <= 20}
    assert set(index.near(queries, 20)) == want


# -- 8 neighbours ------------------------------------------------------------------


def test_neighbours_small_tables_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    bad = [(400, None), (420, [0.0] * 8), (440, [None] + [1.0] * 7), (460, [float("nan")] + [1.0] * 7), (480, [1.0] * 5), (None, [1.0] * 8), (500, [float("inf")] * 8), (520, [])]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows + bad], "vec_id long, embedding array<float>, score double")
    out = cross_polytope.nearest(df, df.vec_id % 20 == 0).collect()
    vecs = [(i, np.array(np.float32(v), np.float64)) for i, v in rows]
    hit = total = 0
    for q, v in vecs:
        if q % 20:
            continue
        want = sorted(((-float((v * w).sum()), i) for i, w in vecs if i != q))[:20]
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        hit += len({i for _, i in want} & {g[1] for g in got})
        total += 20
    assert hit / total >= 0.9 and {r.query_id for r in out} == {q for q, _ in rows if q % 20 == 0}
    few = cross_polytope.nearest(df.where("vec_id in (0, 1, 2)"), df.vec_id % 20 == 0).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert cross_polytope.nearest(df.where("false"), df.vec_id % 20 == 0).count() == 0


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = cross_polytope.nearest(df, df.vec_id % 20 == 0).collect()
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got, hit, n = {}, 0, 0
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -9
        hit += len(got[ids[k]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        n += 20
    assert hit / n >= 0.9


@pytest.mark.parametrize("kind", ["outlier", "lognormal", "two norms"])
def test_neighbours_recall_of_unequal_norms(spark, kind):
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "outlier":
        x[7] *= 5
    elif kind == "lognormal":
        x *= np.exp(rng.normal(0, 0.5, (n, 1)))
    else:
        x[n // 2 :] *= 1.5
        x[0], x[1] = 0.001 * x[0], 30 * x[1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, df.vec_id % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / n >= 0.9


def clustered(n, size, spread, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // size, 64))
    x = centres[np.arange(n) % len(centres)] + spread * rng.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_choice_of_axes_and_probes():
    """The nearer the neighbours, the smaller the share of vectors met; and it falls with the number of clusters."""
    met = []
    for x in (clustered(8000, 25, 0.15), clustered(8000, 25, 0.6), clustered(8000, 8000, 1.0)):
        q = x[::40]
        near = [x[np.argsort(-(x @ v))[1:21]] for v in q]
        depth, probes = cross_polytope.choice(q, near, x, 8)
        owned = [set() for _ in q]
        hit = np.zeros((len(q), 20), bool)
        for t in range(8):
            own, probed = cross_polytope.buckets(cross_polytope.padded(x), t, 1, depth)[:, 0], cross_polytope.buckets(cross_polytope.padded(q), t, probes, depth)
            for i in range(len(q)):
                owned[i] |= set(np.flatnonzero(np.isin(own, probed[i])).tolist())
                hit[i] |= np.isin(cross_polytope.buckets(cross_polytope.padded(near[i]), t, 1, depth)[:, 0], probed[i])
        assert hit.mean() >= cross_polytope.RECALL
        met.append((depth, sum(map(len, owned)) / len(q) / len(x)))
    assert met[0][0] == 2 and met[0][1] < 0.02 and met[0][1] < met[1][1] < met[2][1]


def test_pairs_of_axes_are_probed_nearest_first():
    x = cross_polytope.padded(np.random.default_rng(6).normal(size=(30, 16)))
    got = cross_polytope.buckets(x, 3, 40, 2)
    a, b = cross_polytope.rotated(x, 3), cross_polytope.rotated(x, 3 + cross_polytope.SECOND)
    signed = lambda y: np.stack([y, -y], axis=2).reshape(len(y), -1)
    sums = (signed(a)[:, :, None] + signed(b)[:, None, :]).reshape(len(x), -1)
    for i in range(len(x)):
        assert np.allclose(sums[i, got[i]], np.sort(sums[i])[::-1][:40]) and len(set(got[i].tolist())) == 40
    assert (cross_polytope.buckets(x, 3, 1, 2)[:, 0] == got[:, 0]).all()


def test_neighbours_of_clusters(spark):
    x = clustered(4000, 25, 0.15)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, df.vec_id % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / len(x) >= 0.95


# -- 9 licences --------------------------------------------------------------------


def test_license_places_against_regex(spark):
    rng = random.Random(8)
    parts = ["CC", "by", "BY", "general", "PUBLIC", "license", "all", "rights", "reserved", "é", "x", "mit", "under", "released", "the", "\x85"]
    texts = ODD + ["".join(rng.choice(parts) + rng.choice([" ", ".", "\n\n", "_"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    index = license_scan.build()
    for text in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(s, label) for phrase, label in license_scan.BASE.items() for s in range(len(words)) if words[s : s + len(phrase.split())] == phrase.split()]
        for block in (1 << 20, 16):
            n, found = license_scan.scan(index, None if text is None else text.encode(), block)
            base = [(s, index.templates[t].label) for t, s, _ in found if index.templates[t].base]
            assert n == len(words) and sorted(base) == sorted(places)
    out = license_scan.scan_licenses(odd_docs(spark), ["doc_id"]).collect()
    assert len(out) == len(ODD) and all(r.score == 0 and r.labels == "" and r.first_word is None for r in out)
    lines = ["x. Licensed under the Apache License, Version 2.0. This is CC BY-NC 4.0", "Apache License 2.0", "MIT License", "BSD 3-Clause", "SPDX-License-Identifier: MIT", "it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3 of the License, or"]
    out = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.labels for r in out] == ["apache-2.0,cc-by,cc-by-nc", "apache-2.0", "mit", "bsd-3-clause", "mit", "gpl,gpl-3.0"]
    assert [r.base_labels for r in out] == ["cc-by", "", "", "", "", "gpl"]
    assert license_scan.scan_licenses(odd_docs(spark).where("false"), ["doc_id"]).count() == 0


def test_license_labels_against_all_starts():
    rng = random.Random(9)
    templates = license_scan.TEMPLATES
    counts = {w: rng.randrange(40) for w in license_scan.vocabulary()}
    index = license_scan.build(counts, 50)
    for _ in range(150):
        text = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(templates)[1].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["x", "the", "license"])
            text += words + rng.choices(["foo", "license", "the", "public"], k=rng.randrange(6))
        own = [w.encode() for w in text]
        want = set()
        for t, m in enumerate(index.templates[: index.named]):
            for s in range(len(own) - len(m.words) + 1):
                same = [a == b for a, b in zip(own[s:], m.words, strict=False)]
                if all(same[i] for i in m.fixed) and sum(w for w, x in zip(m.weights, same, strict=True) if x) / sum(m.weights) >= license_scan.AGREE - 1e-12:
                    want.add((t, s))
        assert {(t, s) for t, s, _ in license_scan.scan(index, " ".join(text).encode(), 200)[1] if t < index.named} == want


def test_license_names_and_expressions():
    index = license_scan.build()
    lines = {
        "GNU LGPL v2.1": "lgpl", "GPL-3.0-or-later": "gpl-3.0", "Licensed under GPL v2 or later": "gpl-2.0", "Dual licensed under MIT and Apache 2.0": "apache-2.0,mit", "Artistic License 2.0": "artistic-2.0",
        "CDDL 1.0": "cddl", "EUPL 1.2": "eupl", "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc", "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2.0,mit", "CC BY-SA 3.0": "cc-by,cc-by-sa",
        "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2, or (at your option)\nany later version.": "gpl,gpl-2.0",
        "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause": "bsd-3-clause,gpl-2.0", "SPDX-License-Identifier: Foo": "", "SPDX License": "", "licensed under": "", "": "",
        "SPDX-License-Identifier: MIT OR": "mit", "licensed under the MIT license, or the BSD license": "bsd,mit",
    }
    for line, want in lines.items():
        for pad, block in (("", 1 << 20), ("word " * 30, 40), ("word " * 77, 100)):
            n, found = license_scan.scan(index, f"{pad}{line}".encode(), block)
            labels = ",".join(sorted({index.templates[t].label for t, _, _ in found}))
            assert labels == want, (line, labels)
            assert len(found) == len(set(found)) and all(s >= len(pad.split()) for _, s, _ in found)


def test_license_lookup_takes_only_rare_words():
    index = license_scan.build({w: 10 if len(w) < 5 else 1 for w in license_scan.vocabulary()}, 20)
    for t, m in enumerate(index.templates[: index.named]):
        own = [(w, q) for w, p in index.postings.items() for u, q in p if u == t]
        assert len(own) == len(m.anchors) - m.need + 1 and {q for _, q in own} == set(m.anchors[: len(own)])
        assert not m.base or len(own) == 1


# -- words -------------------------------------------------------------------------


def test_word_blocks_lose_nothing():
    rng = random.Random(9)
    data = " ".join("w" * rng.randrange(1, 9) + str(i) for i in range(500)).encode()
    got = []
    for words in word_blocks(data, 2, 50):
        got += words[2 if got else 0 :]
    assert got == data.split()
    got = []
    for at, words, _ in alnum_blocks(data, 3, 50):
        assert words[: len(got) - at] == got[at:]
        got += words[len(got) - at :]
    assert got == data.split()
