"""The pipeline's stages against plain versions, and on odd rows."""

import random

import corpus_pipeline as P
from quartzmill.llm import near_copies as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_plainly(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingle_set(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r[0] is None, r[0] or 0))
    return sorted(min(g) for g in groups.values())


def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(200)]
        out.append((i, " ".join(base), "en", "s", 1))
        for c in range(i % 4):
            near = list(base)
            near[rng.randrange(200)] = "changed"
            out.append((1000 + 10 * i + c, "  ".join(near).upper(), "en", "s", 1))
    out += [(None, out[0][1], "en", "s", 1), (2000, None, None, None, None), (2001, "", "en", "s", 0), (5, out[8][1], "en", "s", 1), (2002, "a b", "en", "s", 3), (2003, "a  b", "en", "s", 4)]
    return out


def test_near_duplicates_against_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = kept_plainly(data)
    for group in (4096, 3):
        got = S.deduplicated(df, group=group)
        assert got.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    twice = S.deduplicated(df.union(df))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in twice.collect()) == want
    assert S.deduplicated(df.where("false")).count() == 0


def test_near_copies_of_all_kinds_against_all_pairs(spark):
    data, fresh = [], iter(range(10**6))
    for i in range(240):
        n, kind, below = (49, 94, 229)[i % 3], i // 3 % 4, i // 12 % 2  # at 0.8 or just above, or just below
        base, new = ([f"w{next(fresh)}" for _ in range(n)] for _ in range(2))
        sets = n - 4
        near = list(base)
        if kind == 0:
            near += new[: sets // 4 + below]
        elif kind == 1:
            near = near[: n - sets // 5 - below]
        elif kind == 2:
            most = sets // 9 - 4 + below
            near[10 : 10 + most] = new[:most]
        else:
            for at in range(5, 5 + 9 * (sets // 45 + below), 9):
                near[at] = new[at]
        data += [(2 * i, " ".join(base), "en", "s", 1), (2 * i + 1, " ".join(near), "en", "s", 1)]
    got = S.deduplicated(spark.createDataFrame(data, SCHEMA))
    assert sorted((False, r.doc_id) for r in got.collect()) == kept_plainly(data)


def families(count, size, core, tails, rng):
    """Texts of one template each, a fresh tail behind it: of similarity core / (core + both tails)."""
    fresh, out = iter(range(10**7)), []
    for f in range(count):
        base = [f"c{f}_{i}" for i in range(core + 4)]
        for _ in range(size):
            out.append((len(out), " ".join(base + [f"w{next(fresh)}" for _ in range(rng.choice(tails))]), "en", "s", 1))
    return out


def test_templates_against_all_pairs(spark, monkeypatch):
    rng = random.Random(13)
    data = families(8, 14, 156, [1, 5, 12, 19, 20, 21, 30, 45], rng)
    some = [t.split() for _, t, *_ in data]
    data += [(len(data) + i, " ".join(some[3 * i][:100] + some[3 * i + 40][:60]), "en", "s", 1) for i in range(20)]
    want = kept_plainly(data)
    df = spark.createDataFrame(data, SCHEMA)
    for rare, group in ((64, 4096), (2, 4096), (1, 3)):
        monkeypatch.setattr(S, "RARE", rare)
        assert sorted((False, r.doc_id) for r in S.deduplicated(df, group=group).collect()) == want


def test_texts_of_one_template_are_not_paired(spark, monkeypatch):
    dealt = []
    own = S.blocked
    monkeypatch.setattr(S, "blocked", lambda rows, group: dealt.append(rows.count()) or own(rows, group))
    met, pairs = [], S.rare_meetings
    monkeypatch.setattr(S, "rare_meetings", lambda rare, threshold: met.append(pairs(rare, threshold).count()) or pairs(rare, threshold))
    data = families(1, 300, 65, [12], random.Random(14))  # at 65 / 89 = 0.73
    assert S.deduplicated(spark.createDataFrame(data, SCHEMA)).count() == len(data)
    assert met == [0] and not dealt


def test_stages_on_odd_rows(spark, sf_dir):
    data = rows() + [(3000 + i, t, "en", None, None) for i, t in enumerate([None, "", "123 !!", "é" * 30, "x " * 4000])]
    docs = spark.createDataFrame([(*r, "clash", 1.0, []) for r in data], SCHEMA + ", lang_pred string, score double, matches array<int>")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() == len(data)


def test_run_keeps_clean_documents(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = P.run(spark, sf_dir).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) <= set(docs)
    assert all(r.round_trip for r in out) and len(ids) > 0.85 * len(docs)
    gone = [t for i, r in docs.items() if i not in set(ids) for t in [r.text]]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {docs[i].text for i in ids}
    assert not any(item in text for item in items for text in left)
    assert len(gone) == len(docs) - len(ids)


def test_near_copies_meet_by_simhash_too(spark):
    """Texts without a common key of the sketch are found by operator 10's index alone; what it links is verified."""
    import numpy as np

    from quartzmill.llm.scratch import Room

    sets = {1: range(100), 2: range(1, 100), 3: range(500, 600), 4: range(100)}
    prints = {1: 0b1111, 2: 0b1001, 3: 0b1011, 4: 0b1111}
    nodes = spark.createDataFrame([(t, [10 * t], prints[t]) for t in sets], "th long, keys array<long>, fp long")
    table = spark.createDataFrame([(t, bytearray(np.array(list(s), np.uint64).tobytes())) for t, s in sets.items()], "th long, shingles binary")
    with Room(spark) as room:
        got = S.near_classes(nodes, lambda wanted: table.join(wanted, "th"), room).collect()
    assert sorted((r.node, r.root) for r in got) == [(1, 1), (2, 1), (4, 1)]
