"""Operator 10 against a brute-force version."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quartzmill.llm import simhash_dedup as S
from quartzmill.llm.components import components
from quartzmill.llm.scratch import Room


def plain_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    fp = 0
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            fp |= 1 << b
    return fp


def plain(rows):
    fps = [(i, plain_fp(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(fps))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    out = S.simhash_components(df)
    return Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "é", "ÀB", "x\x0by", " ", "q", "\x1c"] + [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300]))] for _ in range(40)]
    rows = [(100 + i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(60):
        b = list(base[i % 40])
        b[rng.randrange(len(b))] = "changed"
        rows.append((1000 - i, "\t".join(b)))
    rows += [(5, None), (6, ""), (7, " \n"), (7, " \n"), (None, "lone null id"), (None, rows[3][1]), (8, "word " * 5000)]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == Counter()


@pytest.mark.parametrize(("segments", "radius"), [(2, 3), (3, 5), (4, 7)])
def test_planted_fingerprints_all_radii(spark, segments, radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 50, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for d in range(1, radius + 2):
            x = b
            for bit in rng.choice(64, d, replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    want = {(int(a), int(b)) for k, a in enumerate(fps) for b in fps[:k] if (int(a) ^ int(b)).bit_count() <= radius}
    df = spark.createDataFrame([(int(np.int64(np.uint64(f).astype(np.int64))),) for f in fps], "fp long")
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in S.links(df, Room(spark), radius, 4096, segments).collect()]
    assert all((max(g), min(g)) in want for g in got)
    assert parts(got, fps) == parts(want, fps)


def test_hot_buckets_are_indexed_again(spark):
    rng = np.random.default_rng(6)
    free = [int(b) for b in (1, 5, 9, 13, 20, 27, 31, 33, 40, 44, 51, 58)]
    fps = {sum(1 << b for b in free if rng.random() < 0.5) | 1 << 63 for _ in range(120)}
    fps = np.array(sorted(fps), np.uint64)
    want = {(int(a), int(b)) for k, a in enumerate(fps) for b in fps[:k] if (int(a) ^ int(b)).bit_count() <= 3}
    df = spark.createDataFrame([(int(np.int64(f.astype(np.int64))),) for f in fps], "fp long")
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in S.links(df, Room(spark), 3, 8).collect()]
    assert all((max(g), min(g)) in want for g in got) and parts(got, fps) == parts(want, fps)


def parts(pairs, nodes):
    root = {int(n): int(n) for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def test_hot_runs_across_batches():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 40, 3000))
    keys[500:2500] = keys[500]
    keys.sort()
    fps = np.arange(3000, dtype=np.int64) * 7919
    for step in (1, 7, 256, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(fps[i : i + step])], ["key", "fp"]) for i in range(0, 3000, step)]
        out = [r for b in S._links(iter(batches), 3, 100) for r in b.to_pylist()]
        hot = {k for k, c in Counter(keys.tolist()).items() if c > 100}
        assert sorted(r["a"] for r in out if r["b"] is None) == sorted(int(f) for k, f in zip(keys, fps, strict=True) if k in hot)


def test_blocks_do_not_change_fingerprints():
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(4000)).encode()
    assert S.fingerprint(text, block=100) == S.fingerprint(text)


def test_components_with_a_hub_and_a_path(spark):
    rng = random.Random(4)
    pairs = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(300)] + [(20_000 + rng.randrange(400), 20_000 + rng.randrange(400)) for _ in range(250)] + [(5, 5), (7, 0)]
    rng.shuffle(pairs)
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    with Room(spark) as room:
        got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), room).collect()}
        assert got == parts(pairs, nodes)
        assert components(spark.createDataFrame([], "a long, b long"), room).count() == 0


def test_components_keep_the_drivers_plans_few(spark):
    """The driver keeps all plans and tasks for a while: a round has few exchanges, and stars need no round."""
    from quartzmill.llm import components as C

    written = []

    class Counted(Room):
        def saved(self, df, name):
            written.append(df._jdf.queryExecution().sparkPlan().toString())
            return super().saved(df, name)

    stars = spark.createDataFrame([(9, 1), (8, 1), (7, 2), (2, 7), (5, 5)], "a long, b long")
    with Counted(spark) as room:
        got = {r.node: r.root for r in C.components(stars, room).collect()}
    assert got == {1: 1, 8: 1, 9: 1, 2: 2, 7: 2} and len(written) == 1
    down = spark.range(1, 40).selectExpr("id a", "id - 1 b")
    with Room(spark) as room:
        edges = room.saved(down, "edges")
        plan = C._small(C._large(edges))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hash") <= 13  # seven, with those that Spark writes once and reads again
        assert C.components(down, room).select("root").distinct().count() == 1
