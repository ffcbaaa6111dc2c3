"""Operators 11 to 13 against brute force, on small tables with nulls, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quartzmill.llm import conversation_repair as C
from quartzmill.llm import lexical_search as L
from quartzmill.llm import queries as Q
from quartzmill.llm import token_binary as T

# -- ranked search -----------------------------------------------------------------

_TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")


def terms_of(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    counts = [Counter(terms_of(t)) for _, t in docs]
    known = [c for c in counts if c]
    n, total = len(known), sum(sum(c.values()) for c in known)
    df = Counter(t for c in known for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c in zip(docs, counts, strict=True):
            size = sum(c.values())
            score = 0
            for t in set(terms_of(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 90 + (90 * size * n) // total
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if gone else d, -s) for i, (s, gone, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join(rng.choice(["The", "a", "éé", "b1", "x-y"] + [f"w{i}" for i in range(40)]) for _ in range(n))


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, words(rng, rng.choice([1, 5, 40, 300]))) for i in range(150)]
    docs += [(None, docs[0][1]), (5, docs[5][1]), (5, docs[7][1]), (900, None), (901, ""), (902, "--- ..."), (903, "w1 " * 70_000), (-4, docs[3][1])]
    items = [(i, words(rng, rng.choice([1, 3, 20]))) for i in range(12)] + [(3, "w1 w2"), (None, "w3"), (50, None), (51, "absent"), (52, "?!")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, rank int, score int").repartition(3)
    q = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, query int")
    want = brute_search(docs, items)
    for how in ({}, {"block_items": 4, "shard_postings": 200}, {"block_bytes": 100, "shard_postings": 1}):
        got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in L.ranked_search(d, q, **how).collect()), key=repr)
        assert got == want
    assert L.ranked_search(d.limit(0), q).count() == 0 and L.ranked_search(d, q.limit(0)).count() == 0
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in L.ranked_search(d, q.where("item_id < 50"), k=3, item_col="item_id").collect()) == sorted(brute_search(docs, [x for x in items if x[0] is not None and x[0] < 50], 3))


def test_search_stops_by_bounds():
    rng = np.random.default_rng(1)
    docs, vocabulary = 20_000, 30
    held = rng.random((docs, vocabulary)) < np.linspace(0.01, 0.6, vocabulary)
    held[17] = True
    sizes, terms = held.sum(axis=1), np.nonzero(held)[1]
    tf, n = rng.integers(1, 4, len(terms)), rng.integers(5, 400, docs)
    n[17] = 40
    weights = np.array([L.weight(docs, int(x)) for x in held.sum(axis=0)])
    shard = L.Shard(sizes, n, terms, tf, docs, int(n.sum()))
    exact = np.zeros(docs, np.int64)
    np.add.at(exact, np.repeat(np.arange(docs), sizes), weights[terms] * L.impacts(tf, np.repeat(n, sizes), docs, int(n.sum())))
    for k in (1, 10):
        shard.added = 0
        found, score = shard.top(np.arange(vocabulary), weights, k)
        assert (score == exact[found]).all()
        best = np.lexsort((np.arange(docs), -exact))[:k]
        assert set(best) <= set(found)
        assert k > 1 or shard.added < len(terms) / 2
    found, _ = shard.top(np.arange(vocabulary), weights, 10, int(exact.max()))
    assert 17 in found or exact.argmax() in found


# -- conversations ---------------------------------------------------------------------

_LEGAL = re.compile(r"(s?(ua)+)?\Z")
_WS = " \t\n\v\f\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(_WS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return out


def prices(rows, audit_roles):
    """All edits of short conversations: (cost, audit, lines)."""
    faults = faults_of(rows)
    gaps = [[""], ["u", "a"], ["uu", "ua", "au", "aa"]]
    inserts = [x for g in gaps for x in g]
    edits = []
    for (role, text), fault in zip(rows, faults, strict=True):
        late = fault == "truncated"
        own = [(3, "D", None, None)]
        if fault not in ("blank", "duplicate"):
            own += [(late, "K", role[:1], f"{role}:{text}"), (2 + late, "R", "u", f"user:{text}"), (2 + late, "R", "a", f"assistant:{text}")]
        edits.append(own)
    names = {"u": "user:", "a": "assistant:"}
    for parts in itertools.product(*[x for e in edits for x in (inserts, e)], inserts):
        cost, audit, initials, lines = 0, "", [], []
        for p in parts:
            if isinstance(p, str):
                cost, audit = cost + 2 * len(p), audit + "I" * len(p)
                initials += p
                lines += [names[x] for x in p]
            else:
                cost, audit = cost + p[0], audit + p[1]
                if p[2] is not None:
                    initials.append(p[2] or "?")
                    lines.append(p[3])
        if _LEGAL.match("".join(initials)):
            yield cost, audit, "\n".join(lines)


def sequential(rows):
    """Forward dynamic program, for long conversations."""
    best = {0: (0, "", ())}
    step = {0: 2, 1: 2, 3: 2, 2: 3}

    def offer(table, state, cost, audit, lines):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, lines)

    def inserted(table):
        for _ in range(3):
            for s, (c, a, ls) in list(table.items()):
                offer(table, step[s], c + 2, a + "I", (ls, "user:" if step[s] == 2 else "assistant:"))
        return table

    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        new, late = {}, fault == "truncated"
        for s, (c, a, ls) in inserted(best).items():
            offer(new, s, c + 3, a + "D", ls)
            if fault in ("fine", "truncated"):
                offer(new, step[s], c + 2 + late, a + "R", (ls, ("user:" if step[s] == 2 else "assistant:") + text))
                kept = 1 if role[:1] == "s" and s == 0 else step[s] if role[:1] == "?ssua"[step[s] + 1] else None
                if kept is not None:
                    offer(new, kept, c + late, a + "K", (ls, f"{role}:{text}"))
        best = new
    cost, audit, chain = min((v for s, v in inserted(best).items() if s in (0, 3)), key=lambda v: v[:2])
    lines = []
    while chain:
        chain, line = chain
        lines.append(line)
    return cost, audit, "\n".join(reversed(lines))


def expected(rows, turns, solve):
    f = faults_of(rows)
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, text = solve(rows)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def reported(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_against_all_edits(spark):
    rng = random.Random(4)
    convs = {}
    for c in range(40):
        n = rng.randint(1, 3)
        convs[c] = [(i * rng.choice([1, 2]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No!", "cut", " \n", "Why? \t", f"t{i}."])) for i in range(n)]
        convs[c].sort(key=lambda r: r[0])
    rows = [(c, *r, "x") for c, own in convs.items() for r in own]
    got = reported(C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string").repartition(5))[0])
    for c, own in convs.items():
        own = sorted(own)
        pairs = [r[1:] for r in own]
        brute = min(prices(pairs, None), key=lambda v: v[:2])
        assert brute == sequential(pairs)
        assert got[c] == expected(pairs, [r[0] for r in own], lambda p: min(prices(p, None), key=lambda v: v[:2])), (c, own)


def test_long_conversation_across_partitions(spark):
    rng = random.Random(5)
    own = [(t // 3 if t > 30 else None, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"t{t}.", f"u{t}", ""])) for t in range(5000)]
    rows = [(7, *r) for r in own] + [(8, 1, "user", "A."), (8, 2, "assistant", "B."), (None, 1, None, None), (None, None, "user", "C.")] + [(9, 1, "user", "same.")] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    report, texts = C.repair(df)
    got = reported(report)
    order = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert got[7] == expected([r[1:] for r in order], [r[0] for r in order], sequential)
    assert got[8] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:A.\nassistant:B.").hexdigest())
    assert got[9] == expected([("user", "same.")] * 300, [1] * 300, sequential)
    assert got[None] == expected([("user", "C."), (" ", " ")], [None, 1], sequential)
    blocks = texts.where("conv_id = 7").orderBy("block").collect()
    assert len(blocks) == -(-5000 // C.CHUNK)
    assert hashlib.sha256("\n".join(b.repaired for b in blocks if b.repaired is not None).encode()).hexdigest() == got[7][-1]


def test_matrices_are_associative_and_damage_is_counted(spark):
    rng = random.Random(6)
    kinds = "".join(chr(97 + rng.randrange(16)) for _ in range(200))
    whole = C.chunk(kinds)
    for cut in (1, 63, 64, 150):
        assert C.joined([C.chunk(kinds[:cut]), C.chunk(kinds[cut:])]) == whole
    assert C.CLOSURE == C._times(C.CLOSURE, C.CLOSURE)
    gone = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    df = spark.createDataFrame([(c, 0, "user", "A.") for c in gone], "conv_id long, turn long, role string, text string")
    assert reported(C.repair(df, damage=True)[0]) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone}
    assert C.repair(df.limit(0), damage=True)[0].count() == 0


@pytest.mark.parametrize("name,table", [("op11_lexical_search", ("documents", "benchmark")), ("op12_conversation_repair", ("conversations",))])
def test_query_against_sql(spark, sf_dir, name, table):
    con = duckdb.connect()
    for t in table:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(Q.SQL[name])
    columns = [d[0] for d in want.description]
    got = Q.QUERIES[name](spark, sf_dir)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall())) != []


# -- token files ----------------------------------------------------------------------------


def plain_unpack(word_list, per, total):
    """The format read word by word."""
    out, at = [], 0
    for b, n in enumerate(per):
        end, own, size = at + n, [], min(T.BLOCK, total - b * T.BLOCK)
        while at < end:
            s = int(word_list[at]) >> 60
            if s == 0:
                own.append(int(word_list[at + 1]))
                at += 2
                continue
            width = int(T.WIDTHS[s])
            own += [(int(word_list[at]) >> (i * width)) & ((1 << width) - 1) for i in range(int(T.COUNTS[s]))]
            at += 1
        out += own[:size]
    return out


@pytest.mark.parametrize("n", [0, 1, 59, 119, 120, 121, 4095, 4096, 4097, 9000])
def test_simple_8b(n):
    rng = np.random.default_rng(n)
    wide = (2.0 ** rng.integers(0, 63, n)).astype(np.uint64)
    wide[::7] = np.uint64(2**64 - 1)
    runs = np.where(np.arange(n) % 500 < 400, 0, rng.integers(0, 1 << 59, n))
    for values in (rng.integers(0, 2, n), rng.integers(0, 49408, n), np.zeros(n), runs, wide, np.full(n, 1 << 60)):
        values = np.asarray(values).astype(np.uint64)
        packed, per = T.pack(values)
        assert per.sum() == len(packed)
        assert (T.unpack(packed, per, n) == values).all() and plain_unpack(packed, per, n) == values.tolist()
    keys = np.array([0, -1, 5, 2**63 - 1, -(2**63)])
    assert (T.unzigzag(T.zigzag(keys)) == keys).all()
    packed, per = T.pack(np.full(60_000, 30_000, np.uint64))
    assert len(packed) == 15_000 + len(per) - (60_000 // T.BLOCK) - (60_000 % T.BLOCK > 0)


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    own = Tokenizer.from_file(T.tokenizer_path())
    texts = ["", None, " ", "Hello  World's\n\tcafé Σίσυφος 123", "<|endoftext|> x<|startoftext|>y", "á b ́c", "x" * 200, "one\x1ctwo\x85three　four", "ends \n"]
    texts += [words(rng, rng.choice([1, 30, 400])) for _ in range(60)] + ["long word " * 150_000]
    docs = [(i * 3 - 40, t) for i, t in enumerate(texts)] + [(5, "twice"), (5, "twice"), (5, "thrice"), (None, "no id"), (-(2**63), "least"), (2**63 - 1, "most")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, key int").repartition(5)
    files = T.TokenFiles.write(df, T.tokenizer_path(), file_ids=700)
    rows = files.documents(with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    ids_of = {t: own.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs}
    assert sorted(((r.doc_id, tuple(r.ids)) for r in rows), key=repr) == sorted(((d, tuple(ids_of[t])) for d, t in docs), key=repr)
    at, last = 0, None
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        assert last is None or r.doc_id is not None and r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id
    assert files.manifest.count() > 3
    every = [i for r in rows for i in r.ids]
    for m in files.placed().collect():
        f = files.open(m.name)
        for start, stop in ((0, 0), (0, 1), (f.totals[0] // 2, f.totals[0]), (f.totals[0] - 1, f.totals[0])):
            assert f.ids(start, stop).tolist() == every[m.base + start : m.base + stop]
        with pytest.raises(IndexError):
            f.ids(0, f.totals[0] + 1)
    whole = T.TokenFiles.write(df, T.tokenizer_path(), by_word=False).documents()
    assert sorted(map(repr, (tuple(r)[:4] for r in rows))) == sorted(map(repr, (tuple(r) for r in whole.collect())))
    assert T.TokenFiles.write(df.limit(0), T.tokenizer_path()).documents().count() == 0


def test_token_query_against_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    own, at = Tokenizer.from_file(T.tokenizer_path()), 0
    rows = {r.doc_id: r for r in T.op13_token_binary(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for d, e in zip(docs, own.encode_batch([d.text or "" for d in docs], add_special_tokens=False), strict=True):
        ids = np.array(e.ids + [1], "<u4")
        assert tuple(rows.pop(d.doc_id)) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not rows
