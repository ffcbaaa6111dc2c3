"""Repair of the structure of conversations (operator 12).

A repaired conversation's role initials match ``(s?(ua)+)?``.  The automaton has four states (nothing
yet, after s, after u, after a), so each turn is a 4x4 matrix over (cost, audit) elements: keeping, reroling or
deleting the turn, after any number of inserted turns (the insert closure).  Sums are least elements, by cost and then
by audit in ASCII order; products add costs and join audits.  This is a semiring on audits of the same
turns: letters fix the cost, so of equal costs none is a proper prefix of another, and their order stays
whatever follows.  Matrices are therefore multiplied in any grouping: ``CHUNK`` turns in a task, then ``CHUNK`` products at a time, level by level,
until each conversation is one matrix, whose first row gives the cheapest audit.

Rows are range-sorted by conversation and turn, so a long conversation lies in many partitions, and a turn's place comes from the
counts of the partitions before.  Duplicates are found by the least place of each (conversation, role and text), aggregated.  The audit
goes back to the turns in blocks of ``CHUNK``.  The digest of a repaired conversation of more than one block passes its blocks
in order through one task that holds one at a time, as SHA-256 has no other way.

Costs: keep 0, rerole to user or assistant 2, delete 3, insert an empty turn of user or assistant 2; a truncated turn that stays adds 1; blank and duplicate turns must go.
Faults, the first that holds: blank (no character but white space), duplicate (role and text as an earlier turn of the conversation), truncated (the last
character that is not white space is not one of ``.!?``).

Defined cases: a null role or text is one space; a null conversation is one of its own; null turns come first and do
not count for gaps; rows of one turn are ordered by role, by the first 256 characters of the text and by a digest of both, so
repeated rows stand together; roles count by their first character; a conversation without rows has
zeros, an empty audit and the digest of nothing; an empty table gives no rows; texts of any length are kept
whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Room, ready, released, saved, table

CHUNK = 64
WHITE = r"\x20\x09-\x0D"

#: Prices of the edits.
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_INITIALS, _FAULTS = "sua?", ("fine", "blank", "duplicate", "truncated")
_LEGAL = {"su", "ua", "au"}
_START, _SYSTEM, _USER, _ASSISTANT = range(4)

Element = tuple[int, str] | None


def _times(a: tuple[Element, ...], b: tuple[Element, ...]) -> tuple[Element, ...]:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(a[i + k][0] + b[4 * k + j][0], k) for k in range(4) if a[i + k] and b[4 * k + j]]
            least = min(ways)[0] if ways else None
            out.append(min((least, a[i + k][1] + b[4 * k + j][1]) for cost, k in ways if cost == least) if ways else None)
    return tuple(out)


def _matrix(entries: dict[tuple[int, int], Element]) -> tuple[Element, ...]:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


ONE = _matrix({(i, i): (0, "") for i in range(4)})
_STEP = {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER, _USER: _ASSISTANT}
#: From any state, as many inserts as lead to user or to assistant at least; more would only return there.
CLOSURE = _matrix({(i, i): (0, "") for i in range(4)} | {(i, _STEP[i]): (INSERT, "I") for i in range(4)} | {(i, _ASSISTANT): (2 * INSERT, "II") for i in (_START, _SYSTEM)})


@lru_cache(maxsize=None)
def turn(kind: str) -> tuple[Element, ...]:
    """The matrix of one turn: inserts, then its own edit."""
    initial, fault = divmod(ord(kind) - 97, 4)
    entries: dict[tuple[int, int], Element] = {(i, i): (DELETE, "D") for i in range(4)}
    if _FAULTS[fault] not in ("blank", "duplicate"):
        more = TRUNCATED if _FAULTS[fault] == "truncated" else 0
        entries |= {(i, j): (RE_ROLE + more, "R") for i, j in _STEP.items()}
        if _INITIALS[initial] == "s":
            entries[_START, _SYSTEM] = (more, "K")
        kept = {"u": _USER, "a": _ASSISTANT}.get(_INITIALS[initial])
        entries |= {(i, j): (more, "K") for i, j in _STEP.items() if j == kept}
    return _times(CLOSURE, _matrix(entries))


def product(matrices: list) -> tuple[Element, ...]:
    """By halves, so that audits are joined a logarithmic number of times."""
    while len(matrices) > 1:
        matrices = [_times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else ONE


@lru_cache(maxsize=1 << 14)
def chunk(kinds: str) -> tuple[str, str, int, tuple[int, ...], tuple[Element, ...]]:
    """First and last initial, illegal neighbours, the faults' counts and the matrix of some turns."""
    initials = "".join(_INITIALS[(ord(k) - 97) // 4] for k in kinds)
    illegal = sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False))
    faults = [(ord(k) - 97) % 4 for k in kinds]
    return initials[0], initials[-1], illegal, tuple(faults.count(f) for f in (1, 2, 3)), product([turn(k) for k in kinds])


def joined(parts: list) -> tuple[str, str, int, tuple[int, ...], tuple[Element, ...]]:
    """The same of neighbouring parts in order."""
    between = sum(x[1] + y[0] not in _LEGAL for x, y in zip(parts, parts[1:], strict=False))
    counts = tuple(map(sum, zip(*(p[3] for p in parts), strict=True)))
    return parts[0][0], parts[-1][1], between + sum(p[2] for p in parts), counts, product([p[4] for p in parts])


def cheapest(matrix: tuple[Element, ...]) -> tuple[int, str]:
    """Inserts at the end, then the least element that ends legally: with nothing, or after an assistant."""
    last = _times(matrix, CLOSURE)
    return min(e for e in (last[_START], last[_ASSISTANT]) if e)


_ELEMENT = "first string, last string, illegal long, faults array<long>, cells array<struct<cost: long, audit: string>>"


def _row(part) -> dict:
    first, last, illegal, faults, cells = part
    return {"first": first, "last": last, "illegal": illegal, "faults": list(faults), "cells": [None if e is None else {"cost": e[0], "audit": e[1]} for e in cells]}


def _part(row: dict) -> tuple:
    return row["first"], row["last"], row["illegal"], tuple(row["faults"]), tuple(e and (e["cost"], e["audit"]) for e in row["cells"])


_KINDS = pa.schema([("key", pa.string()), ("c", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("faults", pa.list_(pa.int64())), ("cells", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c, kinds) -> elements."""
    for batch in batches:
        yield pa.RecordBatch.from_pylist([{"key": r["key"], "c": r["c"]} | _row(chunk(r["kinds"])) for r in batch.to_pylist()], _KINDS)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c, parts in order) -> elements."""
    for batch in batches:
        yield pa.RecordBatch.from_pylist([{"key": r["key"], "c": r["c"]} | _row(joined([_part(p) for p in r["parts"]])) for r in batch.to_pylist()], _KINDS)


_MARKS = pa.schema([("key", pa.string()), ("c", pa.int64()), ("blocks", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("faults", pa.list_(pa.int64())), ("marks", pa.list_(pa.struct([("edit", pa.string()), ("inserts", pa.int64()), ("before", pa.int64())]))), ("outputs", pa.int64()), ("tail", pa.int64())])
_MARKS_SQL = "key string, c long, blocks long, cost long, audit string, illegal long, faults array<long>, marks array<struct<edit: string, inserts: long, before: long>>, outputs long, tail long"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of whole conversations -> blocks of edits; the first block has the conversation's figures."""
    for batch in batches:
        for r in batch.to_pylist():
            first, last, illegal, faults, cells = _part(r)
            cost, audit = cheapest(cells)
            turns, outputs = len(audit) - audit.count("I"), len(audit) - audit.count("D")
            blocks, c, marks, inserts, made = -(-turns // CHUNK), 0, [], 0, 0
            for letter in audit:
                if letter == "I":
                    inserts += 1
                    continue
                marks.append({"edit": letter, "inserts": inserts, "before": made})
                made, inserts = made + inserts + (letter != "D"), 0
                if len(marks) == CHUNK or c == blocks - 1 and len(marks) == turns - c * CHUNK:
                    ends = c == blocks - 1
                    own = {"cost": cost, "audit": audit, "illegal": illegal, "faults": list(faults)} if c == 0 else {}
                    yield pa.RecordBatch.from_pylist([{"key": r["key"], "c": c, "blocks": blocks, "marks": marks, "outputs": outputs, "tail": len(audit) - len(audit.rstrip("I")) if ends else 0} | own], _MARKS)
                    c, marks = c + 1, []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) in order of key and place -> SHA-256 of each key's texts, newline-joined; one text at a time."""
    key, state, begun, done = None, None, False, []
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if state is None or k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state, begun = k, hashlib.sha256(), False
            if text.is_valid:
                state.update((b"\n" if begun else b"") + text.as_py().encode())
                begun = True
        if len(done) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "digest"])
            done = []
    if state is not None:
        done.append((key, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "digest"])


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(key, turn, role, text)`` with the damage of crc32(``key:turn``) % 20."""
    how = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    hit = rows.withColumn("how", how).where("how <> 0")
    return hit.select("key", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _sorted(rows: DataFrame, room: Room) -> DataFrame:
    """``rows(key, turn, role, text)`` with ``digest``, and ``seq`` in order of key and turn, rows of a partition numbered on."""
    own = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    own = own.withColumns({"by_role": F.substring("role", 1, 256), "by_text": F.substring("text", 1, 256), "nth": F.monotonically_increasing_id()})
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("by_role"), F.col("by_text"), F.col("digest"), F.col("nth")]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return room.saved(dealt.select("key", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("seq")), "rows")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows(key, seq, ...)`` with ``pos``, the place in the conversation from 0: a conversation's rows in earlier partitions, and in its own."""
    part = F.shiftright("seq", 33)
    spans = rows.groupBy("key", part.alias("part")).agg(F.min("seq").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    spans = spans.select("key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("move"))
    return rows.withColumn("part", part).join(spans, ["key", "part"]).withColumn("pos", F.col("seq") + F.col("move")).drop("part", "move")


def _kind() -> Column:
    """One letter for initial and fault; needs ``role``, ``text`` and ``again``."""
    initial = F.array_position(F.array(*[F.lit(x) for x in _INITIALS[:3]]), F.substring("role", 1, 1)).cast("int")
    fault = F.when(~F.col("text").rlike(f"[^{WHITE}]"), 1).when(F.col("again"), 2).when(~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"), 3).otherwise(0)
    return F.char(97 + F.when(initial == 0, 3).otherwise(initial - 1) * 4 + fault)


def _elements(placed: DataFrame, room: Room) -> DataFrame:
    """``placed(key, pos, kind)`` -> one element a conversation."""
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "")
    rows = placed.groupBy("key", F.expr(f"pos div {CHUNK}").alias("c")).agg(letters.alias("kinds"))
    found = room.saved(rows.mapInArrow(_chunks, f"key string, c long, {_ELEMENT}"), "elements")
    while (most := found.agg(F.max("c")).first()[0] or 0) > 0:
        own = F.struct("c", "first", "last", "illegal", "faults", "cells")
        up = F.expr(f"c div {CHUNK}") if most >= CHUNK else F.lit(0).cast("long")
        parts = found.groupBy("key", up.alias("up")).agg(F.sort_array(F.collect_list(own)).alias("parts")).withColumnRenamed("up", "c")
        found = room.saved(parts.mapInArrow(_together, f"key string, c long, {_ELEMENT}"), "elements")
    return found


def _made(count: Column, start: Column) -> Column:
    """Lines of ``count`` inserted turns, the first of them output number ``start`` + 1 of all."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(1).cast("long"), count), lambda x: F.concat(_name(start + x), F.lit(":")))).otherwise(F.array().cast("array<string>"))


def _name(nth: Column) -> Column:
    """The role of output number ``nth``, counted back from the assistant at the end."""
    return F.when((F.col("outputs") - nth) % 2 == 0, "assistant").otherwise("user")


def _repaired(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """``placed(key, pos, role, text)`` and their blocks of edits -> ``(key, c, blocks, repaired)``, each block's lines newline-joined, null without lines."""
    c = F.expr(f"pos div {CHUNK}")
    both = placed.withColumn("c", c).join(blocks.select("key", "c", "blocks", "marks", "outputs", "tail"), ["key", "c"])
    m = both.withColumn("m", F.element_at("marks", (F.col("pos") % CHUNK + 1).cast("int"))).drop("marks")
    after = F.col("m.before") + F.col("m.inserts")
    role = F.when(F.col("m.edit") == "K", F.col("role")).otherwise(_name(after + 1))
    own = F.when(F.col("m.edit") == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), F.col("text"))))
    lines = m.select("key", "c", "blocks", "pos", "outputs", "tail", F.concat(_made(F.col("m.inserts"), F.col("m.before")), own).alias("lines"))
    gathered = lines.groupBy("key", "c", "blocks", "outputs", "tail").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"])).alias("lines"))
    every = F.concat("lines", _made(F.col("tail"), F.col("outputs") - F.col("tail")))
    return gathered.select("key", "c", "blocks", F.when(F.size(every) > 0, F.array_join(every, "\n")).alias("repaired"))


def repair(rows: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation, and the
    repaired conversations as ``(conv_id, block, repaired)``: their ``role:text`` lines, ``CHUNK`` turns a block.

    With ``damage``, the rows are damaged first, as ``damaged`` says.
    """
    spark = rows.sparkSession
    ready(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    keyed = rows.select(F.col(conv_col).alias("conv_id"), space(conv_col).alias("key"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    names = keyed.select("conv_id", "key").distinct()
    own = keyed.drop("conv_id")
    with Room(spark) as room:
        ordered = _sorted(damaged(own) if damage else own, room)
        turns = ordered.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key")
        gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
        first = ordered.groupBy("key", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(False).alias("repeats"))
        kinds = ordered.join(first, "seq", "left").withColumn("again", F.coalesce("repeats", F.lit(True))).select("key", "seq", _kind().alias("kind"))
        elements = _elements(_placed(kinds), room)
        blocks = saved(elements.mapInArrow(lambda it: released(_solved(it)), _MARKS_SQL), "repairs")
        texts = saved(_repaired(_placed(ordered.select("key", "seq", "role", "text")), blocks), "repaired")
        gaps = saved(gaps, "gaps")
    short = texts.where("blocks = 1").select("key", F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("digest"))
    long = texts.where("blocks > 1").repartition("key").sortWithinPartitions("key", "c").select("key", "repaired")
    digests = short.unionByName(long.mapInArrow(lambda it: released(_digests(it)), "key string, digest string"))
    figures = blocks.where("c = 0").select("key", "cost", "audit", "illegal", "faults").join(gaps, "key").join(digests, "key")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    report = names.join(figures, "key", "left").select(
        "conv_id", count(F.col("gaps")).alias("gaps"), *[count(F.get("faults", i)).alias(f) for i, f in enumerate(_FAULTS[1:])],
        count(F.col("illegal")).alias("illegal"), count(F.col("cost")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
    return report, names.join(texts, "key").select("conv_id", F.col("c").alias("block"), "repaired")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=True)[0]


_ADD = lambda e, cost, letter: f"{{'c': {e}.c + {cost}, 'a': {e}.a || '{letter}'}}"
_FAR = "{'c': 1000000000::BIGINT, 'a': ''}"


def _edits(state: str, before: tuple[str, ...], initial: str) -> str:
    stay = [f"CASE WHEN x.i = '{initial}' THEN {_ADD(b, 'x.t', 'K')} ELSE {_ADD(b, f'{RE_ROLE} + x.t', 'R')} END" for b in before]
    return f"CASE WHEN x.gone THEN {_ADD(state, DELETE, 'D')} ELSE least({_ADD(state, DELETE, 'D')}, {', '.join(stay)}) END"


SQL = f"""
WITH RECURSIVE table_of AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS key,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT raw.*, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) % 20 AS how FROM raw, table_of),
rows_of AS (SELECT key, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hit, range(CASE WHEN how = 3 THEN 2 ELSE 1 END) WHERE how <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS i FROM rows_of),
faulty AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(i) OVER (PARTITION BY key ORDER BY pos) AS prev,
    row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS again FROM placed),
turns AS (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND cut THEN {TRUNCATED} ELSE 0 END::BIGINT AS t FROM faulty),
dp AS (
  SELECT DISTINCT key, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS e0, {_FAR} AS e1, {_FAR} AS e2, {_FAR} AS e3 FROM raw
  UNION ALL
  SELECT x.key, x.pos, {_ADD("e0", DELETE, "D")}, CASE WHEN NOT x.gone AND x.i = 's' THEN least({_ADD("e1", DELETE, "D")}, {_ADD("e0", "x.t", "K")}) ELSE {_ADD("e1", DELETE, "D")} END,
    {_edits("f2", ("e0", "e1", "f3"), "u")}, {_edits("f3", ("f2",), "a")}
  FROM (SELECT *, least(e3, {_ADD("f2", INSERT, "I")}) AS f3 FROM (SELECT *, least(e2, {_ADD("e0", INSERT, "I")}, {_ADD("e1", INSERT, "I")}, {_ADD("e3", INSERT, "I")}) AS f2 FROM dp)) d JOIN turns x ON x.key = d.key AND x.pos = d.pos + 1),
last AS (SELECT key, max(pos) AS pos FROM dp GROUP BY key),
ended AS (SELECT key, least(e0, e3, {_ADD("least(e2, " + _ADD("e0", INSERT, "I") + ", " + _ADD("e1", INSERT, "I") + ")", INSERT, "I")}) AS e FROM dp JOIN last USING (key, pos)),
solved AS (SELECT key, e.c AS cost, e.a AS audit, length(replace(e.a, 'D', '')) AS outputs, regexp_extract_all(e.a, 'I*[DKR]') AS edits, length(regexp_extract(e.a, 'I*$')) AS tail FROM ended),
edited AS (SELECT turns.*, outputs, edits[pos] AS edit, sum(length(replace(edits[pos], 'D', ''))) OVER (PARTITION BY key ORDER BY pos) AS made FROM turns JOIN solved USING (key)),
lines AS (
  SELECT key, made - CASE WHEN edit LIKE '%D' THEN 0 ELSE 1 END - (length(edit) - 1) + n + 1 AS nth, outputs, NULL AS line FROM edited, range(length(edit) - 1) r(n)
  UNION ALL SELECT key, made, outputs, CASE WHEN edit LIKE '%K' THEN role || ':' || text ELSE CASE WHEN (outputs - made) % 2 = 0 THEN 'assistant:' ELSE 'user:' END || text END FROM edited WHERE edit NOT LIKE '%D'
  UNION ALL SELECT key, outputs - n, outputs, NULL FROM solved, range(tail) r(n)),
texts AS (SELECT key, string_agg(coalesce(line, CASE WHEN (outputs - nth) % 2 = 0 THEN 'assistant:' ELSE 'user:' END), chr(10) ORDER BY nth) AS repaired FROM lines GROUP BY key),
counts AS (SELECT key, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, sum(t) AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY key)
SELECT DISTINCT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM raw JOIN solved USING (key) LEFT JOIN counts USING (key) LEFT JOIN texts USING (key)"""
