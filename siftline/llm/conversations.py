"""Conversation repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``, found by A* on the edit lattice.

A node of the lattice is how many rows are done and what the grammar has read:
nothing, a system turn, a user turn or an assistant turn.  Keep, Rerole, Delete
and Insert lead on.  The heuristic is the sum, over the rows still to come, of
mandatory deletions and of the charge that a truncated row costs whatever is
done to it, so it is admissible and consistent, and a queue keyed by (cost plus
heuristic, audit) meets each node first by its cheapest edits, of these the
ASCII-least.

Rows are sorted over all tasks by conversation and turn, and read as segments of
at most ``SEGMENT`` rows.  A conversation within one segment is searched whole.
One that is longer, or lies across two tasks, has each segment searched from all
four states; its segments then join state by state, cheapest and ASCII-least
first, as equal costs in one state leave the same ways on.  So no task holds the
texts of more than a segment.  Joining holds the audits of a conversation's
segments, sixteen bytes a row at most, and the digest reads its texts as a
stream.

Defined results: a null role or text is one space, a null turn comes first and
counts for no gap, and rows of null conversation are one conversation.  Rows of
one turn stand in order of role and text.  A role with no first character reads
as nothing in the grammar.  Repeated rows are duplicates; an empty text is
blank; a text of any length is one row; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftline.operators.scratch import drop

from .common import materialise, sliced

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows, and bytes of text, of a segment.
SEGMENT, SEGMENT_BYTES = 512, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing read, a system turn, a user turn, an assistant turn; and what each initial leads to.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after the only role that Rerole and Insert can give.
GIVEN = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user."""
    c = F.col
    name = F.concat(F.coalesce(c("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(c("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(c("kind") == 1, "").when(c("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(c("text"))
    role = F.when(c("kind") == 4, "user").otherwise(c("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(c("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def search(codes: str, entry: int = 0, exits: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits of rows ``codes`` from the state ``entry`` to each state of ``exits``, or to whichever end of the grammar is cheapest.

    A code is the initial of a row's role, ``x`` for others and ``e`` for none,
    upper case if its text is truncated, or ``d`` if it must go.
    """
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if codes[i] == "d" else TRUNCATED if codes[i].isupper() else 0)
    queue, closed, out = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        g = f - ahead[i]
        if i == n:
            if not exits and state in (0, 3):
                return {state: (g, audit)}
            if state in exits:
                out[state] = (g, audit)
                if len(out) == len(exits):
                    return out
        follow = [(INSERT, "I", i, GIVEN[state])]
        if i < n:
            follow.append((DELETE, "D", i + 1, state))
            if codes[i] != "d":
                initial, charge = codes[i].lower(), TRUNCATED * codes[i].isupper()
                follow.append((REROLE + charge, "R", i + 1, GIVEN[state]))
                to = state if initial == "e" else STEP[state].get(initial)
                if to is not None:
                    follow.append((charge, "K", i + 1, to))
        for cost, edit, j, to in follow:
            if (j, to) not in closed:
                heapq.heappush(queue, (g + cost + ahead[j], audit + edit, j, to))
    return out


_short = lru_cache(200_000)(search)


def _search(codes: str, entry: int = 0, exits: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    return (_short if len(codes) <= 32 else search)(codes, entry, exits)


def applied(audit: str, entry: int, roles: list[str], codes: str, texts: list[str]) -> list[dict]:
    """The rows that the edits ``audit`` leave, each with its edit."""
    out, state, i = [], entry, 0
    for edit in audit:
        if edit == "K":
            initial = codes[i].lower()
            state = state if initial == "e" else STEP[state][initial]
            out.append({"edit": edit, "role": roles[i], "text": texts[i]})
        elif edit != "D":
            state = GIVEN[state]
            out.append({"edit": edit, "role": ROLE[state], "text": "" if edit == "I" else texts[i]})
        i += edit != "I"
    return out


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with ``initial`` and ``fault``: 0 none, 1 truncated, 2 duplicate, 3 blank."""
    c = F.col
    d = rows.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    d = materialise(d.withColumn("uid", F.monotonically_increasing_id()), "turns")
    first = d.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min(F.struct("turn", "uid")).alias("f")).select(c("f.uid").alias("uid"), F.lit(True).alias("first"))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", 3).when(c("first").isNull(), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).when(initial == "", "e").otherwise("x")
    return d.join(first, "uid", "left").select("conv_id", "turn", "role", "text", "uid", initial.alias("initial"), fault.alias("fault"))


_SEARCHED = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_SEGMENTS = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("conv_id", "seg")] + [T.StructField("open", T.BooleanType())] + [T.StructField(x, T.LongType()) for x in ("first_turn", "last_turn", "turns")]
    + [T.StructField(x, T.LongType()) for x in ("blank", "duplicate", "truncated", "illegal")] + [T.StructField("initials", T.StringType()), T.StructField("codes", T.StringType()), T.StructField("searched", _SEARCHED)]
    + [T.StructField(x, T.ArrayType(T.StringType())) for x in ("roles", "texts")]
)


def _segment(rows: list[tuple], seg: int, is_open: bool) -> dict:
    conv = rows[0][0]
    turns = [r[1] for r in rows if r[1] is not None]
    initials, faults = "".join(r[4] for r in rows), [r[5] for r in rows]
    codes = "".join("d" if f > 1 else x.upper() if f else x for x, f in zip(initials, faults))
    table = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in range(4 if is_open else 1) for x, (c, a) in _search(codes, e, (0, 1, 2, 3) if e == 0 and is_open else (e, 2, 3) if e == 1 else (2, 3) if e else ()).items()]
    return {
        "conv_id": conv, "seg": seg, "open": is_open, "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "blank": faults.count(3), "duplicate": faults.count(2), "truncated": faults.count(1),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "initials": initials, "codes": codes, "searched": table, "roles": [r[2] for r in rows], "texts": [r[3] for r in rows],
    }


def _segments(judged: DataFrame) -> DataFrame:
    """Rows, sorted over all tasks, as segments with what was searched in each."""
    schema = to_arrow_schema(_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, rows, size, out, held = TaskContext.get().partitionId() << 32, [], 0, [], 0
        conv: object = run  # none yet
        is_open = True

        def close() -> None:
            nonlocal seg, rows, size, held
            out.append(_segment(rows, seg, is_open))
            seg, rows, held, size = seg + 1, [], held + size, 0

        for b in sliced(batches):
            for row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if row[0] != conv:
                    if rows:
                        close()
                    is_open, conv = conv is run, row[0]  # the first conversation of a task may have begun before it
                rows.append(row)
                size += len(row[3])
                if len(rows) >= SEGMENT or size >= SEGMENT_BYTES:
                    is_open = True
                    close()
                if held >= SEGMENT_BYTES or len(out) >= 2_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
                    held = 0
        is_open = True  # the last one may go on in the next task
        if rows:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "uid"]
    dealt = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text", "initial", "fault").mapInArrow(run, _SEGMENTS)


class _Way:
    """A way through the segments of a conversation; the last part of its audit, and the way before."""

    __slots__ = ("before", "entry", "audit", "cost")

    def __init__(self, before: _Way | None, entry: int, audit: str, cost: int):
        self.before, self.entry, self.audit, self.cost = before, entry, audit, cost

    def less(self, other: _Way) -> bool:
        """By cost, then audit; both have passed the same segments."""
        if self.cost != other.cost:
            return self.cost < other.cost
        p, q, mine, its = self, other, [], []
        while p is not q and p is not None:
            mine.append(p.audit)
            its.append(q.audit)
            p, q = p.before, q.before
        return "".join(reversed(mine)) < "".join(reversed(its))


def _join(group: list[dict]) -> list[dict]:
    """The chosen entry and audit of each segment of one conversation, in order, with the conversation's counts."""
    best: dict[int, _Way | None] = {0: None}
    count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    turns, low, high, initial = 0, None, None, None
    for s in group:
        ways: dict[int, _Way] = {}
        for x in s["searched"]:
            if x["entry"] in best:
                before = best[x["entry"]]
                way = _Way(before, x["entry"], x["audit"], x["cost"] + (before.cost if before else 0))
                if x["exit"] not in ways or way.less(ways[x["exit"]]):
                    ways[x["exit"]] = way
        best = ways
        for k in count:
            count[k] += s[k]
        count["illegal"] += initial is not None and initial + s["first_initial"] not in LEGAL
        initial = s["last_initial"]
        if s["first_turn"] is not None:
            turns += s["turns"] - (high == s["first_turn"])
            low, high = s["first_turn"] if low is None else low, s["last_turn"]
    ends = [best[k] for k in (0, 3) if k in best]
    way = ends[0] if len(ends) == 1 or ends[0].less(ends[1]) else ends[1]
    gaps, cost, chosen = 0 if low is None else high - low + 1 - turns, way.cost, []
    while way is not None:
        chosen.append((way.entry, way.audit))
        way = way.before
    return [{"seg": s["seg"], "entry": e, "audit": a, "gaps": gaps, "cost": cost} | count for s, (e, a) in zip(group, reversed(chosen))]


def _joined(segments: DataFrame) -> DataFrame:
    kind = T.StructType([T.StructField("seg", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("audit", T.StringType())] + [T.StructField(x, T.LongType()) for x in _COUNTS])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if group and group[-1]["conv_id"] != row["conv_id"]:
                    yield pa.RecordBatch.from_pylist(_join(group), schema=schema)
                    group = []
                group.append(row)
        if group:
            yield pa.RecordBatch.from_pylist(_join(group), schema=schema)

    given = segments.where("open").select(
        "conv_id", "seg", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", F.substring("initials", 1, 1).alias("first_initial"), F.substring("initials", -1, 1).alias("last_initial"), "searched"
    )
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(run, kind)


def _gaps() -> Column:
    return F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))


_REPAIRED = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("edit", "role", "text")]))


def repair(rows: DataFrame) -> DataFrame:
    """One row a segment: ``(conv_id, seg, open, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)``.

    ``rows``: ``(conv_id, turn, role, text)``.  Counts are of the whole
    conversation; ``audit`` and ``repaired``, the rows that stay as (edit, role,
    text), are of the segment, and a conversation's segments are in order of ``seg``.
    """
    judged = materialise(_judged(rows), "judged")
    segments = materialise(_segments(judged), "segments")
    drop(judged)
    chosen = materialise(_joined(segments), "chosen")
    whole = F.get("searched", F.lit(0))
    alone = segments.where("NOT open").select("*", F.lit(0).alias("entry"), whole["audit"].alias("audit"), _gaps().alias("gaps"), whole["cost"].alias("cost"))
    across = segments.where("open").drop("blank", "duplicate", "truncated", "illegal").join(chosen, "seg")
    columns = ["conv_id", "seg", "open", *_COUNTS, "audit", "entry", "codes", "roles", "texts"]
    d = alone.select(*columns).unionByName(across.select(*columns))
    kind = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("seg", T.LongType()), T.StructField("open", T.BooleanType())] + [T.StructField(x, T.LongType()) for x in _COUNTS] + [T.StructField("audit", T.StringType()), T.StructField("repaired", _REPAIRED)])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for i in range(b.num_rows):
                x = {c: b.column(k)[i].as_py() for k, c in enumerate(columns)}
                out.append(x | {"repaired": applied(x["audit"], x["entry"], x["roles"], x["codes"], x["texts"])})
                held += sum(map(len, x["texts"]))
                if held >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return d.mapInArrow(run, kind)


def turns(repaired: DataFrame) -> DataFrame:
    """``(conv_id, seg, place, edit, role, text)``: the rows of repaired conversations."""
    return repaired.select("conv_id", "seg", F.posexplode("repaired").alias("place", "x")).select("conv_id", "seg", "place", "x.*")


def summary(rows: DataFrame, original: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``original``: counts, cost, audit, and the SHA-256 of the repaired rows ``role:text``, joined by line feeds."""
    fixed = materialise(repair(rows), "repaired")
    line = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    alone = fixed.where("NOT open").select("conv_id", *_COUNTS, "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    kind = alone.schema
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([last | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=schema)

        last = None
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(c)[i].as_py() for c in ("conv_id", *_COUNTS, "audit", "lines")}
                if last is None or last["conv_id"] != x["conv_id"]:
                    if last is not None:
                        yield done()
                    last, audit, digest, begun = {c: x[c] for c in ("conv_id", *_COUNTS)}, [], hashlib.sha256(), False
                audit.append(x["audit"])
                for text in x["lines"]:
                    digest.update(b"\n" * begun + text.encode())
                    begun = True
        if last is not None:
            yield done()

    across = fixed.where("open").select("conv_id", "seg", *_COUNTS, "audit", line.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(run, kind)
    both = alone.unionByName(across)
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = [F.coalesce(x, F.lit(0)).alias(x) for x in _COUNTS] + [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")]
    found = both.withColumnRenamed("conv_id", "_c")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", *none)
