"""Repair of conversations by error-correcting Earley parsing.

The roles of a conversation should read ``(s?(ua)+)?``: an optional system row,
then pairs of user and assistant. The grammar below says so; its error productions
add what may go wrong: a row is deleted (4) or takes another role (3), a missing
user or assistant row is inserted (3), and an unfinished row that stays costs 3.
Blank rows and rows seen before have to go.

The chart holds dotted productions with the least (cost, audit) that reaches them,
audits being the edits' initials; equal costs go to the audit that is least in
ASCII. In this grammar a nonterminal only ever stands first in a production, so
every item begins where the parse began: a set of the chart holds a few items,
each needs no origin, and the chart is linear in the rows. Within a set, items are
settled in order of (cost, audit), insertions and completions alike.

A stretch of rows acts on the chart as a table: from each item to each item, the
least (cost, audit). Tables of neighbouring stretches combine associatively, so a
conversation of any size can be cut into stretches that are parsed apart.

Conversations of up to ``MOST_BYTES`` are read in order, one after the other, in
tasks that hold one of them at a time. Larger ones are dealt over tasks by range,
parsed in stretches of ``STRETCH`` rows, and the tables are combined; rows that
repeat are folded before that, and repeats are found by an aggregate. What then
remains in one place is what is one value by nature: the audit, and the hash of
all repaired rows, which is fed row by row.

Edge cases: a null role or text is one space, and so is a null id or turn in the
key of the damage; rows without a conversation id form one conversation; rows
without a turn come first; rows of one turn are ordered by role, then text (code
points), so the result does not depend on how the table is stored; a role without
characters has no initial, counts as one that fits nowhere, and is deleted or
given another; texts of any length are read whole; a conversation that lost all
its rows gives zeros, an empty audit and the hash of nothing; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, bounded, tidy

GRAMMAR = {
    "Dialogue": [(), ("Pairs",)],
    "Pairs": [("Open", "a")],
    "Open": [("Head", "u"), ("Pairs", "u")],
    "Head": [(), ("s",)],
}
ROLES = {"u": "user", "a": "assistant"}  # what a row can become, or be inserted as
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of texts of a conversation that one task may hold, and rows of a stretch.
MOST_BYTES = 8 << 20
STRETCH = 256

Item = tuple[str, tuple[str, ...], int]  # left side, right side, dot
Chart = dict[Item, tuple[int, str]]


def _close(found: Chart) -> Chart:
    """A set of the chart with what completes and what may be inserted."""
    heap = [(cost, audit, item) for item, (cost, audit) in found.items()]
    heap.sort()
    done: Chart = {}
    while heap:
        cost, audit, item = heappop(heap)
        if item in done:
            continue
        done[item] = cost, audit
        left, right, dot = item
        if dot == len(right):  # complete: the productions that begin with it go on
            for other, sides in GRAMMAR.items():
                for side in sides:
                    if side[:1] == (left,):
                        heappush(heap, (cost, audit, (other, side, 1)))
        elif right[dot] in ROLES:
            heappush(heap, (cost + INSERT, audit + "I", (left, right, dot + 1)))
    return done


def _waiting(item: Item) -> bool:
    """Whether an item can meet a row: it waits for a role, or all is said."""
    left, right, dot = item
    return right[dot].islower() if dot < len(right) else left == "Dialogue"


@lru_cache(None)
def _start() -> Chart:
    """The first set: the productions predicted from Dialogue."""
    wanted, seen = ["Dialogue"], {"Dialogue"}
    found: Chart = {}
    while wanted:
        left = wanted.pop()
        for side in GRAMMAR[left]:
            if side and side[0] in GRAMMAR:
                if side[0] not in seen:
                    seen.add(side[0])
                    wanted.append(side[0])
            else:
                found[left, side, 0] = 0, ""
    return {i: v for i, v in _close(found).items() if _waiting(i)}


def _step(chart: Chart, initial: str, fault: int) -> Chart:
    """The set after a row: it is deleted, kept or given another role."""
    found: Chart = {}

    def offer(item: Item, cost: int, audit: str) -> None:
        if item not in found or (cost, audit) < found[item]:
            found[item] = cost, audit

    for item, (cost, audit) in chart.items():
        offer(item, cost + DELETE, audit + "D")
        left, right, dot = item
        if fault in (BLANK, DUPLICATE) or dot == len(right):
            continue
        stays = UNFINISHED if fault == TRUNCATED else 0
        if right[dot] == initial:
            offer((left, right, dot + 1), cost + stays, audit + "K")
        elif right[dot] in ROLES:
            offer((left, right, dot + 1), cost + stays + REROLE, audit + "R")
    return {i: v for i, v in _close(found).items() if _waiting(i)}


def _final(chart: Chart) -> tuple[int, str]:
    return min(v for (left, right, dot), v in chart.items() if left == "Dialogue" and dot == len(right))


@lru_cache(1 << 16)
def _parse_short(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    return _final(reduce(lambda chart, row: _step(chart, *row), rows, _start()))


def parse(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """The least (cost, audit) of rows (initial of the role, fault)."""
    if len(rows) <= STRETCH:
        return _parse_short(tuple(rows))
    return finish(join([stretch(rows[i : i + STRETCH]) for i in range(0, len(rows), STRETCH)]))


Table = dict[Item, Chart]


def _all_items() -> list[Item]:
    return [i for left, sides in GRAMMAR.items() for side in sides for dot in range(len(side) + 1) if _waiting(i := (left, side, dot))]


def stretch(rows: list[tuple[str, int]]) -> Table:
    """From each item before these rows to each item after them."""
    return {item: reduce(lambda chart, row: _step(chart, *row), rows, {item: (0, "")}) for item in _all_items()}


def _then(a: Table, b: Table) -> Table:
    out: Table = {}
    for item, middle in a.items():
        found: dict[Item, tuple[int, str, str]] = {}
        for m, (cost, audit) in middle.items():
            for last, (more, rest) in b.get(m, {}).items():
                old = found.get(last)
                if old is None or cost + more < old[0] or (cost + more == old[0] and audit + rest < old[1] + old[2]):
                    found[last] = cost + more, audit, rest
        out[item] = {i: (cost, audit + rest) for i, (cost, audit, rest) in found.items()}
    return out


def join(tables: list[Table]) -> Table:
    """One table for neighbouring stretches, two by two."""
    while len(tables) > 1:
        tables = [_then(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def finish(table: Table) -> tuple[int, str]:
    return min(_final({last: (cost + more, audit + rest) for last, (more, rest) in table[item].items()}) for item, (cost, audit) in _start().items() if any(i[0] == "Dialogue" and i[2] == len(i[1]) for i in table[item]))


class Repaired:
    """Repaired rows in order, from an audit and the rows it was made for."""

    def __init__(self, audit: str):
        self.audit, self.at, self.n = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2  # then a system row stands first

    def _role(self) -> str:
        return ROLES["ua"[(self.n - self.odd) % 2]]

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            yield self._role(), ""
            self.at, self.n = self.at + 1, self.n + 1

    def row(self, role: str, text: str):
        """What stands up to and in place of the next row."""
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield (role if edit == "K" else self._role()), text
            self.n += 1

    def rest(self):
        yield from self._inserted()


def fault_of(text: str, seen: bool) -> int:
    words = text.rstrip(SPACE)
    return BLANK if not words else DUPLICATE if seen else FINE if words[-1] in ".!?" else TRUNCATED


class Hash:
    """SHA-256 of rows ``role:text``, joined by newlines."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode())
        self.first = False


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def _report(conv_id, gaps, faults, illegal, cost, audit, sha) -> dict:
    return {"conv_id": conv_id, "gaps": gaps, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED], "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


def _rows(batches):
    """Python rows of ordered Arrow batches."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True)


def _groups(rows):
    """(key, rows of it) of ordered rows, one row read ahead."""
    held, key = [], None
    for r in rows:
        if held and r[0] != key:
            yield key, held
            held = []
        key = r[0]
        held.append(r)
    if held:
        yield key, held


def _small(kind: pa.Schema, want_rows: bool):
    """Whole conversations (conv_id, turn, role, text, copies), ordered."""

    def run(batches):
        out = []
        for conv_id, rows in _groups(_rows(batches)):
            rows = [r for r in rows for _ in range(r[4])]
            seen, codes, faults = set(), [], [0] * 4
            for _, _, role, text, _ in rows:
                fault = fault_of(text, (role, text) in seen)
                seen.add((role, text))
                codes.append((role[:1], fault))
                faults[fault] += 1
            cost, audit = parse(codes)
            repaired = Repaired(audit)
            whole = [x for _, _, role, text, _ in rows for x in repaired.row(role, text)] + list(repaired.rest())
            if want_rows:
                out += [{"conv_id": conv_id, "turn": i, "role": role, "text": text} for i, (role, text) in enumerate(whole)]
            else:
                sha = Hash()
                for x in whole:
                    sha.add(*x)
                turns = {r[1] for r in rows} - {None}
                gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
                out.append(_report(conv_id, gaps, faults, sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:], strict=False)), cost, audit, sha.sha.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, kind)

    return run


ITEMS = _all_items()
TABLE = "array<struct<i:int,j:int,cost:bigint,audit:string>>"
PART = f"conv_id long, part int, entries {TABLE}, faults array<bigint>, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"


def _pack(table: Table) -> list[dict]:
    return [{"i": ITEMS.index(a), "j": ITEMS.index(b), "cost": c, "audit": t} for a, found in table.items() for b, (c, t) in found.items()]


def _unpack(entries: list[dict]) -> Table:
    out: Table = {}
    for e in entries:
        out.setdefault(ITEMS[e["i"]], {})[ITEMS[e["j"]]] = e["cost"], e["audit"]
    return out


def _parts(kind: pa.Schema):
    """Ordered rows (conv_id, turn, role, text, n, fresh) of large conversations ->
    one row for each conversation in this task: the table of its stretch, and counts."""

    def codes(rows, part: dict):
        for _, turn, role, text, n, fresh in rows:
            initial, fault = role[:1], fault_of(text, not fresh)
            if turn is not None and turn != part["last_turn"]:
                part["turns"], part["last_turn"] = part["turns"] + 1, turn
                part["first_turn"] = turn if part["first_turn"] is None else part["first_turn"]
            part["first_initial"] = initial if part["first_initial"] is None else part["first_initial"]
            for _ in range(n):
                part["faults"][fault] += 1
                part["illegal"] += part["last_initial"] is not None and part["last_initial"] + initial not in LEGAL
                part["last_initial"] = initial
                yield initial, fault
                fault = BLANK if fault == BLANK else DUPLICATE

    def run(batches):
        rows = _rows(batches)
        row = next(rows, None)
        while row is not None:
            conv_id, left = row[0], []

            def own(first, conv_id=conv_id, left=left):
                yield first
                for r in rows:
                    if r[0] != conv_id:
                        left.append(r)
                        return
                    yield r

            part = {"conv_id": conv_id, "part": TaskContext.get().partitionId(), "faults": [0] * 4, "illegal": 0, "first_initial": None, "last_initial": None, "first_turn": None, "last_turn": None, "turns": 0}
            tables, some = [], []
            for code in codes(own(row), part):
                some.append(code)
                if len(some) == STRETCH:
                    tables.append(stretch(some))
                    some = []
            tables += [stretch(some)] if some else []
            yield pa.RecordBatch.from_pylist([part | {"entries": _pack(join(tables))}], kind)
            row = left[0] if left else None

    return run


def _combined(kind: pa.Schema):
    """Rows (conv_id, parts in order) -> the report, but for the hash."""

    def run(batches):
        for b in batches:
            for conv_id, parts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "parts")), strict=True):
                cost, audit = finish(join([_unpack(p["entries"]) for p in parts]))
                faults = [sum(p["faults"][f] for p in parts) for f in range(4)]
                seams = list(zip(parts, parts[1:], strict=False))
                illegal = sum(p["illegal"] for p in parts) + sum(p["last_initial"] + q["first_initial"] not in LEGAL for p, q in seams)
                timed = [p for p in parts if p["turns"]]
                turns = sum(p["turns"] for p in timed) - sum(p["last_turn"] == q["first_turn"] for p, q in zip(timed, timed[1:], strict=False))
                gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
                yield pa.RecordBatch.from_pylist([_report(conv_id, gaps, faults, illegal, cost, audit, None)], kind)

    return run


def _written(kind: pa.Schema, want_rows: bool):
    """Rows (conv_id, audit, turn, role, text, n), each conversation's audit first,
    then its rows in order -> repaired rows, or their hash; nothing is held."""

    def run(batches):
        repaired, sha, conv_id, out = None, None, None, []

        def take(found):
            for role, text in found:
                sha.add(role, text)
                if want_rows:
                    out.append({"conv_id": conv_id, "turn": take.n, "role": role, "text": text})
                    take.n += 1

        def end():
            if repaired is not None:
                take(repaired.rest())
                if not want_rows:
                    out.append({"conv_id": conv_id, "repaired_sha256": sha.sha.hexdigest()})

        for key, audit, _, role, text, n in _rows(batches):
            if audit is not None:
                end()
                repaired, sha, conv_id, take.n = Repaired(audit), Hash(), key, 0
                continue
            for _ in range(n):
                take(repaired.row(role, text))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out.clear()
        end()
        yield pa.RecordBatch.from_pylist(out, kind)

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), TABLE: pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ", 1) for c in ddl.split(", "))])


ORDER = ["conv_id", "turn", "role", "text"]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: by the CRC-32 of id and turn a row in
    twenty goes, loses its text or its marks, comes twice, or becomes a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = plain(conversations).withColumn("_d", F.crc32(key.cast("binary")) % 20).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_d") == 3, 2).otherwise(1).cast("long").alias("copies"))


def plain(conversations: DataFrame) -> DataFrame:
    """The columns that count; a null role or text is one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def repair(spark: SparkSession, rows: DataFrame, want_rows: bool = False, most_bytes: int | None = None) -> DataFrame:
    """A report for each conversation of rows(conv_id, turn, role, text[, copies]),
    or with ``want_rows`` its repaired rows (conv_id, turn from 0, role, text).

    ``copies`` says how often a row stands there. The report: gaps in the turns,
    rows by their first fault, neighbours whose roles do not fit, the least cost of
    a repair, its audit (D, I, K, R in order) and the hash of the repaired rows."""
    bounded(spark)
    scratch = Scratch(spark, "conversations")
    rows = plain(rows).select(ORDER) if "copies" not in rows.columns else rows.select(*ORDER, F.col("copies").cast("long").alias("copies"))
    rows = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long"))
    out = "conv_id long, turn long, role string, text string" if want_rows else REPORT
    size = (F.octet_length("text") + F.octet_length("role") + 64) * F.col("copies")
    large = scratch.keep(rows.groupBy("conv_id").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > (most_bytes or MOST_BYTES)).select("conv_id"), "large")
    some = not large.isEmpty()
    same = rows["conv_id"].eqNullSafe(large["conv_id"])
    small = rows.join(large, same, "left_anti") if some else rows
    done = small.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(tidy(_small(_schema(out), want_rows)), out)
    return done.unionByName(_repair_large(rows.join(large, same, "left_semi"), scratch, want_rows, out)) if some else done


def _repair_large(rows: DataFrame, scratch: Scratch, want_rows: bool, out: str) -> DataFrame:
    folded = scratch.keep(rows.groupBy(*ORDER).agg(F.sum("copies").alias("n")).withColumn("th", F.sha2("text", 256)), "folded")
    earliest = folded.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("th").alias("h")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("timed"), "turn")).alias("e"))
    meets = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("th") == F.col("h"))
    fresh = folded.join(earliest, meets).select(*ORDER, "n", F.col("turn").eqNullSafe(F.col("e.turn")).alias("fresh"))
    parts = fresh.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(tidy(_parts(_schema(PART))), PART)
    parts = scratch.keep(parts, "parts")  # a few rows for each task
    each = F.struct("part", *[c for c in parts.columns if c not in ("conv_id", "part")])
    together = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("parts"))
    report = scratch.keep(together.mapInArrow(tidy(_combined(_schema(REPORT))), REPORT), "report")
    lines = folded.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "n")
    heads = report.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    order = ["conv_id", F.col("audit").isNull(), "turn", "role", "text"]
    hashed = "conv_id long, repaired_sha256 string"
    stream = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions(*order)
    if want_rows:
        return stream.mapInArrow(tidy(_written(_schema(out), True)), out)
    hashes = stream.mapInArrow(tidy(_written(_schema(hashed), False)), hashed).withColumnRenamed("conv_id", "c")
    return report.drop("repaired_sha256").join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def reports(spark: SparkSession, conversations: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """The report of every conversation after damage, those without rows included."""
    done = repair(spark, damaged(conversations), most_bytes=most_bytes).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", *[F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in done.columns[1:]])


def _plus(value: str, cost: str, letter: str) -> str:
    """SQL of a chart value, eight digits of cost and the audit, after one more edit."""
    return f"(lpad((substr({value}, 1, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({value}, 9) || '{letter}')"


def _oracle() -> str:
    """The chart as a recursion over rows; s0 .. s3: nothing said, a system row,
    an open exchange, whole pairs."""
    can = "r.fault NOT IN ('blank', 'duplicate')"
    stay = "CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END"

    def say(states: str, role: str) -> str:
        kept, other = (", ".join(_plus(f"st.{s}", stay + more, letter) for s in states.split()) for more, letter in (("", "K"), (" + 3", "R")))
        return f"CASE WHEN {can} THEN CASE WHEN r.i = '{role}' THEN least({kept}) ELSE least({other}) END END"

    gone = [_plus(f"st.s{i}", "4", "D") for i in range(4)]
    system = f"CASE WHEN {can} AND r.i = 's' THEN {_plus('st.s0', stay, 'K')} END"
    return rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(k, lambda x: ascii(x)::UBIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 20 AS d FROM c),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM g),
r AS MATERIALIZED (SELECT conv_id, turn, role, text, n, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
m AS (SELECT conv_id, max(n) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM r GROUP BY conv_id),
w AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM r) WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
st AS (SELECT conv_id, 0::BIGINT AS n, '00000000' AS s0, NULL::VARCHAR AS s1, '00000003I' AS s2, '00000006II' AS s3 FROM m
  UNION ALL SELECT conv_id, n, s0, s1, least(s2, {_plus('s0', '3', 'I')}, {_plus('s1', '3', 'I')}, {_plus('s3', '3', 'I')}), least(s3, {_plus('s2', '3', 'I')}, {_plus(_plus('s0', '3', 'I'), '3', 'I')}, {_plus(_plus('s1', '3', 'I'), '3', 'I')})
  FROM (SELECT r.conv_id, r.n, {gone[0]} AS s0, least({gone[1]}, {system}) AS s1, least({gone[2]}, {say('s0 s1 s3', 'u')}) AS s2, least({gone[3]}, {say('s2', 'a')}) AS s3
        FROM st JOIN r ON r.conv_id IS NOT DISTINCT FROM st.conv_id AND r.n = st.n + 1)),
e AS (SELECT m.*, least(st.s0, st.s3) AS best FROM m JOIN st ON st.conv_id IS NOT DISTINCT FROM m.conv_id AND st.n = m.rows),
a AS (SELECT *, substr(best, 9) AS audit FROM e),
l AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS x, generate_subscripts(string_split(audit, ''), 1) AS p FROM a WHERE audit <> ''),
q AS (SELECT *, count(*) FILTER (WHERE x <> 'I') OVER v AS n, count(*) FILTER (WHERE x <> 'D') OVER v - 1 AS j, length(replace(audit, 'D', '')) % 2 AS odd FROM l WINDOW v AS (PARTITION BY conv_id ORDER BY p)),
f AS (SELECT q.conv_id, string_agg(CASE WHEN x = 'K' THEN r.role WHEN (j - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p) AS text
      FROM q LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.n = q.n AND x <> 'I' WHERE x <> 'D' GROUP BY q.conv_id),
z AS (SELECT DISTINCT conv_id FROM conversations)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(best, 1, 8)::BIGINT, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(f.text, '')) AS repaired_sha256
FROM z LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id"""


#: The query's result in DuckDB's SQL.
SQL = _oracle()
