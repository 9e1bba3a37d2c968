"""Repair of the turn structure of conversations over a DAG of tight arcs.

A node of the DAG is (rows consumed, state of the role pattern ``(s?(ua)+)?``); its arcs keep, rerole or delete the next
row or insert one. Forward and backward minimum costs tell which arcs lie on a cheapest path (their sum
with the arc's cost is the total: they are tight); a walk of sets of nodes over tight arcs that takes
the least letter at each step gives the least of all cheapest edit strings.

No conversation's text is gathered. Rows are shuffled once, by conversation; in the sorted partition one byte a row comes first,
for the edits, then the rows that the edits may keep, which are hashed as they pass.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after a system, user, assistant turn; the pattern may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: A row's code is 4 times the place of its role's initial here (3: any other) and the place of its fault in FAULTS.
INITIALS = "sua"
FAULTS = ("", "blank", "duplicate", "truncated")
DROPPED = -1
INFINITE = 1 << 60
WHITE = " \t\n\x0b\x0c\r"
INSERTS = [(q, to) for (q, initial), to in NEXT.items() if initial != "s"]


def _row_arcs(code: int) -> list[tuple[str, int, int, int]]:
    """``letter, cost, from, to``: how a row with this code may be consumed."""
    initial, fault = (*INITIALS, "?")[code >> 2], FAULTS[code & 3]
    arcs = [("D", DELETE, q, q) for q in range(4)]
    if fault in ("blank", "duplicate"):
        return arcs
    more = TRUNCATED if fault == "truncated" else 0
    arcs += [("K", KEEP + more, q, to) for (q, i), to in NEXT.items() if i == initial]
    return arcs + [("R", REROLE + more, q, to) for q, to in INSERTS]


ARCS = [_row_arcs(code) for code in range(16)]


def forward_costs(codes: bytes) -> list[array]:
    """By state, the least cost to have consumed 0, 1, ... rows and be in it."""
    cost, now = [array("q") for _ in range(4)], [0, INFINITE, INFINITE, INFINITE]
    for i in range(len(codes) + 1):
        if i:
            new = [INFINITE] * 4
            for _, c, q, to in ARCS[codes[i - 1]]:
                new[to] = min(new[to], now[q] + c)
            now = new
        now[USER] = min(now[USER], INSERT + min(now[START], now[SYSTEM], now[ASSISTANT]))
        now[ASSISTANT] = min(now[ASSISTANT], INSERT + now[USER])
        for q in range(4):
            cost[q].append(min(now[q], INFINITE))
    return cost


def backward_costs(codes: bytes) -> list[array]:
    """By state, the least cost from it to an end after 0, 1, ... rows are consumed."""
    cost, now = [array("q") for _ in range(4)], [0 if q in ENDS else INFINITE for q in range(4)]
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            new = [INFINITE] * 4
            for _, c, q, to in ARCS[codes[i]]:
                new[q] = min(new[q], now[to] + c)
            now = new
        now[USER] = min(now[USER], INSERT + now[ASSISTANT])
        for q in (START, SYSTEM, ASSISTANT):
            now[q] = min(now[q], INSERT + now[USER])
        for q in range(4):
            cost[q].append(min(now[q], INFINITE))
    for q in range(4):
        cost[q].reverse()
    return cost


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """The least cost of edits that make the roles legal, and the ASCII-least string of edit initials of that cost."""
    ahead, behind = forward_costs(codes), backward_costs(codes)
    total, n = behind[START][0], len(codes)
    letters: list[str] = []
    front = {(0, START)}
    while not any(i == n and q in ENDS for i, q in front):
        steps: dict[str, set[tuple[int, int]]] = {}
        for i, q in front:
            if i < n:
                for letter, c, at, to in ARCS[codes[i]]:
                    if at == q and ahead[q][i] + c + behind[to][i + 1] == total:
                        steps.setdefault(letter, set()).add((i + 1, to))
            for at, to in INSERTS:
                if at == q and ahead[q][i] + INSERT + behind[to][i] == total:
                    steps.setdefault("I", set()).add((i, to))
        least = min(steps)
        letters.append(least)
        front = steps[least]
    return total, "".join(letters)


class Conversation:
    """What is known of one conversation while its codes and then its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.hash = conv_id, bytearray(), hashlib.sha256()
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.edits: str | None = None

    def add(self, turn: int | None, code: int) -> None:
        if code == DROPPED:
            return
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        if self.codes and (self.codes[-1] >> 2, code >> 2) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.codes.append(code)

    def settle(self) -> None:
        self.cost, self.edits = cheapest_edits(bytes(self.codes))
        self.at = self.row = self.out = 0
        self.before = ""

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.out else ''}{role}:{text}".encode())
        self.out, self.before = self.out + 1, role[:1]

    def advance(self, pos: int | None, role: str = "", text: str = "") -> None:
        """Apply the edits up to row ``pos`` (from 1), whose role and text are given, or up to the end."""
        if self.edits is None:
            self.settle()
        while self.at < len(self.edits) and (pos is None or self.row < pos):
            letter = self.edits[self.at]
            self.at += 1
            self.row += letter != "I"
            if letter == "K":
                self.put(role, text)
            elif letter != "D":
                self.put("assistant" if self.before == "u" else "user", text if letter == "R" else "")

    def result(self) -> tuple:
        self.advance(None)
        faults = [c & 3 for c in self.codes]
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, faults.count(1), faults.count(2), faults.count(3), self.illegal, self.cost, self.edits, self.hash.hexdigest())


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from records ``conv_id, kind, pos, turn, code, role, text`` in order of the first three."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    one: Conversation | None = None
    for batch in batches:
        done = []
        for conv_id, kind, pos, turn, code, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if one is None or conv_id != one.conv_id:
                if one is not None:
                    done.append(one.result())
                one = Conversation(conv_id)
            if kind == 0:
                one.add(turn, code)
            else:
                one.advance(pos, role, text)
        if done:
            yield pack(done)
    if one is not None:
        yield pack([one.result()])


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of every conversation of ``conv_id, turn, role, text``.

    Rows with a false ``live`` (all are live without such a column) only name their conversation. Rows go by turn (nulls first), then role and
    text; nulls of role and text are one space; equal rows count as often as they are there. A null ``conv_id`` is a
    conversation like others. A role is known by its first character; an empty one, as any other than s, u, a, must be
    given a role or go. Other columns are ignored; an empty table gives no rows.
    """
    live = F.col("live") if "live" in turns.columns else F.lit(True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), live.alias("live"))
    rows = rows.repartition("conv_id")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "live").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    again = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy("pos")) > 1
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", 1).when(again, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.when(F.col("role") == "", F.lit(0)).otherwise(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)))
    code = F.when(F.col("live"), F.when(initial > 0, initial - 1).otherwise(3) * 4 + fault).otherwise(DROPPED).cast("int")
    none = F.lit(None)
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("turn").alias("turn"), F.col("code").alias("code"), none.cast("string").alias("role"), none.cast("string").alias("text")),
        F.struct(F.lit(1).alias("kind"), none.cast("long").alias("turn"), none.cast("int").alias("code"), F.col("role").alias("role"), F.col("text").alias("text")),
    )
    kinds = F.when(F.col("live") & (F.col("code") % 4).isin(0, 3), kinds).otherwise(F.slice(kinds, 1, 1))
    rows = rows.withColumn("code", code).select("conv_id", "pos", F.explode(kinds).alias("r"))
    rows = rows.select("conv_id", "r.kind", "pos", "r.turn", "r.code", "r.role", "r.text").sortWithinPartitions("conv_id", "kind", "pos")
    return rows.mapInArrow(repair_sorted, SCHEMA)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults that follow from the id and the turn; dropped rows stay with a false ``live``.

    Of 20 remainders of the CRC-32 of ``conv_id:turn``, 0 drops a row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it and 4 makes it a user's. Nulls are one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("k"))
    new = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), (F.col("k") != 0).alias("live"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every damaged conversation."""
    from .common import table

    return repair(damage(table(spark, sf_dir, "conversations")))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(list_prepend(xor(a, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384::ubigint))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::ubigint)), lambda a, b: {bits}), 4294967295::ubigint)"


_LEAST = lambda *ways: f"list_min([{', '.join(ways)}])"
_WAY = lambda letter, cost, to: f"{{'c': {cost} + {to}.c, 's': '{letter}' || {to}.s}}"
_MORE = "(case fault when 3 then 5 else 0 end)"


def _base(q: str, kept: str, to: str, also: str = "") -> str:
    """A state's best way over the next row: delete, keep (if its initial is ``kept``) or rerole into ``to``."""
    ways = [_WAY("D", "2", f"w.{q}")]
    for initial, target in ((kept, to), *([("s", "s")] if also else [])):
        ways.append(f"case when fault in (0, 3) and initial = '{initial}' then {_WAY('K', _MORE, f'w.{target}')} else {{'c': 1000000000, 's': ''}} end")
    ways.append(f"case when fault in (0, 3) then {_WAY('R', f'1 + {_MORE}', f'w.{to}')} else {{'c': 1000000000, 's': ''}} end")
    return _LEAST(*ways)


OP13_SQL = rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from raw, (select unnest([1, 2]) as copy) where k <> 0 and (copy = 1 or k = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by pos) as time, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from placed),
judged as (
  select conv_id, turn, role, text, pos, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by pos) as earlier,
    case when bare = '' then 1 when time > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault from seen),
sizes as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (pos > 1 and earlier || initial not in ('su', 'ua', 'au')) as illegal from judged group by conv_id),
walk as (
  select conv_id, n as i, {{'z': {{'c': 0, 's': ''}}, 's': {{'c': 1000000000, 's': ''}}, 'u': {{'c': 5, 's': 'I'}}, 'a': {{'c': 0, 's': ''}}}} as w from sizes
  union all
  select conv_id, i, {{'z': {_LEAST("b.z", _WAY("I", "5", "u"))}, 's': {_LEAST("b.s", _WAY("I", "5", "u"))}, 'u': u, 'a': {_LEAST("b.a", _WAY("I", "5", "u"))}}}
  from (select conv_id, i, b, {_LEAST("b.u", _WAY("I", "5", "b.a"))} as u from (
    select walk.conv_id, walk.i - 1 as i, {{'z': {_base("z", "u", "u", "s")}, 's': {_base("s", "u", "u")}, 'u': {_base("u", "a", "a")}, 'a': {_base("a", "u", "u")}}} as b
    from walk join judged on walk.conv_id is not distinct from judged.conv_id and judged.pos = walk.i)) ),
edits as (select conv_id, w.z.c as cost, w.z.s as audit from walk where i = 0),
letters as (select conv_id, unnest(string_split(audit, '')) as letter, unnest(range(1, length(audit) + 1)) as nth from edits where audit <> ''),
rows_ as (select *, count(*) filter (letter <> 'I') over (partition by conv_id order by nth) as pos from letters),
out_ as (
  select r.conv_id, nth, letter, j.role, j.text, row_number() over (partition by r.conv_id order by nth) - 1 as place,
    first_value(letter = 'K' and j.initial = 's') over (partition by r.conv_id order by nth) as system
  from rows_ r left join judged j on r.conv_id is not distinct from j.conv_id and r.pos = j.pos and letter <> 'I' where letter <> 'D'),
repaired as (
  select conv_id, string_agg(case when letter = 'K' then role when (place - system::int) % 2 = 0 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by nth) as whole
  from out_ group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join sizes s on c.conv_id is not distinct from s.conv_id
left join edits e on c.conv_id is not distinct from e.conv_id left join repaired r on c.conv_id is not distinct from r.conv_id
"""
