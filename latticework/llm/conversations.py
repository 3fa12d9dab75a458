"""Repair of the structure of conversations: the cheapest edits that make turns alternate.

A repaired conversation has the role initials ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn, or nothing. The edits
are Keep (0), Rerole to user or assistant (1), Delete (2) and Insert of an empty turn of user or assistant (5). A blank or
duplicate turn must go; a truncated turn costs 5 more if it stays.

The dynamic program runs over the turns that are retained (kept or reroled). Its states are the role retained last, or none yet. A
retained turn follows the best retained turn before it: what lies between is deleted, at a price that is a difference of prefix sums, so each
state only needs its running minimum of cost less prefix sum; the pair of roles says how many inserts stand between (none, or one that
the pattern asks for). Of equal costs the least audit (the edits' initials) wins. Audits of two states always differ at a turn that both
have seen, so their order is kept as a rank and no strings are compared. Each state carries the running hash of its repaired text and
each turn four bytes of how it was reached: a conversation is read once, in order, in memory of four bytes a turn.

Turns stand by ``turn`` (nulls first), then role and text. Duplicates (an earlier turn has the same role and text) are found by a
grouped minimum of ``turn``, which is combined before the shuffle. The turns of a conversation meet in one task, sorted by Spark and
read as a stream: a SHA-256 of the repaired conversation can't be had otherwise. The audit, a letter a turn, is one value anyway.

Defined cases: null roles and texts, and null parts of the key that damage goes by, are one space; a null conversation id is one
conversation; repeated rows stand side by side, all but the first as duplicates; a role without letters has no initial and fits nowhere;
a conversation all of whose turns were dropped has zeros, an empty audit and the hash of nothing; an empty table gives an empty
result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import n_partitions

SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5  # prices of edits; CUT: of a truncated turn that stays
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What may stand before a turn of a role: (state, role to insert between or None).
BEFORE = {
    SYSTEM: ((NONE, None),),
    USER: ((NONE, None), (SYSTEM, None), (ASSISTANT, None), (USER, ASSISTANT)),
    ASSISTANT: ((USER, None), (NONE, USER), (SYSTEM, USER), (ASSISTANT, USER)),
}
#: What the pattern asks for after the last retained turn.
AFTER = {NONE: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}

_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, edit string, turn long, role string, text string"


def crc_mod(conv: Column, turn: Column, by: int) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(part(conv), F.lit(":"), part(turn))) % by


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): undamaged turns, one copy each."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(1).alias("copies"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): by the hash of its place a turn is dropped (no copies), emptied, robbed of its full stops, repeated
    (two copies) or given to the user."""
    hit = crc_mod(F.col("conv_id"), F.col("turn"), 20)
    return plain(conversations).select(
        "conv_id",
        "turn",
        F.when(hit == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(hit <= 1, F.lit("")).when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def _with_duplicates(turns: DataFrame) -> DataFrame:
    """Adds ``again``: an earlier turn of the conversation has the same role and text."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls first
    keyed = turns.withColumns({"digest": F.sha2(F.col("text"), 256), "at": place})
    shown = keyed.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    first = shown.agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = keyed["conv_id"].eqNullSafe(first["c"]) & (keyed["role"] == first["r"]) & (keyed["digest"] == first["d"])
    return keyed.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again"))


class Conversation:
    """The dynamic program over the turns of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = self.deletions = 0
        self.least = self.most = self.before = self.initial = None
        # of each state that can be: (cost less deletions so far, rank of its audit, hash of its repaired text, whether that has turns)
        self.live: dict = {NONE: (0, 0, hashlib.sha256(), False)}
        self.steps = bytearray()  # four bytes a turn, one a state: 0 deleted, else 1 + state before + 4 * inserted + 8 * reroled

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        if not copies:
            return
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.numbers += turn != self.most
            self.most = turn
        again = again or self.before == (turn, role, text)
        self.before = (turn, role, text)
        ended, initial = text.rstrip(SPACES)[-1:], role[:1]
        for k in range(copies):
            if self.n:
                self.illegal += self.initial + initial not in ("su", "ua", "au")
            self.n, self.initial = self.n + 1, initial
            cut = False
            if not ended:
                self.blank += 1
            elif again or k:
                self.duplicate += 1
            elif cut := ended not in ".!?":
                self.truncated += 1
            if not ended or again or k:
                self._delete()
            else:
                self._turn(role, text, CUT * cut)

    def _delete(self) -> None:
        self.deletions += DELETE
        self.steps += bytes(4)

    def _turn(self, role: str, text: str, price: int) -> None:
        live, own = self.live, INITIAL.get(role[:1])
        best = {s: (cost, rank, "D", s, None, 0) for s, (cost, rank, _, _) in live.items()}
        for to, ways in BEFORE.items():
            reroled = to != own
            if reroled and to == SYSTEM:
                continue
            for s, between in ways:
                if s in live:
                    cost = live[s][0] - DELETE + price + REROLE * reroled + INSERT * (between is not None)
                    way = (cost, live[s][1], ("" if between is None else "I") + "KR"[reroled], s, between, 1 + reroled)
                    if to not in best or way < best[to]:
                        best[to] = way
        self.deletions += DELETE
        ranks = {key: k for k, key in enumerate(sorted({w[1:3] for w in best.values()}))}
        step, new = bytearray(4), {}
        for to, (cost, rank, suffix, s, between, kind) in best.items():
            _, _, sha, some = live[s]
            if kind:
                sha = sha.copy()
                parts = ([f"{NAMES[between]}:"] if between is not None else []) + [f"{NAMES[to] if kind == 2 else role}:{text}"]
                sha.update((("\n" if some else "") + "\n".join(parts)).encode())
                some = True
                step[to] = 1 + s + 4 * (between is not None) + 8 * (kind - 1)
            new[to] = (cost, ranks[rank, suffix], sha, some)
        self.live = new
        self.steps += step

    def result(self) -> tuple:
        """The row of _OUT."""
        cost, _, _, end = min((c + INSERT * len(AFTER[s]), rank, "I" * len(AFTER[s]), s) for s, (c, rank, _, _) in self.live.items())
        _, _, sha, some = self.live[end]
        if AFTER[end]:
            sha.update(("\n" * some + "\n".join(f"{NAMES[r]}:" for r in AFTER[end])).encode())
        audit, s = ["I" * len(AFTER[end])], end
        for at in range(len(self.steps) - 4, -4, -4):
            if how := self.steps[at + s]:
                how -= 1
                audit.append("R" if how & 8 else "K")
                if how & 4:
                    audit.append("I")
                s = how & 3
            else:
                audit.append("D")
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.numbers
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost + self.deletions, "".join(reversed(audit)), sha.hexdigest()


def _streamed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of a conversation together, in order."""
    return df.repartition(n_partitions(df.sparkSession, df), "conv_id").sortWithinPartitions("conv_id", *order)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def _batches(rows, schema: str, many: int = 1024):
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kinds = [pa.int64() if t == "long" else pa.string() for t in types]
    held = []
    for r in rows:
        held.append(r)
        if len(held) == many:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=list(names))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=list(names))


def repair(turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns`` (as ``plain`` or ``damaged`` give them): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""

    def run(batches):
        def results():
            now = None
            for conv_id, turn, role, text, copies, again in _rows(batches):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield now.result()
                    now = Conversation(conv_id)
                now.add(turn, role, text, copies, again)
            if now is not None:
                yield now.result()

        yield from _batches(results(), _OUT)

    return _streamed(_with_duplicates(turns), [F.col("turn"), F.col("role"), F.col("text")]).mapInArrow(run, _OUT)


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, place (from 0), edit (K, R or I), turn, role, text. ``repairs``: what ``repair``
    gave for ``turns``, by a written table where it is expensive."""
    audits = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"))
    both = audits.unionByName(turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies"))

    def run(batches):
        def result():
            audit, at, place, state = "", 0, 0, NONE

            def inserted():
                nonlocal at, place, state
                while audit[at : at + 1] == "I":
                    state = ASSISTANT if state == USER else USER
                    yield conv_id, place, "I", None, NAMES[state], ""
                    at, place = at + 1, place + 1

            conv_id = None
            for c, kind, turn, role, text, copies in _rows(batches):
                if not kind:
                    yield from inserted()  # after the last turn of the conversation before
                    conv_id, audit, at, place, state = c, text, 0, 0, NONE
                    continue
                for _ in range(copies):
                    yield from inserted()
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        continue
                    state = SYSTEM if edit == "K" and role[:1] == "s" else ASSISTANT if state == USER else USER
                    yield conv_id, place, edit, turn, role if edit == "K" else NAMES[state], text
                    place += 1
            yield from inserted()

        yield from _batches(result(), _TURNS)

    return _streamed(both, [F.col("kind"), F.col("turn"), F.col("role"), F.col("text")]).mapInArrow(run, _TURNS)


#: DuckDB: the same by a table of all states after each turn, audits compared as strings.
ORACLE = """
with recursive codes as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
           lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 as h
  from conversations, codes),
turns as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case h when 0 then 0 when 3 then 2 else 1 end)) as copy
  from hit),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from turns),
seen as (
  select *, row_number() over (partition by conv_id, role, text order by i) as copies_so_far, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as kept_text,
    substr(role, 1, 1) as initial, substr(lag(role) over (partition by conv_id order by i), 1, 1) as initial_before
  from placed),
faults as (
  select *, case when kept_text = '' then 'b' when copies_so_far > 1 then 'd' when right(kept_text, 1) not in ('.', '!', '?') then 't' else '' end as fault from seen),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (i > 1 and initial_before || initial not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id),
ways(state, state_after, edit, letters, inserted, price) as (values
  ('', '', 'D', 'D', []::varchar[], 2), ('s', 's', 'D', 'D', [], 2), ('u', 'u', 'D', 'D', [], 2), ('a', 'a', 'D', 'D', [], 2),
  ('', 's', 'K', 'K', [], 0), ('', 'u', 'K', 'K', [], 0), ('s', 'u', 'K', 'K', [], 0), ('a', 'u', 'K', 'K', [], 0), ('u', 'u', 'K', 'IK', ['assistant:'], 5),
  ('u', 'a', 'K', 'K', [], 0), ('', 'a', 'K', 'IK', ['user:'], 5), ('s', 'a', 'K', 'IK', ['user:'], 5), ('a', 'a', 'K', 'IK', ['user:'], 5),
  ('', 'u', 'R', 'R', [], 1), ('s', 'u', 'R', 'R', [], 1), ('a', 'u', 'R', 'R', [], 1), ('u', 'u', 'R', 'IR', ['assistant:'], 6),
  ('u', 'a', 'R', 'R', [], 1), ('', 'a', 'R', 'IR', ['user:'], 6), ('s', 'a', 'R', 'IR', ['user:'], 6), ('a', 'a', 'R', 'IR', ['user:'], 6)),
ids as (select distinct conv_id from conversations),
paths as (
  select conv_id, 0::bigint as i, '' as state, {'cost': 0::bigint, 'audit': ''::varchar, 'lines': []::varchar[]} as best from ids
  union all
  select conv_id, i, state, min(best) as best from (
    select p.conv_id, f.i, w.state_after as state,
      {'cost': p.best.cost + w.price + case when f.fault = 't' and w.edit <> 'D' then 5 else 0 end, 'audit': p.best.audit || w.letters,
       'lines': case w.edit when 'D' then p.best.lines else list_concat(list_concat(p.best.lines, w.inserted),
         [case w.edit when 'K' then f.role when 'R' then case w.state_after when 'u' then 'user' else 'assistant' end end || ':' || f.text]) end} as best
    from paths p join faults f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1
    join ways w on w.state = p.state and (w.edit = 'D' or f.fault not in ('b', 'd')) and (w.edit <> 'K' or f.initial = w.state_after))
  group by conv_id, i, state),
ends as (
  select conv_id, min({'cost': best.cost + e.price, 'audit': best.audit || e.letters, 'lines': list_concat(best.lines, e.inserted)}) as best
  from paths p join (values ('', '', []::varchar[], 0), ('a', '', [], 0), ('u', 'I', ['assistant:'], 5), ('s', 'II', ['user:', 'assistant:'], 10)) e(state, letters, inserted, price) using (state)
  where not exists (select 1 from faults f where f.conv_id is not distinct from p.conv_id and f.i = p.i + 1)
  group by conv_id)
select e.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
  coalesce(c.illegal, 0) as illegal, e.best.cost as cost, e.best.audit as audit, sha256(array_to_string(e.best.lines, chr(10))) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id
"""
