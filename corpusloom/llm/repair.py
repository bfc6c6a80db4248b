"""Conversation structure repair: cheapest edits by dynamic programming over a prefix trie of signatures.

A conversation becomes a *signature*, one letter a row: the role's initial
(``s u a``, ``o`` for any other role), in upper case if the row is truncated,
or ``x`` if it is blank or a duplicate and must go. Signatures are sorted, so
those that share a prefix follow one another, and a task walks the trie of its
share of them: the path from the root to the present signature is a stack of
DP layers (least cost for each state of the pattern ``(s?(ua)+)?``). Of the
next signature only the layers beyond the common prefix are computed. At a
terminal node the edits are traced, the least in ASCII among the cheapest.

Nothing is gathered: rows of a conversation stream through a task in order,
once to tell the signature and once, after the edits are known, to hash the
repaired text. Signatures are dealt by range of (signature, hash of the
conversation), so one that very many conversations share is many tasks' work.
The task that reads one conversation holds one letter a row of it.

Defined cases: null ids, turns, roles and texts are one space where they are
hashed or repaired; a null id is a conversation of its own; rows of equal turn
are ordered by role, then text; an empty role is of no kind (it is neither
kept nor legal beside others); turns that all are null give no gaps; a
conversation without rows after the damage has zeros, no edits and the hash of
the empty string; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import read_table, stored

SPACE = r"\x20\x09-\x0D"
#: Costs of the edits, and what a truncated row adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a. Where keeping a letter leads, and where a user or assistant turn leads.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
FOLLOWS = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (EMPTY, ASSISTANT)
NEVER = 1 << 60
#: Of the rows of a conversation; ascending order has nulls first.
ORDER = ["turn", "role", "text", "seen"]
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def moves(letter: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, next state, cost) of a row in a state, edits in ASCII order."""
    yield "D", state, DELETE
    if letter != "x":
        extra = TRUNCATED if letter.isupper() else 0
        kept = KEEPS[letter.lower()].get(state)
        if kept is not None:
            yield "K", kept, extra
        yield "R", FOLLOWS[state], REROLE + extra


def inserted(layer: list[int]) -> list[int]:
    """The layer after any number of inserts, of which two are enough: they only alternate."""
    layer = list(layer)
    for state in (EMPTY, SYSTEM, ASSISTANT, USER):
        layer[FOLLOWS[state]] = min(layer[FOLLOWS[state]], layer[state] + INSERT)
    return layer


def advanced(layer: list[int], letter: str) -> list[int]:
    out = [NEVER] * 4
    for state, cost in enumerate(layer):
        if cost < NEVER:
            for _, to, more in moves(letter, state):
                out[to] = min(out[to], cost + more)
    return inserted(out)


class Trie:
    """The path of the present signature: one layer of costs for each letter read."""

    def __init__(self) -> None:
        self.path, self.layers, self.computed, self.answer = "", [inserted([0, NEVER, NEVER, NEVER])], 0, (0, "")

    def repaired(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; signatures come sorted."""
        if signature == self.path:
            return self.answer
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            self.layers.append(advanced(self.layers[-1], letter))
            self.computed += 1
        self.path, self.answer = signature, self._traced(signature)
        return self.answer

    def _traced(self, signature: str) -> tuple[int, str]:
        layers = self.layers
        best = min(layers[-1][s] for s in ACCEPTED)
        # from the end: states that lie on a cheapest way
        on = [set() for _ in layers]
        on[-1] = {s for s in ACCEPTED if layers[-1][s] == best}
        for d in range(len(layers) - 1, -1, -1):
            for _ in range(2):
                on[d] |= {s for s, to in FOLLOWS.items() if to in on[d] and layers[d][s] + INSERT == layers[d][to]}
            if d:
                on[d - 1] = {s for s in range(4) if any(to in on[d] and layers[d - 1][s] + cost == layers[d][to] for _, to, cost in moves(signature[d - 1], s))}
        # from the start: the least letter that stays on one
        d, state, edits = 0, EMPTY, []
        while True:
            ways = []
            if d < len(signature):
                ways = [(edit, d + 1, to) for edit, to, cost in moves(signature[d], state) if to in on[d + 1] and layers[d][state] + cost == layers[d + 1][to]]
            to = FOLLOWS[state]
            if to in on[d] and layers[d][state] + INSERT == layers[d][to]:
                ways.append(("I", d, to))
            if not ways:
                return best, "".join(edits)
            edit, d, state = min(ways)
            edits.append(edit)


def repaired_rows(edits: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) rows that the edits leave; reads each row once."""
    rows, state = iter(rows), EMPTY
    for edit in edits:
        if edit == "I":
            state = FOLLOWS[state]
            yield NAMES[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEEPS[role[0]][state]
            yield role, text
        elif edit == "R":
            state = FOLLOWS[state]
            yield NAMES[state], text


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the contract's faults planted by the checksum of ``conv_id:turn``."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _letter(role: Column, must_go: Column, cut: Column) -> Column:
    initial = F.left(role, F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(must_go, "x").when(cut, F.upper(kind)).otherwise(kind)


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``seen`` (an equal row comes before), ``fault`` (blank, duplicate, truncated or null) and ``letter``."""
    hashes = [F.xxhash64("role", "text", F.lit(s)).alias(f"h{s}") for s in (1, 2)]
    alike = Window.partitionBy("conv_id", "h1", "h2").orderBy("turn")
    rows = rows.select("*", *hashes).withColumn("seen", F.row_number().over(alike) > 1).drop("h1", "h2")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    fault = F.when(blank, "blank").when(F.col("seen"), "duplicate").when(cut, "truncated")
    must_go = F.coalesce(fault.isin("blank", "duplicate"), F.lit(False))
    return rows.withColumn("fault", fault).withColumn("letter", _letter(F.col("role"), must_go, F.coalesce(fault == "truncated", F.lit(False))))


def _streamed(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch[c].tolist() for c in columns])


def _by_key(rows: Iterator[tuple]) -> Iterator[tuple[str | None, Iterator[tuple]]]:
    """(key, its rows) of rows that come sorted by key, without holding them; the rows of a key must be read before the next key."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own(key=key) -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        yield key, own()


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def told() -> Iterator[tuple]:
        for key, rows in _by_key(_streamed(batches, ["key", "kind", "turn", "initial", "fault", "letter"])):
            letters, count = [], dict.fromkeys(COUNTS, 0)
            before = first = last = None
            turns = 0
            for _, kind, turn, initial, fault, letter in rows:
                if not kind:
                    continue
                letters.append(letter)
                if fault:
                    count[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    count["illegal"] += 1
                before = initial
                if turn:  # as text, since pandas has no whole numbers with nulls
                    turn = int(turn)
                    turns += turn != last
                    first, last = turn if first is None else first, turn
            count["gaps"] = last - first + 1 - turns if turns else 0
            yield (key, *[count[c] for c in COUNTS], "".join(letters))

    yield from _frames(told(), ["key", *COUNTS, "signature"])


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = Trie()
    for batch in batches:
        found = [trie.repaired(s) for s in batch["signature"]]
        yield batch.drop(columns="signature").assign(cost=[c for c, _ in found], audit=[a for _, a in found])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["key", "known", *COUNTS, "cost", "role", "text"]

    def told() -> Iterator[tuple]:
        for key, rows in _by_key(_streamed(batches, columns)):
            _, _, *numbers, audit, _ = next(rows)  # what is known of a conversation comes before its rows
            digest, first = hashlib.sha256(), True
            for role, text in repaired_rows(audit, (r[-2:] for r in rows)):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
            for _ in rows:  # rows that no edit asks for, of which there are none
                pass
            yield (key, *map(int, numbers), audit, digest.hexdigest())

    yield from _frames(told(), ["key", *COUNTS, "cost", "audit", "repaired_sha256"])


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For every conv_id of ``conversations``: counts, cost, edits and the repaired text's hash of its ``rows`` (conv_id, turn, role, text)."""
    key = F.col("conv_id").cast("string").alias("key")
    numbers = ", ".join(f"{c} long" for c in COUNTS)
    rows = faults(rows)
    marks = conversations.select("conv_id").distinct()
    named = marks.select(key, F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("seen", "boolean"), ("fault", "string"), ("letter", "string"))])
    asked = named.union(rows.select(key, F.lit(1), "turn", "role", "text", "seen", "fault", "letter"))
    asked = asked.repartition("key").sortWithinPartitions("key", "kind", *ORDER)
    asked = asked.select("key", "kind", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn"), F.left("role", F.lit(1)).alias("initial"), "fault", "letter")
    told = stored(asked.mapInPandas(_signatures, f"key string, {numbers}, signature string"), "signatures")

    dealt = told.repartitionByRange("signature", F.xxhash64("key")).sortWithinPartitions("signature")
    known = stored(dealt.mapInPandas(_answers, f"key string, {numbers}, cost long, audit string"), "edits")

    none = [F.lit(0).cast("long").alias(c) for c in (*COUNTS, "cost")]
    first = known.select("key", F.lit(True).alias("known"), *COUNTS, "cost", F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit("").alias("text"), F.lit(False).alias("seen"))
    both = first.union(rows.select(key, F.lit(False), *none, "turn", "role", "text", "seen"))
    both = both.repartition("key").sortWithinPartitions("key", F.desc("known"), *ORDER)
    out = both.select("key", "known", *COUNTS, "cost", "role", "text").mapInPandas(_hashes, f"key string, {numbers}, cost long, audit string, repaired_sha256 string")
    return out.select(F.col("key").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *COUNTS, "cost", "audit", "repaired_sha256")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(conversations, damaged(conversations))


_LEAST = "list_min([{}])"
_STEP = lambda state, cost, edit: f"struct_pack(c := {state}.c + {cost}, w := {state}.w || '{edit}')"
_ONLY = lambda letter, x: f"case when low = '{letter}' then {x} end"
_NOT_X = lambda x: f"case when low <> 'x' then {x} end"
_ONTO_USER = ", ".join(f"{_ONLY('u', _STEP(s, 'cut', 'K'))}, {_NOT_X(_STEP(s, '2 + cut', 'R'))}" for s in "esa")
#: The checksum bit by bit, rows numbered, a recursion over rows with the best (cost, edits) of each state, and edits laid over the rows again.
ORACLE = f"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: unicode(x)::ubigint) as b from conversations),
z as (select * exclude b, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda h, x: list_reduce(list_prepend(xor(h, x), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, y: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)), 4294967295::ubigint) % 20 as k from k),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy from z where k <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos from d),
f as (select *, left(role, 1) as ini, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core, row_number() over (partition by conv_id, role, text order by pos) > 1 as seen from o),
g as (select *, case when core = '' then 'blank' when seen then 'duplicate' when right(core, 1) not in ('.', '!', '?') then 'truncated' end as fault, lag(ini) over (partition by conv_id order by pos) || ini as two from f),
r as (select *, case when fault in ('blank', 'duplicate') then 'x' when ini in ('s', 'u', 'a') then ini else 'o' end as low, (fault is not distinct from 'truncated')::int as cut from g),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where two not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
t as (
  select conv_id, 0::bigint as i, struct_pack(c := 0, w := '') as e, struct_pack(c := 1000000000, w := '') as s, struct_pack(c := 2, w := 'I') as u, struct_pack(c := 4, w := 'II') as a from n
  union all
  select conv_id, i, e, s, u, {_LEAST.format("a, " + _STEP('u', '2', 'I'))} from (
    select conv_id, i, e, s, {_LEAST.format("u, " + ", ".join(_STEP(s, '2', 'I') for s in 'esa'))} as u, a from (
      select conv_id, pos as i, {_STEP('e', '3', 'D')} as e, {_LEAST.format(_STEP('s', '3', 'D') + ", " + _ONLY('s', _STEP('e', 'cut', 'K')))} as s,
        {_LEAST.format(_STEP('u', '3', 'D') + ", " + _ONTO_USER)} as u, {_LEAST.format(_STEP('a', '3', 'D') + ", " + _ONLY('a', _STEP('u', 'cut', 'K')) + ", " + _NOT_X(_STEP('u', '2 + cut', 'R')))} as a
      from t join r using (conv_id) where pos = i + 1))),
b as (select n.*, {_LEAST.format("e, a")} as x from t join n using (conv_id) where i = n),
l as (select conv_id, unnest(string_split(x.w, '')) as edit, generate_subscripts(string_split(x.w, ''), 1) as p from b where x.w <> ''),
q as (select *, count(*) filter (where edit <> 'I') over (partition by conv_id order by p) as pos, count(*) filter (where edit <> 'D') over (partition by conv_id order by p) as m from l),
v as (select q.*, role, text, first_value(edit = 'K' and ini = 's') over (partition by q.conv_id order by edit = 'D', p) as sys from q left join r on r.conv_id = q.conv_id and r.pos = q.pos and edit <> 'I'),
h as (select conv_id, string_agg(case when edit = 'K' then role when (m - sys::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by p) as body from v where edit <> 'D' group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(x.c, 0)::bigint as cost, coalesce(x.w, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join b using (conv_id) left join h using (conv_id)
"""
