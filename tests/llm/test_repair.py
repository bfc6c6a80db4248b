"""Conversation repair against a plain search over edits, and its trie."""

import hashlib
import itertools
import re
import zlib
from heapq import heappop, heappush

import pytest

from corpusloom.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?")
LETTERS = "xsuaoSUAO"


def cheapest(signature):
    """Uniform-cost search over (row, roles so far), edits compared as strings."""
    heap, limit = [(0, "", 0, "")], 3 * len(signature)
    while heap:
        cost, edits, at, roles = heappop(heap)
        if at == len(signature) and PATTERN.fullmatch(roles):
            return cost, edits
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        for role in "ua":
            if cost + 2 <= limit:
                heappush(heap, (cost + 2, edits + "I", at, roles + role))
        if at < len(signature):
            letter = signature[at]
            heappush(heap, (cost + 3, edits + "D", at + 1, roles))
            if letter != "x":
                extra = letter.isupper()
                if letter.lower() in "sua":
                    heappush(heap, (cost + extra, edits + "K", at + 1, roles + letter.lower()))
                for role in "ua":
                    heappush(heap, (cost + 2 + extra, edits + "R", at + 1, roles + role))


def test_every_short_signature():
    trie, seen = repair.Trie(), 0
    for signature in sorted("".join(x) for n in range(4) for x in itertools.product(LETTERS, repeat=n)):
        assert trie.repaired(signature) == cheapest(signature), signature
        seen += len(signature)
    # a layer for each node of the trie, not for each letter read
    assert trie.computed == sum(len(LETTERS) ** n for n in range(1, 4)) < seen


def test_longer_signatures_and_shared_prefixes():
    trie = repair.Trie()
    for signature in sorted(["uaua", "suauxaua", "ssuu", "uuaaUA", "oxoxo", "auauaus"]):
        assert trie.repaired(signature) == cheapest(signature)
    long = "ua" * 20_000
    trie = repair.Trie()
    assert trie.repaired(long + "u") == (2, "K" * 40_001 + "I") and trie.computed == 40_001
    assert trie.repaired(long + "us") == (2, "K" * 40_001 + "R") and trie.computed == 40_002


def brute(rows):
    """{conv_id: row} in plain Python."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        spaced = lambda v: " " if v is None else str(v)
        k, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, letters, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(letters)
        body = "\n".join(f"{r}:{t}" for r, t in repair.repaired_rows(audit, [(r, t) for _, r, t in own]))
        yield conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()


def test_conversations_against_brute_force(spark):
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Hi.", "so?", "cut", " ", None, "a.b! \n", "é🎉.", ""]
    rows = [(c, None if (c + t) % 11 == 5 else t * (1 + c % 3), roles[(c * 5 + t * 3) % 7], texts[(c + t * t) % 8]) for c in range(60) for t in range(c % 6)]
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (900, None, "user", "a."), (900, None, "assistant", "b."), (901, 1, "user", "Same."), (901, 1, "user", "Same.")]
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)  # its only row is dropped
    rows.append((gone, 0, "user", "Hi."))
    table = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(5)
    got = {r[0]: tuple(r) for r in repair.repaired(table, repair.damaged(table)).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert [(got[k], want[k]) for k in want if got.get(k) != want[k]] == [] and len(got) == len(want)
    assert got[gone] == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and len({r[6] for r in got.values()}) > 5


def test_messy_and_empty_tables(spark, tables):
    full, empty = tables
    rows = repair.op11_structure_repair(spark, full).collect()
    source = spark.read.parquet(f"{full}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert {tuple(r) for r in rows} == set(brute([tuple(r) for r in source]))
    assert repair.op11_structure_repair(spark, empty).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_one_signature_of_most_conversations(spark, parts):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}.") for c in range(400) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    assert all(r.audit == "KKKK" and r.cost == 0 for r in repair.repaired(table, table).collect())
