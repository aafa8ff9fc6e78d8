"""Conversation repair: cheapest edits against all edit scripts, sharing of layers, damage, odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from codetide.llm import repair as R

GOOD = re.compile(r"(s?(ua)+)?")


def every_script(signature, inserts=2):
    """All ways to edit a signature with at most so many inserted rows in a gap: cost, audit and initials."""
    for plan in itertools.product(*([("", *("u", "a", "ua", "au")[: 2 * inserts])] + [c for s in signature for c in (("D", "K", "Ru", "Ra") if s != "x" else ("D",), ("", *("u", "a", "ua", "au")[: 2 * inserts]))])):
        cost, audit, left = 0, "", ""
        for k, part in enumerate(plan):
            if k % 2 == 0:
                cost, audit, left = cost + 5 * len(part), audit + "I" * len(part), left + part
                continue
            symbol = signature[k // 2]
            audit += part[0]
            cost += {"D": 2, "K": 0, "R": 1}[part[0]] + (5 if part != "D" and symbol.isupper() else 0)
            left += "" if part == "D" else symbol.lower() if part == "K" else part[1]
        if GOOD.fullmatch(left):
            yield cost, audit


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_every_short_signature_against_all_scripts(length):
    trie = R.Trie()
    for signature in sorted(map("".join, itertools.product("suaoSUAOx" if length < 3 else "suaUx", repeat=length))):
        assert trie.answer(signature) == min(every_script(signature)), signature


def test_longer_signatures_against_all_scripts():
    rng = random.Random(3)
    for _ in range(6):
        signature = "".join(rng.choices("suaoUAx", k=5))
        assert R.Trie().answer(signature) == min(every_script(signature, 1))


def test_layers_are_computed_once_for_a_shared_prefix():
    signatures = sorted({"uaua"[:k] + tail for k in range(5) for tail in ("", "x", "xx", "UA")})
    trie = R.Trie()
    alone = [R.Trie().answer(s) for s in signatures]
    assert [trie.answer(s) for s in signatures] == alone
    assert trie.steps == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_long_signature():
    cost, audit = R.Trie().answer("ua" * 50_000 + "x")
    assert (cost, audit) == (2, "K" * 100_000 + "D")


def plain_repair(rows):
    """The contract for one conversation, row by row: rows are (turn, role, text) after damage, in order."""
    seen, signature, faults, before, illegal = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, None, 0
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if fault:
            faults[fault] += 1
        signature += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
    cost, audit = min(every_script(signature)) if len(signature) < 4 else R.Trie().answer(signature)
    out, at, last = [], 0, ""
    for edit in audit:
        wanted = "assistant" if last == "u" else "user"
        if edit == "I":
            out.append(wanted + ":")
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            role = role if edit == "K" else wanted
            out.append(f"{role}:{text}")
        last = out[-1][0]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_damage(conv, turn, role, text):
    said = lambda v: " " if v is None else str(v)
    kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
    role, text = said(role), said(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def run(spark, rows):
    from pyspark.sql import functions as F

    turns = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", F.lit(1)).withColumn("CONV", F.lit("extra")).repartition(3))
    edits = R.cheapest_edits(R.diagnose(turns))
    digests = {r["conv"]: r["sha256"] for r in R.transcripts(R.repaired(turns, edits)).collect()}
    empty = hashlib.sha256().hexdigest()
    found = edits.collect()
    assert len({r["conv"] for r in found}) == len(found)
    return {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], digests.get(r["conv"], empty)) for r in found}


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        out[conv] = plain_repair([d for r in own for d in plain_damage(*r)])
    return out


def test_random_conversations_against_the_plain_way(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!  \n", "Why?", "so it", " \t", "", None, "é…", "一。", "Yes."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "User", "users"]), rng.choice(texts)) for conv in [*range(60), None] for turn in rng.sample(range(30), rng.randint(1, 8))]
    rows += [(1, None, "user", "First."), (77, None, "user", "Alone."), (78, None, None, None)]
    assert run(spark, rows) == expected(rows)


def test_copies_far_apart_and_repeated_rows(spark):
    rows = [(5, turn, "user" if turn % 2 else "assistant", "Same." if turn % 7 == 0 else f"Text {turn}.") for turn in range(200)] + [(5, 300, "user", "Tie."), (5, 300, "user", "Tie.")]
    assert run(spark, rows) == expected(rows)


def test_a_conversation_that_loses_all_rows_keeps_its_line(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table_and_extreme_turns(spark):
    assert run(spark, []) == {}
    turns = [t for t in range(40) if zlib.crc32(f"3:{t}".encode()) % 20 > 4][:1]
    rows = [(3, turns[0], "user", "A" * 300_000 + "."), (3, -(1 << 63), "user", "x."), (3, (1 << 63) - 1, "assistant", "y.")]
    found = run(spark, rows)
    assert found[3][0] <= R.LONGEST_GAP and found[3][5] >= 0


def test_the_real_output_has_whole_rows(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "user", "Cut"), (1, 3, "assistant", "So.")], "conv long, turn long, role string, text string").selectExpr("*", "true as present")
    edits = R.cheapest_edits(R.diagnose(turns))
    assert edits.first()["audit"] == "DKDK"
    assert [tuple(r)[1:] for r in R.repaired(turns, edits).collect()] == [(0, "user", "What?", "K"), (1, "assistant", "So.", "K")]
