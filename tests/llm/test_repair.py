"""Conversation repair against a plain table over all prefixes, and against all edit sequences of short ones."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import repair

FITS = re.compile(r"(s?(ua)+)?\Z")
RND = random.Random(11)


def brute(rows):
    """counts, cost, audit and repaired lines of one conversation's rows (turn, role, text), in order."""
    seen, steps, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        steps.append((role, text, fault))
    # best[state]: least (cost, audit, lines) of the rows so far, the state being the last initial put out

    def put(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    def inserted(best):
        out, again = dict(best), list(best.items())
        while again:
            state, (cost, audit, lines) = again.pop()
            for role in ("user", "assistant"):
                if to := put(state, role[0]):
                    way = cost + 2, audit + "I", [*lines, f"{role}:"]
                    if to not in out or way[:2] < out[to][:2]:
                        out[to] = way
                        again.append((to, way))
        return out

    best = {"": (0, "", [])}
    for role, text, fault in steps:
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            ways = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways += [(put(state, role[:1]), (cost + more, audit + "K", [*lines, f"{role}:{text}"]))]
                ways += [(put(state, r[0]), (cost + 2 + more, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant")]
            for to, way in ways:
                if to is not None and (to not in new or way[:2] < new[to][:2]):
                    new[to] = way
        best = new
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, lines


def ordered(rows):
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield conv, turn, "user" if kind == 4 else role, text
        if kind == 3:
            yield conv, turn, role, text


ROLES = ["system", "user", "assistant", "tool", "", None]
TEXTS = ["Hello.", "Why?", "cut off", " \n", "", None, "x! \t", "yes.", "no"]


def conversation(n):
    return [(RND.choice([None, *range(n)]), RND.choice(ROLES[:3] * 4 + ROLES), RND.choice(TEXTS)) for _ in range(n)]


CASES = {i: conversation(RND.randint(0, 9)) for i in range(120)} | {500: [(t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(40)], 501: [(3, "user", "same.")] * 70, 502: conversation(400), None: conversation(12)}


def test_search_against_all_edit_sequences():
    for _ in range(150):
        steps = [(RND.choice("suat"), RND.choice([0, 0, 0, 1]), False) for _ in range(RND.randint(0, 4))]
        steps = [(s, g, not g and RND.random() < 0.4) for s, g, _ in steps]
        entry, size = RND.randrange(4), sum(max(1, g) for _, g, _ in steps)
        singles = [(s, bool(g), c) for s, g, c in steps for _ in range(max(1, g))]
        want = {}
        for audit in ("".join(x) for k in range(size, size + 4) for x in itertools.product("DIKR", repeat=k)):
            state, cost, at, fine = entry, 0, 0, not audit.endswith("I")
            for edit in audit if fine else "":
                if edit == "I":
                    state, cost = repair.PUTS[state][1], cost + 2
                    continue
                if at == size:
                    fine = False
                    break
                initial, must, cut = singles[at]
                at += 1
                if edit == "D":
                    cost += 3
                elif must or edit == "K" and (state, initial) not in repair.KEEPS:
                    fine = False
                    break
                else:
                    state, cost = (repair.KEEPS[state, initial], cost + cut) if edit == "K" else (repair.PUTS[state][1], cost + 2 + cut)
            if fine and at == size:
                want[state] = min(want.get(state, (99, "")), (cost, audit))
        got = repair.search(steps, entry)
        assert {s: w for s, w in got.items() if len(w[1]) < size + 4} == {s: w for s, w in want.items() if s in got and len(got[s][1]) < size + 4}


@pytest.mark.parametrize("block", [1024, 3])
def test_conversations_rows_and_digest(spark, block):
    turns = spark.createDataFrame([(c, t, r, x, 1, "k") for c, rows in CASES.items() for t, r, x in rows], "conv_id long, turn long, role string, text string, a int, b string").toDF("conv_id", "turn", "role", "text", "at", "TEXT").repartition(4)
    found = repair.Repair(turns, block=block)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in found.conversations().collect()}
    want = {c: brute(ordered(rows)) for c, rows in CASES.items() if rows}
    assert got == {c: w[:-1] for c, w in want.items()}
    lines = collections.defaultdict(list)
    for r in sorted(found.rows().collect(), key=lambda r: (r.at, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert (r.edit == "I") <= (r.text == "")
    assert {c: w[-1] for c, w in want.items() if w[-1]} == lines
    assert all(FITS.match("".join(x[:1] for x in own)) for own in lines.values())
    hashes = {r.conv_id: r.repaired_sha256 for r in found.digest().collect()}
    assert hashes == {c: hashlib.sha256("\n".join(own).encode()).hexdigest() for c, own in lines.items()}


def test_query_rows_with_damage(spark):
    rows = [(c, t, r, x) for c, own in CASES.items() for t, r, x in own] + [(7000 + i, 0, "user", "alone.") for i in range(60)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    own = collections.defaultdict(list)
    for c, t, r, x in damaged(rows):
        own[c].append((t, r, x))
    want = {}
    for c in {r[0] for r in rows}:
        *found, lines = brute(ordered(own[c]))
        want[c] = (*found, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert got == want and any(not own[c] for c in want)
    assert repair.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
