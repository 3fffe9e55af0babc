"""Conversation repair against enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

from matchframe.llm import turn_repair as t

GRAMMAR = re.compile(r"(s?(ua)+)?")
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def brute(word):
    """Least (cost, audit) over all edits with up to two insertions in a gap."""
    best = None
    fill = ["", *("".join(p) for k in (1, 2) for p in itertools.product("ua", repeat=k))]
    ways = []
    for c in word:
        keep = [] if c == "x" else [(0, "K", c.lower()), (2, "R", "u"), (2, "R", "a")]
        ways.append([(3, "D", ""), *[(p + c.isupper(), o, s) for p, o, s in keep]])
    spots = [[(2 * len(f), "I" * len(f), f) for f in fill]]
    for w in ways:
        spots += [w, spots[0]]
    for choice in itertools.product(*spots):
        if GRAMMAR.fullmatch("".join(s for _, _, s in choice)):
            got = (sum(p for p, _, _ in choice), "".join(o for _, o, _ in choice))
            best = got if best is None else min(best, got)
    return best


def solve(word, size):
    """The operator's fold over blocks of so many turns."""
    parts = [word[k:k + size] for k in range(0, len(word), size)]
    cost, path = t.fold([t.order_of(t.align(p)) for p in parts])
    audit = "".join(t.align(p)[step][1] for p, step in zip(parts, path))
    return cost, audit + t.TAIL[path[-1][1]]


def test_alignment_against_all_edits():
    words = ["".join(w) for k in (1, 2) for w in itertools.product("suaoSUAx", repeat=k)]
    rng = random.Random(3)
    words += ["".join(rng.choice("suaoSUAOx") for _ in range(3)) for _ in range(25)]
    for w in words:
        want = brute(w)
        for size in (1, 2, 9):
            assert solve(w, size) == want, (w, size)


def plain(word):
    """Least (cost, audit) by plain dynamic programming over grammar states."""
    best = {(t.START): (0, "")}
    after = {(t.START, "s"): t.S, (t.START, "u"): t.U, (t.S, "u"): t.U, (t.U, "a"): t.A, (t.A, "u"): t.U}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for x, (c, a) in list(out.items()):
                y = t.A if x == t.U else t.U
                out[y] = min(out.get(y, (9 ** 9, "")), (c + 2, a + "I"))
        return out
    for ch in word:
        new = {}
        for x, (c, a) in inserted(best).items():
            ways = [(x, c + 3, a + "D")]
            if ch != "x":
                if (x, ch.lower()) in after:
                    ways.append((after[x, ch.lower()], c + ch.isupper(), a + "K"))
                ways.append((t.A if x == t.U else t.U, c + 2 + ch.isupper(), a + "R"))
            for y, cost, audit in ways:
                new[y] = min(new.get(y, (9 ** 9, "")), (cost, audit))
        best = new
    return min(v for x, v in inserted(best).items() if x in (t.START, t.A))


def test_long_conversations_and_blocks():
    rng = random.Random(4)
    for n in (5, 30, 200, 700):
        base = "s" + "ua" * n
        word = "".join(c for c in base[:n] if rng.random() > 0.1)
        word = "".join(rng.choice("suaoxUA") if rng.random() < 0.2 else c for c in word)
        want = plain(word)
        for size in (7, 64, 512):
            assert solve(word, size) == want, (n, size)


def by_hand(rows):
    """Contract columns of one table, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, n, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            turns += [(n, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in turns:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("1" if not ink else "2" if (role, text) in seen else "3" if ink[-1] not in ".!?" else "0")
            seen.add((role, text))
        first = [r[:1] for _, r, _ in turns]
        word = "".join("x" if f in "12" else (i if i in ("s", "u", "a") else "o").upper() if f == "3" else i if i in ("s", "u", "a") else "o" for i, f in zip(first, faults))
        cost, audit = plain(word) if word else (0, "")
        lines, state, at = [], "", 0
        for op in audit:
            expect = "assistant" if state == "u" else "user"
            if op == "I":
                lines.append(f"{expect}:")
                state = expect[0]
            else:
                _, role, text = turns[at]
                at += 1
                if op != "D":
                    role = expect if op == "R" else role
                    lines.append(f"{role}:{text}")
                    state = role[0]
        numbers = [n for n, _, _ in turns if n is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (gaps, faults.count("1"), faults.count("2"), faults.count("3"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, block int, pos string"


def table(rng, n_conv, most):
    rows = []
    for c in range(n_conv):
        for k in range(rng.choice([1, 2, 5, most])):
            role = rng.choice(["system", "user", "tool", "", None]) if rng.random() < 0.15 else ("user", "assistant")[k % 2]
            text = rng.choice(["Yes.", "Why?", "so it goes", "", " \n", None, f"turn {k}!", "é…"])
            rows.append((c, k + rng.choice([0, 0, 0, 1, 7]) if rng.random() > 0.05 else None, role, text))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in t.repair_report(df).collect()}
    assert got == by_hand(rows)


def test_report_against_plain_python(spark):
    rows = table(random.Random(5), 120, 12)
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", None), (7, 0, "user", "again."), (7, 0, "user", "again.")]
    check(spark, rows)


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k % 900}.") for k in range(3000) if rng.random() > 0.05]
    rows += [(2, k, "user", "x" * 200_000 + ".") for k in range(2)] + table(rng, 20, 5)
    check(spark, [r if r[0] in (1, 2) and len(r[3] or "") > 5 else (r[0] + 10, *r[1:]) for r in rows])


def test_repaired_turns_alternate(spark):
    rows = table(random.Random(8), 60, 9)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = {}
    for r in t.Repair(t.damage(df)).turns().orderBy("conv_id", "place").collect():
        found.setdefault(r.conv_id, []).append(r.role[0])
    assert found and all(GRAMMAR.fullmatch("".join(v)) for v in found.values())


def test_empty_table(spark):
    assert t.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
