import hashlib
import itertools
import random
import re
import zlib

import pytest

from playline.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, stays string, name int"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired text) by trying every way of editing, fewest edits first."""
    best = None

    def go(i, cost, letters, out):
        nonlocal best
        if best and cost > best[0] or len(out) > len(rows) + 3:
            return
        if i == len(rows):
            got = "".join(r[:1] for r, _ in out)
            if LEGAL.fullmatch(got) and (best is None or (cost, letters) < best[:2]):
                best = (cost, letters, "\n".join(f"{r}:{t}" for r, t in out))
        if cost + 3 <= (best[0] if best else 4 * len(rows)) and letters[-2:] != "II":
            for role in ("user", "assistant"):
                go(i, cost + 3, letters + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            if fault not in (C.BLANK, C.TWICE):
                more = 3 if fault == C.TRUNCATED else 0
                if role:
                    go(i + 1, cost + more, letters + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, letters + "R", [*out, (new, text)])
            go(i + 1, cost + 4, letters + "D", out)

    go(0, 0, "", [])
    return best


def plain(rows):
    """(cost, audit) by keeping the whole audit of every node as text."""
    def least(*xs):
        return min(x for x in xs if x)

    def closed(v):
        u, a = v[2], v[3]
        u, a = least(u, a and (a[0] + 3, "I" + a[1])), least(a, u and (u[0] + 3, "I" + u[1]))
        return [least(v[0], (u[0] + 3, "I" + u[1])), least(v[1], (u[0] + 3, "I" + u[1])), u, a]

    v = closed([(0, ""), None, None, (0, "")])
    for role, _, fault in reversed(rows):
        new = []
        for s in range(4):
            ways = [(v[s][0] + 4, "D" + v[s][1])]
            if fault not in (C.BLANK, C.TWICE):
                more = 3 if fault == C.TRUNCATED else 0
                t = v[C.TURN[s]]
                ways.append((t[0] + 3 + more, "R" + t[1]))
                t = C.after(s, role[:1])
                if t is not None:
                    ways.append((v[t][0] + more, "K" + v[t][1]))
            new.append(min(ways))
        v = closed(new)
    return v[0]


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), f"t{k}", rng.choice([0, 0, 0, 0, 1, 2, 4, 4])) for k in range(n)]


def test_audit_is_the_least_of_all_ways():
    rng = random.Random(4)
    for n in [0, 1, 2, 3, 4] * 40:
        rows = some_rows(rng, n)
        cost, letters = C.audit("".join(r[:1] or "-" for r, _, _ in rows), [f for *_, f in rows])
        text = "\n".join(f"{r}:{t}" for r, t in C.repaired(letters, ((r, t) for r, t, _ in rows)))
        assert (cost, letters, text) == cheapest(rows), rows


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "DIGITS", block + 2 * (block + 1) + 1)
    monkeypatch.setattr(C, "TOP", 3 * (C.DIGITS - 1))
    monkeypatch.setattr(C, "WIDTH", 3 * C.DIGITS)
    monkeypatch.setattr(C, "LOW", (1 << C.WIDTH) - 1)
    rng = random.Random(block)
    for n in [*range(9), 63, 64, 65, 128, 200, 411] * 3:
        rows = some_rows(rng, n)
        assert C.audit("".join(r[:1] or "-" for r, _, _ in rows), [f for *_, f in rows]) == plain(rows)


def test_time_follows_the_rows():
    import time

    rows = some_rows(random.Random(1), 60_000)
    a = time.process_time()
    _, letters = C.audit("".join(r[:1] or "-" for r, _, _ in rows), [f for *_, f in rows])
    assert len(letters.replace("I", "")) == len(rows) and time.process_time() - a < 30


def brute(rows):
    """Every conversation by the contract, with the shortest path kept as text."""
    out = []
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        name = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
        left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], name(*x[1:])))
        seen, rated = set(), []
        for _, role, text in left:
            tail = text.strip(" \t\n\v\f\r")[-1:]
            rated.append((role, text, 1 if not tail else 2 if (role, text) in seen else 4 if tail not in ".!?" else 0))
            seen.add((role, text))
        turns = [t for t, *_ in left if t is not None]
        cost, letters = plain(rated)
        fixed = "\n".join(f"{r}:{t}" for r, t in C.repaired(letters, ((r, t) for r, t, _ in rated)))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for *_, f in rated) for k in (1, 2, 4)),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rated)), cost, letters,
                    hashlib.sha256(fixed.encode()).hexdigest()))
    return sorted(out, key=str)


def awkward(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "tool"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2],
             rng.choice(["Yes.", "No", "", " \n", None, "é🙂!", "Why? \t", "a\x85", f"text {t}."]) if rng.random() < 0.6 else f"said {c} {t}.", "x", 1)
            for c in range(40) for t in range(rng.randint(1, 30)) if rng.random() < 0.9]
    rows += [(None, k % 5 or None, "user", f"null {k % 3}.", "x", 1) for k in range(30)]       # no conv_id, equal turns, no turn
    rows += [(77, None, None, None, None, None)] * 3 + [(78, 5, "user", "Same.", "x", 1)] * 4
    rows += [(80, t, ("user", "assistant")[t % 2], "x" * 200_000 + ".", "x", 1) for t in range(3)] + [(c, 3, "user", "One.", "x", 1) for c in range(900, 960)]
    rows += [(81, t, ("user", "assistant")[t % 2], f"long {t}.", "x", 1) for t in range(1500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_matches_plain_version(spark):
    table = awkward(spark)
    got = sorted((tuple(r) for r in C.repair(C.damaged(table)).collect()), key=str)
    assert got == brute([tuple(r) for r in table.collect()])


def test_empty(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
