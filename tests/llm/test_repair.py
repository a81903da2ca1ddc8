import hashlib
import random
import re
import zlib

import pytest

from loomspan.llm.repair import Repair, damaged, repair, with_faults

SCHEMA = "conv_id long, turn long, role string, text string, fault int, dropped string, kind double"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def broken(rows):
    """Rows after damage, by conversation, in order."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(k, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, k in found.items()}


def judged(rows):
    seen, out = set(), []
    for turn, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, text) by trying every edit: a search by cost over all sequences of edits, with inserts anywhere."""
    best = None
    limit = 2 * len(rows)  # deleting all
    def go(i, roles, lines, cost, audit):
        nonlocal best
        if cost > (best[0] if best else limit):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(lines))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if len(roles) < 2 * len(rows) + 2 and re.fullmatch("s?(ua)*u?", roles + initial):
                go(i, roles + initial, [*lines, f"{name}:"], cost + 5, audit + "I")
        if i == len(rows):
            return
        _, role, text, fault = rows[i]
        go(i + 1, roles, lines, cost + 2, audit + "D")
        if fault not in ("blank", "duplicate"):
            more = 5 if fault else 0
            for initial, name, price, letter in ((role[:1], role, 0, "K"), ("u", "user", 1, "R"), ("a", "assistant", 1, "R")):
                if initial and re.fullmatch("s?(ua)*u?", roles + initial):
                    go(i + 1, roles + initial, [*lines, f"{name}:{text}"], cost + price + more, audit + letter)
    go(0, "", [], 0, "")
    return best


def plain(rows):
    out = []
    for conv, kept in broken(rows).items():
        kept = judged(kept)
        turns = [r[0] for r in kept if r[0] is not None]
        faults = [sum(r[3] == f for r in kept) for f in ("blank", "duplicate", "truncated")]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        cost, audit, text = cheapest(kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 1.0) for r in rows], SCHEMA)
    out = repair(with_faults(damaged(table)))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_every_conversation_is_repaired_as_by_trying_all_edits(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No", "What? ", "", " \t\n", "Yes.", "Fine! ", "é.", None, "a.\x0b", "?"]
    roles = ["user", "assistant", "system", "tool", "ux", "", None, "user", "assistant"]
    rows = []
    for conv in [None, *range(120)]:
        for i in range(rng.randint(1, 5)):
            rows.append((conv, rng.choice([None, i, i, i, i + 3, 2]), rng.choice(roles), rng.choice(texts)))
    assert ours(spark, rows) == plain(rows)


def test_defined_results(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(3)))
    long = "word " * 200000 + "end."
    out = {r[0]: r[1:] for r in ours(spark, [(gone, 0, "user", "Hi."), (whole, 0, "system", "Be brief."), (whole, 1, "user", long), (whole, 2, "assistant", "Yes!")])}
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY_SHA)
    assert out[whole] == (0, 0, 0, 0, 0, 0, "KKK", hashlib.sha256(f"system:Be brief.\nuser:{long}\nassistant:Yes!".encode()).hexdigest())
    assert ours(spark, []) == []


@pytest.mark.parametrize("n", [4, 500, 5000])
def test_long_conversations_keep_little(n):
    rng, way = random.Random(n), Repair()
    rows = [(i, rng.choice(["user", "assistant", "assistant", "system"]), f"{i}.", rng.choice([None, None, "blank", "truncated"])) for i in range(n)]
    for row in rows:
        way.row(*row)
        assert max(len(w[1]) for w in way.ways.values()) < 600
    *_, cost, audit, digest = way.result()
    # the audit, applied, gives a right order at that cost
    roles, lines, paid, left = "", [], 0, iter(rows)
    for letter in audit:
        if letter == "I":
            name, text, paid = "assistant" if roles.endswith("u") else "user", "", paid + 5
        else:
            _, role, text, fault = next(left)
            paid += {"K": 0, "R": 1, "D": 2}[letter] + (5 if fault == "truncated" and letter != "D" else 0)
            assert letter == "D" or fault != "blank"
            if letter == "D":
                continue
            name = role if letter == "K" else "assistant" if roles.endswith("u") else "user"
        roles += name[0]
        lines.append(f"{name}:{text}")
    assert next(left, None) is None and re.fullmatch("(s?(ua)+)?", roles) and paid == cost
    assert digest == hashlib.sha256("\n".join(lines).encode()).hexdigest()
