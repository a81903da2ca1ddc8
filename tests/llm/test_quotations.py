import random
import re
import textwrap

from loomspan.llm.quotations import conversations

SCHEMA = "conv_id long, turn long, role string, text string, row int, hash int, thread string"

A = "Shall we move the release to Friday?\nI would rather test one more day."
B = "Ann wrote:\n> Shall we move the release to Friday?\n\nFriday is fine with me."
C = "> Ann wrote:\n>> I would rather test ONE  more day.\n> Friday is fine with me.\nThen Friday it is, thanks all."
D = "An unrelated question about lunch plans?"
E = "> > not found anywhere at all\n> An unrelated question about lunch plans?\nPizza."


def test_threads(spark):
    rows = [(1, i, "user", t, 1, 1, "x") for i, t in enumerate([A, B, D, C, E])]
    rows += [(2, 0, None, None, 1, 1, "x"), (2, 1, "user", "> Shall we move the release to Friday?\nno", 1, 1, "x"), (None, None, "user", "> a b c\nd", 1, 1, "x"), (2, 1, "user", "", 1, 1, "x")]
    rows += [(3, i, "user", f"> message number {i - 1} of chain\nmessage number {i} of chain", 1, 1, "x") for i in range(40)]
    out = [r for r in conversations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(out) == len(rows)
    one = [(r.turn, r.reply_to, r.thread, r.n_quoted, r.n_linked) for r in out if r.conv_id == 1]
    assert one == [(0, None, 0, 0, 0), (1, 0, 0, 1, 1), (3, 1, 0, 3, 2), (2, None, 2, 0, 0), (4, 2, 2, 2, 1)]
    texts = {r.turn: r.text for r in out if r.conv_id == 1}
    assert texts == {0: A, 1: "Friday is fine with me.", 2: D, 3: "Then Friday it is, thanks all.", 4: "Pizza."}
    two = [(r.turn, r.reply_to, r.thread, r.text) for r in out if r.conv_id == 2]
    assert sorted(two, key=repr) == sorted([(0, None, 0, ""), (1, None, 1, "no"), (1, None, 1, "")], key=repr)
    chain = [r for r in out if r.conv_id == 3]
    assert all(r.thread == 0 and r.reply_to == (r.turn - 1 if r.turn else None) for r in chain)
    assert [r.turn for r in chain] == list(range(40))
    assert next(r.formatted for r in out if r.conv_id == 1 and r.turn == 4) == "<|user|>\nPizza.\n"
    nothing = [r for r in out if r.conv_id is None]
    assert [(r.reply_to, r.thread, r.text) for r in nothing] == [(None, None, "d")]
    assert conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_passages_decide_where_no_longer_one_is_linked(spark):
    texts = ["Is it ready now?", "Yes.", "> yes.\nGood.", "> Yes.\n> Is it ready  now?\nAsked and answered.", "> no\nWhat?", ">> Good.\n> not said anywhere before\nFine."]
    out = conversations(spark.createDataFrame([(1, i, "user", t, 1, 1, "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.turn: (r.reply_to, r.thread, r.n_linked) for r in out} == {0: (None, 0, 0), 1: (None, 1, 0), 2: (1, 1, 1), 3: (0, 0, 2), 4: (None, 4, 0), 5: (2, 1, 1)}


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub(r"^(?:[ \t]*>)+", "", line)).strip().lower()


def level(line):
    return re.match(r"^(?:[ \t]*>)*", line).group().count(">")


def pieces(held):
    text = re.sub(r"(?<=[^\n])\n(?=[^\n])", " ", "\n".join(held))
    return [p for p in dict.fromkeys([*held, *re.split(r"\n+|(?<=[.!?])\s+", text)]) if p]


def brute(rows, least=3):
    first, found = {}, []
    for conv, turn, text in rows:
        lines = re.split("\r?\n", text or "")
        quotes = any(level(x) for x in lines)
        own = [x for x in lines if not level(x) and not (quotes and re.search(r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", x))]
        quoted = [(n, p) for n in sorted({level(x) for x in lines} - {0}) for p in pieces([norm(x) if level(x) == n else "" for x in lines])]
        found.append((conv, turn, quoted, "\n".join(own).strip(" \t\r\n")))
        if conv is not None and turn is not None:
            for p in pieces([norm(x) for x in own]):
                first[conv, p] = min(first.get((conv, p), turn), turn)
    out, up = [], {}
    for conv, turn, quoted, text in found:
        ways = {}
        for n, p in quoted:
            o = first.get((conv, p))
            if o is not None and turn is not None and o < turn:
                w = len(p.split(" "))
                a, b, c = ways.get((n, o), (0, 0, 0))
                ways[n, o] = (a + w, b + (w if w >= least else 0), c + 1)
        best = min(((v[1] == 0, n, -(v[1] or v[0]), -o) for (n, o), v in ways.items()), default=None)
        reply = None if best is None else -best[3]
        if reply is not None:
            up[conv, turn] = min(up.get((conv, turn), reply), reply)
        out.append([conv, turn, text, len(quoted), sum(v[2] for v in ways.values()), reply])
    for r in out:
        at = r[1]
        while (r[0], at) in up:
            at = up[r[0], at]
        r.append(at)
    return sorted(map(tuple, out), key=repr)


def test_against_brute_force(spark):
    """Generated conversations: wrapped, nested, repeated, partly quoted, out of order, and a long one whose root all answer."""
    rng = random.Random(5)
    words = "we ship it on friday after one more test run of the new build please".split()
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rng.randrange(1, 12)):
            lines = []
            for _ in range(rng.randrange(0, 4)):
                if said and rng.random() < 0.7:
                    old = rng.choice(said)
                    marks = rng.choice(["> ", "> > ", ">", ">>", ""])
                    if rng.random() < 0.5:
                        old = "\n".join(textwrap.wrap(old.replace("\n", " "), rng.choice([12, 20, 40])))
                    lines += [marks + x for x in old.split("\n")]
                    if rng.random() < 0.3:
                        lines.insert(0, "Someone wrote:")
            own = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!", "", "\n"]) for _ in range(rng.randrange(0, 4)))
            said.append(own)
            text = "\n".join([*lines, own]) if rng.random() < 0.95 else None
            rows.append((conv if rng.random() < 0.97 else None, turn, text))
    rows += [(99, i, "> A question for all of you.\nanswer" if i else "A question for all of you.") for i in range(300)]
    rows += rows[:5]
    out = conversations(spark.createDataFrame([(c, t, "user", x, 1, 1, "x") for c, t, x in rows], SCHEMA).repartition(3)).collect()
    assert sorted(((r.conv_id, r.turn, r.text, r.n_quoted, r.n_linked, r.reply_to, r.thread) for r in out), key=repr) == brute(rows)


def test_a_quote_that_is_wrapped_anew_is_linked(spark):
    texts = ["I think that we should move the release to Friday, if nobody minds. Otherwise not.", "> I think that we should move the\n> release to Friday, if nobody\n> minds. Otherwise not.\nFine."]
    out = conversations(spark.createDataFrame([(1, i, "user", t, 1, 1, "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert [(r.reply_to, r.thread, r.text) for r in out] == [(None, 0, texts[0]), (0, 0, "Fine.")]
