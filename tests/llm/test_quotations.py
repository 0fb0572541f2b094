"""Quotation linking against a plain Python version on a table that is made up here: the given tables hold no quotes."""

import random
import re

from chronolith.llm import quotations


def normal(x):
    return re.sub(r"\s+", " ", x.lower()).strip()


def passages(text):
    out = []
    for line in text.split("\n"):
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level = marks.count(">")
        if level:
            line = re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, "\n".join(lines)) for level, lines in out]


def pieces(text):
    paragraphs = re.split(r"\n[ \t\r]*\n", text)
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p) if len(s.split()) >= quotations.SENTENCE_WORDS]
    return [(k, n) for k, x in [(3, text), *((2, p) for p in paragraphs), *((1, x) for x in text.split("\n")), *((0, s) for s in sentences)] if (n := normal(x))]


def linked(rows):
    """{(conv_id, turn): (parent, root, depth, n_quotes, n_linked, text)} of messages with one text a turn."""
    first = {}
    for c, t, text in rows:
        for level, body in passages(text):
            for _, n in pieces(body) if level == 0 else []:
                first[c, n] = min(first.get((c, n), t), t)
    parent, counts = {}, {}
    for c, t, text in rows:
        by_level, quotes, found = {}, 0, 0
        for level, body in passages(text):
            if level and normal(body):
                quotes += 1
                votes = {}
                for kind, n in pieces(body):
                    source = first.get((c, n))
                    if source is not None and source < t:
                        k, m = votes.get(source, (0, 0))
                        votes[source] = (max(k, kind), m + 1)
                if votes:
                    found += 1
                    source = max((k, m, s) for s, (k, m) in votes.items())[2]
                    by_level.setdefault(level, []).append(source)
        counts[c, t] = quotes, found
        if by_level:
            own = by_level[min(by_level)]
            parent[c, t] = max(own, key=lambda s: (own.count(s), s))
    out = {}
    for c, t, text in rows:
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = parent[c, root], depth + 1
        own = "\n".join(body for level, body in passages(text) if level == 0).strip(" \t\r\n")
        out[c, t] = (parent.get((c, t)), root, depth, *counts[c, t], own)
    return out


def conversations():
    rng, rows = random.Random(9), []
    say = lambda n: " ".join(rng.choice("the of reader file opens line fails maybe again never write path disk node".split()) for _ in range(n))
    for c, size in enumerate([1, 2, 3, 5, 8, 12, 20, 300]):
        said = []
        for t in range(size):
            own = [f"{say(4).capitalize()} {c} {t}. {say(5).capitalize()}." + ("\n\n" + say(7) if rng.random() < 0.4 else "") + ("\nThanks in advance." if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 3))]
            blocks = []
            for _ in range(rng.randrange(0, 3) if said else 0):
                quote = rng.choice(said)
                how = rng.randrange(6)
                if how == 0:
                    quote = quote.replace(" ", "  ").upper()  # white space and case
                elif how == 1:
                    quote = quote.replace("the", "a")  # edited
                elif how == 2:
                    quote = quote.split(". ")[0] + "."  # a sentence
                elif how == 3:
                    words = quote.split("\n\n")[0].split()
                    quote = "\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3))  # wrapped anew
                mark = rng.choice(["> ", ">", "  > "])
                blocks.append("\n".join(mark + x for x in quote.split("\n")))
                if rng.random() < 0.3:
                    blocks.append("\n".join("> > " + x for x in rng.choice(said).split("\n")))
            if rng.random() < 0.3:
                blocks.append("> Thanks in advance.")  # a line that is quoted all over
            parts = [*blocks, *own]
            rng.shuffle(parts)
            text = "\n".join(parts)
            said.append("\n".join(own))
            rows.append((c, t, text))
    rows += [(50, 0, ""), (50, 1, ">"), (50, 2, "> > \n>x y z\n"), (50, 3, "a " * 30_000 + "\n> nothing of it"), (50, 4, "> " + "a " * 30_000)]
    return rows


def test_quotations_like_plain_python(spark):
    rows = conversations()
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quotes, r.n_linked, r.text) for r in quotations.reply_order(df).collect()}
    want = linked(rows)
    assert sum(x[0] is not None for x in want.values()) > 150 and got == want


def test_several_texts_at_a_turn_and_repeated_rows(spark):
    rows = [(1, 0, "one two three"), (1, 0, "four five six"), (1, 1, "> four five six\nyes"), (1, 1, "> four five six\nyes"), (1, 1, "> never said so\nno"), (1, 1, None)]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = sorted((r.turn, r.text, r.parent_turn, r.n_quotes, r.n_linked) for r in quotations.reply_order(df).collect())
    # All that stands at a turn is one message to others, so its parent is what any of its texts quotes.
    assert got == [(0, "four five six", None, 0, 0), (0, "one two three", None, 0, 0), (1, "", 0, 0, 0), (1, "no", 0, 1, 0), (1, "yes", 0, 1, 1), (1, "yes", 0, 1, 1)]
