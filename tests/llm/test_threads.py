"""Quotation threads against brute force: nested quotes, repeated passages, long messages, clashing columns."""

import random
import re
import time

from headwater.llm import chat_threads, queries

WORDS = "hello how are you fine thanks yes No Maybe later today".split()
MARKS = re.compile(r"^(?:[ \t]*>)+")
SAYS = re.compile(r"(?is)^.*\b(?:wrote|writes|said|schrieb|a écrit|escribió):\s*$")


def parsed(text):
    lines = []
    for raw in re.sub(r"\r\n?", "\n", text or "").split("\n"):
        m = MARKS.match(raw)
        lines.append((m[0].count(">") if m else 0, MARKS.sub("", raw).strip(" ")))
    passages, held = [], None
    for level, line in lines:
        if line == "" or held is None or held[0] != level:
            held = None if line == "" else [level, line]
            if held:
                passages.append(held)
        else:
            held[1] += " " + line
    return lines, [(level, re.sub(r"\s+", " ", p).lower().strip()) for level, p in passages]


def brute(messages):
    """(conv_id, turn, text, parent, linked, branch, depth, quotes, unlinked) for messages with one text a turn."""
    own, out = {}, []
    for conv, turn, _, text in sorted(messages):
        for level, p in parsed(text)[1]:
            if level == 0:
                own.setdefault((conv, p), turn)
    previous, branch = {}, {}
    for conv, turn, _, text in sorted(messages):
        lines, passages = parsed(text)
        quotes = {(level, p): own.get((conv, p)) for level, p in passages if level}
        quotes = {k: (o if o is not None and o < turn else None) for k, o in quotes.items()}
        links = [(-level, o) for (level, _), o in quotes.items() if o is not None]
        original = max(links)[1] if links else None
        before = previous.get(conv)
        if before is None or original is not None and original != before:
            branch[conv] = turn
        kept = [line for i, (level, line) in enumerate(lines) if level == 0 and not (i + 1 < len(lines) and lines[i + 1][0] > 0 and SAYS.match(line))]
        said = re.sub(r"\n{3,}", "\n\n", "\n".join(kept).strip()).strip() if any(level for level, _ in lines) else text or ""
        out.append((conv, turn, said, original if original is not None else before, original is not None, branch[conv], max((level for level, _ in quotes), default=0), len(quotes), sum(o is None for o in quotes.values())))
        previous[conv] = turn
    return out


def conversation(rng, conv, n):
    """Messages that quote earlier ones whole, in part, nested, changed in case and white space, or made up."""
    texts, turns = [], sorted(rng.sample(range(5000), n))
    for _ in range(n):
        own = "\n\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 3)))
        parts = []
        for _ in range(rng.randrange(3)):
            source = rng.choice(texts) if texts and rng.random() < 0.8 else "made up words"
            if rng.random() < 0.3:
                source = source.upper().replace(" ", "  ")
            if rng.random() < 0.5:
                parts.append(rng.choice(["On Monday A wrote:", "Il a écrit: ", "just a line:"]))
            mark = rng.choice(["> ", ">", "  > ", ">> ", "> > "])
            parts += [mark + line for line in source.split("\n")]
            if rng.random() < 0.3:
                parts.append("")
        texts.append("\n".join([*parts, own] if rng.random() < 0.8 else [own, *parts, "", "", "", own]))
    return [(conv, t, rng.choice(["user", "assistant"]), x) for t, x in zip(turns, texts)]


def test_threads_equal_brute_force(spark):
    rng = random.Random(1)
    messages = [m for conv in range(25) for m in conversation(rng, conv, rng.randrange(1, 14))]
    rows = [(*m, "clash", 1, "x", "y") for m in messages]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent_turn string, lines int, original string, chat string").repartition(4)
    got = {(r.conv_id, r.turn, r.text, r.parent_turn, r.linked, r.branch_turn, r.quote_depth, r.n_quotes, r.n_unlinked) for r in chat_threads.quotation_threads(docs).collect()}
    want = brute(messages)
    assert sum(w[4] for w in want) > 40 and max(w[6] for w in want) >= 3
    assert got == set(want)


def test_a_long_message_takes_time_in_proportion(spark):
    lines = [f"> line {i} quoted" if i % 3 else "" if i % 2 else f"own line {i}" for i in range(60_000)]
    rows = [(1, 0, "user", "\n".join(x.removeprefix("> ") for x in lines)), (1, 1, "user", "\n".join(lines)), (1, 2, "user", "a " * 200_000 + "said:\n> x")]
    t = time.perf_counter()
    got = sorted(chat_threads.quotation_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert time.perf_counter() - t < 90
    assert got[1].n_quotes > 10_000 and got[1].linked and got[2].text == ""


def test_the_query_reads_quotes(spark):
    rows = queries.op9_chat_threads(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.linked for r in rows) > len(rows) // 4 and max(r.quote_depth for r in rows) == 2
