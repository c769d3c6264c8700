"""Quotation links against plain Python, and the cases that single lines get wrong."""

import random
import re

from pyspark.sql import functions as F

from heddle.llm import chat_format as cf

KIND = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return {(r["conv"], r["turn"], r["level"]): (r["quoted_turn"], r["n_lines"]) for r in cf.quotation_links(df).collect()}


def level_of(line):
    marks = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
    return (marks[1].count(">"), line[marks.end() :].strip(" ")) if marks else (0, line.strip(" "))


def plain(x):
    return re.sub(r"[ \t\n\v\f\r]+", " ", x.lower()).strip(" ")


def slow_passages(text):
    """{level: (passages, lines)} of a text, by walking over its lines."""
    lines = [level_of(x) for x in re.split("\r?\n", text)]
    raw = re.split("\r?\n", text)
    out, runs = {}, []
    for i, (level, line) in enumerate(lines):
        announces = re.search(cf._ANNOUNCES, raw[i]) and i + 1 < len(lines) and lines[i + 1][0] > 0
        if not runs or runs[-1][0] != level:
            runs.append((level, [[]]))
        if line == "":
            runs[-1][1].append([])
        elif not announces:
            runs[-1][1][-1].append(line)
    for level, paragraphs in runs:
        found, single = out.setdefault(level, (set(), set()))
        whole = [plain(" ".join(p)) for p in paragraphs if p]
        found.update([plain(" ".join(x for p in paragraphs for x in p)), *whole, *(s for w in whole for s in re.split(r"(?<=[.!?]) ", w))])
        single.update(plain(x) for p in paragraphs for x in p)
        found.update(single)
    return {level: (found - {""}, single - {""}) for level, (found, single) in out.items()}


def slow_links(rows):
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        cut = {}
        for c, turn, _, text in rows:
            if c == conv and turn is not None and text is not None:
                for level, (found, single) in slow_passages(text).items():
                    old = cut.setdefault(turn, {}).setdefault(level, (set(), set()))
                    old[0].update(found)
                    old[1].update(single)
        said = {turn: levels.get(0, (set(), set()))[0] for turn, levels in cut.items()}
        for turn, levels in cut.items():
            for level, (found, single) in levels.items():
                score = {}
                for p in found if level else ():
                    sayers = [t for t in said if p in said[t]]
                    before = [t for t in sayers if t < turn]
                    if before:
                        alone, weight = score.get(max(before), (0, 0))
                        score[max(before)] = (alone + (len(sayers) == 1), weight + (1 << 20) // len(sayers))
                if score:
                    best = max(score, key=lambda t: (*score[t], t))
                    out[conv, turn, level] = (best, len(single & said[best]))
    return out


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma.", "delta?", "eps", "zeta!"]
    rows = []
    for conv in range(6):
        told = []
        for turn in range(14):
            lines = []
            if told and rng.random() < 0.6:
                source = rng.choice(told).split("\n")
                a = rng.randrange(len(source))
                lines += (["On Monday Ann wrote:"] if rng.random() < 0.3 else []) + [">" * rng.randint(1, 2) + " " + x for x in source[a : a + rng.randint(1, 5)]]
            lines += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 4))] + rng.choice([[], ["regards", "Ann"], ["", "thanks"]])
            told.append("\n".join(lines))
            rows.append((conv, turn * 700, "user", told[-1]))
    rows += [rows[5], (None, 1, "user", "> eps"), (0, None, "user", "eps"), (0, 99_999, "user", None), (1, 99_999, "user", "")]
    want = slow_links(rows)
    assert linked(spark, rows) == want and len(want) > 30 and {k[2] for k in want} >= {1, 2}


def test_shared_lines_pull_no_quote(spark):
    sign = "regards\nAnn\n555"
    rows = [(1, 0, "u", f"hello\n{sign}"), (1, 1, "u", "other"), (1, 2, "u", f"the unique claim\n{sign}"), (1, 3, "u", "\n".join(f"> {x}" for x in f"the unique claim\n{sign}".split("\n"))), (1, 4, "u", f"more\n{sign}"), (1, 5, "u", f"> the unique claim\n> {sign.replace(chr(10), chr(10) + '> ')}\nno")]
    got = linked(spark, rows)
    assert got[1, 3, 1] == (2, 4) and got[1, 5, 1] == (2, 4)


def test_wrapped_and_partial_quotes(spark):
    text = "The first sentence goes on for a while and ends here. A second one\nfollows it at once. And a third."
    rows = [(1, 0, "u", "unrelated"), (1, 1, "u", text), (1, 2, "u", "> The first sentence goes on\n> for a while and ends here. A second\n> one follows it at once. And a third.\nyes"), (1, 3, "u", "> A second one follows\n> it at once.\nno"), (1, 4, "u", "> something else entirely")]
    assert {k[1]: v[0] for k, v in linked(spark, rows).items()} == {2: 1, 3: 1}


def test_hot_conversation_stays_linear(spark):
    n = 3 * cf.BLOCK
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.concat(F.when(F.col("id") % 2 == 1, F.concat(F.lit("> claim "), (F.col("id") - 1).cast("string"), F.lit("\n> thanks\n"))).otherwise(""), F.lit("claim "), F.col("id").cast("string"), F.lit("\nthanks")).alias("text"))
    out = cf.formatted(rows)
    assert out.where("turn % 2 = 1 and reply_to = turn - 1").count() == n // 2 and out.count() == n


def test_long_and_empty_messages(spark):
    long = "\n".join(f"line {i} of it" for i in range(20_000))
    rows = [(1, 0, "u", long), (1, 1, "u", "\n".join(f"> line {i} of it" for i in range(5000, 15_000)) + "\n"), (1, 2, "u", ""), (1, 3, "u", ">\n>  \n> > "), (1, 4, "u", None)]
    got = {r["turn"]: (r["reply_to"], r["text"]) for r in cf.formatted(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {0: (None, long), 1: (0, ""), 2: (None, ""), 3: (None, ""), 4: (None, None)}
