"""Mixing, secrets, licences and chat formatting against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from heddle.llm import chat_format, licenses, mixing, secrets


def targets(sizes):
    """Shares by weight with the excess over three times a source shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] >= 3 * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.fixture(scope="module")
def mixed_docs():
    rng = random.Random(6)
    rows = []
    for s, n in (("b", 400), ("a", 300), ("é", 12), (None, 40), ("Z", 1200), ("one", 1), ("none", 3)):
        for _ in range(n):
            words = 0 if s == "none" else rng.choice((1, 3, 10, 40, 200))
            rows.append((len(rows), s, None if words == 0 and rng.random() < 0.5 else "\t".join(f"w\x1cx{k}" for k in range(words))))
    return rows


def test_mix(spark, mixed_docs):
    df = spark.createDataFrame(mixed_docs, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as rank", "3 as h", "4 as draws")
    got = {r["id"]: r for r in mixing.mix(df, levels=2, block_words=128).collect()}
    again = {r["id"]: r for r in mixing.mix(df.repartition(7), levels=2, block_words=128).collect()}
    assert got == again and len(got) == len(mixed_docs)
    source = {i: s for i, s, _ in mixed_docs}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in mixed_docs}
    totals = Counter()
    for i, s in source.items():
        totals[s] += size[i]
    want = targets(dict(totals))
    taken = defaultdict(int)
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], totals[source[i]]) and abs(r["target"] - want[source[i]]) < 1e-6 * (1 + r["target"])
        assert len(r["draws"]) <= 3 and (r["size"] > 0 or not r["draws"])
        taken[source[i]] += r["size"] * len(r["draws"])
    for s, t in want.items():
        # Within half a document: of the smallest class for sources with small documents.
        assert abs(taken[s] - t) <= (100.5 if s == "one" else 5.5), (s, taken[s], t)
    shards = Counter(d["shard"] for r in got.values() for d in r["draws"] for _ in range(r["size"]))
    assert set(shards) == {0, 1, 2, 3} and max(shards.values()) < 1.3 * min(shards.values())
    assert mixing.mixed_shards(mixing.mix(df, levels=2)).count() == sum(len(r["draws"]) for r in got.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_rows_are_whole_rows(spark, mixed_docs):
    df = spark.createDataFrame([*mixed_docs, (None, "b", "x y z")], "doc_id long, source string, text string")
    times = {r["id"]: len(r["draws"]) for r in mixing.mix(df).collect()}
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({i: n for i, n in times.items() if n})


def test_splitting_tree_is_exact(spark):
    blocks = [(0, 17), (1, 0), (2, 900), (3, 5), (4, 40000)]
    rows = mixing.splitting_tree(spark.createDataFrame(blocks, "rank int, n long"), 3).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        assert r["quota"] >= 0
        per_source[r["rank"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
    assert per_source == Counter(dict(blocks)) and len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 3


def test_hypergeometric_draws(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for total, marked, drawn in ((50, 20, 25), (10, 10, 4), (10, 0, 4), (9, 5, 9), (1000, 3, 500)):
        got = [r[0] for r in u.select(mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), F.col("u"))).collect()]
        assert min(got) >= max(0, drawn + marked - total) and max(got) <= min(drawn, marked)
        assert abs(sum(got) / len(got) - drawn * marked / total) < 0.01
        p = marked / total
        spread = drawn * p * (1 - p) * (total - drawn) / max(total - 1, 1)
        assert abs(sum((g - drawn * p) ** 2 for g in got) / len(got) - spread) < 0.02 * (1 + spread)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark):
    rng = random.Random(7)
    bits = ["password", "Token", "token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123", "deadbeef", "0123456789abcdef", "é", "\U0001f600", "x", "-", "\n", "abcdef", "a"]
    texts = [None, "", "password=token: abcdefgh", "password==abcdef", "AKIAAKIA12", "a" * 23, "A" * 70000 + " secret: abcdef"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    texts.append(f"é {key} end")
    texts.append("internationalisation-of-the-internationalisation")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as base", "2 as runs", "3 as id")
    got = {r["id"]: r for r in secrets.span_digest(secrets.secret_spans(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = base_spans(t)
        names = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest(), t
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == names
    assert got[len(texts) - 2]["spans"] == "random:2:50" and "random" not in got[len(texts) - 1]["spans"]
    assert secrets.secret_spans(df.limit(0)).count() == 0


def test_battery_knows_random_from_text(spark):
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    texts = ["".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=40)) for _ in range(60)]
    rows = spark.createDataFrame([(x,) for x in drawn + texts + ["ab" * 20, "0" * 30 + "1" * 30]], "x string").select(secrets._battery(F.col("x")).alias("t")).select("t.*").collect()
    # Forty characters lie 3.4 deviations below text on average; p under 0.01 is 2.3.
    assert sum(r["random"] for r in rows[:60]) >= 58 and sum(r["bin"] >= 20 for r in rows[:60]) >= 50
    assert all(r["bin"] < 20 for r in rows[60:120]) and not rows[120]["random"] and not rows[121]["random"]


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\nThe above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY."
    bsd = "Redistribution and use in source and binary forms are permitted. Redistributions of source code must retain the notice. Redistributions in binary form must reproduce the notice."
    cases = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "x\nThis work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "GNU General Public License, version 2\nor (at your option) any later version.": "GPL-2.0-or-later",
        "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        mit: "MIT",
        bsd: "BSD-2-Clause",
        bsd + " Neither the name of X may be used to endorse products.": "BSD-3-Clause",
        "GNU Lesser General Public License, version 3. Released under the MIT License.": "LGPL-3.0-only,MIT",
        "An odd licence of our own.": "",
        "# you can modify it under the terms of the GNU\n# General Public License as published by the Free\n# Software Foundation, either version 3 of the License, or\n# (at your option) any later version.": "GPL-3.0-or-later",
        "subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
        "/* SPDX-License-Identifier: BSD-3-Clause */\nint x;": "BSD-3-Clause",
        "// SPDX-License-Identifier: GPL-2.0-or-later\n": "GPL-2.0-or-later",
        "GNU Affero General Public License, version 3 or any later version": "AGPL-3.0-or-later",
        "Under CC BY 3.0.\nUnder CC BY 4.0": "CC-BY-4.0,CC-BY-3.0",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.": "ISC",
        bsd[:-1] + ". Neither the name of the\ncopyright holder nor the names of its contributors may be used to endorse\nproducts.": "BSD-3-Clause",
        "x " * 300_000 + "\nReleased under the MIT License.\n" + "Released under the MIT License. " * 50: "MIT",
        "no words of it": "",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string").selectExpr("*", "1 as sentence_ids", "2 as licenses", "3 as id")
    got = {r["id"]: ",".join(r["licenses"]) for r in licenses.license_scan(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_each_license_identifier_has_a_rule():
    used = {x for _, seq in licenses.RULES for x in seq.split()}
    versions = [f"{a}{b}" for a in range(1, 5) for b in ("", ".0", ".1", ".5")]
    values = [*versions, *(f"{k} {v}" for k in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd") for v in versions)]
    values += [f"{k} {v}{w}" for k in ("apache", "gpl", "lgpl", "agpl", "mpl", "cc0") for v in versions for w in ("", " or later")] + ["mit", "isc", "bsd 2 clause", "bsd 3 clause"]
    for name, pattern in licenses.SENTENCES:
        if name.endswith("-"):
            group = re.search(r"\((?!\?)((?:[^()]|\(\?:[^()]*\))*)\)", pattern)[1]
            found = [name + v.replace(" ", "-") for v in values if re.fullmatch(group, v)]
            assert found and set(found) <= used, name
        else:
            assert name in used | {"RESERVED", "UNKNOWN"}


def test_chat(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\nI have flour."),
        (1, 1, "assistant", "Mix it with water."),
        (1, 2, "user", "On Monday they wrote:\n> How do I  BAKE bread?\nNever mind."),
        (1, 3, "user", "> > How do I bake bread?\n> Never mind.\nWhy?"),
        (1, 4, "user", ">said by nobody\nok"),
        (1, 5, "user", "> Why?\n>> Never mind.\nBecause."),
        (2, 0, "user", "Never mind."),
        (2, 1, "user", "> How do I bake bread?"),
        (2, 1, "user", "> How do I bake bread?"),
        (None, 0, "user", "> Why?"),
        (3, None, "user", "Why?"),
        (3, 1, "user", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as root", "3 as level")
    got = defaultdict(list)
    for r in chat_format.formatted(df).collect():
        got[r["conv"], r["turn"]].append((r["text"], r["reply_to"], r["root"], r["depth"], r["quotes"]))
    assert got[1, 0] == [(rows[0][3], None, 0, 0, "")]
    assert got[1, 2] == [("Never mind.", 0, 0, 1, "1:0")]
    assert got[1, 3] == [("Why?", 2, 0, 2, "1:2,2:0")]
    assert got[1, 4] == [("ok", None, 4, 0, "")]
    assert got[1, 5] == [("Because.", 3, 0, 3, "1:3,2:2")]
    assert got[2, 1] == [("", None, 1, 0, "")] * 2 and got[None, 0] == [("", None, 0, 0, "")] and got[3, 1] == [(None, None, 1, 0, "")]
    assert sum(map(len, got.values())) == len(rows)
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_blocks_are_permuted(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    steps = [b - a for a, b in zip(got, got[1:], strict=False)]
    assert len(set(steps)) > 500


def test_mixed_rows_of_equal_ids(spark):
    rows = [(i % 4, "a", f"{'x ' * 9}{i}", f"{i}") for i in range(8)] + [(None, "a", f"y {i}", "n") for i in range(6)] + [(9, "a", "z z", "1"), (9, "a", "z z", "2")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _none string")
    taken = sum(len(r["draws"]) for r in mixing.mix(df).collect())
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows)) and taken == len(rows)
    assert mixing.mixed_rows(df.limit(0)).count() == 0
