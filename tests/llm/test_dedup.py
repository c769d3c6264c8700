"""Fingerprints, links, components and decontamination against brute force."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from heddle.llm import decontamination as dc
from heddle.llm import simhash_dedup as sd
from heddle.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéÉ") for _ in range(rng.randint(1, 6)))
    out = ["", None, " \t\n", "one", "One", "a b c", "A B C D", "x y\x1cz b c d e"]
    base = [word() for _ in range(300)]
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(300)] = word()
        out.append(rng.choice([" ", "\n", "  "]).join(near))
    out += [" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(60)]
    out.append(" ".join(word() for _ in range(30000)))
    return out + out[:20]


def test_groups_equal_brute_force(spark, texts):
    prints = [slow_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(len(texts), links)
    rows = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, fp string, key int, component int")
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in sd.near_duplicate_groups(rows.repartition(5)).collect()}
    assert got == {i: (prints[i], want[i]) for i in range(len(texts))}
    kept = {r["doc_id"] for r in sd.one_of_each_group(rows).collect()}
    assert kept == set(want) and sd.one_of_each_group(rows).columns == rows.columns


def test_repeated_null_and_empty(spark):
    kind = "doc_id long, text string"
    rows = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (None, "q r s"), (5, "a b")], kind)
    got = sorted((str(r["id"]), str(r["component"])) for r in sd.near_duplicate_groups(rows).collect())
    assert got == [("3", "3"), ("3", "3"), ("5", "3"), ("None", "3"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in sd.one_of_each_group(rows).collect()) == ["3", "None", "None"]
    assert sd.near_duplicate_groups(spark.createDataFrame([], kind)).count() == 0


def test_golay_keys_meet_within_four_errors():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    (wa, ka), (wb, kb) = (sd.bucket_keys(x.view(np.int64)) for x in (a, b))
    met = set(zip(wa.tolist(), ka.tolist(), strict=True)) & set(zip(wb.tolist(), kb.tolist(), strict=True))
    assert {w for w, _ in met} == set(range(len(a)))


def test_long_runs_keep_components():
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 40, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 300, dtype=np.uint64)))
    fps = np.concatenate([fps, ~fps[:50]])
    h, t = sd.bucket_links(np.zeros(len(fps), np.int64), fps, 4)
    at = {f: i for i, f in enumerate(fps.tolist())}
    every = [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 4]
    assert roots(len(fps), [(at[x], at[y]) for x, y in zip(h.tolist(), t.tolist(), strict=True)]) == roots(len(fps), every)
    assert len(h) < len(fps)


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    links = [(a, b) for a, b in edges if a is not None and a != b]
    want = roots(2200, links)
    assert got == {x: want[x] for pair in links for x in pair}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_matches(docs, items, least=0.8):
    """Every window of every document against every item."""
    strip = lambda t: [w for w in (dc._strip(w) for w in (t or "").split()) if w]
    out = set()
    for d, t in docs:
        words = strip(t)
        for i, s in items:
            item = strip(s)
            if not item or not words:
                continue
            k = min(5, len(item))
            grams = lambda w, k=k: dc.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
            n = min(len(item), len(words))
            if max((dc.similarity(grams(words[a : a + n]), grams(item)) for a in range(len(words) - n + 1)), default=0) >= least:
                out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 5, 9, 30, 45, 60, 45))] + [(90, None), (91, ""), (92, "...")]
    items.append((93, items[4][1]))
    docs = [(0, None), (1, ""), (2, "! ?")]
    for d in range(3, 90):
        text = [word() for _ in range(rng.randint(0, 120))]
        item = items[rng.randrange(8)][1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            item[rng.randrange(len(item))] = word()
        item = [w.upper() + "," if rng.random() < 0.3 else w for w in item]
        at = rng.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + item * rng.choice((0, 1, 1, 2)) + text[at:])))
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as id", "3 as item")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r["id"], r["item"]) for r in dc.contaminated(rows, bench).collect()}
    assert got == slow_matches(docs, items) and len(got) > 20
    clean = {r["doc_id"] for r in dc.without_contaminated(rows, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    assert dc.contaminated(rows, bench.limit(0)).count() == 0 and dc.contaminated(rows.limit(0), bench).count() == 0


def test_blocks_of_items_cover_all(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 40)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(7)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    assert sorted((r["id"], r["item"], r["first_word"], r["end_word"]) for r in dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(i, i, 1, 7) for i in range(7)]


def test_equal_ids_of_different_texts_stay(spark):
    kind = "doc_id long, text string, _key_none int"
    rows = spark.createDataFrame([(5, "a b c d e f", 1), (5, "u v w x y z", 1), (1, "a b c d e f", 2), (5, "k l m n", 3), (5, "k l m n", 3)], kind)
    got = sd.one_of_each_group(rows)
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e f", 2), (5, "k l m n", 3), (5, "u v w x y z", 1)]
