"""The pipeline's near-duplicate stage against brute force."""

import importlib.util
import random

import numpy as np
import pytest

from heddle.llm import shingle_dedup as sh
from tests.llm.test_dedup import roots


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(20)]
    out = [None, "", "one", "One", "a b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 300))]
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = word()
            out.append(rng.choice([" ", "\n"]).join(near))
    out += [" ".join([*common, *(word() for _ in range(40))]) for _ in range(30)]
    base = [word() for _ in range(200)]
    for _ in range(60):
        near = list(base)
        near[rng.randrange(200)] = word()
        out.append(" ".join(near))
    return out + out[:10]


@pytest.mark.parametrize("sample", [1, 20_000])
def test_groups_equal_brute_force(spark, copies, sample):
    sets = [slow_set(t) for t in copies]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    want = roots(len(sets), links)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(copies)], "doc_id long, text string").repartition(5)
    got = {r["id"]: r["component"] for r in sh.similar_groups(rows, sample=sample).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(want) - 80
    assert sh.similar_groups(rows.limit(0)).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = [(0, " ".join(base))]
    for i in range(1, 11):
        near = list(base)
        for at in (20, 80, 140):
            near[at + i] = f"new{i}"
        docs.append((i, " ".join(near)))
    docs += [(50, " ".join(base[:100] + [f"x{i}" for i in range(100)])), (None, docs[3][1]), (0, "another text of id zero")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.simhash_dedup(spark, rows, "").collect())
    # The last row has an id that another text has, too, and stays.
    assert kept == ["0", "0", "50", "None"]


def test_sketches_pass_all_similar_pairs():
    rng = np.random.default_rng(5)
    apart = []
    for _ in range(400):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - int(rng.integers(0, len(a) // 4 + 1))], rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        differ = int(np.bitwise_count(sh.sketch(a).view(np.uint64) ^ sh.sketch(b).view(np.uint64)).sum())
        assert differ <= len(a) + len(b) - 2 * both
        if both >= 0.8 * (len(a) + len(b) - both):
            assert differ <= sh.most_apart(len(a), len(b), 0.8)
            apart.append(differ)
    assert len(apart) > 50


def test_many_components_of_one_key(spark):
    """Texts that share their rare words but not all that makes them similar: pairs across components, which sketches thin."""
    rng = random.Random(17)
    shared = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(rng.randint(9, 16))]
        texts += [" ".join(shared + own), " ".join(shared + own[:-1])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [slow_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["id"]: r["component"] for r in sh.similar_groups(rows, sample=0).collect()}
    assert got == dict(enumerate(roots(len(sets), links)))


def test_simhash_links_come_first(spark, monkeypatch):
    """The pipeline's stage searches by fingerprints, and what that links is verified and not looked for again."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    import corpus_pipeline

    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = [" ".join([*base[:at], "new", *base[at + 1 :]]) for at in range(10, 110, 10)]
    docs = spark.createDataFrame(list(enumerate([" ".join(base), *near, " ".join(base[:80]), None, ""])), "doc_id long, text string")
    seen = []
    monkeypatch.setattr(sh, "fingerprint_links", lambda prints, radius, f=sh.fingerprint_links: seen.append([r["fp"] for r in prints.collect()]) or f(prints, radius))
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [0, 11, 12]
    texts = [r["text"] for r in docs.collect()]
    assert sorted(seen[0]) == sorted({np.uint64(sh.majority(sh.shingles((t or "").encode()))).astype(np.int64) for t in texts})


def test_simhash_pairs_equal_brute_force(spark):
    rng = random.Random(22)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for fp in prints[:20]:
        for _ in range(rng.randint(1, 40)):
            near = fp
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                near ^= 1 << bit
            prints.append(near)
    rows = spark.createDataFrame([(k, int(np.uint64(x).astype(np.int64))) for k, x in enumerate(prints)], "class long, fp long")
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    got = [(r["u"], r["v"]) for r in sh.simhash_pairs(rows).collect()]
    assert all(u < v for u, v in got) and roots(len(prints), got) == roots(len(prints), links)


def test_rows_of_a_group_grow_with_its_texts_not_its_pairs(spark, monkeypatch):
    """Copies of one text that are almost similar to each other: each pair of them passes most sketches, and few are linked."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(1500)]

    def edited(words, count):
        near = list(words)
        for at in rng.sample(range(1500), count):
            near[at] = f"x{rng.randrange(10**9)}"
        return near

    words = [edited(base, 20) for _ in range(80)]
    words += [edited(w, 5) for w in words[::8]]
    sets = [slow_set(" ".join(w)) for w in words]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    made = []

    def counted(df, name, f=sh.materialise):
        out = f(df, name)
        made.append((name, out.count() if name in ("candidates", "units", "similar") else 0))
        return out

    monkeypatch.setattr(sh, "materialise", counted)
    monkeypatch.setattr(sh, "BLOCK", 8, raising=False)
    got = {r["id"]: r["component"] for r in sh.similar_groups(rows).collect()}
    want = roots(len(sets), links)
    assert got == dict(enumerate(want)) and 20 < len(set(want)) < len(sets)
    # A class may enter a few units. As rows, pairs across components were 3046 here.
    assert max(count for _, count in made) <= 4 * len(sets), made
