"""The pipeline's stages against each operator's own brute force, on a small corpus."""

import importlib.util
import random

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, toxic = [], {}
    for i in range(300):
        words = text(rng.randint(30, 90)).split()
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), "grumpf")
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    item = text(40)
    clean = [i for i, y in toxic.items() if not y]
    docs += [(400, docs[clean[0]][1], "en", "s0", 0), (401, f"{text(20)} {item} {text(20)}", "en", "s1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = kept.columns
        kept = corpus_pipeline.materialise(stage(spark, kept, folder), "test")
        seen[name] = sorted(r["doc_id"] for r in kept.collect())
        if name != "token_output":
            assert kept.columns == columns
    assert seen["toxicity"] == [*clean, 400, 401]
    assert seen["simhash_dedup"] == [*clean, 401]
    assert seen["decontamination"] == clean
    assert set(seen["mixing"]) <= set(clean) and max(map(seen["mixing"].count, clean)) <= 3
    assert seen["token_output"] == seen["mixing"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == seen["mixing"]
