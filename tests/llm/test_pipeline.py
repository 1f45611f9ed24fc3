"""The pipeline's stages against brute force, on rows with null and repeated ids, repeated rows and clashing columns."""

import random

import numpy as np

import corpus_pipeline
from plexora.llm import toxicity
from plexora.llm.decontaminate import decontaminate, without_contaminated, words_of
from plexora.llm.quality_rules import quality_rules
from plexora.llm.tokens import WordTokenizer, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _d int"


def corpus(spark, folder):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7))) for _ in range(3000)]

    def prose(n=90):
        return ". ".join(" ".join(rnd.choices(words, k=10)) for _ in range(n // 10))

    items = [(k, " ".join(rnd.choices(words, k=20))) for k in range(5)]
    texts = [prose() for _ in range(120)]
    texts += [f"krumpot {prose()} krumpot {prose()}" for _ in range(40)]
    texts += [" ".join(w + "###" for w in rnd.choices(words, k=90))]
    texts += [t + " " + rnd.choice(words) for t in texts[:10]] + texts[3:6] + [None, "", "few words"]
    texts += [f"{prose(40)} {items[k][1]} {prose(40)}" for k in range(4)]
    rows = [(k, t, "en", "s", len(t or ""), 0.5, 1) for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", None, 1, None, None), (None, prose(), None, None, 1, None, None), (7, texts[7], "en", "s", 1, 0.1, 2), (7, prose(), "en", "s", 1, 0.1, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int((t or "").startswith("krumpot"))) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def grams(text, n):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    sf = str(tmp_path / "sf")
    items = corpus(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns
        path = str(tmp_path / name.replace(" ", "_"))
        before = [tuple(r) for r in docs.collect()]
        out.coalesce(1).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        kept[name] = (before, [tuple(r) for r in docs.collect()])

    before, after = kept["quality rules"]
    for row in before:
        w = (row[1] or "").split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
        if len(w) < 50 or 2 * len(repeated) > len(w) or "###" in row[1]:
            assert row not in after
        else:
            assert after.count(row) == before.count(row)

    before, after = kept["toxicity"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not r[1].startswith("krumpot"))

    before, after = kept["n-gram Jaccard join"]
    sets = [grams(r[1], 5) for r in before]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if z in (x, y) else z for z in comp]
    assert len(after) == len(set(comp)) and len(after) < len(before)
    of = {r[1]: c for r, c in zip(before, comp, strict=True)}
    assert len({of[r[1]] for r in after}) == len(after)

    before, after = kept["benchmark decontamination"]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words_of(t)] for k in range(len(w) - 9)}
    clean = [r for r in before if not any(tuple(w[k : k + 10]) in windows for w in [words_of(r[1])] for k in range(len(w) - 9))]
    assert sorted(map(str, after)) == sorted(map(str, clean)) and len(clean) < len(before)

    pieces = stages["best-fit packing"](spark, docs, sf).collect()
    tokenizer = WordTokenizer(public_path("byte_bpe_50k.json")).tokenizer
    sizes = [len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in after]
    assert sum(p.length for p in pieces) == sum(sizes)
    bins = {}
    for p in pieces:
        bins[p.sequence_id] = bins.get(p.sequence_id, 0) + p.length
    assert max(bins.values()) <= 2048 and len(bins) <= int(np.ceil(sum(sizes) / 2048)) + 1

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    source = spark.read.parquet(f"{sf}/documents.parquet")
    found = decontaminate(source, bench).where("not contaminated").count()
    assert without_contaminated(source, bench, 0).count() == without_contaminated(source, bench).count() == found
    for name in stages:
        assert stages[name](spark, source.limit(0), sf).count() == 0
    assert quality_rules(source.limit(0)).count() == 0 and toxicity.Scorer(toxicity.ToxicityModel({}, {}))([])[1] == []
