"""The findings of round 2, each by a case that failed before."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plexora.llm import common, ngram_join, pairwise_quality, token_files
from plexora.llm import quality_rules as rules
from plexora.llm.licenses import TEMPLATES, LicenseScanner
from plexora.llm.token_files import LEAST, PAIRS, Shard, re_pair, replaced_pairs, write_shard
from plexora.llm.tokens import WordTokenizer, public_path, word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rnd, words, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) if words is None else rnd.choice(words) for _ in range(n))


def test_quality_rules_join_no_estimates_by_pairs_of_tasks(spark, monkeypatch):
    """The estimate of all rows was joined by a Cartesian product: a task for each two partitions, 44,521 at 211."""
    plans, kept = [], rules.stored
    monkeypatch.setattr(rules, "stored", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, *a))[1])
    monkeypatch.setattr(rules, "FEW_TASKS", 2)
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, prose(rnd, None, 80), "en" if k % 3 else "de", "ab"[k % 2]) for k in range(60)], SCHEMA)
    assert rules.quality_rules(docs).where("kept").count() == 60
    assert plans and not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)


def test_ngram_join_makes_few_rows_of_a_large_group(spark, monkeypatch):
    """Near copies of a text and copies of these: pairs of classes that aren't similar to the centre were rows each."""
    rows, kept = {}, ngram_join.stored

    def counted(df, name, *by):
        out = kept(df, name, *by)
        if name in ("pairs", "linked", "rest", "sifted"):
            rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    base = rnd.choices(words, k=100)
    texts = []
    for k in range(240):
        own = list(base if k % 8 == 0 else texts[k - k % 8])
        for _ in range(3 if k % 8 == 0 else 1):
            own[rnd.randrange(100)] = rnd.choice(words)
        texts.append(own)
    docs = spark.createDataFrame([(k, " ".join(w), "en", "a") for k, w in enumerate(texts)], SCHEMA)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard(docs, 4, 85).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(97)} for w in texts]
    comp = list(range(240))
    for a in range(240):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                x, y = sorted((comp[a], comp[b]))
                comp = [x if z == y else z for z in comp]
    assert found == {k: (len(sets[k]), comp[k]) for k in range(240)} and 1 < len(set(comp)) < 100
    assert sum(rows.values()) < 10 * len(texts), rows


def test_pairwise_quality_learns_from_all_training_rows(spark, monkeypatch):
    """6000 rows of a label value were learned from, the threshold came from these."""
    n = 20_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat(repeat('word ', 1 + cast(id % 97 as int)), repeat('# ', cast(id % 7 as int))) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 7 < 6 as int) as quality")
    rows, kept = {}, pairwise_quality.stored
    monkeypatch.setattr(pairwise_quality, "stored", lambda df, name: rows.setdefault(name, kept(df, name)))
    monkeypatch.setattr(pairwise_quality, "BLOCK", 500)
    model = pairwise_quality.fit(docs, labels)
    x = np.array([r.x for r in rows["train"].orderBy("doc_id").collect()])
    y = np.array([r.y for r in rows["train"].orderBy("doc_id").collect()])
    assert len(x) == labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").count() > 12_000
    raw = np.sort(model.raw(x))
    k = int((y == 0).sum())
    assert abs(model.threshold - (raw[k - 1] + raw[k]) / 2) < 1e-9
    pairs = rows["pairs"].collect()
    assert len(pairs) == -(-int((y == 1).sum()) // 500) and sum(len(r.d) for r in pairs) == 8 * 8 * 16 * (y == 1).sum()


def test_ngram_join_moves_only_differences_that_histograms_allow():
    """Sizes and places let nearly all classes of a long list pass, and the whole differences of all of them were moved."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    own = [np.sort(np.concatenate([base[:1], rng.integers(0, 2**63, 299, dtype=np.uint64)])) for _ in range(60)]
    own += [np.sort(np.concatenate([base[:270], rng.integers(0, 2**63, 30, dtype=np.uint64)])) for _ in range(5)]
    k = len(own)
    columns = {"sig": [1] * k, "nid": list(range(k)), "c": [99] * k, "n": [1000] * k, "d": [300] * k, "at": [0] * k, "side": [0] * k, "comp": list(range(k))}
    plain = pa.table(columns)
    table = plain.append_column("spread", pa.array([ngram_join.histogram(x, ngram_join.DIFFERENCE_CELLS) for x in own], pa.binary()))
    assert ngram_join._partnered(85)(plain).num_rows == k
    some = ngram_join._partnered(85)(table)
    assert some.column("nid").to_pylist() == list(range(60, k))
    links = ngram_join._joined(85)(some.append_column("own", pa.array([x.tobytes() for x in own[60:]], pa.binary())))
    assert {frozenset(x) for x in zip(links.column("a").to_pylist(), links.column("b").to_pylist())} == {frozenset((60, j)) for j in range(61, k)}


def test_ngram_join_moves_only_values_of_classes_in_pairs(spark, monkeypatch):
    """The histograms and sets of all classes were moved for both sides of a join with few pairs."""
    read, kept = {}, ngram_join.stored

    def counted(df, name, *by):
        out = kept(df, name, *by)
        read.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    rnd = random.Random(3)
    texts = [prose(rnd, None, 60) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate([*texts, texts[0] + " more"])], SCHEMA)
    join = ngram_join.NgramJaccard(docs, 4, 85)
    table = spark.createDataFrame([(n, bytes(8)) for n in range(1000)], "nid long, cells binary")
    pairs = spark.createDataFrame([(1, 2), (3, 2)], "a long, b long")
    monkeypatch.setattr(ngram_join, "discard", lambda *tables: None)
    out = join._with(pairs, table, "cells", ngram_join._can_be_similar(0), "a long, b long", "tried")
    assert {(r.a, r.b) for r in out.collect()} == {(1, 2), (3, 2)}
    assert sum(t.count() for t in read["only"]) < 20


def test_pipeline_stages_begin_without_what_was_left_before(spark, monkeypatch):
    """Executors kept the garbage and the remembered words of stages before, until a later one took more than their memory."""

    class BegunError(Exception):
        pass

    def begun(session):
        raise BegunError

    monkeypatch.setattr(corpus_pipeline, "collect_garbage", begun)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(BegunError):
            stage(spark, None, "")
    word_tokenizer(public_path("word_bpe_49k.json"))
    common.unburden()
    assert word_tokenizer.cache_info().currsize == 0
    common.collect_garbage(spark)


def test_license_notices_are_all_judged_by_compression(monkeypatch):
    """Wording without other words between was confirmed whatever compression saved, and marks between the words lessened that."""
    scanner = LicenseScanner(TEMPLATES)
    for name, t in TEMPLATES.items():
        ((_, found, saved, _),) = scanner(t)[1]
        ((_, strange, parted, _),) = scanner("Copyright: " + t.replace(" ", " @#$%^ "))[1]
        assert found == strange == name and saved == parted >= 0.15
    short = LicenseScanner({"short": "cc0"})
    assert [f[1] for f in short("This work is CC0.")[1]] == ["short"]
    monkeypatch.setattr(LicenseScanner, "saved", lambda self, words, name: -1.0)
    for t in TEMPLATES.values():
        assert all(name is None for _, name, _, _ in scanner("So: " + t)[1])


class Counting:
    """A tokenizer that counts the characters it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.seen += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_with_marks_and_at_line_ends_are_encoded_once(name):
    """CPU seconds of op9 and op10: each word was encoded again with every run of marks behind it and every word of the next line."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeéö") for _ in range(12)) for _ in range(400)]
    texts = [" ".join(w + m for w in words) for m in ("", ".", "!!", "&&&", ".***", ",$$$", "%%%")]
    texts += ["\n".join(rnd.sample(words, 400)), "\n".join(" ".join(rnd.sample(words, 40)) + "." for _ in range(20))]
    odd = ["\u0130. \u0130! a\u0130<", "a.\nb c\n's d", "a\r\nb c", "\na b\n", "a\n\nb c", "a b\n\x0bc d", "a\t\nb", "", "\n", " \n a", "x' 's. don't, d'.", "\u00df\u0152. \u0153! T\u0308. \u2167."]
    own = WordTokenizer(public_path(name))
    counts = [Counting(own.tokenizer), Counting(own.model)] if hasattr(own, "model") else [Counting(own.tokenizer)]
    want = [e.ids for e in own.tokenizer.encode_batch(texts + odd, add_special_tokens=False)]
    own.tokenizer, own.model = counts[0], counts[-1]
    assert [x.tolist() for x in own(texts)] == want[: len(texts)]
    assert sum(c.seen for c in counts) < 4 * sum(map(len, words))
    assert [x.tolist() for x in own(odd)] == want[len(texts) :]
    ids, sizes = own.flat([*odd, *texts], 7)
    assert ids.tolist() == [i for x in want[len(texts) :] + want[: len(texts)] for i in [*x, 7]] and sizes.sum() == len(ids)


def test_re_pair_counts_only_pairs_that_changed(monkeypatch):
    """CPU seconds of op9: every round of Re-Pair counted all pairs again. The symbols are those of such rounds."""
    rng = np.random.default_rng(3)
    for keep in (None, 1):
        ids = (rng.zipf(1.3, size=20_000) % 50).astype(np.uint32)
        seq, rules_of, rounds = ids, 0, 0
        while len((found := replaced_pairs(seq, PAIRS, LEAST, keep))[0]):
            at, symbols, k, numbers = dict(zip(found[1].tolist(), found[2].tolist(), strict=True)), [], 0, []
            while k < len(seq):
                symbols.append(-1 - at[k] if k in at else int(seq[k]))
                k += 1 + (k in at)
            numbers = {n: 100 + rules_of + i for i, n in enumerate(sorted({-1 - x for x in symbols if x < 0}))}
            seq = np.array([numbers[-1 - x] if x < 0 else x for x in symbols], np.uint32)
            rules_of, rounds = rules_of + len(numbers), rounds + 1
        own, rules_made = re_pair(ids, 100, keep)
        assert np.array_equal(own, seq) and len(rules_made) == rules_of
        assert np.array_equal(Shard(write_shard([0], [ids], 100, keep)).all(), ids)
    seen, pairs_of = [], token_files._pairs_of
    monkeypatch.setattr(token_files, "_pairs_of", lambda seq, keep: (seen.append(len(seq)), pairs_of(seq, keep))[1])
    re_pair(ids, 100, 1)
    assert len(seen) < rounds
