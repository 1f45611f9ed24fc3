"""The training-data operators against brute force, and on odd inputs."""

import random
import zlib

import numpy as np
import pytest

from plexora.llm import pairwise_quality, toxicity, url_filter
from plexora.llm.decontaminate import decontaminate, items_digest, words_of
from plexora.llm.licenses import license_scan
from plexora.llm.ngram_join import difference, ngram_jaccard, signatures
from plexora.llm.packing import pack, plan
from plexora.llm.quality_rules import quality_rules
from plexora.llm.token_files import Shard, re_pair, token_files, write_shard
from plexora.llm.tokens import WordTokenizer, public_path
from plexora.llm.warc import assemble, read_records, warc_round_trip, write_warc

SCHEMA = "doc_id long, text string, lang string, source string, score double, n long, words string"


SCHEMA_REST = ["text", "lang", "source", "score", "n", "words"]


def documents(spark, texts):
    return spark.createDataFrame([(k, t, None if k % 3 else "en", "s" if k % 2 else None, 1.0, 2, "x") for k, t in enumerate(texts)], SCHEMA)


def odd(spark):
    """Null, empty and blank texts, repeated rows, one very long text, columns with clashing names."""
    return documents(spark, [None, "", "   ", "a b", "a b", "\n\n", "word " * 60_000, "x y z " * 30]).union(documents(spark, ["same id"]))


def vocabulary(seed, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def near_texts(seed=1):
    """Groups of near copies, copies, a passage in many texts."""
    rnd, words = random.Random(seed), vocabulary(seed)
    passage = rnd.choices(words, k=40)
    out = []
    for _ in range(25):
        base = rnd.choices(words, k=rnd.randint(5, 120))
        for _ in range(rnd.randint(1, 6)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            if rnd.random() < 0.4:
                own = own[:10] + passage + own[10:]
            out.append(" ".join(own).upper() if rnd.random() < 0.2 else " ".join(own))
    return out + out[:5] + [None, "", "one", "one two", "one two"]


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if z in (x, y) else z for z in comp]
    return [(k, len(s), comp[k]) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent", "limits"), [(5, 80, None), (4, 60, (3, 3))])
def test_ngram_join_equals_brute_force(spark, monkeypatch, width, percent, limits):
    import plexora.llm.ngram_join as module

    if limits:  # frequent classes, and lists that count as long, at a small size
        for name, v in zip(("FREQUENT", "SHORT"), limits, strict=True):
            monkeypatch.setattr(module, name, v)
    texts = near_texts()
    found = ngram_jaccard(documents(spark, texts), width, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == brute_components(texts, width, percent)


def test_ngram_join_odd_inputs(spark):
    nobody = documents(spark, ["a b", "alone here"]).selectExpr("cast(null as long) as doc_id", *SCHEMA_REST)
    found = list(map(tuple, ngram_jaccard(odd(spark).union(nobody), 4, 85).collect()))
    assert len(found) == 11
    assert (None, 1, 3, 3) in found and (None, 1, None, None) in found
    assert (0, 0, 0, 0) in found and (3, 1, 3, 3) in found and (4, 1, 3, 3) in found
    assert ngram_jaccard(documents(spark, []), 4, 85).collect() == []


def chained_texts(seed, n=150):
    """A group of near copies with many or few changes each, copies of copies among them."""
    rnd, words = random.Random(seed), vocabulary(seed, 200)
    out = [rnd.choices(words, k=80)]
    for _ in range(n):
        own = list(out[0] if rnd.random() < 0.7 else rnd.choice(out))
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        out.append(own)
    return [" ".join(w) for w in out]


def test_ngram_join_settles_long_lists(spark, monkeypatch):
    import plexora.llm.graphs as graphs
    import plexora.llm.ngram_join as module

    for name, v in zip(("FREQUENT", "SHORT"), (3, 2), strict=True):
        monkeypatch.setattr(module, name, v)
    monkeypatch.setattr(graphs, "FEW", 5)
    texts = chained_texts(6) + near_texts(7)
    found = ngram_jaccard(documents(spark, texts), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == brute_components(texts, 4, 85)


def test_differences_keep_every_similar_pair():
    rng = np.random.default_rng(4)
    none, seen = np.empty(0, np.uint64), 0
    for _ in range(3000):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 120)), dtype=np.uint64))
        c, x, y = (np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.15], rng.integers(0, 2**63, int(rng.integers(0, 8)), dtype=np.uint64)])) for _ in range(3))
        shared = rng.integers(0, 2**63, int(rng.integers(0, 12)), dtype=np.uint64)
        x, y = np.union1d(x, shared), np.union1d(y, shared)

        def similar(a, b):
            k = len(np.intersect1d(a, b))
            return 100 * k >= 85 * (len(a) + len(b) - k)

        if not similar(x, y) or similar(x, c) and similar(y, c):
            continue
        seen += 1
        (p, half_p, most_p), (q, half_q, most_q) = difference(x, c, 85, none), difference(y, c, 85, none)
        if not similar(x, c) and not similar(y, c):
            assert len(np.intersect1d(p[:half_p], q[:half_q]))
        else:
            a, b = (p[:most_p], q[:half_q]) if similar(y, c) else (p[:half_p], q[:most_q])
            assert len(np.intersect1d(a, b))
    assert seen > 100


def test_signatures_keep_every_similar_pair():
    rng = np.random.default_rng(3)
    for trial in range(300):
        n = int(rng.integers(1, 200))
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.07], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12)), dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if 100 * common >= 85 * (len(base) + len(other) - common):
            hot = np.sort(rng.permutation(base)[: int(len(base) * rng.random())])
            assert len(np.intersect1d(signatures(base, hot, 85), signatures(other, hot, 85))), trial


def test_decontaminate_equals_brute_force_both_ways(spark):
    rnd, words = random.Random(5), vocabulary(5, 60)
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 9, 10, 11, 40])))) for k in range(20)] + [(20, None), (21, "!!!")]
    texts = [None, "", "?"]
    for _ in range(60):
        w = rnd.choices(words, k=rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 2)):
            item = rnd.choice(items)[1] or ""
            cut = item.split()[rnd.randint(0, 3) :]
            w[10:10] = cut
        texts.append(", ".join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    windows = {}
    for i, t in items:
        w = words_of(t or "")
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    for d, t in enumerate(texts):
        w, hit, own = words_of(t or ""), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    own |= found
                    hit.update(range(k, k + n))
        want.append((d, len(w), len(hit), len(own), items_digest(list(own)), bool(hit)))
    for bound in (1 << 24, 0):
        got = decontaminate(documents(spark, texts), bench, bound).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got)) == want


def test_decontaminate_odd_inputs(spark):
    bench = spark.createDataFrame([(1, "a b"), (None, "c")], "item_id long, text string")
    assert decontaminate(odd(spark), bench).where("contaminated").count() == 2
    assert decontaminate(odd(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(documents(spark, []), bench).count() == 0


def test_plan_places_every_piece_once():
    for trial in range(150):
        rnd = random.Random(trial)
        capacity = rnd.choice([10, 30, 64, 2048])
        counts = {}
        for _ in range(rnd.choice([0, 1, 5, 50, 800])):
            n = rnd.randint(1, capacity)
            counts[n] = counts.get(n, 0) + 1
        slots, made = plan(dict(counts), capacity)
        bins, placed = {}, dict.fromkeys(counts, 0)
        for n, rank, k, first, each, offset in slots.tolist():
            assert rank == placed[n]
            placed[n] += k
            for r in range(k):
                bins.setdefault(first + r // each, []).append((offset + r % each * n, n))
        assert placed == counts and set(bins) == set(range(made))
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity and sum(3 * n > capacity for _, n in own) <= 2


def test_pack_equals_its_documents(spark):
    docs = odd(spark)
    rows = pack(docs, public_path("byte_bpe_50k.json"), 64).collect()
    tokenizer = WordTokenizer(public_path("byte_bpe_50k.json")).tokenizer
    want = sorted((d.doc_id, p, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for d in docs.collect() for x in [tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]] for p, (a, b) in enumerate(cuts(len(x), 64)))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert pack(documents(spark, []), public_path("byte_bpe_50k.json")).count() == 0


def cuts(n, size):
    ends = list(range(n % size or size, n + 1, size))
    return list(zip([0, *ends], ends, strict=False))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_tokenizer_equals_the_tokenizer(name):
    rnd, words = random.Random(9), [*vocabulary(9), "Don't", "é", "é", "ΟΣ", "ΣΑΣ.", "İx", "日本", "12,3", "a,b", "<|endoftext|>", "...", "x..", "Word,", "ÉA.", "q'S.", "́."]
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a\tb c", ".", ", .", "a\x1cb c", "a b c  d"]
    texts += [rnd.choice([" ", " ", "  ", "\n"]).join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(300)]
    own = WordTokenizer(public_path(name))
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for most in (1_000_000, 20):
        own.MOST = own.YOUNG = most
        assert [x.tolist() for x in own(texts)] == want


def test_re_pair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        docs = [np.append(rng.choice([3, 4, 5, 6], size=rng.integers(0, n + 1)).astype(np.uint32), np.uint32(1)) for _ in range(12)] + [np.full(30, 7, np.uint32)]
        shard = Shard(write_shard(list(range(13)), docs, 10, 1))
        assert np.array_equal(shard.all(), np.concatenate(docs))
        for k, d in enumerate(docs):
            assert np.array_equal(shard.document(k), d)
    seq, rules = re_pair(np.tile(np.array([3, 4, 5, 1], np.uint32), 100), 10, 1)
    assert len(seq) < 300 and len(rules) and not (rules[:, 0] == 1).any()


def test_token_files_equal_their_documents(spark):
    docs = odd(spark).union(documents(spark, ["no id", None, "no id"]).selectExpr("cast(null as long) as doc_id", *SCHEMA_REST))
    rows = sorted(map(tuple, token_files(docs, public_path("word_bpe_49k.json")).collect()), key=lambda r: r[1])
    tokenizer, start, want = WordTokenizer(public_path("word_bpe_49k.json")).tokenizer, 0, []
    for d in docs.selectExpr("doc_id", "coalesce(text, '') as text").selectExpr("*", "xxhash64(text) as h").orderBy("doc_id", "h").collect():
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [1]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == want and len(rows) == 12
    assert token_files(documents(spark, []), public_path("word_bpe_49k.json")).count() == 0


def test_quality_base_counts_equal_brute_force(spark):
    texts = [t for t in near_texts(4)] + ["a b c a b c a", "l one\nl one\n\nl two\nl one", "# * $ x | <b> & %", None, "x\x0by\x0cz w"]
    got = {r.doc_id: r for r in quality_rules(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        r = got[k]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rules_reject_outliers_and_keep_the_rest(spark):
    rnd, words = random.Random(8), vocabulary(8, 5000)
    texts = [". ".join(" ".join(rnd.choices(words, k=12)) for _ in range(rnd.randint(6, 20))) for _ in range(150)]
    junk = [" ".join(w + "###" for w in rnd.choices(words, k=90)), " ".join(w.upper() + "!!" for w in rnd.choices(words, k=90))]
    got = {r.doc_id: r.kept for r in quality_rules(documents(spark, texts + junk)).collect()}
    assert all(got[k] for k in range(150)) and not got[150] and not got[151]
    assert quality_rules(documents(spark, [])).count() == 0
    assert quality_rules(odd(spark)).where("kept").count() == 0


def labelled(spark, bad):
    rnd, words = random.Random(3), vocabulary(3, 300)
    texts, labels = [], []
    for k in range(600):
        w = rnd.choices(words, k=60)
        y = k % 4 == 0
        texts.append(bad(w, rnd) if y else " ".join(w))
        labels.append((k, int(y)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, y int")


def test_toxicity_learns_terms_and_finds_misspelled_ones(spark):
    def bad(w, rnd):
        w[rnd.randrange(60)], w[rnd.randrange(60)] = rnd.choice(["zzulgar", "qwvile"]), "krumpot"
        return " ".join(w)

    docs, labels = labelled(spark, bad)
    model = toxicity.fit(docs, labels, "y")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert sum((got[k] >= 0.7) == (k % 4 == 0) for k in range(600)) >= 594
    more = toxicity.toxicity(documents(spark, ["you qrumpot, so xzulgar " + "abc " * 20, None, "", "clean text"]), model).collect()
    assert more[0].terms == ["krumpot", "zzulgar"] and more[1].score == more[2].score < 0.7
    assert toxicity.toxicity(documents(spark, []), model).count() == 0 and toxicity.toxicity(odd(spark), model).count() == 9
    assert toxicity.fit(docs, labels.limit(0), "y").words == {}
    score = lambda t: toxicity.Scorer(model)([t])[0][0]
    rest = " abc" * 40
    used, near, cited, none = (score(t + rest) for t in ("krumpot zzulgar", "kqumpot zqulgar", 'he said "krumpot" and "zzulgar"', "kind words"))
    assert used > 0.7 and near > 0.7 and cited < 0.5 and none < 0.5 and cited < near
    assert max(model.weights[4:6]) > 0 > model.weights[6]
    x = np.array(toxicity.features("krumpot abc".split(), toxicity.Matcher(model)("krumpot abc".split())))  # by hand
    z = sum((a - c) / s * w for a, c, s, w in zip(x, model.center, model.scale, model.weights, strict=True)) + model.bias
    assert score("krumpot abc") == pytest.approx(1 / (1 + np.exp(-z)))


def test_trie_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(2)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 10))): 1.0 for _ in range(40)}
    automaton = toxicity.TrieAutomaton(terms)
    for _ in range(500):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 11)))
        want = {(t, distance(word, t)) for t in terms if distance(word, t) <= toxicity.allowed_edits(t)}
        assert set(automaton.find(word)) == want


def test_quotation_weighs_apart():
    words = 'they said "you idiot" and left'.split()
    assert toxicity.quoted(words, 3) and not toxicity.quoted("you idiot and left".split(), 1)


def test_pairwise_quality_separates(spark):
    docs, labels = labelled(spark, lambda w, rnd: " ".join(x.upper() + "!!" for x in w))
    model = pairwise_quality.fit(docs, labels.selectExpr("doc_id", "1 - y as y"), "y")
    got = {r.doc_id: r.score for r in pairwise_quality.quality(docs, model).collect()}
    assert sum((got[k] >= 0.5) == (k % 4 != 0) for k in range(600)) >= 594
    assert pairwise_quality.quality(odd(spark), model).where("score between 0 and 1").count() == 9
    assert pairwise_quality.fit(docs, labels.limit(0), "y").weights[0] == 0


def test_bradley_terry_minimises_the_loss_of_its_pairs(spark):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.7, 1, (40, 3)), rng.normal(0, 1, (30, 3))
    w = pairwise_quality.bradley_terry(good, bad, ridge=1.0, each=4)
    bads = np.repeat(np.arange(30), 4)
    d = good[np.random.default_rng(7).integers(0, 40, 120)] - bad[bads]

    def loss(v):
        return np.log1p(np.exp(-d @ v)).sum() + v @ v / 2

    for _ in range(200):
        assert loss(w) <= loss(w + rng.normal(0, 0.05, 3)) + 1e-9
    model = pairwise_quality.PairwiseModel([0.0] * 16, [1.0] * 16, [0.0] * 16)
    assert pairwise_quality.quality(documents(spark, []), model).count() == 0
    nobody = documents(spark, ["a text"]).selectExpr("cast(null as long) as doc_id", *SCHEMA_REST)
    assert pairwise_quality.quality(nobody, model).first().score == 0.5 and len(pack(nobody, public_path("byte_bpe_50k.json")).collect()) == 1


def test_url_filter_rules_and_terms(spark):
    policy = url_filter.UrlPolicy((url_filter.Rule("allow", "org/"), url_filter.Rule("block", "example.org/es/")))
    urls = [None, "", "no scheme/porn", "http://A.Example.ORG/es/x?q", "http://a.org/porn", "https://x.com/best-porn", "https://x.com/sportporn", "https://x.com/free/poker", "https://x.com/free/free", "http://x.org", "http://evilorg/", "https://x.de/billig/kredit", "https://x.de/Erotik-billig", "https://x.de/Erotik-billig"]
    pages = spark.createDataFrame([(k, u, "rule") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, policy).orderBy("page_id").collect()]
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "block")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("org/", "allow")
    assert [g[3] for g in got[5:9]] == ["block", "allow", "block", "allow"]
    assert got[9] == ("x.org", "", None, "allow") and got[10][2] is None
    assert [g[3] for g in got[11:]] == ["allow", "block", "block"]  # equal urls are judged each
    assert url_filter.url_filter(pages.limit(0), policy).count() == 0


def test_warc_round_trip(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 5000, "x\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    pages = spark.createDataFrame([(k + 10, None if k == 2 else f"http://x/{k}", h, "t") for k, h in enumerate(html)], "page_id long, url string, html string, type string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(pages).collect()}
    assert got == {10: (0, "response", None), 11: (0, "revisit", 10), 12: (8, "response", None), 13: (8, "revisit", 12), 14: (10000, "response", None), 15: (15, "response", None), 16: (8, "revisit", 12)}
    assert {r.page_id for r in warc_round_trip(pages, 9).where("record_type = 'response'").collect()} == set(range(10, 17))
    assert warc_round_trip(pages.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "http://x/a b", "p"), (1, "http://x/2", "p"), (None, "http://x/3", "p"), (None, "http://x/4", "q"), (1, None, "q"), (2, "u", "z" * 3_000_000)], "page_id long, url string, html string")
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.url) for r in warc_round_trip(again).collect()), key=str)
    assert [r[:4] for r in rows if r[1] != 1] == [(2, 3_000_000, "response", None)] and len(rows) == 6
    assert sorted(r[2] for r in rows if r[0] is None) == ["revisit"] * 2 and all(r[3] == 1 for r in rows if r[2] == "revisit")
    assert sum(r[2] == "response" for r in rows) == 3 and any(r[4] == "http://x/a%20b" for r in rows)


def test_warc_assembly_joins_records_wherever_they_stand(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/1", "one"), (2, "http://x/2", "two")], "page_id long, url string, html string")
    write_warc(pages, f"file://{tmp_path}/w")
    records = read_records(spark, f"file://{tmp_path}/w")
    whole = assemble(records.orderBy("record_id")).collect()
    assert len(whole) == 2 and all(r.request.type == "request" and r.metadata.type == "metadata" and r.capture.target_uri == r.request.target_uri for r in whole)
    assert sorted(bytes(r.capture.block).split(b"\r\n\r\n", 1)[1] for r in whole) == [b"one", b"two"]
    assert assemble(records.where("type <> 'request'")).where("request is null").count() == 2


def test_license_scan_confirms_wording(spark):
    texts = ["x\nThis work is licensed under the GNU General Public License, version 3.\ny", "This work is licensed under the GNU General Public License, version 4.", "Copyright 2020 Someone. All rights reserved.", "no such thing here", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0."]
    got = [(r.licenses, r.unknown_wording) for r in license_scan(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(["GPL-3.0"], False), ([], True), (["Proprietary"], False), ([], False), (["CC-BY-NC-4.0"], False), (["CC-BY-4.0"], False)]
    assert license_scan(odd(spark)).where("n_candidates = 0").count() == 9 and license_scan(documents(spark, [])).count() == 0
