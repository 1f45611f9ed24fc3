
import random

import numpy as np
import pandas as pd

from plexora.llm import toxicity
from plexora.llm.licenses import TEMPLATES, LicenseScanner, license_scan
from plexora.llm.quality_rules import BINS, CUTOFF, FEATURES, NEAR, PAIRS, RESCALE, _concentrate, _steady, concentrated, quality_rules, statistics
from plexora.llm.token_files import CELLS, LEAST, _pairs_of, expand, re_pair, replaced_pairs

SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], SCHEMA)


def licenses(spark, texts):
    return [r.licenses for r in license_scan(documents(spark, texts)).orderBy("doc_id").collect()]


def test_license_notice_in_a_line_with_other_text(spark):
    pad = "Further words of a page footer stand here, " * 5
    texts = [
        "Copyright (c) 2015-2024 The Example Foundation and its contributors, 5 Harbour Street, Dublin. All rights reserved.",
        pad + "Released under the MIT License. " + pad,
        "See the page of terms for what you may do with these pages and pictures, and whom to ask for more. Licensed under CC BY 4.0. " + pad,
        "ALL RIGHTS RESERVED.",
        "the work was released by some people under the strange spell of the old MIT people and their License to rule",
        pad + "This work is licensed under the GNU General Public License, version 4. " + pad,
    ]
    assert licenses(spark, texts) == [["Proprietary"], ["MIT"], ["CC-BY-4.0"], ["Proprietary"], [], []]


def test_every_license_template_is_found_in_long_lines():
    scanner = LicenseScanner(TEMPLATES)
    pad = "Some other words stand here and there. " * 40
    assert [[f[1] for f in scanner(pad + t + " " + pad)[1]] for t in TEMPLATES.values()] == [[k] for k in TEMPLATES]


def test_license_notices_over_lines_and_more_than_one(spark):
    grant, redistribution = TEMPLATES["MIT-grant"], TEMPLATES["BSD-2-Clause"]
    texts = [
        "Licensed under the Apache License,\nVersion 2.0.",
        "/*\n * This work is licensed under the GNU General Public\n * License, version 3.\n */",
        "# All rights\n# reserved.",
        "\n".join("// " + w for w in grant.split()),
        "dnl " + redistribution.replace(" are ", "\ndnl are "),
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU Affero General Public\nLicense, version 3.",
        TEMPLATES["Apache-2.0-notice"].replace("you may", "\n   you may") + "\n\nLicensed under CC BY-\nNC 4.0.",
        "This work is licensed under the GNU General Public License, version 4. See\nversion 3. of the text.",
        "Licensed under the Apache License,\n\nVersion 2.0 of the page",
    ]
    want = [["Apache-2.0"], ["GPL-3.0"], ["Proprietary"], ["MIT-grant"], ["BSD-2-Clause"], ["Apache-2.0", "MIT"], ["AGPL-3.0"], ["Apache-2.0-notice", "CC-BY-NC-4.0"], [], []]
    assert licenses(spark, texts) == want
    got = license_scan(documents(spark, ["x\n\nReleased under the\nMIT License.\nA copyright line"])).first()
    assert got.n_candidates == 2 and [(f.line, f.license) for f in got.findings] == [(2, "MIT"), (4, None)]


def test_re_pair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.integers(2, 5000, 200)
    ids = np.concatenate([np.r_[rng.integers(2, 5000, 300), passage, 1] for _ in range(100)]).astype(np.uint32)
    seq, rules = re_pair(ids, 5000, 1)
    assert np.array_equal(expand(seq, rules, 5000), ids)
    inner = seq[:-1] != 1
    assert np.unique(np.column_stack([seq[:-1], seq[1:]])[inner], axis=0, return_counts=True)[1].max() < LEAST
    used = np.concatenate([seq, rules.ravel()])
    assert np.isin(np.arange(5000, 5000 + len(rules)), used).all() and len(seq) < 300 * 100 + 5 * 100


def test_frequent_pairs_that_share_a_cell_are_all_found():
    ids = np.arange(2, 4000, dtype=np.uint32)
    a, b = (x.ravel() for x in np.meshgrid(ids[:1200], ids[:1200]))
    cells = _pairs_of(np.column_stack([a, b]).ravel().astype(np.uint32), None)[1][::2]
    assert cells.max() < CELLS
    order = np.argsort(cells, kind="stable")
    k = int(np.flatnonzero(np.diff(cells[order]) == 0)[0])
    one, other = (np.array([a[i], b[i], 1], np.uint32) for i in order[k : k + 2])
    pairs, _, number = replaced_pairs(np.concatenate([np.tile(one, 20), np.tile(other, 9)]), 100, LEAST, 1)
    found = {(int(p >> np.uint64(32)), int(p & np.uint64(0xFFFFFFFF))): int(n) for p, n in zip(pairs, np.bincount(number), strict=True)}
    assert found[tuple(map(int, one[:2]))] == 20 and found[tuple(map(int, other[:2]))] == 9


def test_toxicity_searches_misspellings_of_every_lexicon_word():
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(6, 10))): 2.0 + (k % 30) / 10 for k in range(1500)} | {"grum-pock": 2.1, "vile": 2.5}
    matcher = toxicity.Matcher(toxicity.ToxicityModel(words, {}))
    for w in words:
        if len(w) >= 6:
            assert matcher.match(w[:2] + "z" + w[3:])[2] and matcher.match(w[:2] + "z" + w[3:])[1] > 0, w
    assert matcher.match("grvm-pock") == ("grum-pock", 2.1, True) and matcher.match("v1le") == ("vile", 2.5, True) and matcher.match("vilx")[1] == 0
    matcher.automaton.MOST_PAIRS = 100
    assert matcher.match("grum-qock") == ("grum-pock", 2.1, True)


def distances(x, mu, cov):
    floors = np.array(list(FEATURES.values()))
    sd = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), floors)
    cov = cov + np.diag(sd**2 - np.diag(cov))
    d = x - mu
    return np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)


def test_quality_verdicts_equal_brute_force(spark):
    """Groups of several sizes: estimates are reweighted, drawn to those above, and the verdict is that of the distance."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    rows = [(k, ". ".join(" ".join(rnd.choices(words, k=12)) for _ in range(rnd.randint(6, 20))), "en" if k < 150 else "de", "ab"[k % 2] if k < 140 else "c") for k in range(160)]
    rows += [(200, " ".join(w + "###" for w in rnd.choices(words, k=90)), "en", "a"), (201, " ".join(w.upper() for w in rnd.choices(words, k=90)), "de", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    stats = {r.doc_id: r for r in statistics(docs).collect()}
    x = {k: np.array([r[n] for n in FEATURES]) / 1024 for k, r in stats.items()}
    groups = {"all": list(x)}
    for k, _, lang, source in rows:
        groups.setdefault(lang, []).append(k)
        groups.setdefault((lang, source), []).append(k)
    named = [(str(g), *(int(v * 1024) for v in x[k])) for g, ks in groups.items() for k in ks]
    raw = {r.grp: r for r in concentrated(spark.createDataFrame(named, "grp string, " + ", ".join(f"{n} long" for n in FEATURES))).collect()}

    def matrix(upper):
        cov = np.zeros((6, 6))
        for v, (i, j) in zip(upper, PAIRS, strict=True):
            cov[i, j] = cov[j, i] = v
        return cov

    def estimate(g):
        own = np.array([x[k] for k in groups[g]])
        near = own[distances(own, np.array(raw[str(g)].mu), _steady(raw[str(g)].n, matrix(raw[str(g)].cov))) <= NEAR]
        return len(own), near.mean(0), np.cov(near.T, bias=True) * RESCALE

    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for k, _, lang, source in rows:
        cov, mu = np.diag((4 * np.array(list(FEATURES.values()))) ** 2), estimate("all")[1]
        for g in ("all", lang, (lang, source)):
            n, own, own_cov = estimate(g)
            w = n / (n + 60)
            cov, mu = w * own_cov + (1 - w) * cov + w * (1 - w) * np.outer(own - mu, own - mu), w * own + (1 - w) * mu
        d = distances(x[k][None], mu, cov)[0]
        assert abs(got[k].distance - d) < 1e-6 * (1 + d) and got[k].kept == (d <= CUTOFF)
    assert all(got[k].kept for k in range(160)) and not got[200].kept and not got[201].kept


def test_quality_estimates_of_tiny_groups(spark):
    """Groups of one to eight rows that differ much have an estimate too."""
    rng = np.random.default_rng(2)
    for n in range(1, 9):
        rows = [("g", *map(int, r)) for r in rng.integers(0, 9000, (n, 6))]
        bins = pd.DataFrame([(r[0], k, 1, *r[1:], *(r[1 + i] * r[1 + j] for i, j in PAIRS)) for k, r in enumerate(rows)], columns=["grp", "bin", "k", *(f"s_{i}" for i in range(6)), *(f"s_{i}_{j}" for i, j in PAIRS)])
        assert np.isfinite(_concentrate(bins)["inv"].iloc[0]).all()


def test_quality_estimate_stands_still(spark):
    rng = np.random.default_rng(9)
    x = np.rint(1024 * (rng.gamma(1.0, 1.0, (300, 6)) @ (np.eye(6) + 0.4))).astype(int)
    x[:60] += 9000
    names = list(FEATURES)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "grp string, " + ", ".join(f"{n} long" for n in names)).cache()
    e = concentrated(rows).collect()
    assert len(e) == 1

    def step(mu, inv):
        d = x / 1024 - np.array(mu)
        dist = np.zeros(len(x))
        for k, (i, j) in enumerate(PAIRS):
            dist = dist + inv[k] * d[:, i] * d[:, j]
        bins = pd.DataFrame({"grp": "g", "bin": np.floor(BINS * np.log2(np.maximum(dist, 0) + 2.0**-12)).astype(int), "k": 1, **{f"s_{i}": x[:, i] for i in range(6)}, **{f"s_{i}_{j}": x[:, i] * x[:, j] for i, j in PAIRS}})
        out = _concentrate(bins.groupby(["grp", "bin"], as_index=False).sum()).iloc[0]
        return out["mu"], out["inv"]

    at, seen = (e[0].mu, e[0].inv), []
    for _ in range(20):  # the estimate comes again: at once, or after a circle
        at = step(*at)
        seen.append(np.allclose(at[0], e[0].mu, rtol=1e-9) and np.allclose(at[1], e[0].inv, rtol=1e-9))
    assert any(seen)
