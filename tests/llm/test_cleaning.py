"""Quality rules, quality classifier, URL filters, language identification."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import rows
from pyspark.sql import functions as F

from pagelode.llm import language_id, quality_classifier, quality_rules, url_filters

SF = "/root/testdata/sf0.01"


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_measures_equal_brute_force(spark, odd_docs):
    texts = {r.doc_id: r.text for r in odd_docs.select("doc_id", "text").collect()}
    got = quality_rules.ledger(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id


def test_repeated_windows_that_overlap(spark):
    for text in ("a a a a a a a", "a b c d e a b c d e", "a b c d e x a b c d e a b", "a b a b a b a b"):
        r = quality_rules.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert r.n_repeat_words == brute_measures(text)[4], text


def test_policies_and_ablations(spark, odd_docs, no_docs):
    ledger = quality_rules.ledger(odd_docs)
    kept = quality_rules.apply_policy(ledger, "base").where("kept").count()
    assert kept >= quality_rules.apply_policy(ledger, "v2").where("kept").count() > 0
    masks = [r.failed & quality_rules.policy_mask("v2") for r in ledger.collect()]
    for r in quality_rules.ablation(ledger, "v2").collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        assert (r.n_failed, r.n_failed_alone) == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks))
    out = quality_rules.keep_documents(odd_docs)
    assert out.columns == odd_docs.columns and rows(out.select("doc_id")) == rows(quality_rules.apply_policy(ledger).where("kept").select("doc_id"))
    assert quality_rules.ledger(no_docs).count() == 0 and quality_rules.keep_documents(no_docs).count() == 0


def test_em_finds_labellers_that_are_mostly_right():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    patterns = Counter()
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9, 0.95, 0.6]
    for t in truth:
        code = 0
        for p in right:
            vote = 0 if rng.random() < 0.3 else (2 if t == (rng.random() < p) else 1)
            code = 3 * code + vote
        patterns[code] += 1
    post, found = quality_classifier.estimate(patterns)
    assert all(abs(g - p) < 0.05 for (g, _), p in zip(found, right))
    assert abs(sum(post[c] * n for c, n in patterns.items()) / 20_000 - truth.mean()) < 0.02
    assert quality_classifier.estimate({}) == ({}, [])


def brute_votes(text):
    """What each labeller votes, from the words themselves: 2 good, 1 bad, 0 abstains."""
    raw = (text or "").encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, chars, kinds = len(ws), sum(map(len, ws)), len(set(ws))
    symbols, upper = sum(c in b"#*$%&|<>" for c in raw), sum(65 <= c <= 90 for c in raw)
    stops = len({w.decode("utf-8", "replace") for w in ws} & set(quality_classifier.STOP_WORDS))
    stutters, stopped, last = sum(a == b for a, b in zip(ws, ws[1:])), sum(c in b".!?" for c in raw), ws[-1][-1] if ws else 0
    vote = lambda bad, good: 1 if bad else 2 if good else 0
    return [
        vote(n < 10, n >= 40), vote(n and symbols > 0.1 * n, n and symbols < 0.01 * n), vote(stops == 0, stops >= 3) if n >= 20 else 0, vote(kinds < 0.12 * n, kinds > 0.3 * n) if n >= 50 else 0,
        vote(chars < 2.5 * n or chars > 14 * n, 3 * n <= chars <= 9 * n) if n >= 5 else 0, vote(stutters > 0.15 * n, stutters < 0.03 * n) if n >= 5 else 0,
        vote(upper > 0.3 * chars, upper < 0.15 * chars) if chars >= 20 else 0, vote(last in b"#*$%&|<>" if last else False, last in b".!?" if last else False),
        vote(n > 120 * stopped, 2 * stopped <= n <= 50 * stopped) if n >= 20 else 0,
    ]


def brute_posteriors(casts):
    """Expectation-maximisation over documents one by one."""
    post = [min(0.98, max(0.02, 0.5 + 0.5 * (c.count(2) - 1.5 * c.count(1)) / max(1, 9 - c.count(0)))) for c in casts]
    for _ in range(200):
        share = min(0.98, max(0.02, sum(post) / len(post)))
        right, wrong = [], []
        for k in range(9):
            voted = [(p, c[k]) for p, c in zip(post, casts) if c[k]]
            right.append((2 + sum(p for p, v in voted if v == 2)) / (4 + sum(p for p, _ in voted)))
            wrong.append((2 + sum(1 - p for p, v in voted if v == 2)) / (4 + sum(1 - p for p, _ in voted)))
        new = []
        for c in casts:
            good, bad = share, 1 - share
            for k, v in enumerate(c):
                if v:
                    good *= right[k] if v == 2 else 1 - right[k]
                    bad *= wrong[k] if v == 2 else 1 - wrong[k]
            new.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        if done:
            break
        post = new
    return post


def brute_features(text):
    """The hashed features as a dense vector, from the words themselves."""
    raw = (text or "").encode()
    ws, v, start = re.findall(rb"[^\x20\x09-\x0D]+", raw), np.zeros(quality_classifier.WIDTH), quality_classifier.WIDTH - 256 - 33
    if not ws:
        return v
    words, ends = Counter(ws), Counter(w[-1] for w in ws)
    square = sum(np.log1p(n) ** 2 for n in words.values()) + sum((3 * np.log1p(n)) ** 2 for n in ends.values())
    shares = [sum(a == b for a, b in zip(ws, ws[1:])) / len(ws), sum(65 <= c <= 90 for c in raw) / len(raw), len(words) / len(ws)]
    for w, n in words.items():
        v[zlib.crc32(w) % start] += np.log1p(n)
    for k, x in enumerate(shares):
        v[start + 11 * k + round(10 * x)] += 0.5 * square**0.5
    for e, n in ends.items():
        v[quality_classifier.WIDTH - 256 + e] += 3 * np.log1p(n)
    return v / (square + 3 * 0.25 * square) ** 0.5


def test_classifier_equals_brute_force(spark, odd_docs):
    rng, words = np.random.default_rng(4), ["the", "of", "and", "cat", "house", "runs", "über", "la", "Big", "grass"]
    data = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect() if r.doc_id != 6]
    for i in range(60):
        some = list(rng.choice(words, rng.integers(5, 120))) if i % 3 else ["##", "BUY", "BUY", "$$"] * int(rng.integers(3, 30))
        data.append((100 + i, " ".join(some) + rng.choice([".", "", "!", " |"])))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    casts = [brute_votes(t) for _, t in data]
    post = brute_posteriors(casts)
    x = np.array([brute_features(t) for _, t in data])
    y = np.array(post)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    wide = np.hstack([x, np.ones((len(x), 1))])
    for step in range(1, 151):  # full-batch Adam on the weighted logistic loss
        slope = wide.T @ (weight * (1 / (1 + np.exp(-(wide @ w))) - y)) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    score = 1 / (1 + np.exp(-(wide @ w)))
    want = {}
    for (d, t), cast, p, s in zip(data, casts, post, score):
        want.setdefault((d, t), (int("".join(map(str, cast)), 3), p, s))
    got = quality_classifier.classify(docs.withColumn("score", docs["text"])).join(docs.select(docs["doc_id"].alias("d"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    assert len(got) == len(data) and len({round(p, 3) for p in post}) > 5
    for r in got:
        code, p, s = want[r.d, r.text]
        assert r.votes == code and r.posterior == pytest.approx(p, abs=1e-6) and r.score == pytest.approx(s, abs=1e-4) and r.kept == (r.score >= 0.5)


def test_classifier_cases(odd_docs, no_docs):
    got = quality_classifier.classify(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, None)}) == 1
    assert quality_classifier.classify(no_docs).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_samples_are_bounded_though_rows_share_an_id(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality_classifier, "FIT_ROWS", 7)
    monkeypatch.setattr(quality_classifier, "fit_scorer", lambda rows, labels: sizes.append((len(rows), len(labels))) or np.zeros(quality_classifier.WIDTH + 1))
    monkeypatch.setattr(language_id, "FIT_ROWS", 9)
    monkeypatch.setattr(language_id, "train", lambda rows: sizes.append(sorted(lang for lang, _ in rows)))
    docs = spark.createDataFrame([(1 if i % 2 else None, f"some words of text {i % 9}", "en" if i % 3 else "de") for i in range(60)], "doc_id long, text string, lang string")
    assert quality_classifier.classify(docs).count() == 60
    language_id.fit(docs)
    assert sizes == [(7, 7), ["de"] * 4 + ["en"] * 4]


def test_classifier_agrees_with_held_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.classify(docs).join(labels, "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    assert got[got.quality == 1].kept.mean() > 0.98


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls_equal_brute_force(spark):
    urls = [None, "", "x", "http://", "http://EXAMPLE.com/en/7", "http://a.example.com/en/71?x=/en/", "http://xexample.com/en/7", "https://com/en/", "http://a.com/en", "http://a.com/EN/x", "http://b.net/de/1",
            "http://example.net/de/8", "http://example.net/de/81#a", "http://sub.example.net/de/9", "http://q.org/es/?", "http://q.org?/es/", "http://q.org#/es/", "http://a.b/c://d.com/en/", "http://casino-win.example.net/de/5",
            "http://casino-win.example.net/fr/5", "ftp://İ.com/en/x", "http://é.org/es/a", "http://free-bets.example.org/fr/1", "http://freebets.org/fr/1", "http://a.com/en/x\ny"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id long, url string")
    got = url_filters.judge(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert verdict in (None, r.verdict)
    by = {urls[r.page_id]: r.verdict for r in got}
    assert by["http://casino-win.example.net/fr/5"] == "block" and by["http://casino-win.example.net/de/5"] == "allow" and by["http://freebets.org/fr/1"] == "allow" and by[None] == "allow"
    assert url_filters.judge(df.where("false")).count() == 0
    assert url_filters.judge(df, rules=()).where("verdict <> 'allow'").count() == 0


def test_url_columns_are_kept_and_long_urls_read_whole(spark):
    long = "http://a.com/en/" + "x/" * 200_000 + "?q"
    names = ["_tokens", "_u", "_c", "_hits", "_best", "_row", "token", "a.b"]
    df = spark.createDataFrame([(1, long, "mine")], "page_id long, url string, host string")
    for name in names:
        df = df.selectExpr("*", f"'kept' as `{name}`")
    r = url_filters.judge(df).first()
    assert (r.host, r.rule, r.verdict, len(r.path)) == ("a.com", "com/en/", "block", len(long) - len("http://a.com?q"))
    assert all(r[name] == "kept" for name in names) and url_filters.judge(df).columns == ["page_id", "url", *names, "host", "path", "rule", "matched", "verdict"]


def test_rules_are_filed_under_their_rarest_token():
    rule = url_filters.host_rule("example.com", "/en/7", "allow")
    assert rule.tokens == ("example", "com", "en") and url_filters.rarest(rule, {"example": 9, "com": 5, "en": 7}) == "com"
    assert url_filters.rarest(url_filters.Rule("x", "block", ".*x", (), False), {}) is None


def test_language_cases(odd_docs, no_docs):
    got = {r.doc_id: r for r in language_id.identify(odd_docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5, 11)) and got[1].lang_pred == got[2].lang_pred != "und"
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(("" if k is None else str(k)).encode()) % 4 == 2)
    assert language_id.identify(no_docs).count() == 0
    kept = language_id.keep_known(odd_docs, 0.0001)
    assert kept.columns == odd_docs.columns and 3 not in {r.doc_id for r in kept.collect()}
    nothing = language_id.identify(odd_docs.withColumn("lang", odd_docs["lang"].substr(99, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_kernel_equals_brute_force():
    spectrum = language_id.Spectrum()
    texts = ["the cat", "the dog and the cat", "über die Brücke", "a"]
    grams = [spectrum(t) for t in texts]
    assert spectrum("12 -- \n") is None and spectrum(None) is None
    model = language_id.train([("en", grams[0]), ("en", grams[1]), ("de", grams[2])])
    starts = (*language_id.STARTS, language_id.SPACE)

    def kernel(a, b):
        parts = []
        for lo, hi in zip(starts, starts[1:]):
            x, y = ({int(g) for g in s if lo <= g < hi} for s in (a, b))
            parts.append(len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0.0)
        return sum(parts) / 3

    landmarks = [grams[2], grams[0], grams[1]]
    want = [[kernel(a, b) for b in landmarks] for a in grams]
    assert np.allclose(model.kernels(grams), want, atol=1e-6)


def test_letters_of_all_planes(spark):
    texts = ["\U0001f600 \U0001f600", "\U0001d7ce 1", "\U00020000\U00020001", "\U0001d400\U0001d401 x", "the cat and the dog", None, "\u0301", "\U000100af"]
    docs = spark.createDataFrame([(i, t, "en" if i == 4 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert {k for k, v in got.items() if v == "und"} == {k for k, t in enumerate(texts) if not any(c.isalpha() for c in t or "")} == {0, 1, 5, 6}


def syllables(k):
    """Words of an invented language: no two share many syllables."""
    rng = np.random.default_rng(k)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 6))) for _ in range(25)]


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "DENSE_CELLS", 1000)
    rng, data = np.random.default_rng(0), []
    for k in range(300):
        words = syllables(k)
        data += [(6 * k + i, " ".join(rng.choice(words, 60)), f"l{k:03d}") for i in range(6)]
    got = language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    lang = {d: name for d, _, name in data}
    learned = {lang[r.doc_id] for r in got if not r.held_out}
    assert len(learned) == 300 and all(r.lang_pred == lang[r.doc_id] for r in got if not r.held_out)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.95


def test_scores_are_the_least_of_the_ridge(monkeypatch):
    """The scorer minimises the weighted squares plus the penalty over functions of the landmarks, and sparse products equal dense ones."""
    rng = np.random.default_rng(3)
    spectrum, rows = language_id.Spectrum(), []
    for k in range(3):
        words = syllables(k)
        rows += [(f"l{k}", spectrum(" ".join(rng.choice(words + syllables(9), 30)))) for _ in range(12 + 5 * k)]
    monkeypatch.setattr(language_id, "LANDMARKS_PER_LANG", 6)
    model, grams = language_id.train(rows, ridge=0.5), [g for _, g in rows]
    marks = language_id.landmarks_of(rows, model.langs)
    assert len(marks) == 18
    k, mm = model.kernels(grams).astype(float), model.kernels(marks).astype(float)
    w = np.array([1 / sum(l == lang for l, _ in rows) for lang, _ in rows])
    w /= w.sum()
    y = np.array([[float(l == lang) for lang in model.langs] for l, _ in rows])
    lam = 0.5 / len(rows) ** 0.5

    def cost(a, b):
        return (w[:, None] * (k @ a + b - y) ** 2).sum() + lam * np.trace(a.T @ mm @ a)

    a, b = model.weights.astype(float), model.bias.astype(float)
    least = cost(a, b)
    for _ in range(50):
        assert cost(a + 1e-2 * rng.standard_normal(a.shape), b) > least and cost(a, b + 1e-3 * rng.standard_normal(b.shape)) > least
    assert np.allclose(model.scores(grams), k @ a + b, atol=1e-4) and np.allclose(model.scores(grams).sum(axis=1), 1, atol=1e-3)
    dense = model.kernels(grams)
    monkeypatch.setattr(language_id, "DENSE_CELLS", 0)
    sparse = language_id.train(rows, ridge=0.5)
    assert np.allclose(sparse.kernels(grams), dense, atol=1e-6) and sparse.marks is None
    assert language_id.train([("only", grams[0])]).scores(grams[:1])[0, 0] == pytest.approx(1, abs=1e-5)


def test_texts_of_no_learned_language_go(spark):
    rng, data = np.random.default_rng(5), []
    for k in range(4):
        words = syllables(k)
        data += [(100 * k + i, " ".join(rng.choice(words, 80)), f"l{k}") for i in range(40)]
    data += [(1000 + i, " ".join(rng.choice(syllables(50 + i), 80)), None) for i in range(10)] + [(2000, "12 34", "l1"), (2001, None, "l1")]
    kept = {r.doc_id for r in language_id.keep_known(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert {d for d, _, l in data if d < 1000} <= kept and not kept & {2000, 2001} and len(kept & set(range(1000, 1010))) <= 3
