import random
import re

import numpy as np
import pytest

from reelloom.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    marked = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed


def test_statistics_against_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(10)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "# ", "é "]) for _ in range(rng.randint(0, 120))), "en", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in quality.judge(docs).collect():
        assert tuple(r[f] for f in fields) == brute(rows[r.doc_id][1])
        assert not (r.base_failed and r.kept)
    got = sorted(tuple(r[f] for f in fields) for r in quality.judge(edge_docs).collect())
    assert got == sorted(brute(r.text) for r in edge_docs.collect())
    assert quality.judge(no_docs).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 400))), "en", "s", 1) for i in range(200)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(150)), "en", "s", 1) for i in range(10)]
    rows += [(2000 + i, " ".join(word() for _ in range(100)), None, None, 1) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")


def test_outliers_go_and_clean_documents_stay(spark, corpus):
    kept = {r.doc_id: r.kept for r in quality.judge(corpus).collect()}
    assert all(kept[i] for i in range(200)) and all(kept[2000 + i] for i in range(5))
    assert not any(kept[1000 + i] for i in range(10))
    stays = quality.filter_docs(corpus)
    assert stays.columns == corpus.columns
    assert {r.doc_id for r in stays.select("doc_id").collect()} == {i for i, k in kept.items() if k}


def test_small_groups_are_measured_by_their_language_or_by_all(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    text = lambda end="": " ".join(word() + end for _ in range(rng.randint(60, 400)))
    rows = [(i, text(), "en", f"s{i % 20}") for i in range(200)]
    rows += [(1000 + i, text("###"), "en", f"s{i}") for i in range(5)]
    rows += [(2000, text(), "fr", "s1"), (2001, text("###"), "fr", "s1"), (2002, text("###"), None, None), (2003, text(), None, None)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.distance is not None for r in found.values())
    assert {i for i, r in found.items() if not r.kept} == {1000, 1001, 1002, 1003, 1004, 2001, 2002}


def test_each_statistic_alone_can_reject(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    twice = words(30)
    planted = {
        "n_words": words(30000),
        "word_chars": " ".join(word() * 12 for _ in range(150)),
        "n_symbols": " ".join("#" * len(w) if i % 5 < 3 else w for i, w in enumerate(words(200).split())),
        "n_dup_lines": "\n".join(f"note\nnote\n{words(12)}" for _ in range(15)),
        "n_repeat_words": f"{twice} {words(75)} {twice} {words(75)}",
    }
    rows = [(i, words(rng.randint(60, 400)), "en", "s") for i in range(300)] + [(1000 + k, t, "en", "s") for k, t in enumerate(planted.values())]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i].kept for i in range(300))
    for k, name in enumerate(planted):
        r = found[1000 + k]
        assert not r.base_failed and not r.kept, name
        assert all(r[other] == 0 for other in ("n_symbols", "n_dup_lines", "n_repeat_words") if other != name)


def test_quantiles():
    assert quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 5) == pytest.approx(0.75)
    assert quality.chi2_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)


def concentrate(x, start, keep=quality.KEEP):
    """Concentration steps in numpy from (mean, covariance), to a set that stays: mean, covariance, log-determinant."""
    near = quality.chi2_quantile(keep, quality.DIMS)
    widen = keep / quality.chi2_cdf(near, quality.DIMS + 2)
    ridge = np.diag([(s * quality.SCALE) ** 2 for s in quality.LEAST_SD])
    mean, cov = start
    chosen = None
    for _ in range(200):
        off = x - mean
        far = np.einsum("ij,ij->i", off, np.linalg.solve(cov, off.T).T)
        order = np.argsort(far, kind="stable")[: int(np.ceil(keep * len(x)))]
        if chosen is not None and set(order) == chosen:
            break
        chosen = set(order)
        mean, cov = x[order].mean(0), np.cov(x[order].T, bias=True) * widen + ridge
    return mean, cov, np.linalg.slogdet(cov)[1]


def test_estimates_against_numpy_from_many_starts(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 60, (400, 5)), "b": rng.normal(0, 30, (150, 5)) + 200}
    groups["a"][:80] += 700  # a fifth that lies elsewhere
    rows = [(g, int(k * 1000 + i), *map(int, np.round(v))) for k, (g, x) in enumerate(groups.items()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "g string, key long, " + ", ".join(f"x{i} long" for i in range(5)))
    found = {r.g: r for r in quality.estimates(vectors).collect()}
    for g in groups:
        x = np.array([r[2:] for r in rows if r[0] == g], float)
        r = found[g]
        factor = np.array([[r[f"l{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        mean, cov = np.array([r[f"m{i}"] for i in range(5)]), factor @ factor.T
        again = concentrate(x, (mean, cov))
        assert np.allclose(again[0], mean, atol=6) and abs(again[2] - np.linalg.slogdet(cov)[1]) < 0.1  # a fixed point but for rings of distance
        ridge = np.diag([(s * quality.SCALE) ** 2 for s in quality.LEAST_SD])
        best = min(concentrate(x, (p.mean(0), np.cov(p.T, bias=True) + ridge))[2] for p in (x[rng.choice(len(x), 10, replace=False)] for _ in range(60)))
        assert np.linalg.slogdet(cov)[1] < best + 0.15
    assert np.abs(np.array([found["a"][f"m{i}"] for i in range(5)])).max() < 40  # the fifth does not pull


def test_verdict_is_the_distance_from_the_groups_estimate(spark, corpus):
    got = quality.judge(corpus).collect()
    assert list(got[0].asDict()) == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "distance"]
    cutoff = quality.chi2_quantile(1 - quality.TAIL, quality.DIMS)
    assert all(r.kept == (not r.base_failed and r.distance <= cutoff) for r in got)


def test_filter_on_edge_documents_and_on_none(spark, edge_docs, no_docs):
    kept = [(r.doc_id, r.n_words) for r in quality.judge(edge_docs).collect() if r.kept]
    assert quality.filter_docs(edge_docs).count() == len(kept)
    assert quality.filter_docs(edge_docs).columns == edge_docs.columns
    assert quality.filter_docs(no_docs).count() == 0
