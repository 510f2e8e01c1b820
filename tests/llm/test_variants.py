import random
import re
import zlib
from collections import Counter

import pytest

from reelloom.llm import variants as V


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """Every word's answer by comparing all with all."""
    by = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, found in by.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), form[w] and words[form[w]]))
    return sorted(out, key=str)


def plain_words(rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def vocabulary(rng, syllables):
    """Words of common pieces, their misspellings, and runs of one letter."""
    words = {"".join(rng.choices(syllables, k=rng.randint(3, 6))) for _ in range(250)}
    for w in list(words):
        for _ in range(2):
            i, c = rng.randint(0, len(w)), rng.choice("abé")
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    words |= {"a" * n for n in range(6, 14)} | {"ab" * n for n in range(3, 7)} | {"x" * 3000, "x" * 3001}
    return {w: rng.choice([5, 6, 24, 25, 30, 125, 700]) for w in words if len(w) >= 6}


@pytest.mark.parametrize(("places", "longest"), [(256, 32), (3, 2), (0, 1)])
def test_groups_against_all_pairs(spark, places, longest):
    rng = random.Random(places)
    words = vocabulary(rng, ["an", "be", "tion", "ing", "é", "o", "ster"])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = V.grouped(df, places=places, longest=longest)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(words)


def test_an_edit_changes_no_more_grams_than_the_bound():
    rng = random.Random(1)
    words = list(vocabulary(rng, ["an", "be", "tion", "ing", "é", "o"]))
    counts = Counter(w[i : i + q] for w in words for q in (2, 3) for i in range(len(w) - q + 1))
    for least in (0, 5, 60):
        frequent = {g: n for g, n in counts.items() if n > least}
        grams = lambda w: Counter(w[a : a + n] for a, n in V.decompose(w, frequent))  # noqa: E731, B023
        for w in words[:300]:
            if len(w) > 50:
                continue
            bound = V.affected(w, V.decompose(w, frequent), frequent)
            assert bound <= V.LONGEST_GRAM
            for i in range(len(w) + 1):
                for other in (w[:i] + "q" + w[i:], w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :]):
                    assert (grams(w) & grams(other)).total() >= len(w) - 1 - bound


def test_short_words_are_refused():
    with pytest.raises(ValueError):
        V.merged_lists("ab", {})


def test_counts_on_edge_rows(spark, edge_docs, no_docs, tmp_path):
    rows = edge_docs.collect()
    got = {r.word: r.n for r in V.counted(edge_docs).collect()}
    assert got == plain_words(rows)
    many = spark.createDataFrame([(i, "Übergang commonest words ÀÉ Thousands " * 3) for i in range(400)], "doc_id long, text string")
    assert {r.word: r.n for r in V.counted(many).collect()} == plain_words(many.collect())
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert V.op11_spelling_variants(spark, str(tmp_path)).count() == 0


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    try:
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    except duckdb.Error:
        pytest.skip("no driver tables here")
    got = V.op11_spelling_variants(spark, folder)
    assert sorted(map(str, duck.execute(V.OP11_SQL).fetchall())) == sorted(str(tuple(r)) for r in got.collect())
