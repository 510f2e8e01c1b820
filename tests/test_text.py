"""Cleaning and folding, on the cases of the fixtures."""

import pytest
from pyspark.sql import functions as F

from reelloom.functions import text as tx
from reelloom.functions.normal import with_bare, with_composed


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_clean_text(apply):
    cases = {
        "  Ravi \t": "Ravi", "Production house": "Production house", "160 minutes [ 1 ]": "160 minutes", "X[12]": "X", "X [ a ]": "X", "X [note 2]": "X",
        "Cast [edit]": "Cast", "12 January 2020 ( 2020-01-12 )": "12 January 2020", "S. S. R & Co: it's": "S. S. R & Co: it's", None: "", "": "", "a [ ] b": "a b",
    }
    assert apply(tx.clean_text, list(cases)) == list(cases.values())


def test_placeholders_and_pointers(apply):
    assert all(apply(tx.is_placeholder, ["", " ", "-", "—", "N/A", "TBA", "unknown", "[ citation needed ]", "none", None]))
    assert not any(apply(tx.is_placeholder, ["Ravi Teja", "A Company", "3 Monkeys"]))
    assert apply(tx.is_cross_reference, ["see below", "See Distribution.", "A Company", None]) == [True, True, False, False]


def test_names_and_lists(apply):
    assert apply(tx.clean_name, ["Name (special appearance)", "• Name", "Ravi Teja - guest", "Sun & Moon"]) == ["Name", "Name", "Ravi Teja", "Sun & Moon"]
    assert apply(tx.split_values, ["A\nB\nC", "A, B and C", "Sun & Moon", "S. S. R", None, ""]) == [["A", "B", "C"], ["A", "B", "C"], ["Sun & Moon"], ["S. S. R"], [], []]
    assert apply(tx.split_camel_run, ["Ravi TejaPrakash Raj", "Ravi"]) == [["Ravi Teja", "Prakash Raj"], ["Ravi"]]
    deduped = lambda c: tx.dedupe_names(F.split(c, ","))
    assert apply(deduped, ["Ravi Teja,ravi teja,Prakash Raj", "-,A,a"]) == [["Ravi Teja", "Prakash Raj"], ["A"]]
    assert apply(tx.multi_values, ["Action| action ||Drama", None]) == [["Action", "Drama"], []]
    assert apply(tx.plain_values, ["A | A| "]) == [["A", "A"]]
    captions = lambda c: tx.drop_captions(F.split(c, ","))
    assert apply(captions, ["Songs:,Radhan,Score:,Harsha"]) == [["Radhan", "Harsha"]]


def test_keys(apply):
    a, b, c, d = apply(tx.key, ["Nenu.. Sailaja...", "Nenu Sailaja", "Pokiri", "Pokkiri"])
    assert a == b and c != d
    assert apply(tx.label_key, ["Production house", "Music by", "Directed by:"]) == ["production house", "music by", "directed by"]
    assert apply(tx.display_title, ["T (2000 film)", "T (film)", "T (2021 Telugu film)", "A: B"]) == ["T", "T", "T", "A: B"]
    assert apply(tx.name_key, ["S. S. Rajamouli", "S S  Rajamouli", "D'Cruz", None]) == ["s s rajamouli", "s s rajamouli", "dcruz", ""]
    assert apply(tx.search_key, ["R & B", "R and B"]) == ["r and b", "r and b"]


def test_unicode_forms(spark):
    df = spark.createDataFrame([(1, "Café ﬁn"), (2, "plain"), (3, None), (4, "a &amp; b")], "i int, v string")
    assert {r.i: r.x for r in with_bare(df, "v", "x").collect()} == {1: "Cafe fin", 2: "plain", 3: None, 4: "a &amp; b"}
    assert {r.i: r.x for r in with_composed(df, "v", "x").collect()}[4] == "a & b"


def test_years_urls_and_filters(apply):
    assert apply(tx.parse_year, ["2006", " 2006 ", "2006.0", "abc", "1900", "2100", None]) == [2006, 2006, None, None, None, None, None]
    base = "https://en.wikipedia.org/wiki/"
    url = apply(lambda c: tx.title_to_url(c, base), ["A: B (2000 film)", "50% off", "café"])
    assert url == [base + "A:_B_(2000_film)", base + "50%25_off", base + "caf%C3%A9"]
    assert apply(tx.url_to_title, url) == ["A: B (2000 film)", "50% off", "café"]
    ok = [base + "Pushpa:_The_Rise", base + "Category:Films", "http://x.org/wiki/A", None, base + "A b"]
    assert apply(tx.is_article_url, ok) == [True, False, False, False, False]
    assert apply(tx.is_non_work, ["List of films", "May", "2004", "A Film", ""]) == [True, True, True, False, True]
    assert apply(tx.is_month_or_day, ["J A N U A R Y", "12", "", "Jana Gana"]) == [True, True, True, False]
    assert apply(tx.strip_credit, ["Produced by Leaf Films", "Banner: X", "A House", "-"]) == ["Leaf Films", "X", "A House", ""]
    assert apply(tx.iso_date, ["on 2021-12-17.", None]) == ["2021-12-17", ""] and apply(tx.year_in, ["in 2004", "12004"]) == [2004, None]
    parts = apply(tx.query_parts, ["pokiri 2006", "2006", "a 1999 b 2001"])
    assert [(p.text, p.year) for p in parts] == [("pokiri", 2006), ("2006", None), ("a b", 1999)]


def test_plausible_redirects(spark):
    cases = [("List of films of 2020", "Eureka", False), ("Yogi (2007 film)", "Yogi", True), ("Yogi", "Yogi (film)", True), ("Baahubali characters", "Sivudu", False), ("Other", "Yogi", False), (None, "Yogi", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, n string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", tx.is_plausible(F.col("t"), F.col("n"))).collect())


def test_marks_entities_and_white_space(spark):
    from reelloom.operators import search

    one = spark.range(1)
    get = lambda *c: list(one.select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first())
    lit = F.lit
    assert get(tx.name_key(lit("José Núñez")), tx.name_key(lit("José Núñez")), tx.name_key(lit("Łódź ΆΒΓ й"))) == ["jose nunez", "jose nunez", "łodz αβγ и"]
    assert get(tx.search_key(lit("Amélie & Co")), tx.key(lit("Straße ñ"))) == ["amelie and co", "stra e n"]
    assert get(tx.split_values(lit("AT&amp;T, B &#233;&#x1F600;; &nosuch; x")), tx.unescaped(lit("a & b &lt;c&gt &eacute;"))) == [["AT&T", "B é😀", "&nosuch", "x"], "a & b <c&gt é"]
    assert get(tx.parse_year(lit("\t2001\n")), tx.multi_values(lit("a\t|b|A | ")), tx.plain_values(lit(" x|x\n"))) == [2001, ["a", "b"], ["x", "x"]]
    titles = spark.createDataFrame([(1, "Amélie", 2001), (2, "Other", 2001)], "id long, title string, year int").withColumn("key", tx.search_key(F.col("title")))
    assert [r.id for r in search.search(titles, "amelie").collect()] == [1]
    asked = spark.createDataFrame([(7, "AMÉLIE"), (8, "th er"), (9, "zz"), (10, "o")], "query_id long, query string")
    assert sorted((r.query_id, r.id) for r in search.batch_search(titles, asked).collect()) == [(7, 1), (8, 2), (10, 2)]


def test_a_file_that_is_no_array_is_refused(spark, tmp_path):
    from reelloom.sources import files

    (tmp_path / "a.json").write_text(' [{"movie_name": "A", "year": "2001", "cast": ["x"]}]')
    assert files.read_json(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.json").write_text('{"movie_name": "B"}')
    with pytest.raises(ValueError, match="no array"):
        files.read_json(spark, str(tmp_path))


def test_sessions_fold_alike_whatever_the_order_of_arrival():
    import random

    from reelloom.streaming import jobs

    events = [(i, "guess", i % 11, 10, i % 11 != 3) for i in range(9)] + [(9, "unlock", 0, 10, True), (10, "guess", 10, 10, True)]
    want = jobs.fold(events)
    assert want == ("won", 8, True, (0, 1, 2, 4, 5, 6, 7, 10))
    for seed in range(20):
        random.Random(seed).shuffle(events)
        assert jobs.fold(events) == want


def test_plain_texts_skip_what_would_not_change_them(apply, monkeypatch):
    """The short way for plain texts and ASCII gives what the long way gives, on random texts of awkward pieces."""
    import random

    rng = random.Random(3)
    pieces = ["a", "B", "7", "#", ".", "'", "/", "_", " ", "  ", "\n", "\t", "-", "–", ",", ";", "(", ")", "[", "]", "[1]", "&", "&amp;", "&#233;", "&#0;", "&#xZ;", "&nosuch;", "&apos;", "é", "Ł", "ﬁ", " ", "’", "and", " and ", "N/A", "tba", " (film)", " - as x", "|", "\x1c", "İ", "K"]
    made = ["".join(rng.choice(pieces[: rng.choice([9, 10, len(pieces)])]) for _ in range(rng.randint(0, 7))) for _ in range(800)] + [None]
    joined = lambda f: lambda c: F.array_join(f(c), "\x00")
    functions = [tx.clean_text, tx.clean_name, tx.key, tx.label_key, tx.name_key, tx.search_key, tx.is_placeholder, joined(tx.split_values), joined(lambda c: tx.dedupe_names(F.split(c, " ")))]
    got = [apply(f, made) for f in functions]
    assert sum(g == m for g, m in zip(got[0], made, strict=True)) > 100
    monkeypatch.setattr(tx, "unless_plain", lambda c, f: f(c))
    monkeypatch.setattr(tx, "MARKED", r"^")  # every text takes the long way
    assert got == [apply(f, made) for f in functions]


def test_only_texts_that_composition_changes_leave_the_jvm():
    import random
    import re
    import unicodedata

    from reelloom.functions.normal import composed, uncomposed

    inner = re.sub(r"^\[[^&]*&&(\[.*?\])\]", r"\1", uncomposed())  # Python has no intersection of classes
    pattern = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", inner))
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x80, 0x30000) if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c))]
    n_left = 0
    for _ in range(30_000):
        text = "".join(rng.choice([rng.choice("aeK& ;#"), chr(rng.randrange(0x80, 0x600)), chr(rng.randrange(0x900, 0xD7FF)), rng.choice(marks)]) for _ in range(rng.randint(1, 5)))
        if not pattern.search(text):
            n_left += 1
            assert composed(text) == text
    assert n_left > 1000
    assert not pattern.search("Café Ñandú ß & co") and pattern.search("e\u0301") and pattern.search("&eacute;")


def test_clean_texts_need_no_python(spark):
    from reelloom.functions.normal import with_composed

    made = spark.createDataFrame([(1, "Café & ß"), (2, "Cafe\u0301 &eacute;"), (3, None), (4, "plain")], "k int, t string")
    assert {r.k: r.u for r in with_composed(made, "t", "u").collect()} == {1: "Café & ß", 2: "Café é", 3: None, 4: "plain"}


def test_labels_of_plain_words(spark):
    """A label of words with single spaces only loses its capitals; any other is cleaned in full."""
    words = ["Production house", "a_1", "X", "TITLE 2"]
    other = ["", " a", "a ", "a  b", "a:b", "a.b.", "Sta\u00f1r", "a\u00a0b", "a\n", "a &amp; b", "Cast[1]", None]
    df = spark.createDataFrame([(x,) for x in [*words, *other]], "c string")
    got = df.select("c", F.col("c").rlike(tx.WORDS).alias("plain"), tx.label_key(F.col("c")).alias("k")).collect()
    assert [r.k for r in got if r.plain] == [x.lower() for x in words]
    assert [r.k for r in got if not r.plain] == ["", "a", "a", "a b", "a b", "a.b", "sta\u00f1r", "a b", "a", "a & b", "cast", ""]
