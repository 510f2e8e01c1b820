import random
import zlib

import numpy as np
import pytest

from reelloom.llm import packing, token_files

P = pytest.importorskip("public_tokenizers")
KINDS = [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "end")]


@pytest.mark.parametrize(("name", "kind"), KINDS)
def test_cached_words_equal_the_tokenizer(name, kind):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = " \n  abAé,.'1 \t<|%"
    texts = ["", " ", "  a  b", "don't can't's 'x", "<|endoftext|> hi<|endoftext|>", "日本語 123", "a\x1cb", "5th a1b2", "İstanbul ΣΑΣ", "x" * 5000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    words, whole = token_files.WordCache(P.path(name), kind), Tokenizer.from_file(P.path(name))
    for t in texts:
        assert np.frombuffer(words.ids(t), words.type).tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("name", "kind"), KINDS)
def test_long_runs_take_time_in_proportion(name, kind):
    """Runs of letters or marks before a digit or a foreign letter, in texts that take the careful path."""
    import time

    from tokenizers import Tokenizer

    words, whole = token_files.WordCache(P.path(name), kind), Tokenizer.from_file(P.path(name))
    for n in [*range(1, 70), 200, 1000, 10_000]:
        for run in ("abcdefghij" * n)[:n], ("-=_+" * n)[:n], ("ab-=" * n)[:n], ("é" * n):
            for text in f"日本  {run}9", f"{run}日 \tx {run}7":
                began = time.perf_counter()
                fits = bool(words.PLAIN.fullmatch(run + "9"))
                assert not fits and time.perf_counter() - began < 0.05
                if n <= 200:
                    assert np.frombuffer(words.ids(text), words.type).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "kind"), KINDS)
def test_texts_with_long_words_equal_the_tokenizer(name, kind):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words, whole = token_files.WordCache(P.path(name), kind), Tokenizer.from_file(P.path(name))
    pieces = ["a", "ab", "é", "-", "=", "9", "日", " ", "  ", "\t", "\n", "'s", "http://", "İ"]
    for _ in range(400):
        text = "".join(p * rng.choice([1, 1, 2, 31, 64, 90]) if len(p) == 1 else p for p in rng.choices(pieces, k=rng.randint(1, 12)))
        assert np.frombuffer(words.ids(text), words.type).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark, edge_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    parts = token_files.write(edge_docs, str(tmp_path / "a"), P.path("byte_bpe_50k.json"), 2)
    got = token_files.read(parts, str(tmp_path / "a"), with_ids=True).collect()
    rows = sorted(edge_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == [r.doc_id for r in rows]
    assert sorted(tuple(r.ids) for r in got) == sorted((*t.encode(r.text or "", add_special_tokens=False).ids, 2) for r in rows)
    none = token_files.write(no_docs, str(tmp_path / "b"), P.path("byte_bpe_50k.json"), 2)
    assert token_files.read(none, str(tmp_path / "b")).count() == 0


def test_packing_covers_every_id_once(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = packing.pack(edge_docs, P.path("word_bpe_49k.json"), 1).collect()
    texts = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in edge_docs.dropDuplicates(["doc_id"]).collect() if r.doc_id not in (None, 3)}
    copies = {r.doc_id: r["count"] for r in edge_docs.groupBy("doc_id").count().collect()}
    for d, ids in texts.items():
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == d)
        assert sum(n for _, n, _ in mine) == len(ids) * copies[d]
        for start, n, crc in mine:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in by_sequence.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert packing.pack(no_docs, P.path("word_bpe_49k.json"), 1).count() == 0


def test_patterns_cover_the_demand_with_little_waste():
    rng = np.random.default_rng(0)
    demand = np.zeros(129, "i8")
    np.add.at(demand, rng.integers(1, 129, 20_000), 1)
    plan = packing.patterns(demand)
    covered = sum((counts * times for counts, times in plan), np.zeros(129, "i8"))
    assert (covered == demand).all() and all((counts * np.arange(129)).sum() <= 128 for counts, _ in plan)
    used = sum(times for _, times in plan)
    assert used <= 1.02 * -(-int((demand * np.arange(129)).sum()) // 128) + 2
    assert packing.patterns(np.zeros(129, "i8")) == []
