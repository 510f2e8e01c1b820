import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from reelloom.llm import piecewise as P


def plain_hash(octets):
    """The rolling hash after each byte, byte by byte."""
    window, plain, weighted, shifted, out = [0] * P.WINDOW, 0, 0, 0, []
    for i, c in enumerate(octets):
        weighted = weighted - plain + P.WINDOW * c
        plain += c - window[i % P.WINDOW]
        window[i % P.WINDOW] = c
        shifted = (shifted << 5 ^ c) & 0xFFFFFFFF
        out.append((plain + weighted + shifted) & 0xFFFFFFFF)
    return out


def plain_fingerprint(text):
    octets = text.encode()
    rolled = plain_hash(octets)

    def letters(size):
        out, start = "", 0
        for i, h in enumerate(rolled):
            if h % size == size - 1:
                out, start = out + P.LETTERS[zlib.crc32(octets[start : i + 1]) >> 26], i + 1
        return out + (P.LETTERS[zlib.crc32(octets[start:]) >> 26] if start < len(octets) else "")

    ends = lambda size: sum(h % size == size - 1 for h in rolled) + 1
    size = P.LEAST
    while size * P.AIM < len(octets):
        size *= 2
    while ends(size) > P.MOST:
        size *= 2
    while size > P.LEAST and ends(size) < P.FEWEST and ends(size // 2) <= P.MOST:
        size //= 2
    return f"{size}:{letters(size)}:{letters(2 * size)}"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(row[j - 1] if x == y else 1 + min(row[j], now[-1]))
        row = now
    return row[-1]


def plain_likeness(one, other):
    if one == other:
        return 1.0
    best = 0.0
    for i, a in enumerate(one.split(":")[1:]):
        for j, b in enumerate(other.split(":")[1:]):
            if int(one.split(":")[0]) << i != int(other.split(":")[0]) << j:
                continue
            if any(a[k : k + P.RUN] in b for k in range(len(a) - P.RUN + 1)):
                best = max(best, 1 - edit_distance(a, b) / (len(a) + len(b)))
    return best


def texts():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "naïve", "日本", "über", "delta\n", "x1"]
    out = ["", "a", "é", "same " * 300, "x" * 5000, "\n" * 100, "ab" * 4000]
    return out + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 150, 900]))) for _ in range(40)]


def test_fingerprints_against_a_loop_over_bytes(monkeypatch):
    for t in texts():
        assert P._rolled(np.frombuffer(t.encode(), "u1")).tolist() == plain_hash(t.encode())
        assert P.fingerprint(t) == plain_fingerprint(t)
    monkeypatch.setattr(P, "STEP", 50)
    for t in texts()[:20]:
        assert P.fingerprint(t) == plain_fingerprint(t)


def test_likeness_against_the_edit_distance():
    rng = random.Random(3)
    prints = [P.fingerprint(t) for t in texts()]
    for t in texts():
        cut = rng.randint(0, len(t))
        prints.append(P.fingerprint(t[:cut] + "Q" + t[cut:]))
    pairs = [(a, b) for a in prints for b in prints[::5]]
    for a, b in pairs:
        assert P.likeness(a, b) == P.likeness(b, a) == pytest.approx(plain_likeness(a, b))
        assert 0 <= P.likeness(a, b) <= 1
    assert P._alike("", "abc") == 0 and P.likeness("3::", "3::") == 1


def test_small_edits_stay_near_and_strangers_do_not():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    make = lambda: " ".join(word() for _ in range(rng.randint(150, 3000)))
    own = [make() for _ in range(60)]
    for i, t in enumerate(own):
        at = rng.randint(0, len(t))
        assert P.likeness(P.fingerprint(t), P.fingerprint(t[:at] + " inserted words " + t[at:])) > 0.8
        assert P.likeness(P.fingerprint(t), P.fingerprint(P.edited(t, own[i - 1]))) > 0.3
        assert P.likeness(P.fingerprint(t), P.fingerprint(own[i - 1])) < 0.2


def brute(rows):
    """Every row's answer by a sort of all rows; ties by nothing but the text, so these must be alike."""
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    out = []
    for r, after in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        a, b = r.text or "", after.text or ""
        n = len(a) // 2
        changed = a[: len(a) - n] + b[:n]
        f, g, h = P.fingerprint(a), P.fingerprint(changed), P.fingerprint(b)
        out.append((r.doc_id, len(a), sha256(changed.encode()).hexdigest(), f, g, P.likeness(f, g), P.likeness(f, h)))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_successors_against_a_sort(spark, blocks):
    rng = random.Random(blocks)
    ids = rng.sample(range(-500, 500), 150)
    rows = [(None, "no id")] + [(i, None if i % 17 == 0 else " ".join(rng.choice(["ab", "cde", "é"]) for _ in range(rng.randint(0, 300)))) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in P.successors(docs, blocks).collect()), key=str) == brute(docs.collect())


def test_edge_rows(spark, edge_docs, no_docs):
    got = P.successors(edge_docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = got.collect()
    assert len(rows) == edge_docs.count() and P.successors(no_docs).count() == 0
    by_text = {t.text or "": P.fingerprint(t.text or "") for t in edge_docs.collect()}
    assert sorted(r.fingerprint for r in rows) == sorted(by_text[t.text or ""] for t in edge_docs.collect())
    assert sorted(r.fingerprint for r in P.fingerprints(edge_docs).collect()) == sorted(r.fingerprint for r in rows)
    one = P.successors(edge_docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    copies = spark.createDataFrame([(5, "same text here")] * 30 + [(6, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.near_next) for r in P.successors(copies, 4).collect()) == [(5, 0.0), *[(5, 1.0)] * 29, (6, 0.0)]
