import hashlib
import random
import re

from reelloom.llm import pii

PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_against_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(8)
    texts = ["".join(rng.choice(al) for _ in range(rng.randint(1, 50))) for al in ("ab1@.+-_% ()0123456789é\ufffe😀", "a@.1-", "1.+4 -") for _ in range(400)]
    texts += ["4111 1111 1111 1111 x 4111-1111-1111-1112", "mail a@b.cc.d@e.ff", "1.2.3.4.5.6.7.8", "+1 (212) 555-0100.", "1" * 2000, "a" * 3000 + "@b.c"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.find(docs).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in want.split(",") if x])
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.find(edge_docs).count() == edge_docs.count()
    assert pii.find(no_docs).count() == 0


def test_patterns_discover_unseen_identifiers_and_leave_others(spark):
    rng = random.Random(9)
    docs = [(i, f"note {i} reachable at number +1 212 555 {1000 + i} thanks") for i in range(30)]
    docs += [(100 + i, f"text reachable at number 555-{2000 + i:04d} today") for i in range(5)]
    docs += [(200 + i, f"order total was {rng.randint(10**6, 10**7)} units") for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert all(got[100 + i].n_phone == 0 and got[100 + i].spans.startswith("phone:") for i in range(5))
    assert all(got[200 + i].spans == "" for i in range(20))
    assert all(got[i].n_phone == 1 for i in range(30))


def test_numbers_that_touch_each_other_are_found_and_decoys_stay_out(spark):
    rng = random.Random(10)

    def card(good=True):
        while True:
            d = str(rng.randint(10**15, 10**16 - 1))
            if luhn(d) == good:
                return d

    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    around = lambda x: f"{word()} {word()} {x} {word()} {word()}"
    docs = [(1000 + i, around(card())) for i in range(90)] + [(i, around(phone())) for i in range(40)]
    docs += [(200 + i, around(card(False))) for i in range(40)]
    docs += [(300 + i, around(f"{phone()} {card()}")) for i in range(10)]
    docs += [(400 + i, around(f"{card()} {card()}")) for i in range(10)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    planted = added = right = 0
    for i, r in got.items():
        base = set(filter(None, brute(texts[i]).split(",")))
        spans = [x for x in r.spans.split(",") if x and x not in base]
        assert r.n_added == len(spans)
        if 200 <= i < 300:
            assert not spans
        planted += 2 * (300 <= i < 1000)
        added += len(spans)
        for x in spans:
            kind, a, b = x.split(":")
            m = texts[i][int(a) : int(b)]
            right += 300 <= i < 1000 and (kind == "phone" and m.startswith("+1") or kind == "card" and len(m) == 16 and luhn(m))
    assert planted == 40 and added == right and right >= 38


def score_by_hand(rows, rounds=pii.ROUNDS, support=pii.LEAST_SUPPORT, confident=pii.CONFIDENT):
    """Confident patterns and believed instances from (pattern, k, m, seed) rows of forms, with plain dictionaries."""
    edges, seeds, total = {}, {}, {}
    for pat, k, m, seed in rows:
        edges[pat, k, m] = edges.get((pat, k, m), 0) + 1
        seeds[k, m] = seeds.get((k, m), False) or seed
    instances = {}
    for pat, k, m in edges:
        instances.setdefault((pat, k), set()).add(m)
    graph = {e: n for e, n in edges.items() if len(instances[e[0], e[1]]) >= support}
    for (pat, _, _), n in graph.items():
        total[pat] = total.get(pat, 0) + n
    belief = {x: float(s) for x, s in seeds.items()}
    for _ in range(rounds):
        sums, backed = {}, {}
        for (pat, k, m), n in graph.items():
            sums[pat, k] = sums.get((pat, k), 0) + n * belief[k, m]
            backed[pat, k] = backed.get((pat, k), 0) + (belief[k, m] > 0.5)
        scores = {p: min(s / total[p[0]], 0.999999) for p, s in sums.items() if s / total[p[0]] >= confident and backed[p] >= support}
        for (k, m), seed in seeds.items():
            said = 1.0
            for (pat, k2, m2), _ in graph.items():
                if (k2, m2) == (k, m) and (pat, k) in scores:
                    said *= 1 - scores[pat, k]
            belief[k, m] = 1.0 if seed else 1 - said
    return scores, {x for x, b in belief.items() if b >= confident}


def test_scores_against_plain_dictionaries(spark):
    rng = random.Random(12)
    rows = [(rng.randint(1, 12), rng.randint(0, 1), str(rng.randint(0, 40)), rng.random() < 0.4) for _ in range(400)]
    rows += [(13, 0, str(i), i < 9) for i in range(10)] + [(14, 1, str(100 + i), False) for i in range(6)]
    uses = spark.createDataFrame([("form", *r) for r in rows], "type string, pat long, k int, m string, seed boolean")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    patterns, believed = pii.bootstrap(docs, uses, pii.ROUNDS, pii.LEAST_SUPPORT, pii.CONFIDENT)
    scores, want = score_by_hand(rows)
    assert {(r.pat, r.k): round(r.score, 9) for r in patterns.collect()} == {p: round(x, 9) for p, x in scores.items()}
    loose = {(k, m) for _, k, m, seed in rows if not seed}
    assert {(r.k, r.m) for r in believed.collect()} == want & loose
    assert len(scores) > 1
