import random

import pytest

from recordmill.operators import grouping, matching
from pyspark.sql import functions as F


def shingles(text, k=3):
    w = text.lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute_greedy(docs, thr, coverage):
    """Longest first; join the first similar representative."""
    first, rep = {}, {}
    for key in sorted(docs):
        first.setdefault(docs[key], key)
    reps = []
    for key in sorted(first.values(), key=lambda k: (-len(docs[k]), k)):
        a = shingles(docs[key])
        for r in reps:
            b = shingles(docs[r])
            la, lb = len(docs[key]), len(docs[r])
            if min(la, lb) >= coverage * max(la, lb) and len(a & b) / len(a | b) >= thr:
                rep[key] = r
                break
        else:
            reps.append(key)
            rep[key] = key
    return {k: rep[first[v]] for k, v in docs.items()}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = []
    hot = [rnd.choice(words) for _ in range(30)]
    for _ in range(40):  # a third of all texts are variants of one
        d = list(hot)
        for _ in range(rnd.randint(0, 3)):
            d[rnd.randrange(len(d))] = rnd.choice(words)
        docs.append(d[: rnd.randint(24, 30)])
    for _ in range(60):
        d = [rnd.choice(words[:12]) for _ in range(rnd.randint(1, 25))]
        docs.append(d)
        if rnd.random() < 0.4:
            docs.append(d[:-1] or d)
    return {i: " ".join(d) for i, d in enumerate(docs)}


@pytest.mark.parametrize("front,hot", [(1, 64), (16, 4)])
def test_greedy_links_equal_brute_force(spark, monkeypatch, front, hot):
    monkeypatch.setattr(grouping, "HOT_BUCKET", hot)
    docs = corpus(7)
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    rounds = []
    links = grouping.greedy_links(df, [], "id", "text", [0.5, 0.8], coverage=0.6, front=front, trace=rounds)
    assert all(a > b for a, b in zip(rounds, rounds[1:])) and rounds[-1] == 0
    got = {(r.thr, r.id): r.representative for r in links.collect()}
    for thr in (0.5, 0.8):
        want = brute_greedy(docs, thr, 0.6)
        assert {k: got[thr, k] for k in docs} == want
        assert len(set(want.values())) < len(docs)


def test_consensus_by_hand(spark):
    df = spark.createDataFrame([("g", 1, "a b c"), ("g", 2, "a x c"), ("g", 3, "a b"), ("g", 4, "a b c z")], "g string, k long, t string")
    got = {r.k: (r.n_positions, round(r.agreement, 6)) for r in grouping.consensus_agreement(df, ["g"], "k", F.split("t", " ")).collect()}
    assert got == {1: (3, 1.0), 2: (3, 0.666667), 3: (2, 1.0), 4: (3, 1.0)}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_candidates_miss_nothing(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(90)]
    left, right = list(enumerate(names[:40])), list(enumerate(names[40:]))
    a, b = [spark.createDataFrame(x, "key long, norm string") for x in (left, right)]
    got = {(r.l, r.r) for r in matching.edit_candidates(a, b).collect()}
    want = {(i, j) for i, x in left for j, y in right if 1 - lev(x, y) / max(len(x), len(y)) > 0.6}
    assert got == want and want


def test_fuzzy_rounds(spark):
    left = [(1, "North River Station 7"), (2, "north river station 7"), (3, "alpha bravo charlie delta"), (4, "zulu"), (5, "unlike anything")]
    right = [(10, "NORTH-RIVER station7"), (11, "alpha bravo charlie delte"), (12, "zulus"), (13, "north river station 7")]
    a, b = [spark.createDataFrame(x, "key long, name string") for x in (left, right)]
    got = {(r.l, r.r, r["round"]) for r in matching.fuzzy_match(a, b, "key", "key", "name").collect()}
    assert got == {(1, 10, 1), (2, 13, 1), (3, 11, 2), (4, 12, 3)}
