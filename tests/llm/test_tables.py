"""Operators on whole tables: exact duplicates, the manifest, collocations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.llm import collocations, exact_dedup, merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Exact duplicates


def exact_truth(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(order):
            out[i, order[0], len(ids), k == 0, digest(text)] += 1
    return out


@pytest.fixture(params=[None, 300])
def few_bytes(request, monkeypatch):
    """Also with a memory that forgets names soon."""
    if request.param:
        monkeypatch.setattr(exact_dedup, "HELD", request.param)


def test_exact_groups_against_plain_python(llm, odd_docs, few_bytes):
    rng = random.Random(3)
    long = "".join(rng.choice("ab ") for _ in range(40_000))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    # equal in the first piece, the second, the third; different at the very end; different white space
    rows += [(100 + i, long[: 40 + 13 * (i % 5)]) for i in range(20)]
    rows += [(200 + i, long + "xy"[i % 2]) for i in range(6)] + [(210 + i, long.replace(" ", "\n\t", i)) for i in range(4)]
    rows += [(300 + i, long[:2000] + "xyz"[i % 3] + long[2001:3000]) for i in range(9)] + [(400, " "), (401, " "), (402, "é" * 28), (403, "é" * 28 + " ")]
    rows += [(500 + i, "one text of a third of all rows") for i in range(60)]
    rng.shuffle(rows)
    frame = llm.createDataFrame([(*r, 1, "m", 0) for r in rows], "doc_id long, text string, mid long, piece string, n long").repartition(7)
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == exact_truth(rows)


def test_exact_rows_kept(llm, odd_docs, no_docs):
    kept = exact_dedup.dedup_exact(odd_docs)
    assert kept.columns == odd_docs.columns
    want = exact_truth([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k[0]) for k, n in want.items() if k[3] for _ in range(n))
    assert exact_dedup.exact_groups(no_docs).collect() == [] and exact_dedup.dedup_exact(no_docs).collect() == []


def test_pieces_cover_any_length():
    for n in (0, 1, 1024, 1025, 10**6, 10**9):
        cuts = exact_dedup.pieces_of(n)
        assert [a for a, _ in cuts] == np.cumsum([0, *[w for _, w in cuts]])[:-1].tolist() and sum(w for _, w in cuts) >= n
        assert all(w <= exact_dedup.LONGEST for _, w in cuts) and len(cuts) < 70


# Manifest


def fields(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_truth(rows, tampered, changes):
    """Every root rebuilt from all leaves: rows are (id, source, text)."""

    def lift(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
        return out

    def siblings(tree, at):
        out = ""
        for low in tree[:-1]:
            a = at // 16 * 16
            out += "".join(h for k, h in enumerate(low[a : a + 16], a) if k != at)
            at //= 16
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, digest(fields(r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
    trees = [lift([x[2] for x in groups[s]]) for s in names]
    top = lift([t[-1][0] for t in trees])
    out = Counter()
    for g, s in enumerate(names):
        for k, (_, _, leaf, r) in enumerate(groups[s]):
            folded = top[-1][0]
            if tampered(r) and changes(r) != r:
                leaves = [x[2] for x in groups[s]]
                leaves[k] = digest(fields(changes(r)))
                subs = [t[-1][0] for t in trees]
                subs[g] = lift(leaves)[-1][0]
                folded = lift(subs)[-1][0]
            proof = digest(siblings(trees[g], k) + siblings(top, g))
            out[r[0], leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("plain", [10, 10**6])
def test_manifest_against_rebuilt_trees(llm, monkeypatch, plain):
    monkeypatch.setattr(merkle, "PLAIN_ROWS", plain)
    rng = random.Random(5)
    rows = [(i, "hot", f"Text {i}") for i in range(600)] + [(1000 + i, f"s{i % 23}", rng.choice(["A", "b", None, "", "Ünï"])) for i in range(150)]
    rows += [(2000, "=", "x"), (2001, "", "Y"), (2002, None, "Z"), (None, None, None), (None, "hot", "N"), (7, "hot", "Text 7"), (7, "hot", "Text 7"), (3000, "one", "A" * 5000)]
    rows += [(4000 + i, "full", "F") for i in range(256)] + [(5000 + i, "more", "M") for i in range(257)]
    frame = llm.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, part string, pos int").repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(frame, ["doc_id", "source", "text"], tampered=tampered, changes={"text": F.lower("text")})
    keys = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    low = lambda r: (r[0], r[1], r[2].lower() if r[2] is not None else None)
    hit = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    assert Counter(tuple(r[k] for k in keys) for r in got.collect()) == tree_truth(rows, hit, low)


def test_manifest_versions_copy_only_ancestors(llm, no_docs):
    rows = [(i, "s", f"T{i}") for i in range(300)] + [(1000, "t", "x")]
    frame = llm.createDataFrame(rows, "doc_id long, source string, text string")
    got = merkle.manifest(frame, ["doc_id", "text"], tampered=F.col("doc_id") == 17, changes={"text": F.lower("text")}).collect()
    # leaf, three levels of 300 leaves, one level of two groups
    assert [len(r.copied) for r in got if r.doc_id == 17] == [5] and all(not r.copied for r in got if r.doc_id != 17)
    assert [r.doc_id for r in got if not r.verified] == [17]
    alone = merkle.manifest(frame.where("doc_id = 1000"), ["doc_id", "text"]).first()
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.proof_sha256 == digest("")
    assert merkle.manifest(no_docs.withColumn("source", F.lit("a")), ["doc_id", "text"]).collect() == []


# Collocations


def split(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def collocation_truth(rows, longest=3, least=10, cover=50, best=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for w in split(text):
            for k in range(1, longest + 1):
                f[lang or "und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in candidates.items():
            if any(p in (q[i : i + len(p)] for i in range(len(q) - len(p) + 1)) and 100 * c >= cover * a for q, c in candidates.items() if len(q) > len(p)):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, le, r = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), le, r))
        for k, (s, a, p, le, r) in enumerate(sorted(scored)[:best]):
            out.append((lang, k + 1, p.decode(), -a, le, r, n, -s))
    return sorted(out)


def random_texts(seed, rows=260):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "de", "en", "es", "a", "é", "x" * 300, "New", "York", "city", " ", "q\x00", "don't"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]
    out = [(rng.choice(["en", "de", "es", None, "und", ""]), "".join(rng.choice(vocab) + rng.choice(ends) for _ in range(rng.randint(0, 120)))) for _ in range(rows)]
    return out + [("en", None), ("en", ""), ("de", " \t\n"), (None, "word"), ("en", "the of " * 3000), ("fr", "once only here")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_against_plain_python(llm, monkeypatch, small):
    if small:  # many routes, words that go by two routes, vocabularies and chunks sent on early
        for name, value in (("ROUTE", 900), ("CHUNK", 3000), ("HOT", 200), ("MOST_HOT", 1 << 30), ("VOCABULARY", 40)):
            monkeypatch.setattr(collocations, name, value)
    rows = random_texts(1)
    frame = llm.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, a long, ids string").repartition(5)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[c] for c in names) for r in collocations.collocations(frame).collect()) == collocation_truth(rows)
    few = collocations.collocations(frame, longest=4, least=25, cover=80, best=5)
    assert sorted(tuple(r[c] for c in names) for r in few.collect()) == collocation_truth(rows, 4, 25, 80, 5)


def test_collocations_of_nothing(llm, no_docs):
    frame = no_docs.withColumn("lang", F.lit("en"))
    assert collocations.collocations(frame).collect() == []
    none = llm.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert collocations.collocations(none).collect() == []


def test_products_beyond_64_bits(llm):
    """Counts as large as a corpus has them: the score is exact integer arithmetic."""
    a, le, r = 3_000_000_000_007, 3_000_000_000_011, 4_000_000_000_003
    row = llm.sql(f"select cast({a}L as decimal(15,0)) a, cast({le}L as decimal(15,0)) l, cast({r}L as decimal(15,0)) r")
    assert row.select(collocations.score("a", "l", "r")).first()[0] == 1000000 * a * a // (le * r)


def test_prefix_counts_by_quicksort():
    rng = np.random.default_rng(2)
    for case in range(30):
        width, size, words = rng.integers(2, 5), int(rng.integers(1, 400)), int(rng.integers(1, 30))
        w = rng.integers(1, words + 1, (width, size)).astype(np.uint64)
        for k in range(2, width):
            w[k][(rng.random(size) < 0.2) | (w[k - 1] == 0)] = 0
        n = rng.integers(1, 6, size).astype(float)
        want = Counter()
        for c in range(size):
            for k in range(2, width + 1):
                if w[k - 1, c]:
                    want[tuple(w[:k, c].tolist())] += int(n[c])
        got = collocations.count_prefixes(w, n, 10)
        assert sorted((tuple(p.tolist()), c) for p, c in got) == sorted((p, c) for p, c in want.items() if c >= 10)
