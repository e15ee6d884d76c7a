"""Operators on pairs: Jaccard join, line dedup, containment."""

import random
from itertools import combinations

import numpy as np
import pytest

from recordmill.llm import decontaminate, jaccard_join, line_dedup
from recordmill.llm.components import components
from recordmill.llm.regions import links_in_regions


def groups_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def mutate(rng, words, share):
    return [rng.choice("abcdefgh") * 5 if rng.random() < share else w for w in words]


def test_components_of_paths_and_stars(llm):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (None, 3), (500, 499)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components(llm.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p if x is not None and p[0] != p[1] and None not in p}
    assert got == groups_of([p for p in pairs if None not in p and p[0] != p[1]], nodes)


def test_jaccard_against_all_pairs(llm, monkeypatch):
    """Families at every distance and a shared passage; cells are divided again from three members on."""
    monkeypatch.setattr(jaccard_join, "LARGE_CELL", 3)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))] + passage
        texts += [" ".join(mutate(rng, words, rng.choice([0, 0.01, 0.02, 0.04]))) for _ in range(12)]
    docs = list(enumerate(texts))
    frame = llm.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for size, num, den in ((3, 90, 100), (5, 8, 10)):
        sets = {i: shingles(t, size) for i, t in docs}
        links = [
            (a, b) for a, b in combinations(sets, 2) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
        ]
        want = groups_of(links, sets)
        got = jaccard_join.jaccard_groups(frame, size=size, num=num, den=den).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_jaccard_of_small_sets_at_any_threshold(llm):
    rng = random.Random(31)
    texts = ["a b c d", "a b c d e", "p q r", "p q r s", "a", "a b", "", None]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    frame = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    for num, den in ((5, 10), (1, 3), (7, 10), (8, 10)):
        links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
        got = jaccard_join.jaccard_groups(frame, size=2, num=num, den=den).collect()
        assert {r.doc_id: r.component_id for r in got} == groups_of(links, sets)


def test_longer_runs_lose_nothing():
    for num, den in ((9, 10), (90, 100), (8, 10), (19, 20)):
        run, least = jaccard_join.longer_run(num, den)
        assert all(run * (jaccard_join._differ(n, num, den) + 1) <= n for n in range(least, 3000) if jaccard_join._differ(n, num, den))


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = jaccard_join.jaccard_groups(odd_docs).collect()
    assert len(got) == 16
    by = {r.doc_id: r.component_id for r in got if r.doc_id}
    assert by == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12, 13: 13}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "None"]
    assert jaccard_join.jaccard_groups(no_docs).collect() == []


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        assert line_dedup.word_edit_distance(a, b) == row[-1]
        assert (line_dedup.word_edit_distance(a, b, 2) <= 2) == (row[-1] <= 2)


def line_truth(docs, min_words=5, similarity=0.8):
    """All pairs of normalised lines, by the definition."""
    places = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            norm = line_dedup.normalize(line)
            if norm and len(norm.split(" ")) >= min_words:
                places.setdefault(norm, []).append((i, k))
    norms = sorted(places, key=lambda n: (n.count(" "), n))
    tokens = [n.split(" ") for n in norms]
    names = {w: k for k, w in enumerate({w for t in tokens for w in t})}
    # exact bounds before the distance: every word that one line has and the other has not takes an edit
    bags = [np.bincount([names[w] % 256 for w in t], minlength=256).astype(np.int16) for t in tokens]
    bags = np.array(bags).reshape(-1, 256)
    sizes = np.array([len(t) for t in tokens])
    links = []
    for i in range(len(norms)):
        most = np.floor((1 - similarity) * sizes[i] + 1e-9)
        near = np.flatnonzero(sizes[:i] >= sizes[i] - most)
        missing = np.maximum(bags[i] - bags[near], 0).sum(axis=1)
        for j in near[missing <= most].tolist():
            if line_dedup.word_edit_distance(tokens[i], tokens[j], most) <= most:
                links.append((norms[i], norms[j]))
    groups = groups_of(links, norms)
    members = {}
    for n in norms:
        members.setdefault(groups[n], []).extend(places[n])
    drop = {p for m in members.values() for p in m if p != min(m)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop) for i, t in docs}, len(links)


@pytest.mark.parametrize("small", [2, 16])
def test_lines_against_all_pairs(llm, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL_POSTING", small)
    rng = random.Random(11)
    bases = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(4, 60))] for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(5):
            words = list(rng.choice(bases))
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(["zz", "Q9", "Q1"])
            lines.append(" ".join(words) + rng.choice(["", ".", "!"]))
        docs.append((i, "\n".join(lines)))
    want, links = line_truth(docs)
    assert links > 5
    got = line_dedup.dedup_lines(llm.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.lines_removed == docs[r.doc_id][1].count("\n") + 1 - (r.text.count("\n") + 1 if r.text else 0) for r in got)


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_lines_at_the_bound_of_edit_similarity(llm, similarity):
    """Lines with as many edits as allowed, or one more, against all pairs by edit similarity alone."""
    rng = random.Random(23)
    lines = []
    for n in [*range(3, 14), 20, 33, 60]:
        for _ in range(3):
            base = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(9))}" for _ in range(n)]
            lines.append(base)
            for extra in (0, 0, 1):
                words = list(base)
                for k in rng.sample(range(n), min(n, int((1 - similarity) * n + 1e-9) + extra)):
                    words[k] = rng.choice(["new", "the", words[k] + " new", "", words[k - 1]])
                lines.append(" ".join(w for w in words if w).split())
    docs = [(i, " ".join(w)) for i, w in enumerate(lines)]
    norms = {i: t.split(" ") for i, t in docs if t.count(" ") >= 2}
    links = [
        (a, b) for a, b in combinations(norms, 2)
        if line_dedup.word_edit_distance(norms[a], norms[b]) <= (1 - similarity) * max(len(norms[a]), len(norms[b])) + 1e-9
    ]
    groups = groups_of(links, norms)
    got = line_dedup.dedup_lines(llm.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=3, similarity=similarity)
    assert {r.doc_id for r in got.collect() if r.lines_removed} == {i for i, g in groups.items() if g != i}


def test_ascii_lines_are_normalised_alike():
    rng = random.Random(3)
    for _ in range(200):
        line = "".join(chr(rng.randrange(128)) for _ in range(30))
        assert line_dedup.normalize(line) == line_dedup.normalize(line + " \u00a0")


def test_lines_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "lines_removed"]
    got = out.collect()
    assert len(got) == 16
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].lines_removed == 0 and by[2].text == by[3].text == "" and by[5].text is None and by[6].text == ""
    assert by[11].text == "same line of five words\n" and by[11].lines_removed == 2
    # repeated rows count as one document
    assert [r.lines_removed for r in got if r.doc_id == 10] == [0, 0]
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_containment(llm, odd_docs, no_docs, monkeypatch):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(90, None), (91, " "), (None, "v1 v2 v3 v4 v5 v6")]
    docs = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(200)]
        for _, t in rng.sample(items[:30], 3):
            part = mutate(rng, t.split(), rng.choice([0, 0, 0.03, 0.2]))
            at = rng.randrange(len(text))
            text[at:at] = part
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, "")]
    want = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            y = (x or "").lower().split()
            if y:
                size = min(5, len(y))
                a, b = ({tuple(z[k : k + size]) for k in range(len(z) - size + 1)} for z in (w, y))
                if len(a & b) * 10 >= len(b) * 8:
                    want.add((d, i, len(a & b), len(b)))
    frames = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.contained_items(*frames).collect()} == want and len(want) > 30
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    assert {tuple(r) for r in decontaminate.contained_items(*frames).collect()} == want
    assert decontaminate.contained_items(no_docs, frames[1]).collect() == []
    assert decontaminate.contained_items(odd_docs, frames[1].limit(0)).collect() == []
    assert decontaminate.contained_items(odd_docs, odd_docs.withColumnRenamed("doc_id", "item_id")).count() > 12


def test_containment_keeps_no_index_of_another_benchmark(llm, monkeypatch):
    """Two benchmarks one after the other, as if the second broadcast had the address of the first."""
    monkeypatch.setattr(decontaminate, "id", lambda _: 1, raising=False)
    docs = llm.createDataFrame([(1, "a b c d e f"), (2, "p q r s t u")], "doc_id long, text string").coalesce(1)
    for item, text, doc in ((7, "a b c d e f", 1), (8, "p q r s t u", 2)):
        items = llm.createDataFrame([(item, text)], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()] == [(doc, item)]


def test_regions_test_every_pair(llm):
    """Points on a line: links within the radius connect the same points as in every region alone."""
    rng = random.Random(3)
    at = {i: rng.random() * 4 for i in range(60)}
    members = [(r, i) for i in at for r in range(5) if rng.random() < 0.5]

    def measure(pairs):
        places = llm.createDataFrame(list(at.items()), "i long, x double")
        a, b = (places.withColumnsRenamed({"i": c, "x": f"x{c}"}) for c in "ab")
        return pairs.join(a, "a").join(b, "b").selectExpr("a", "b", "abs(xa - xb) as d")

    from pyspark.sql import functions as F

    out = links_in_regions(llm.createDataFrame(members, "region long, item long"), measure, 0.03, True, lambda a, b: F.lit(True))
    links = {tuple(sorted(r)) for r in out.collect()}
    want = [(a, b) for a, b in combinations(at, 2) if abs(at[a] - at[b]) <= 0.03 and any((r, a) in members and (r, b) in members for r in range(5))]
    assert groups_of(links, at) == groups_of(want, at)


def test_the_corpus_is_cut_into_sets_once(llm, monkeypatch):
    """Cells come from the first pass; two more passes over the texts cost as much again each."""
    read, old = [], jaccard_join.map_batches
    monkeypatch.setattr(jaccard_join, "map_batches", lambda df, *rest: read.append(df.columns) or old(df, *rest))
    monkeypatch.setattr(jaccard_join, "LARGE_CELL", 1_000)
    base = [f"w{i}" for i in range(60)]
    docs = llm.createDataFrame([(i, " ".join(base[: 58 + i % 3])) for i in range(9)], "doc_id long, text string")
    got = jaccard_join.jaccard_groups(docs, size=3, num=90, den=100).collect()
    assert {r.component_id for r in got} == {0}
    assert [c for c in read if "text" in c] == [["id", "row", "text"]]
