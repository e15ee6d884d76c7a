"""Operators on rows: quality, secrets, personal data, token ids, archives, search."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.llm import byte_bpe, compression_quality, disclosure, secrets, token_files, topk_search, warc
from recordmill.session import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(llm):
    docs, labels = (llm.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = compression_quality.fit(docs, labels)
    rows = docs.withColumn("score", compression_quality.score(model, docs)).join(labels, "doc_id").where(compression_quality.held_out()).toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert ((rows.score >= 0.5) == (rows.quality == 1)).mean() > 0.9
    assert {zlib.crc32(str(i).encode()) % 3 for i in rows.doc_id} == {1}


def test_quality_odd_rows(llm, odd_docs, no_docs):
    labels = llm.createDataFrame([(1, 1), (5, 0), (None, 1), (8, None)], "doc_id long, quality int")
    for frame in (labels, labels.limit(0)):
        model = compression_quality.fit(odd_docs, frame)
        scores = odd_docs.select(compression_quality.score(model, odd_docs).alias("s")).collect()
        assert len(scores) == 16 and all(0 <= r.s <= 1 for r in scores)
    assert no_docs.select(compression_quality.score(model, no_docs)).collect() == []


def test_secret_base_spans():
    rng = random.Random(1)
    bits = ["password", "Passwd", "api_key", "APIKEY", "secret", " ", "  ", "=", ":", '"', "'", "AKIA", "AKIA1234567890ABCD", "deadbeef" * 4, "abc", "0" * 31, "hunter2hunter2", "x", "é", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        want = [("assign", m.span()) for m in re.finditer(r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
        want += [("access", m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [("hex", m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        want.sort(key=lambda s: (s[1][0], secrets.KINDS.index(s[0])))
        assert secrets.strong_spans(text) == [(k, a, b) for k, (a, b) in want]


def test_weak_parts_need_the_others(llm, odd_docs, no_docs):
    parts = ["user: alice", "Zx8Qw3Rt6Yu1Io9Pa2Sd4Fg7", "https://db.example.org/login"]
    together, apart = " and ".join(parts), (" " * 1000).join(parts)
    rows = [(1, together), (2, apart), (3, parts[0] + " " + parts[1]), (4, "user: bob AKIA" + "B" * 16 + " " + parts[2] + " password=12345678")]
    frame = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(frame).collect()}
    assert got == {1: ["account", "opaque", "endpoint"], 2: [], 3: [], 4: ["account", "access", "endpoint", "assign"]}
    # the same by comparing every part with every part
    for r in secrets.find_secrets(frame).collect():
        text = dict(rows)[r.doc_id]
        strong = secrets.strong_spans(text)
        every = [(*s, False) for s in strong] + [(*s, True) for s in secrets.weak_spans(text) if not any(s[1] < y and x < s[2] for _, x, y in strong)]
        want = set()
        for k, a, b, weak in every:
            near = {secrets._PART[o] for o, x, y, _ in every if x < b + secrets.REACH and y > a - secrets.REACH} - {secrets._PART[k]}
            if not weak or len(near) == 2:
                want.add((k, a, b))
        assert {tuple(s) for s in r.spans} == want
    assert secrets.find_secrets(odd_docs).count() == 16 and secrets.find_secrets(no_docs).collect() == []


def test_linking_against_all_pairs(llm):
    rng = random.Random(4)
    bits = ["user=alice", "account: bob99", "https://a.example/x", "host=db.example", "Zx8Qw3Rt6Yu1Io9Pa2Sd4Fg7", "AKIA" + "Q" * 16, "password=hunter2hunter2", "deadbeef" * 4, "word", " " * 90, " " * 150]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    for r in secrets.find_secrets(llm.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id]
        strong = secrets.strong_spans(text)
        weak = [s for s in secrets.weak_spans(text) if not any(s[1] < y and x < s[2] for _, x, y in strong)]
        assert secrets.apart(secrets.weak_spans(text), strong) == weak
        every = strong + weak
        want = set(strong)
        for k, a, b in weak:
            near = {secrets._PART[o] for o, x, y in every if x < b + secrets.REACH and y > a - secrets.REACH} - {secrets._PART[k]}
            if len(near) == 2:
                want.add((k, a, b))
        assert {tuple(s) for s in r.spans} == want


def test_long_dumps_are_scanned_in_linear_time():
    import time

    text = "user=alice password=hunter2hunter2 https://h.example/p Zx8Qw3Rt6Yu1Io9Pa2Sd4Fg7\n" * 12_500
    start = time.monotonic()
    assert len(secrets.apart(secrets.weak_spans(text), secrets.strong_spans(text))) >= 30_000
    assert time.monotonic() - start < 5


def test_weak_parts_of_any_length():
    key, name, host = "aB3/" * 22, "n" * 90, "https://h.example/" + "p" * 400
    text = f"user={name} {host} {key}"
    got = {(k, text[a:b]) for k, a, b in secrets.weak_spans(text)}
    assert {("account", f"user={name}"), ("endpoint", host), ("opaque", key)} <= got


def test_personal_base_spans():
    rng = random.Random(6)
    bits = ["a.b", "@", "ex-1", ".", "com", "1", "12", "255", "256", "999", "+", "(", ")", " ", "-", "4111111111111111", "4225039295678253", "9" * 17, "x", "é", "_%"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 22)))

        def ok(kind, m):
            digits = re.sub("[^0-9]", "", m)
            if kind == "ip":
                return all(int(p) <= 255 for p in m.split("."))
            if kind == "card":
                double = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
                return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0
            return kind == "email" or 8 <= len(digits) <= 15

        patterns = {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if ok(k, m[0])]
        assert disclosure.entities(t) == want, t


def test_disclosure_counts(llm, odd_docs, no_docs):
    tell = "Contact zorblax at joe@example.org or call the office in town"
    rows = [(i, tell + f" number{i}" * 2) for i in range(4)] + [(10 + i, "the office in town is open") for i in range(40)] + [(60 + i, "zorblax alone") for i in range(2)]
    got = {r.doc_id: r.spans for r in disclosure.find_personal(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = {(s.kind, tell[s.start : s.stop]) for s in got[0] if s.stop <= len(tell)}
    assert ("email", "joe@example.org") in kinds and ("remove", "zorblax") in kinds and ("remove", "Contact") in kinds
    assert not {"the", "office", "town"} & {w for _, w in kinds} and got[10] == []
    # a flagged term goes wherever it stands, beside a mention or not
    assert [tuple(s) for s in got[60]] == [("remove", 0, 7)]
    clean = {r.doc_id: r.text for r in disclosure.sanitise(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zorblax" not in clean[0] and "[email]" in clean[0] and "office" in clean[0] and clean[10] == rows[4][1]
    assert disclosure.find_personal(odd_docs).count() == 16 and disclosure.find_personal(no_docs).collect() == []


def test_disclosure_against_plain_python(llm):
    rng = random.Random(9)
    mails = [f"u{i}@x.org" for i in range(4)]
    vocab = ["alpha", "beta", "gamma", "delta", "Omega", "is", "und", "x1y", "zeta"] + [f"rare{c}" for c in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(mails if rng.random() < 0.05 else vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(900, "rarea near u0@x.org " * 4), (901, "rarea"), (902, None), (903, "")]
    both, total, base = {}, {}, {}
    for i, text in rows:
        found = disclosure.entities(text or "")
        base[i] = {(k, a, b) for k, a, b in found}
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text or "")]
        for a, b in spans:
            total[text[a:b].lower()] = total.get(text[a:b].lower(), 0) + 1
        free = [s for s in spans if not any(s[0] < b and a < s[1] for _, a, b in found)]
        pairs = set()
        for _, a, b in found:
            after = sum(s[0] < a for s in free)
            pairs |= {(text[a:b].lower(), k) for k in range(max(0, after - disclosure.NEAR), min(len(free), after + disclosure.NEAR))}
        for e, k in pairs:
            t = text[free[k][0] : free[k][1]].lower()
            both[e, t] = both.get((e, t), 0) + 1
    kinds = {}
    for (e, t), n in both.items():
        if n >= disclosure.SUPPORT and 4 * n >= total[t]:
            kinds[t] = max(kinds.get(t, ""), "remove" if 2 * n >= total[t] else "generalise")
    assert "rarea" in kinds
    frame = llm.createDataFrame(rows, "doc_id long, text string")
    for r in disclosure.find_personal(frame).collect():
        text = dict(rows)[r.doc_id] or ""
        want = set(base[r.doc_id])
        for m in re.finditer(r"[^\W\d_]{3,}", text):
            if m[0].lower() in kinds and not any(m.start() < b and a < m.end() for _, a, b in base[r.doc_id]):
                want.add((kinds[m[0].lower()], m.start(), m.end()))
        assert {tuple(s) for s in r.spans} == want


def test_sanitise_odd_rows(llm, odd_docs, no_docs):
    frame = odd_docs.withColumnRenamed("key", "row").withColumnRenamed("n", "id")
    rows = disclosure.sanitise(frame).collect()
    assert len(rows) == 16 and sum(r.text is None for r in rows) == 2 and sum(r.text == "" for r in rows) == 1
    assert disclosure.sanitise(no_docs).collect() == []


def test_quality_is_calibrated(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = compression_quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(compression_quality.held_out()).withColumn("score", compression_quality.score(model, docs)).toPandas()
    for low in np.arange(0, 1, 0.25):
        part = rows[(rows.score >= low) & (rows.score < low + 0.25)]
        if len(part) >= 40:
            assert abs(part.score.mean() - part.quality.mean()) < 0.15
    assert abs(rows.score.mean() - rows.quality.mean()) < 0.05


def test_quality_of_repeated_rows(llm):
    docs = llm.createDataFrame([(i, f"good words number {i} " * 5 if i % 2 else f"zzz qqq {i} " * 5) for i in range(60)] * 2, "doc_id long, text string")
    labels = llm.createDataFrame([(i, i % 2) for i in range(60)] * 3 + [(1, 0)], "doc_id long, quality int")
    model = compression_quality.fit(docs, labels)
    assert docs.select(compression_quality.score(model, docs).alias("s")).where("s between 0 and 1").count() == 120


def test_byte_bpe_equals_library(llm, odd_docs, no_docs):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path).collect()
    want = sorted((str(r.doc_id), np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    assert byte_bpe.encode(no_docs, path, pattern).collect() == []
    none = llm.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decode(none, path).first().decoded is None


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 4096, 10_000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        raw = token_files.pack(ids, bits)
        assert len(raw) == -(-n // token_files.BLOCK) * token_files.BLOCK * bits // 8
        assert (token_files.unpack(raw, bits)[:n] == ids).all()


def test_token_files_equal_library(llm, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    files = token_files.write_token_files(docs, path, 49_408, 1, token_files.token_folder(docs))
    rows = token_files.read_token_files(files).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(rows) == docs.count()
    texts = {(r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect()}
    assert {(r.doc_id, bytes(r.ids)) for r in rows} == texts
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    first = files.orderBy("part").first()
    reader, row = token_files.Reader(first.uri), rows[5]
    if row.start + row.n_tokens <= first.n_ids:
        assert reader.ids(row.start, row.start + row.n_tokens).astype("<u4").tobytes() == bytes(row.ids)
    empty = token_files.write_token_files(no_docs, path, 49_408, 1, token_files.token_folder(no_docs))
    assert token_files.read_token_files(empty).collect() == []


def test_warc_round_trip(llm):
    warc.register(llm)
    rows = [
        (1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b\r\nWARC-Type: evil", "é" * 3000), (4, "u", None), (5, "u", ""),
        (None, "n", "<p>x</p>"), (2, "again", "<p>x</p>"), (7, "crlf", "a\r\n\r\nb\r\n\r\n"),
    ]
    pages = llm.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha string")
    path = new_path(llm, "warc-test")
    warc.write_pages(pages, path)
    got = warc.read_warc(llm, path).collect()
    assert len(got) == len(rows)
    kept = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert kept["urn:page:7"] == b"a\r\n\r\nb\r\n\r\n" and kept["urn:page:3"] == ("é" * 3000).encode() and kept["urn:page:none"] == b"<p>x</p>"
    for r in got:
        body = next((x[2] or "").encode() for x in rows if f"urn:page:{x[0] if x[0] is not None else 'none'}" == r.record_id)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        assert (r.payload is None) == (r.record_type == "revisit")
    assert {(r.record_id, r.refers_to) for r in got if r.record_type == "revisit"} == {("urn:page:1", "urn:page:2"), ("urn:page:4", "urn:page:5")}
    slim = warc.read_warc(llm, path, payload=False).where("record_type = 'revisit' and payload_bytes >= 0")
    assert "PushedFilters" not in slim._jdf.queryExecution().toString() or slim.count() == 2
    assert slim.count() == 2 and all(r.payload is None for r in slim.collect())
    big = new_path(llm, "warc-test")
    warc.write_pages(pages, big, min_bytes=5)
    assert warc.read_warc(llm, big).where(F.col("record_type") == "revisit").count() == 1
    none = new_path(llm, "warc-test")
    warc.write_pages(pages.limit(0), none)
    assert warc.read_warc(llm, none).collect() == []
    assert not [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".part")]


def _archive(llm, data):
    path = new_path(llm, "warc-odd")
    folder = path.removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/x.warc.gz", "wb") as f:
        f.write(data)
    return path


def test_archives_of_others_and_damaged_ones(llm):
    import gzip

    warc.register(llm)
    body = bytes(random.Random(1).randbytes(300_000))
    records = [warc.record("response", f"urn:{i}", "http://a", "1970-01-01T00:00:00Z", "D", len(body), body, None) for i in range(3)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nWARC-Date: d\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    ours, plain = b"".join(map(warc.member, records)), gzip.compress(info) + b"".join(map(gzip.compress, records))
    for data, n in ((ours, 3), (plain, 4), (plain + ours, 7)):
        got = warc.read_warc(llm, _archive(llm, data)).collect()
        assert len(got) == n and all(bytes(r.payload) == (b"abcde" if r.record_type == "warcinfo" else body) for r in got)
        assert warc.read_warc(llm, _archive(llm, data), payload=False).where("record_id = 'urn:1'").count() == (2 if n == 7 else 1)
    flipped = bytearray(ours)
    flipped[150_000] ^= 255
    headless = warc.member(b"WARC/1.1 without an end")
    for data in (ours[:-9], ours[: len(ours) // 2], plain[:-9], bytes(flipped), headless, gzip.compress(b"nothing"), b"no gzip at all, only text" * 9, ours + b"x"):
        with pytest.raises(Exception, match="no whole record at byte"):
            warc.read_warc(llm, _archive(llm, data)).collect()


def test_member_is_plain_gzip():
    import gzip

    raw = warc.record("response", "urn:x", "http://a", "1970-01-01T00:00:00Z", "D", 3, b"abc", None)
    assert gzip.decompress(warc.member(raw) + warc.member(b"two")) == raw + b"two"


def test_top_k_against_all_pairs(llm, monkeypatch):
    monkeypatch.setattr(topk_search, "SLICE", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 8)
    monkeypatch.setattr(topk_search, "_STEP", 8)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + 0.1 * rng.normal(size=12)).astype("f4").tolist()) for i in range(500)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(100)]  # ties
    rows += [(700, None), (750, [1.0, None]), (800, [float("nan")] * 12), (850, [float("inf")] * 12), (None, rows[0][1]), (900, [1.0, 2.0]), (950, []), (0, rows[0][1])]
    frame = llm.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    ints = {i: np.array([*np.floor(256 * np.array(v, float)).astype(int), *[0] * (12 - len(v))]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in topk_search.top_k(frame, F.col("id") % 50 == 0).collect()} == want
    assert topk_search.top_k(frame.limit(0), F.col("id") % 50 == 0).collect() == []
    x = np.stack(list(ints.values()))[:500]
    pivots = topk_search._far_apart(x, 16)
    far, ids = topk_search._distances(x, pivots), np.arange(len(x))
    _, evaluated = topk_search.search_block(ids[:10], x[:10], far[:10], ids, x, far, 5)
    assert evaluated < 0.6 * 10 * len(x)
