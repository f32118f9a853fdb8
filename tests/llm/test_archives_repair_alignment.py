"""Alignment, conversation repair and web archives against brute force, round trips and edge rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from tests.llm.test_free import noise
from tidemark.llm import alignment, repair, warc
from tidemark.llm.perfect import Places
from tidemark.session import cut_lineage

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- perfect hashing --------------------------------------------------------------------
def test_places():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        p = Places.load(Places.build(keys).dump())
        assert p.count == len(keys) and sorted(p.of(keys).tolist()) == list(range(len(keys)))
        other = rng.integers(1 << 41, 1 << 42, 1000)
        assert ((p.of(other) >= -1) & (p.of(other) < max(1, len(keys)))).all()
    assert len(Places.build(np.arange(50_000)).dump()) * 8 / 50_000 < 5  # bits a key
    with pytest.raises(ValueError):
        Places.build(np.array([5, 5]))


# --- alignment --------------------------------------------------------------------------
def brute_alignment(texts):
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    char = alignment._byte_of()
    made, held = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        ta = [(i, bytes(char[c] for c in a.id_to_token(i))) for i in a.encode(" " + (t or ""), add_special_tokens=False).ids]
        tb = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(t or ""))]
        groups = []
        if t and b"".join(x for _, x in ta) == raw and b"".join(x for _, x in tb) == raw:
            ends = lambda ts: [sum(len(x) for _, x in ts[: k + 1]) for k in range(len(ts))]
            ea, eb = ends(ta), ends(tb)
            low = 0
            for cut in sorted(set(ea) & set(eb)):
                groups.append(([i for (i, _), e in zip(ta, ea) if low < e <= cut], [i for (i, _), e in zip(tb, eb) if low < e <= cut]))
                low = cut
        links = [(x, y) for g, h in groups for x in g for y in h]
        held.update(set(links))
        made.append((groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links),
             sum(held[p] for p in links), ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)) for groups, links in made]


TEXTS = [None, "", " ", "a", "  a  b", "x▁y", "</s> <unk> <s>", "<|endoftext|>", "\x00z", "ab" * 300, "漢字かな交じり文😀👩‍👩‍👧" * 8, "it's we'll 'S 1234 12\t\n\n x", "a" * 700]


def test_alignment(spark):
    texts = TEXTS + noise(60, 5) + noise(20, 5)
    want = sorted((i, *r) for i, r in enumerate(brute_alignment(texts)))
    frame = spark.createDataFrame([(i, t, "row", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, row int").repartition(5)
    whole = alignment.align(frame, BYTES, PIECES)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, whole.collect())) == want
    # small segments, several levels of sums, and most pairs found by the join
    assert sorted(map(tuple, alignment.align(frame.repartition(40), BYTES, PIECES, segment=16, table=100).collect())) == want
    assert sorted(map(tuple, alignment.align(frame, BYTES, PIECES, segment=64, table=0).collect())) == want
    assert alignment.align(frame.limit(0), BYTES, PIECES).count() == 0


def test_ranks_give_the_ids_of_the_file():
    a, plain = alignment.ByteSide(BYTES), Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    assert a.fast is not None
    texts = [t for t in TEXTS if t] + noise(300, 9) + [" " * 6000 + "x", "a" * 30_000, "é" * 5000, "\n \t" * 4000]
    assert a.encode(texts) == [plain.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_links_of_large_groups(monkeypatch):
    m = alignment.meter(BYTES, PIECES)
    rng = random.Random(3)
    four = [i for i in range(m.size_a) if m.len_a[i] == 4][:9], [i for i in range(m.size_b) if m.len_b[i] == 4][:5]
    one = [i for i in range(m.size_a) if m.len_a[i] == 1][:3], [i for i in range(m.size_b) if m.len_b[i] == 1][:3]
    docs_a, docs_b = [], []
    for n in (50, 0, 7):  # tokens that end together only at the end: one byte, fours, and three bytes against fours and four
        docs_a.append(np.array([rng.choice(one[0])] + [rng.choice(four[0]) for _ in range(n)] + [rng.choice(one[0]) for _ in range(3)], np.uint16).tobytes())
        docs_b.append(np.array([rng.choice(four[1]) for _ in range(n)] + [rng.choice(one[1]) for _ in range(4)] if n else [rng.choice(four[1])], np.uint16).tobytes())
    def total(got):
        out = Counter()
        seen = defaultdict(set)
        for step, (doc, pair, times) in enumerate(got.links()):
            for d, p, t in zip(doc.tolist(), pair.tolist(), times.tolist()):
                out[d, p] += t
                seen[d, p].add(step)
        assert all(len(s) == 1 for s in seen.values())
        return out
    plain = total(alignment.Aligned(m, docs_a, docs_b))
    monkeypatch.setattr(alignment, "LINKS", 20)
    few = alignment.Aligned(m, docs_a, docs_b)
    assert total(few) == plain and sum(plain.values()) == int(few.n_links.sum()) and len(list(few.links())) > 2


# --- conversation repair ----------------------------------------------------------------
def cheapest(rows):
    """(cost, audit, repaired) of [(initial, role, text, gone, cut)] by plain recursion over whole strings."""
    memo = {}

    def go(i, s, inserted):
        if (i, s, inserted) not in memo:
            nxt = "a" if s == "u" else "u"
            ways = [(0, "", [])] if i == len(rows) and s in ("", "a") else []
            if inserted < 2:
                c, a, t = go(i, nxt, inserted + 1)
                ways.append((2 + c, "I" + a, [{"u": "user", "a": "assistant"}[nxt] + ":"] + t))
            if i < len(rows):
                ini, role, text, gone, cut = rows[i]
                c, a, t = go(i + 1, s, 0)
                ways.append((3 + c, "D" + a, t))
                if not gone:
                    c, a, t = go(i + 1, nxt, 0)
                    ways.append((2 + cut + c, "R" + a, [{"u": "user", "a": "assistant"}[nxt] + ":" + text] + t))
                    if ini == nxt or (s == "" and ini == "s"):
                        c, a, t = go(i + 1, ini, 0)
                        ways.append((cut + c, "K" + a, [role + ":" + text] + t))
            memo[i, s, inserted] = min(ways, key=lambda w: w[:2]) if ways else (10**9, "", [])
        return memo[i, s, inserted]

    return go(0, "", 0)


def brute_repair(said):
    """Contract's row of every conversation from (conv, turn, role, text)."""
    out, by = [], defaultdict(list)
    for conv, turn, role, text in said:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = by[conv]
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked, faults, initials = set(), [], Counter(), ""
        for turn, role, text in rows:
            last = text.strip(" \t\n\v\f\r")[-1:]
            blank, again, cut = last == "", (role, text) in seen, last not in (".", "!", "?")
            seen.add((role, text))
            faults["blank" if blank else "duplicate" if again else "truncated" if cut else ""] += 1
            marked.append((role[:1], role, text, blank or again, cut))
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(marked, marked[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, fixed = cheapest(marked)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def said(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " ", "Why?", "\x0b", " ", "Said. Again.  ", "x" * 90 + ".", "x" * 90 + "?", "é漢."]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]) if rng.random() < 0.5 else ("user", "assistant")[t % 2]
            rows.append((c, None if rng.random() < 0.03 else t + (rng.random() < 0.1), role, None if rng.random() < 0.03 else rng.choice(texts) + rng.choice(["", "", str(rng.random())])))
    return rows + [(None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (-3, None, None, None), (-4, 7, "system", "only."), (-4, 7, "system", "only.")]


SAID = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rows = said(1, 150, 9)
    frame = spark.createDataFrame([(*r, "c", 5) for r in rows], SAID + ", conv string, piece int").repartition(4)
    got = repair.report(frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute_repair(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, repair.report(frame, size=1).collect()), key=str) == want  # pieces of one row are joined
    assert sorted(map(tuple, repair.report(frame, size=3).collect()), key=str) == want
    assert repair.report(frame.limit(0)).count() == 0
    fixed = repair.repair(frame).collect()
    assert all(len(r["roles"]) == len(r["texts"]) and set(r["roles"]) <= {"user", "assistant", "system", "u", "a", "s"} for r in fixed)


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(7)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "user", rng.choice(["Same.", f"Own {t}.", f"cut {t}"])) for t in range(6000)]
    rows += [(1, 6000, "user", "Same."), *[(2, None, "user", "All the same.")] * 2500, (3, 0, "user", "x.")]
    frame = spark.createDataFrame(rows, SAID).repartition(6)
    cut = cut_lineage(repair.pieces(repair.damaged(frame)))
    assert cut.where("conv = 1").count() >= 6000 * 0.95 // repair.PIECE
    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    try:
        want = brute_repair(rows)
    finally:
        sys.setrecursionlimit(limit)
    assert sorted(map(tuple, repair.report(frame).collect()), key=str) == want


def test_endings_are_computed_once(monkeypatch):
    import pandas as pd

    calls = Counter()
    plain = repair.node_before
    monkeypatch.setattr(repair, "node_before", lambda code, after: calls.update([1]) or plain(code, after))
    rng = random.Random(2)
    words = {"".join(rng.choice("ADGBE") for _ in range(rng.randint(0, 8))) for _ in range(500)}
    endings = sorted(w[::-1] for w in words)
    got = pd.concat(repair._walk(iter([pd.DataFrame({"ending": endings[:200], "last": True}), pd.DataFrame({"ending": endings[200:], "last": True})])))
    assert calls[1] == len({w[i:] for w in words for i in range(len(w))}) and set(got["word"]) == words


# --- web archives -----------------------------------------------------------------------
def test_archives(spark):
    big = "<p>" + "long page " * 300_000
    rows = [(i, f"http://h.com/{i % 7}?q=ä b", None if i % 11 == 0 else f"<html>{'same page ' * 30}{i % 13 if i % 3 else i}</html>") for i in range(400)]
    rows += [(400, None, ""), (401, "http://x/\r\nWARC-Type: response", "short"), (402, "", "short"), (403, "u", big), (404, "u", big), (None, "u", big), (5, "again", big),
             (406, "u", "\x00\r\n\r\n 漢😀 WARC/1.1\r\n" * 20), (-7, "u", "P*M\x18\0\0\0\0" * 20), (403, "u", big)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(3)
    got = warc.archived(frame).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and i != first[h or ""]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None, None if again else data))
    number = lambda k: None if warc.key_of(k) is None else int(warc.key_of(k))
    have = [(number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]), None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r["fault"] is None and r["date"] == warc.DATE for r in got)
    assert {r["target_uri"] for r in got if r["record_id"] == "<urn:record:401>"} == {"http://x/%0D%0AWARC-Type:%20response"}
    assert warc.archived(frame.limit(0)).count() == 0


def test_archives_have_a_dictionary_each(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    many = pages.crossJoin(spark.range(40)).withColumnRenamed("id", "n").selectExpr("page_id * 100 + n AS page_id", "url", "concat(html, n) AS html")
    path = f"{tmp_path}/a"
    warc.write_archives(many.repartition(2), path)
    files = [f for f in spark.read.format("binaryFile").load(path).collect() if f["length"]]
    assert files and all(bytes(f["content"][:4]) == warc.DICT for f in files)
    total = sum(f["length"] for f in files)
    assert total < many.selectExpr("sum(length(html))").first()[0] / 3
    assert warc.read_archives(spark, path).count() == many.count()
    # any reader of Zstandard that is given the dictionary sees plain records one after the other
    data = bytes(files[0]["content"])
    held = data[8 : 8 + int.from_bytes(data[4:8], "little")]
    text = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).stream_reader(data, read_across_frames=True).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_reader_checks_headers_and_lengths(spark, tmp_path):
    pack = zstandard.ZstdCompressor(write_checksum=True)
    body = b"<p>text</p>" * 30
    good = warc.record("1", "http://a/", body, hashlib.sha256(body).hexdigest(), "response", None)
    assert warc.parsed(good)["payload"] == body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    other = good.replace(f"sha256:{hashlib.sha256(body).hexdigest()}".encode(), f"sha1:{sha1}".encode())
    assert warc.parsed(other)["payload_digest"] == hashlib.sha1(body).hexdigest()
    for bad in (good[:-1], good[:-4] + b"\n\n\n\n", good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC Date "), good.replace(b"WARC-Type: response\r\n", b""),
                good.replace(b"<p>text", b"<p>tent", 1), good.replace(b"Content-Length: 330", b"Content-Length: 331"), good.replace(b"\r\n\r\n", b"\r\n"), b"", b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    samples = [warc.record(str(i), f"http://a/{i}", body + b"%d" % i * 50, "0", "response", None) for i in range(300)]
    held = zstandard.train_dictionary(4096, samples).as_bytes()
    packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(held)).compress(good)
    for lead in (warc.skippable(held), warc.skippable(pack.compress(held))):  # dictionary as it is, and compressed
        assert [(d, f) for _, d, f in warc.frames(lead + packed + warc.GAP.encode() + packed)] == [(good, None)] * 2
    assert [f for *_, f in warc.frames(packed)] != [None]  # its dictionary is missing
    unsized = zstandard.ZstdCompressor(write_content_size=False).compress(good)
    stream = pack.compress(good) + unsized + pack.compress(b"")
    assert [d for _, d, _ in warc.frames(stream)] == [good, good, b""]
    assert list(warc.frames(stream[:-5]))[-1][2] and list(warc.frames(b"plain"))[0][2] and list(warc.frames(warc.skippable(b"no dictionary")))[0][2]
    damaged = bytearray(pack.compress(os_noise := bytes(random.Random(1).randbytes(5000))))
    damaged[3000] ^= 1
    assert list(warc.frames(bytes(damaged)))[0][1] is None and len(os_noise) == 5000
    (tmp_path / "a.warc.zst").write_bytes(pack.compress(good) + pack.compress(b"no record") + pack.compress(good))
    rows = warc.read_archives(spark, str(tmp_path), strict=False).orderBy("start").collect()
    assert [r["fault"] is None for r in rows] == [True, False, True]
    with pytest.raises(Exception, match="no version line"):
        warc.read_archives(spark, str(tmp_path)).collect()
