"""Html extraction, neighbours, token counts, near-duplicates, packing and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_native import docs, words
from tidemark.llm import markup, neighbours, packing, simhash, tokens

PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "The", " ", "  ", "\n", "\t", "é", "e\u0301", "ß", "İ", "漢", "😀", ".", "...", "'s", "don't", "</s>", "<|endoftext|>", "<|EndOfText|>", "0", "10",
        "\u3000", "\x1c", "\xa0", "\r\n", "ing", "tion", "ΣΑΣ", "$$$", "▁", "ﬁ", "x.", "\x85", "    "]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def page(body, n=0):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a>m{n}</a></ul></nav>{body}<footer>f{n}</footer></body></html>"


def test_markup():
    text = lambda h: markup.main_text(h, {})
    assert text(None) == text("") == text("<nav>x</nav>") == ""
    assert text("plain &amp; <b>bold</b>\n text") == "plain & bold text"
    assert text(page("<div class='ad'>ad</div><article><h1>H</h1><p><b>a<br><p>b &lt;i&gt; c</p><div class=\"user-comments\"><p>no</p></div></article>")) == "H\na\nb <i> c"
    assert text(page("<header>no</header><div id=cookie-notice>no</div><form>no</form><aside>no</aside><div><p>yes</p></div>")) == "yes"
    assert text("<article><p title=\"a > b\">x</p><!-- <p>no</p> --><p hidden>y</p>z < 3 &am</article>") == "x\ny\nz < 3 &am"
    assert text("<script>never closed <p>x") == "" and text("<a <b <c") == "<a <b <c"
    assert len(text("<article>" + "<p>word</p>" * 20000 + "</article>").split("\n")) == 20000


def test_templates_leave_out_what_all_pages_repeat(spark):
    rows = [(i, f"http://h.com/{i}", f"<html><body><div><p>Welcome</p></div><div><p>text {i}</p></div><div><p>Bye</p></div></body></html>", "c") for i in range(30)]
    rows += [(99, None, None, "c"), (100, "http://one.com/", "<p>Welcome", "c"), (100, "http://one.com/", "<p>Welcome", "c")]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = defaultdict(list)
    for r in markup.extract(frame).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
    assert all(got[i] == [(f"text {i}", len(f"text {i}"))] for i in range(30))
    assert got[99] == [("", 0)] and got[100] == [("Welcome", 7)] * 2
    assert markup.extract(frame.limit(0)).count() == 0


def test_copies_keep_their_text(spark):
    same = page("<article><h1>H</h1><p>one</p><p>two</p></article>")
    rows = [(i, "http://copies.com/", same) for i in range(25)]
    rows += [(100 + i, "http://shared.com/", page("<article><h1>H</h1><p>one</p></article>", i)) for i in range(25)]
    rows += [(200 + i, "http://plain.com/", "<html><body><div><h2>H</h2></div><div><p>one</p></div></body></html>") for i in range(8)]
    rows += [(300 + i, "http://h.com/", page(f"<article><p>Read on</p><p>own {i // 2}</p></article>", i)) for i in range(50)]
    got = {r["page_id"]: r["text"] for r in markup.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)).collect()}
    assert all(got[i] == "H\none\ntwo" and got[100 + i] == "H\none" for i in range(25))
    assert all(got[200 + i] == "H\none" for i in range(8))
    assert all(got[300 + i] == f"own {i // 2}" for i in range(50))  # what distinct articles repeat is still template


def test_what_stands_twice_is_template(spark):
    bar = "<div><span>Home</span></div><div><span>News</span></div>"
    rows = [(i, "http://bars.com/", f"<html><body>{bar}<div><p>own {i}</p></div>{bar}</body></html>") for i in range(12)]
    rows += [(100 + i, "http://captions.com/", f"<html><body><div><p>Photo</p><p>own {i}</p><p>Photo</p>{'<p>x%d</p>' % i * (i % 3)}</div></body></html>") for i in range(12)]
    rows += [(200 + i, "http://varying.com/", f"<html><body><div><p>own {i}</p>{'<p>Again</p>' * (1 + i % 4)}</div></body></html>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in markup.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)).collect()}
    assert all(got[i] == f"own {i}" for i in range(12))
    assert all(got[100 + i] == "\n".join([f"own {i}"] + [f"x{i}"] * (i % 3)) for i in range(12))
    assert all(got[200 + i] == "\n".join([f"own {i}"] + ["Again"] * (1 + i % 4)) for i in range(12))


def brute_nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        i = list(ids).index(q)
        s = (x * x[i]).sum(axis=1)
        s[np.array(ids) == q] = -np.inf
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((300, 8)) * rng.uniform(0.2, 3, (300, 1)), 4, axis=0) + 0.02 * rng.standard_normal((1200, 8))
    x[600:900] = x[600]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [None] + [1.0] * 7), (5080, [1.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(np.arange(1200), x, range(0, 1200, 20), 20)
    for window in (None, 2000):
        got = defaultdict(list)
        for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 20, window=window).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * 20 * len(want)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)  # the wide window is exact, ties too
    few = frame.where("vec_id < 3")
    assert neighbours.nearest(few, F.col("vec_id") % 20 == 0, 20).count() == 2
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_prefix_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    table = tokens.Prefixes(PIECE)
    for t in noise(250, 1):
        want = [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        got = table.of(t)
        assert got.all().tolist() == want == [got.at(i) for i in range(len(t) + 1)] and got.total == want[-1]
        assert got.fits(5) == max(i for i, n in enumerate(want) if n <= 5)
    texts = [None, "", "x" * 20000, "word " * 9000, "same", "same", *noise(20, 2)]
    for r in tokens.count(docs(spark, texts), PIECE).collect():
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(library.encode(t))) and r["over_limit"] == (r["n_tokens"] > 4096)
        assert len(library.encode(t[: r["fits_chars"]])) <= 4096
    assert tokens.count(docs(spark, []), PIECE).count() == 0
    assert tokens.prefix_counts(docs(spark, ["a b"]), PIECE).first()["prefix_tokens"] == [0, 1, 2, 2]


def slow_fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(keys, fps, radius=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {}
    for k, x in zip(keys, label):
        least[x] = min(k, least.get(x, k))
    return [least[x] for x in label]


def test_masks_cover_the_radius():
    masks = simhash.masks()
    rng = random.Random(4)
    for _ in range(20000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)


@pytest.mark.parametrize("block", [8, 1024])
def test_links_keep_all_classes(spark, block):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 60])):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                x ^= 1 << b
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in simhash.links(frame, block=block).collect():
        u, v = u % (1 << 64), v % (1 << 64)
        assert (u ^ v).bit_count() <= 4
        label[max(find(u), find(v))] = min(find(u), find(v))
    assert [find(x) for x in fps] == classes_of(fps, fps)


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [None, "", " \n", "A b", "a B", "a b c d e", base, base + " more", base.upper(), base.replace("word7 ", "x "), "z " * 3000, "unlike the others here"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == classes_of(range(len(texts)), fps)
    frame = docs(spark, texts).unionByName(docs(spark, texts).where("doc_id < 4"))
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes_of(range(len(texts)), fps)))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(6)
    for hi in (40, 100, 60, 100):
        x = rng.integers(1, hi + 1, 200)
        bins, offsets, free = packing.best_fit(x, 100)
        used = np.bincount(bins, weights=x)
        assert (used <= 100).all() and (100 - used == free).all()
        assert -(-x.sum() // 100) <= packing.lower_bound(x, 100) <= len(free)
    assert packing.lower_bound(np.array([51, 51, 51, 10]), 100) == 3
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def pieces_of(texts):
    library = Tokenizer.from_file(WORD)
    out = Counter()
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out[d, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def hold(rows, texts):
    assert Counter(tuple(r)[:5] for r in rows) == pieces_of(texts)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 4096
    return len(places)


def test_packing(spark):
    texts = [None, "", "word " * 9000, "x" * 5000, *noise(600, 7), "same", "same"]
    frame = docs(spark, texts)
    rows = packing.pack_documents(frame, WORD).collect()
    floor = -(-sum(k[3] * n for k, n in pieces_of(list(enumerate(texts))).items()) // 4096)
    assert hold(rows, list(enumerate(texts))) <= floor + 1
    for few in (40, 2):  # few: hundreds of partitions, more rounds than four
        many = packing.pack(packing.pieces(frame, WORD), per_partition=few)
        assert hold(many.collect(), list(enumerate(texts))) <= floor + 2
    assert packing.pack_documents(docs(spark, []), WORD).count() == 0


def test_ids_of_texts(monkeypatch):
    """Odd texts have the library's ids, also while the table of words is full; a word is one row whatever stands behind it."""
    library = Tokenizer.from_file(WORD)
    texts = ["a, b. a. a! a", None, "", " ", "\t\r\n\n", "It's IT'S. don't! 'tis 'S", "(word) word) (word", "x" * 300 + ", " + "x" * 300, "3rd 42. 4,2 a1, 1a.",
             "Été ÉTÉ, été. straße STRASSE ÿ µ ª º", "e\u0301t\u00e9 e\u0301, \u0301", "\u0130stanbul, \u0130. i\u0307", "\u039f\u0394\u039f\u03a3 \u039f\u0394\u039f\u03a3, \u0441\u043b\u043e\u0432\u043e. \u0421\u041b\u041e\u0412\u041e!",
             "\u4e2d\u6587, \u4e2d. \U0001f600 Smile, SMILE. caf\u00e9\U0001f600", "<|endoftext|> <|ENDOFTEXT|> A<|startoftext|>B, Word", "non\u00a0breaking\u2003space\u0085next\u000bline\u2028x\u200bx",
             "0 a 0 b0 0", "\ufb01ne \u212b \u1e9e \u01c5 \u0149x, \u01f0.", "@a #b $c ^d `e {f} [g]\\h ~i _j_ -k- '", "\x00 a\x00, \x1c\x1d", *noise(300, 11)]
    ids, stops = packing.Ids(WORD), None
    for held in (packing.CACHED, 40):
        monkeypatch.setattr(packing, "CACHED", held)
        for at in range(0, len(texts), 7 if held == 40 else len(texts)):
            part = texts[at : at + 7] if held == 40 else texts
            got, stops = ids.texts(part)
            for t, a, b in zip(part, stops[:-1], stops[1:], strict=True):
                assert got[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    few = packing.Ids(WORD)
    few.texts(["word, word. word! Word; word other, other."])
    assert sorted(few.rows) == sorted(["word", "other", "", ",", ".", "!", ";"])
    monkeypatch.setattr(packing, "CACHED", 5)
    few.texts(["word new"])  # a full table keeps what is in use
    assert sorted(few.rows) == sorted(["word", "new", ""])


def test_pipeline(spark, sf):
    from tests.llm.test_native import rejected

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, frame, sf)
    passed = {r["doc_id"] for r in kept.collect()}
    for r in frame.collect():
        assert rejected(r["text"]) == (r["doc_id"] not in passed)
    rows = kept.collect()
    one = stages["simhash_near_dedup"](spark, kept, sf)
    ids = [r["doc_id"] for r in rows]
    assert one.columns == frame.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(classes_of(ids, [slow_fingerprint(r["text"]) for r in rows])))
    mixed = stages["mixing"](spark, one, sf)
    assert mixed.columns == frame.columns and mixed.count() > 0
    texts = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert max(Counter(texts).values()) <= 3
    hold(stages["best_fit_packing"](spark, mixed, sf).collect(), texts)
    assert corpus_pipeline.run(spark, sf).count() == sum(pieces_of(texts).values())


def test_pipeline_edge_rows(spark, sf):
    """Null, empty and very long texts, repeated rows, null keys and sources, clashing columns, an empty table."""
    good = " ".join(f"word{i}" for i in range(40))
    names = ["size", "times", "fp", "root", "target", "taken", "kept", "piece", "length", "bin", "source_size"]
    texts = [None, "", " \n", good, good, good + " more", " ".join(f"other{i}" for i in range(60)), " ".join(f"long{i}" for i in range(60_000)), "x" * 100_000, "a b c"]
    rows = [(None if i == 9 else i, t, "en", None if i % 3 == 0 else "s", len(t or ""), *[f"own{i}"] * len(names)) for i, t in enumerate(texts)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    for held in (rows, []):
        frame = spark.createDataFrame(held, schema)
        kept = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = Counter(kept.collect())
            kept = stage(spark, kept, sf)
            assert kept.columns == frame.columns, name
            after = Counter(kept.collect())
            assert set(after) <= set(before), name  # rows come out as they went in
            if name == "simhash_near_dedup":
                assert sum(after.values()) == len({r["text"] for r in after}) == (4 if held else 0)
            kept = spark.createDataFrame([r for r, n in after.items() for _ in range(n)], schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
        assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
        assert (packed.count() > 0) == bool(held)
