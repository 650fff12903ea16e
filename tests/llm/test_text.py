"""Archives, pages, tokens, fingerprints, toxicity and the pipeline on small tables."""

import base64
import hashlib
import io
import random
import struct
import unicodedata
import zipfile

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from touchline.llm import fingerprint, page_text, piece_codec, toxicity, warc_zip

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PAGES = "page_id bigint, url string, html string, path string, text string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "one"), (2, "http://a/y\r\nz %41", "é" * 70_000), (3, None, None), (4, "u", ""), (5, "v", "one"), (6, "w", "é" * 70_000), (None, "n", "one"), (1, "http://a/x", "one")]
    pages = spark.createDataFrame([(*r, "p", "t") for r in rows], PAGES).repartition(3)
    out = warc_zip.round_trip(pages).collect()
    assert len(out) == len(rows)
    want = {1: None, 2: None, 3: None, 4: 3, 5: 1, 6: 2}
    for r in out:
        text = next(h or "" for i, _, h in rows if i == r.page_id)
        raw = text.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.refers_to == want.get(r.page_id) and r.record_type == ("revisit" if r.refers_to else "response")
        assert r.payload is None if r.refers_to else bytes(r.payload) == raw
    assert {r.url for r in out} == {u for _, u, _ in rows}
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_zip_directories():
    for force in (False, True):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
            with z.open("a", "w", force_zip64=force) as f:
                f.write(b"abc" * 100)
            z.writestr("b/é", b"")
            z.comment = b"PK\5\6 is no end record"
        found = warc_zip.members(pa.BufferReader(held.getvalue()))
        assert [(m.name, held.getvalue()[m.offset : m.offset + m.size]) for m in found] == [("a", b"abc" * 100), ("b/é", b"")]
    with pytest.raises(ValueError):
        warc_zip.members(pa.BufferReader(b"no zip"))


def test_zip64_directory():
    """A directory whose every number stands in its ZIP64 record."""
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 3, 3, 1, 0) + b"m" + b"xyz"
    extra = struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
    head = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(head), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(head), 1)
    last = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + head + end + locator + last
    (m,) = warc_zip.members(pa.BufferReader(raw))
    assert (m.name, raw[m.offset : m.offset + m.size]) == ("m", b"xyz")


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("most", [1 << 25, 4])
def test_common_lines(most):
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        at = page_text._aligned(a, b, most)
        assert len(at) == len(page_text.common_lines(a, b)) == brute_lcs(a, b) and at == sorted(set(at))
        rest = iter(b)
        assert all(a[k] in rest for k in at)


def test_page_text(spark):
    body = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><div class='ad x'>Buy</div>{}<div class=\"comments\"><p>Nice</p></div><footer>(c)</footer></body></html>"
    rows = [
        (1, "http://h.org/a/1", body.format("<article><h1>T &amp; U</h1><p>One\n two<br>three<p><b>Four<p>Five</article>")),
        (2, "http://h.org/a/21?x=1", "<p>Shared line</p><p>Own of 2</p>"),
        (3, "https://H.org/a/22#y", "<p>Shared line</p><p>Own of 3</p><script>var a = '<p>no</p>'</script>"),
        (4, None, None),
        (5, "http://other.org/", "<p>Alone</p>cut off <b"),
        (6, "http://h.org/a/1/", "<main><p>kept</p></main><p>out</p>"),
    ]
    pages = spark.createDataFrame([(*r, "p", "t") for r in rows], PAGES).repartition(2)
    out = {r.page_id: (r.text, r.n_chars) for r in page_text.extract_text(pages).collect()}
    want = {1: "T & U\n\nOne two three\n\nFour\n\nFive", 2: "Own of 2", 3: "Own of 3", 4: "", 5: "Alone\n\ncut off", 6: "kept"}
    assert out == {k: (v, len(v)) for k, v in want.items()}
    assert page_text.extract_text(pages.limit(0)).count() == 0


def test_nearest_paths(spark):
    rng = random.Random(2)
    rows = sorted({(f"h{rng.randint(0, 3)}", "/" + "/".join(rng.choice("ab") * rng.randint(1, 3) for _ in range(3))) for _ in range(60)})
    out = {(r.host, r.path): (r.near, r.other) for r in page_text.nearest_paths(spark.createDataFrame([(h, p, [k]) for k, (h, p) in enumerate(rows)], "host string, path string, hashes array<bigint>")).collect()}

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for k, (h, p) in enumerate(rows):
        beside = [(shared(p, rows[j][1]), -j, j) for j in (k - 1, k + 1) if 0 <= j < len(rows) and rows[j][0] == h]
        beside.sort(reverse=True)
        assert out[h, p] == tuple([beside[n][2]] if len(beside) > n else None for n in range(2))


def test_the_pages_beside_decide(spark):
    """A notice that only differencing can find: within the article, in no element of its own."""
    page = "<body><article><p>{0} Daily says hello</p><p>Story {1}, told at length, with all that happened on day {1} and what was said of it</p><p>A common sentence</p><p>More of {1}</p><p>Read on at {0} Daily</p></article></body>"

    def texts(rows):
        return {r.page_id: r.text.split("\n\n") for r in page_text.extract_text(spark.createDataFrame([(i, u, h, "p", "t") for i, u, h in rows], PAGES)).collect()}

    own = [(k, f"http://h/a/{k}", page.format("The", k)) for k in range(1, 5)]
    out = texts(own)
    assert out[2][1:] == ["A common sentence", "More of 2"] and out[2][0].startswith("Story 2") and out[2] == [t.replace("3", "2") for t in out[3]]
    # The first and the last of the host have a page on one side only.
    assert out[1][0] == out[4][0] == "The Daily says hello" and len(out[1]) == 5
    # With other pages beside it, the same page keeps its lines.
    assert len(texts([own[1], *((k, u, h.replace("The", "Another")) for k, u, h in (own[0], own[2]))])[2]) == 5
    # Copies of an article take nothing from each other.
    assert {len(t) for t in texts([(k, f"http://h/a/{k}", own[0][2]) for k in range(1, 5)]).values()} == {5}


def test_copies_without_an_article(spark):
    """Pages of which the nearest has every line keep them; names of classes don't hide an article, nor does a form around it."""
    plain = "<div class='nav'>Menu</div><p>First words</p><p>Licensed under CC BY.</p>"
    rows = [(1, "http://h/a/one", plain), (2, "http://h/a/two", plain), (3, "http://g/x/1", plain), (4, "http://g/x/2", plain.replace("First", "Other"))]
    rows += [(5, "http://f/1", '<form><nav>M</nav><article class="related-work"><div class="header">Head</div><p>Text</p><article class="comment">No</article></article></form><form><p>q</form>')]
    out = {r.page_id: r.text for r in page_text.extract_text(spark.createDataFrame([(*r, "p", "t") for r in rows], PAGES)).collect()}
    assert out == {1: "First words\n\nLicensed under CC BY.", 2: "First words\n\nLicensed under CC BY.", 3: "First words", 4: "Other words", 5: "Head\n\nText"}


def test_deep_markup(spark):
    deep = "<div>" * 3000 + "<nav>Menu entry</nav>" + "<b><i>" * 3000 + "text" + "</div>" * 3000 + "<article><p>" + "<b>" * 100 + "One<p>Two</article><p>out"
    assert [t for s, t in page_text.page_lines(deep) if s == page_text.ARTICLE] == ["One", "Two"]
    assert [t for s, t in page_text.page_lines(deep) if s == page_text.MARKED] == ["Menu entry"]


def test_pages_given_twice(spark):
    rows = [(1, "http://h/a", "<p>same</p><p>own a"), (1, "http://h/a", "<p>same</p><p>own a"), (None, None, None), (2, "http://h/" + "b" * 5000 + "/1", "<p>same</p><p>own b"), (3, "http://h/" + "b" * 5000 + "/2", "<p>own b</p><p>own c")]
    out = sorted((r.page_id or 0, r.text) for r in page_text.extract_text(spark.createDataFrame([(*r, "p", "t") for r in rows], PAGES)).collect())
    assert out == [(0, ""), (1, "own a"), (1, "own a"), (2, "same"), (3, "own c")]


def test_codec(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = [None, "", " ", "a", "  two  spaces ", "日本語 text\n\ttabs", "🙂🙃\x00é́", "word" * 3000, "<s> </s> <unk> <0x41>"]
    texts += ["".join(rng.choice("abcdeth  .,\n'0é日🙂▁") for _ in range(rng.randint(1, 300))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = piece_codec.decode_documents(piece_codec.encode_documents(docs, MODEL), MODEL).collect()
    for r in got:
        want = sp.encode(texts[r.doc_id] or "")
        assert list(r.ids) == want and r.text == sp.decode(want)
    assert len(got) == len(texts)


def canon(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


def test_normalisation(spark):
    rng = random.Random(4)
    odd = [c for c in map(chr, range(0x20, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c))]
    jamo = [chr(c) for c in (*range(0x1100, 0x1120), *range(0x1155, 0x1180), *range(0x11A0, 0x11D0), *range(0xAC00, 0xAC40))]
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x300, 0x350))]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for pool in (odd, jamo, letters, letters + odd[:300]) for _ in range(200)] + [f"a{c}b" for c in odd]
    texts += ["ａ" * 60_000, "日" * 60_000, "e\u0301" * 30_000, "x" * 60_000 + "ａ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    assert [r for r in docs.select("i", fingerprint.nfkc(F.col("t")).alias("n")).collect() if r.n != unicodedata.normalize("NFKC", texts[r.i])] == []


def test_fingerprints(spark):
    texts = ["Ａbc  d", "abc d", "ﬁne", "FINE ", "é", "é", None, "", "한글", "한글", "x" * 40_000, "same text", "same text", "same text", "Same text", "ab", "AB", "Straße 1", "STRASSE 1", "ΟΔΟΣ x", "οδοσ x", "ᾳδω", "ΑΙΔΩ", "ẞ", "ss", "ı", "I", "i"]
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in enumerate(texts)], "doc_id bigint, text string, a int, h string").repartition(3)
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert (prints[i] == prints[j]) == (canon(texts[i]) == canon(texts[j]))
    out = fingerprint.fingerprint_report(docs).collect()
    for r in out:
        text, following = texts[r.doc_id] or "", texts[r.doc_id - 1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[r.doc_id])
        assert (r.near_edited, r.near_next) == (float(canon(edited) == canon(text)), float(canon(following) == canon(text)))
        assert all((r.edited_fingerprint == prints[k]) == (canon(edited) == canon(t)) for k, t in enumerate(texts))
    assert len(out) == len(texts)
    assert fingerprint.fingerprint_report(docs.limit(0)).count() == fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (None, None), (2, "ONE  two")], "doc_id bigint, text string")
    out = fingerprint.fingerprint_report(docs).collect()
    assert len(out) == 5 and len({r.fingerprint for r in out}) == 2 and sorted(r.n_chars for r in out) == [0, 7, 7, 7, 8]


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """Where all canonical texts meet in one bucket, their bytes decide."""
    monkeypatch.setattr(fingerprint, "wide_hash", lambda *c: [F.length(c[0]).cast("long"), F.lit(0).cast("long")])
    texts = ["abc", "abd", "ABC", "xyz", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in fingerprint.fingerprint_report(docs).collect()}
    assert all((out[i].fingerprint == out[j].fingerprint) == (texts[i].lower() == texts[j].lower()) for i in out for j in out)
    assert {i: r.near_edited for i, r in out.items()} == {i: float((t[:2] + texts[i - 1][0]).lower() == t.lower()) for i, t in enumerate(texts)}


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["vile", "hateful"] if i % 4 == 0 and rng.random() < 0.3 else ["calm", "green", "river", "stone"]) for _ in range(40)), i % 2, int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "k") for i, t, _, _ in rows] + [(900, None, "k"), (901, "", "k")], "doc_id bigint, text string, p_toxic string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i < 300] + [(5000, 1, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score(docs, toxicity.document_chain(docs, labels)).collect()
    held_out = [r for r in out if 300 <= r.doc_id < 900]
    assert len(out) == 402 and sum(r.is_toxic == (r.doc_id % 4 == 0) for r in held_out) >= 0.95 * len(held_out)
    assert toxicity.score(docs.limit(0), toxicity.document_chain(docs, labels.limit(0))).count() == 0


def test_chain_learns_from_unseen_probabilities(spark, monkeypatch):
    """A "model" that says which folds it was fitted on: each row's probability must come from the other folds."""
    fitted = []

    def fit(rows, category):
        fitted.append(rows)
        return float(sum(r.fold for r in rows.select("fold").distinct().collect()))

    monkeypatch.setattr(toxicity, "_fit", fit)
    docs = spark.createDataFrame([(i, f"calm green river {i}") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    toxicity.document_chain(docs, labels)
    last = fitted[-1].select("fold", "p_low_quality").distinct().collect()
    assert {(r.fold, r.p_low_quality) for r in last} == {(k, 3.0 - k) for k in range(3)}
