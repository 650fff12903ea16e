"""Shards, manifests and alignments against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from touchline.llm import kd_shards, merkle, queries, token_align

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(seed=3, n=300):
    """Rows with nulls, empty, repeated and long texts, ids given twice, and a source with a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "same text " * 4] + [" ".join(rng.choice(["ab", "ç", "d\ne", "▁", "\U0001f600", "xyz  "]) for _ in range(rng.choice([1, 5, 30])))] * 6)
        rows.append((rng.choice([None, k, k, k, k // 2]), text, rng.choice(["en", "de", "é", None, ""]), rng.choice(["src1", "src1", f"src{k % 7}", None]), rng.choice([None, len(text or "")])))
    return rows + [rows[5]] * 40 + [(10**9, "long word " * 40_000, "fr", "src1", 400_000)]


def table(spark, rows):
    extra = ", id string, idx string, tree string, size string, shard string, pairs string, __row string, key string, slot string"
    return spark.createDataFrame([(*r, *"abcdefghi") for r in rows], SCHEMA + extra).repartition(5)


# --- shards


def plain_tree(rows, shards, n_dims):
    """The shard of each (keys, size) by cutting lists."""

    def cut(part, first, k):
        if k == 1 or not part:
            for r in part:
                out[r[2]] = first
            return
        spread = [max(r[0][d] for r in part) // 2**32 - min(r[0][d] for r in part) // 2**32 for d in range(n_dims)]
        dim = spread.index(max(spread))
        part = sorted(part, key=lambda r: r[0][dim])
        goal, below, left = sum(r[1] for r in part) * (k // 2) // k, 0, []
        while part and 2 * below + part[0][1] <= 2 * goal:
            below += part[0][1]
            left.append(part.pop(0))
        cut(left, first, k // 2)
        cut(part, first + k // 2, k - k // 2)

    out = {}
    cut(rows, 0, shards)
    return out


@pytest.mark.parametrize("top_leaves", [1024, 3])
def test_kd_cuts(spark, top_leaves):
    rows = documents()
    keyed = kd_shards._keyed(table(spark, rows), kd_shards.DIMENSIONS, "doc_id", "text", [F.col("doc_id")])
    given = [([r[f"__k{d}"] for d in range(4)], r["size"], r["__row"]) for r in keyed.collect()]
    want = plain_tree(given, 13, 4)
    got = kd_shards._sharded(keyed, 13, None, 4, top_leaves).collect()
    assert {r["__row"]: r.shard for r in got} == want and len(got) == len(rows)


def test_shards_of_all_rows(spark):
    rows = documents()
    got = kd_shards.assign_shards(table(spark, rows), shards=5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))


def test_shards_are_even(spark):
    # A third of all rows of one source, language and length; a third of all rows the same row.
    rows = [(k, "x" * 200, "en", "hot", 200) for k in range(800)] + [(None, "y" * 190, None, None, None)] * 800 + [(k, "z" * (k % 300), "de", f"s{k % 9}", k % 300) for k in range(800)]
    sizes = Counter()
    for r in kd_shards.assign_shards(table(spark, rows), shards=24).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 308
    # As many shards as the target asks for.
    assert kd_shards.assign_shards(table(spark, rows), target_bytes=200_000).agg(F.max("shard")).first()[0] == -(-sum(sizes.values()) // 200_000) - 1


def test_shards_of_nothing(spark):
    assert kd_shards.assign_shards(table(spark, []), shards=24).collect() == []
    few = kd_shards.assign_shards(table(spark, documents()[:2]), shards=24).collect()
    assert len(few) == 2 and {r.slot for r in few} <= {0, 1}
    with pytest.raises(ValueError):
        kd_shards.assign_shards(table(spark, []))


def test_shards_as_files(spark, tmp_path):
    rows = documents()
    docs = table(spark, rows)
    out = kd_shards.write_shards(docs, f"{tmp_path}/shards", shards=6)
    assert Counter(tuple(r.doc[:5]) for r in out.select("doc").collect()) == Counter(rows)
    slots = defaultdict(list)
    for r in out.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(6))


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_proofs(digests):
    """(root, for each digest the siblings and sides on its way)."""
    level, at, ways = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for k, p in enumerate(at):
            q = p ^ 1
            ways[k].append((level[q] if q < len(level) else None, bool(p & 1)))
            at[k] = p // 2
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], ways


def plain_manifest(rows):
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        changed = n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        trees[lang].append((i is not None, i or 0, plain_leaf(i, source, lang, n, text), i, plain_leaf(i, source, lang, changed, text)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: plain_proofs([leaf[2] for leaf in sorted(trees[x])]) for x in names}
    root, over = plain_proofs([built[x][0] for x in names])
    out = []
    for x, above in zip(names, over):
        for leaf, way in zip(sorted(trees[x]), built[x][1]):
            way, now = way + above, leaf[4]
            for sibling, left in way:
                now = h(now) if sibling is None else h(sibling, now) if left else h(now, sibling)
            out.append((leaf[3], leaf[2], built[x][0], root, h(*[s for s, _ in way if s]), now, now == root))
    return out


@pytest.mark.parametrize("n", [300, 1, 2])
def test_manifest(spark, tmp_path, n):
    rows = documents(n=n) if n > 2 else documents()[:n]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_manifest(rows))


def test_manifest_in_short_steps(spark):
    rows = documents()
    got = merkle.prove(table(spark, rows), with_way=False, stride=2).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(r[:5] for r in plain_manifest(rows)) and all(r.verified for r in got)


def test_manifest_gives_its_way(spark):
    rows = documents(n=40)
    got = merkle.prove(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(merkle.fold(r.leaf, r.way) == r.root == r.folded_root and r.verified for r in got)
    assert merkle.prove(table(spark, [])).collect() == []


# --- alignment


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    out, counts = [], Counter()
    for text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False)
        b = b_model.encode(text or "")
        raws_a = [bytes(byte_of[c] for c in t) for t in a.tokens]
        raws_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
        if not text or b"".join(raws_a) != b" " + text.encode() or b"".join(raws_b) != b" " + text.encode():
            out.append((0, 0, 0, [], ""))
            continue
        spans = []
        for ids, raws in ((a.ids, raws_a), (b, raws_b)):
            at, own = 0, []
            for i, raw in zip(ids, raws):
                own.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(text) < 5000 else None
        both = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, begin = [], 0
        if links is None:
            links, k = [], 0
            for x in spans[0]:
                while spans[1][k][1] <= x[0]:
                    k += 1
                j = k
                while j < len(spans[1]) and spans[1][j][0] < x[1]:
                    links.append((x[2], spans[1][j][2]))
                    j += 1
        lists = [iter(own) for own in spans]
        for end in both:
            part = []
            for own in lists:
                ids = []
                at = begin
                while at < end:
                    s = next(own)
                    ids.append(str(s[2]))
                    at = s[1]
                part.append(",".join(ids))
            groups.append("|".join(part))
            begin = end
        counts.update(set(links))
        out.append((len(a.ids), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(n_a, n_b, n_g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, n_g, links, g in out]


@pytest.mark.parametrize("broadcast_pairs", [token_align.BROADCAST_PAIRS, 3])
def test_alignment(spark, broadcast_pairs):
    rows = documents(n=60) + [(900 + k, t, "en", "s", 1) for k, t in enumerate(["<|endoftext|> and </s> <s> <0x41>", " leading", "  two", "tab\tnew\n\nline ", "ﬁ ａｂｃ ½", "日本語のテキスト", "a" * 500, "\x00\x7f", "don't Won't it's 12345 67"])]
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = token_align.alignment_report(table(spark, rows), *files, broadcast_pairs=broadcast_pairs).collect()
    want = plain_alignment([r[1] for r in rows])
    assert Counter(tuple(r) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want))
    assert token_align.alignment_report(table(spark, []), *files).collect() == []


def test_groups_are_given(spark):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    r = token_align.align_documents(table(spark, [(1, "abc def", None, None, None)]), *files).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and sum(r.times) == r.n_links and r.groups.count(";") == r.n_groups - 1


def test_words_are_encoded_once():
    """Both libraries see a repeated word once, and what is put together is what they make of the whole text."""
    own = token_align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    seen = []
    library = own.b

    class Counted:
        def encode(self, texts, num_threads):
            seen.extend(texts)
            return library.encode(texts, num_threads=num_threads)

    own.b = Counted()
    texts = ["alpha beta " * 1000 + "alpha", "beta alpha", "", "end  ", "end ", "a \n b\u180e c", "x\r y\u2581z w", " ", "it's  two\u00a0 three\t four"]
    a, b = own.encode(texts)
    assert sum(map(len, seen)) < 200
    for k, text in enumerate(texts):
        whole_a, whole_b = own.a.encode(" " + text, add_special_tokens=False).ids if text else [], library.encode(text)
        if b"".join(own.b_bytes[i] for i in whole_b) != b" " + text.encode():
            whole_a = whole_b = []
        assert [np.frombuffer(x, np.int64).tolist() for x in (a[k], b[k])] == [whole_a, whole_b], text
