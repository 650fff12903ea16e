"""The deduplication operators against plain Python over small tables with every odd case."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from touchline.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from touchline.llm.components import connected_components
from touchline.llm.mixing import mix

SCHEMA = "doc_id bigint, text string, k string, t string, bucket string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def passages(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "日本", "a\tb"]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(18, 45))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(pool) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(words)))
    return rows + [(901, None), (902, ""), (903, " \n"), (904, "same " * 300), (905, rows[5][1]), (906, rows[5][1]), (907, "x " * 21)]


def brute_repeats(rows, window=20):
    seen, out = {}, {}
    order = sorted(rows)
    words_of = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in order}
    for i, _ in order:
        words = words_of[i]
        gone = set()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if key in seen:
                gone.update(range(at, at + window))
            else:
                seen[key] = (i, at)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages(spark, seed):
    rows = passages(seed)
    out = substring_dedup.remove_repeats(table(spark, rows)).collect()
    want = brute_repeats([(i, t or "") for i, t in rows])
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out} == want
    assert sum(w[1] for w in want.values()) > 100


def test_repeated_passages_of_one_id(spark):
    words = " ".join(f"a{k}" for k in range(30))
    out = substring_dedup.remove_repeats(table(spark, [(1, words), (1, words), (1, words + " end"), (None, words)])).collect()
    kept = sorted(r.n_words - r.n_removed for r in out)
    assert len(out) == 4 and kept[-1] >= 30 and kept[0] == 0
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def brute_near(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(4, 160))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 9999)}"
            rows.append((len(rows) * 2, " ".join(words).title() if rng.random() < 0.2 else " ".join(words)))
    return rows + [(801, None), (803, ""), (805, "  "), (807, "one two"), (809, "One TWO"), (811, rows[0][1]), (813, "ÀB c d e f")]


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    docs = table(spark, rows)
    out = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_near(rows)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, v in brute_near(rows).items() if v[2]}


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    out = near_dedup.near_duplicates(table(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])).collect()
    # The row without an id has the same words as those of id 4, which name the component.
    assert sorted((r.doc_id or -1, r.n_shingles, r.kept) for r in out) == [(-1, 2, out[[r.doc_id for r in out].index(None)].kept), (4, 2, True), (4, 2, True)]
    assert {r.component_id for r in out if r.doc_id} == {4}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (300, 200), (200, 300)]
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert out == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


def test_exact_duplicates(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a " * 5000), (8, "a " * 5000), (9, "a"), (9, "a")]
    docs = table(spark, rows)
    for capacity in (1, 4096):
        out = exact_dedup.exact_duplicates(docs, capacity=capacity).collect()
        assert len(out) == len(rows)
        for r in out:
            text = dict(rows)[r.doc_id] or ""
            same = [i for i, t in rows if (t or "") == text]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), r.doc_id == max(same), hashlib.sha256(text.encode()).hexdigest())
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [2, 5, 6, 8, 9, 9]
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_directory_doubles():
    depth, slots = exact_dedup.grow_directory({0: 5, 1: 5, 255: 1}, 8, 5)
    assert depth == 8 and len(slots) == 256 and slots[0] != slots[1] and slots[128] == slots[255]


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, "q\nq\nq\nq\nq"), (6, "a\nb\nc\nd")]
    out = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert out == {1: (4, 0, "a\nb\nc\nd"), 2: (5, 3, "x\ny"), 3: (2, 0, "a\nb"), 4: (1, 0, ""), 5: (5, 4, "q"), 6: (4, 4, "")}
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_mixing(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * (i % 7), ["en", "de", None][i % 3], f"s{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = mix(docs, F.lit("d"), 60, {"lang": {"en": 3, "de": 1}}, max_epochs=3).collect()
    total = sum(i % 7 for i in range(200))
    assert len(out) == 200 and all(0 <= r.copies <= 3 for r in out)
    given = sum(r.copies * r.n_tokens for r in out)
    assert given <= total * 60 // 100 and given > total * 0.5
    leaves = {}
    for r in out:
        leaves.setdefault((r.lang, r.source), [0, r.alloc])[0] += r.copies * r.n_tokens
    assert all(used <= alloc for used, alloc in leaves.values())
    assert mix(docs.limit(0), F.lit("d")).count() == 0
