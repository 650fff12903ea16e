"""Canonical exact digests of documents.

A text is brought to a canonical form (Unicode NFKC, full case folding, white space folded to single spaces) and
hashed to 128 bits by two xxhash64. Documents with equal hashes are grouped and their canonical bytes
compared; where a bucket turns out to hold different texts, their fingerprints are told apart.

DataFrame expressions only. Spark has no function for Unicode normalisation, so tables of decompositions,
compositions and combining classes are derived by rule from Python's ``unicodedata`` when the plan is made,
and only texts that hold a character outside the quick-check set pay for it.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import bisect_column, shuffle_partitions, stored, text_of, wide_hash

#: Most keys that may be broadcast in the byte comparison: 16 bytes each, 4 MB in all.
BROADCAST_KEYS = 250_000
#: White space that NFKC has not made a space already.
_SPACE = r"[\t-\r\x1C-\x1F\x{85}\x{1680}\x{2028}\x{2029}]"

#: ASCII, its controls and the Latin letters up to U+0131: none of them changes under NFKC.
_QUICK = r"[\x00-\x{9F}\x{C0}-\x{131}]"


def _java_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a < b else f"\\x{{{a:X}}}" for a, b in ranges) + "]"


def _ranges(code_points: set[int] | list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in sorted(code_points):
        if out and out[-1][1] == cp - 1:
            out[-1] = out[-1][0], cp
        else:
            out.append((cp, cp))
    return out


#: Hangul: first code points of leading, vowel and trailing letters and of the syllables, and how many there are.
_L, _V, _T, _S, _N_L, _N_V, _N_T = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28
#: Small maps that a table is spread over, as a map is searched from its beginning.
_SPREAD = 512


def _number(chars: str) -> int:
    """Which of the small maps holds one or two characters."""
    return (ord(chars[0]) * (31 if len(chars) > 1 else 1) + (ord(chars[1]) if len(chars) > 1 else 0)) % _SPREAD


def _spread(values: dict[str, object]) -> str:
    """JSON of ``_SPREAD`` maps. Tables stand in every plan that uses them, so they are kept short."""
    maps: list[dict] = [{} for _ in range(_SPREAD)]
    for chars, value in values.items():
        maps[_number(chars)][chars] = value
    return json.dumps(maps, ensure_ascii=False, separators=(",", ":"))


@cache
def _unicode_tables() -> tuple[str, str, str, str, str, str, str]:
    """(pattern of a character that needs work, pattern of one that may, class of marks, class of all that may
    join what stands before it, decompositions, compositions, combining classes).

    Java tests a class of hundreds of ranges one by one, so what is plain at first sight (``_QUICK``) and
    the long stretches without a character that needs work are passed over before the rest is looked at.
    Hangul syllables are told by their numbers and stand in no table.
    """
    letters = [*range(_V, _V + _N_V), *range(_T + 1, _T + _N_T)]
    needs, marks, joining, down, order = set(letters), [], set(letters), {}, {}
    pairs: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or _S <= cp < _S + _N_L * _N_V * _N_T:
            continue
        c = chr(cp)
        if ccc := unicodedata.combining(c):
            needs.add(cp)
            marks.append(cp)
            order[c] = ccc
        if unicodedata.normalize("NFKC", c) != c:
            needs.add(cp)
        if (full := unicodedata.normalize("NFKD", c)) != c:
            down[c] = full
        pair = unicodedata.decomposition(c)
        if pair and not pair.startswith("<") and " " in pair:
            first, second = (int(x, 16) for x in pair.split())
            if unicodedata.normalize("NFC", chr(first) + chr(second)) == c:
                pairs[chr(first) + chr(second)] = c
                needs.add(second)
                joining.add(second)
    edges = [-1, *sorted(needs), sys.maxunicode + 1]
    plain_class = _java_class([(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b > a + 1 and (b - a > 64 or b < 0x180)])
    return (
        f"(?:(?!{_QUICK})(?!{plain_class}){_java_class(_ranges(needs))})",
        f"(?!{_QUICK})(?!{plain_class})(?s:.)",
        _java_class(_ranges(marks)),
        _java_class(_ranges({*marks, *joining})),
        _spread(down),
        _spread(pairs),
        _spread(order),
    )


def _character(code_point: Column) -> Column:
    """The character of a number below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code_point), 4, "0")), "UTF-16BE")


def nfkc(text: Column) -> Column:
    """Unicode NFKC of ``text``.

    The text is cut into stretches that need work, each with the character before it, and the rest. A stretch is
    decomposed, cut where nothing can join what stands before, and each piece composed.
    """
    needs, odd, marks, joining, down, up, order = _unicode_tables()
    down_of, up_of, ccc_of = (F.from_json(F.lit(t), f"array<map<string,{kind}>>") for t, kind in ((down, "string"), (up, "string"), (order, "int")))
    at = lambda table, c: F.get(table, F.ascii(c) % _SPREAD)[c]

    def ordered(piece: Column) -> Column:
        chars = F.transform(F.split(piece, ""), lambda c, i: F.struct(F.coalesce(at(ccc_of, c), F.lit(0)).alias("ccc"), i.alias("i"), c.alias("c")))
        return F.array_sort(chars)

    def joined(base: Column, c: Column) -> Column:
        """The composed character of two, or null."""
        x, y = F.ascii(base), F.ascii(c)
        lead, vowel, syllable, trail = x - _L, y - _V, x - _S, y - _T
        return (
            F.when((lead >= 0) & (lead < _N_L) & (vowel >= 0) & (vowel < _N_V), _character((lead * _N_V + vowel) * _N_T + _S))
            .when((syllable >= 0) & (syllable < _N_L * _N_V * _N_T) & (trail > 0) & (trail < _N_T), F.when(syllable % _N_T == 0, _character(x + trail)))
            .otherwise(F.get(up_of, (x * 31 + y) % _SPREAD)[F.concat(base, c)])
        )

    def step(s: Column, x: Column) -> Column:
        free = F.when(s["rest"] == "", True).otherwise((x["ccc"] > 0) & (s["ccc"] < x["ccc"]))
        new = F.when(free & (s["base"] != ""), joined(s["base"], x["c"]))
        joins, starts = new.isNotNull(), x["ccc"] == 0
        return F.struct(
            F.when(~joins & starts, F.concat(s["out"], s["base"], s["rest"])).otherwise(s["out"]).alias("out"),
            F.when(joins, new).when(starts, x["c"]).otherwise(s["base"]).alias("base"),
            F.when(joins, s["rest"]).when(starts, "").otherwise(F.concat(s["rest"], x["c"])).alias("rest"),
            F.when(joins, s["ccc"]).otherwise(x["ccc"]).alias("ccc"),
        )

    def composed(piece: Column) -> Column:
        parts = F.regexp_extract_all(piece, F.lit(f"(?s)^{marks}++|.{marks}*+"), F.lit(0))
        start = F.struct(F.lit("").alias("out"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))
        whole = F.aggregate(F.flatten(F.transform(parts, ordered)), start, step, lambda s: F.concat(s["out"], s["base"], s["rest"]))
        return F.when(F.length(piece) == 1, piece).otherwise(whole)

    def normalised(stretch: Column) -> Column:
        full = F.array_join(F.transform(F.split(stretch, ""), lambda c: F.coalesce(at(down_of, c), c)), "")
        return F.array_join(F.transform(F.regexp_extract_all(full, F.lit(f"(?s)^{joining}++|.{joining}*+"), F.lit(0)), composed), "")

    # A stretch that needs work begins with the last plain character before it.
    stretches = F.regexp_extract_all(text, F.lit(f"(?s)(?:(?!{needs}).)?{needs}++|(?:(?!{needs}).(?!{needs}))++|."), F.lit(0))
    fixed = F.array_join(F.transform(stretches, lambda s: F.when(s.rlike(needs), normalised(s)).otherwise(s)), "")
    return F.when(text.rlike(_QUICK.replace("[", "[^")) & text.rlike(odd), fixed).otherwise(text)


@contextmanager
def short_plans(spark: SparkSession, most: int = 1 << 16) -> Iterator[None]:
    """Meanwhile plans are described by ``most`` characters and not planned anew after each stage, with a description each
    time: those that hold the Unicode tables come to megabytes each."""
    meant = {"spark.sql.maxPlanStringLength": str(most), "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in meant}
    for name, value in meant.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@cache
def _folds() -> dict[str, str]:
    """Of the characters that NFKC leaves, those in lower case that full case folding still changes, such as a sharp s or a
    final sigma: some fifty, each with what it becomes."""
    found = {}
    for c in map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]):
        folded = c.casefold().lower()
        if folded != c.lower() and unicodedata.normalize("NFKC", c) == c and unicodedata.normalize("NFKC", folded) != c.lower():
            found[c.lower()] = unicodedata.normalize("NFKC", folded)
    return found


def folded(text: Column) -> Column:
    """Full case folding of text in NFKC. Characters that become two are told their second first (an iota, nearly always),
    so that all that is left is one for one."""
    singles, seconds = {}, {}
    for c, becomes in _folds().items():
        singles[c] = becomes[0]
        if len(becomes) > 1:
            seconds.setdefault(becomes[1:], []).append(c)
    out = F.lower(text)
    for second, chars in seconds.items():
        out = F.regexp_replace(out, f"([{''.join(chars)}])", f"$1{second}")
    return F.translate(out, "".join(singles), "".join(singles.values()))


def canonical(text: Column) -> Column:
    """NFKC, case folding, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(nfkc(text)), _SPACE, " "), "  +", " "))


def _hex(pair: list[Column] | tuple[Column, Column]) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in pair])


def _told_apart(key: Column, sha: Column, mixed: DataFrame | None) -> Column:
    return key if mixed is None else F.when(F.col("__mixed"), F.concat(key, F.lit("-"), F.substring(sha, 1, 16))).otherwise(key)


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, a stored table of some longs a row, marked for broadcast if it is small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def mixed_buckets(docs: DataFrame, light: DataFrame, id_col: str, text_col: str, edits: bool = False) -> DataFrame | None:
    """Keys (a, b) of buckets whose canonical texts differ; None if there are none, as nearly always.

    ``light``: id, h, a, b of each document; with ``edits`` also n_chars, ea, eb of its edited text and nid, nh of the
    next document. Only the texts in buckets of two or more are read again, and their bytes compared.
    """
    keys = light.select("a", "b")
    if edits:  # the edited text of fewer than three characters is the text
        edited = light.where("n_chars >= 3")
        keys = keys.unionAll(edited.select("ea", "eb"))
    shared = stored(keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"), "fingerprint-keys")
    if shared.isEmpty():
        return None
    shared = _few(shared)
    own = light.join(shared, ["a", "b"], "left_semi").select("id", "h", "a", "b").distinct()
    needed = own.select("id", "h")
    if edits:
        pairs = edited.drop("a", "b").withColumnsRenamed({"ea": "a", "eb": "b"}).join(shared, ["a", "b"], "left_semi").select("id", "h", "nid", "nh", "a", "b").distinct()
        needed = needed.unionAll(pairs.select("id", "h")).unionAll(pairs.select("nid", "nh"))
    needed = stored(needed.distinct().select(F.col("id").alias("i"), F.col("h").alias("j")), "fingerprint-members")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = rows.join(_few(needed), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left_semi").dropDuplicates(["id", "h"])

    def of(df: DataFrame, id_at: str, h_at: str, name: str) -> DataFrame:
        named = texts.select(F.col("id").alias("i"), F.col("h").alias("j"), F.col("text").alias(name))
        return df.join(named, F.col(id_at).eqNullSafe(F.col("i")) & (F.col(h_at) == F.col("j"))).drop("i", "j")

    variants = of(own, "id", "h", "text").select("a", "b", canonical(F.col("text")).alias("c"))
    if edits:
        both = of(of(pairs, "id", "h", "text"), "nid", "nh", "following")
        variants = variants.unionAll(both.select("a", "b", canonical(_edited(F.col("text"), F.col("following"))).alias("c")))
    variants = variants.groupBy("a", "b", "c").agg(F.lit(1).alias("one"))
    mixed = stored(variants.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"), "fingerprint-mixed")
    return None if mixed.isEmpty() else mixed


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("canon", canonical(F.col("text")))
    a, b = wide_hash(F.col("canon"))
    return rows.withColumns({"a": a, "b": b, "sha": F.sha2("canon", 256), "h": F.xxhash64("text")}).drop("canon")


def _resolved(df: DataFrame, mixed: DataFrame | None, a: str, b: str, sha: str, out: str) -> DataFrame:
    """Adds the fingerprint column ``out`` from the hash columns."""
    if mixed is not None:
        df = df.join(mixed.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit(True).alias("__mixed")), (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left")
    return df.withColumn(out, _told_apart(_hex((F.col(a), F.col(b))), F.col(sha), mixed)).drop("__a", "__b", "__mixed")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint.

    Documents have equal fingerprints if and only if their canonical texts have equal bytes. Null counts
    as empty, and the empty text has a fingerprint like any other. Rows repeated stay repeated; an empty
    table gives an empty result; other columns are ignored.
    """
    with short_plans(docs.sparkSession):
        light = stored(_keyed(docs, id_col, text_col).drop("text"), "fingerprints")
    mixed = mixed_buckets(docs, light, id_col, text_col)
    return _resolved(light, mixed, "a", "b", "sha", "fingerprint").select(F.col("id").alias(id_col), "fingerprint")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``next``, a struct of the ``carried`` columns of the row that follows in order of descending id.

    After the last comes the first. Ids are cut into buckets at approximate quantiles, and each bucket also
    gets the head of the bucket after it, so the rows are shuffled once and no task holds more than a
    bucket. Only one id per bucket passes through the driver. Null ids come last; equal ids follow each
    other in the order of their text hash ``h``.
    """
    spark = rows.sparkSession
    low = -(1 << 63)
    rows = rows.withColumn("__k", F.coalesce("id", F.lit(low)))
    pieces = 4 * shuffle_partitions(spark)
    points = F.array(*[F.lit(k / pieces) for k in range(1, pieces)]) if pieces < 64 else F.expr("array(" + ",".join(f"{k / pieces!r}D" for k in range(1, pieces)) + ")")
    bounds = rows.agg(F.percentile_approx("__k", points, 10 * pieces).alias("b")).first().b or []
    rows = rows.withColumn("__at", bisect_column(F.col("__k"), sorted(set(bounds))))
    heads = {r["__at"]: r.head for r in rows.groupBy("__at").agg(F.max("__k").alias("head")).collect()}
    if not heads:
        return rows.withColumn("next", F.struct(*carried)).drop("__k", "__at")
    order = sorted(heads)  # bucket k is followed by the one below it, the lowest by the highest
    above = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
    size = order[-1] + 1
    head = F.from_json(F.lit(json.dumps([heads.get(b) for b in range(size)])), "array<bigint>")
    to = F.from_json(F.lit(json.dumps([above.get(b) for b in range(size)])), "array<int>")
    own = F.struct(F.col("__at").alias("at"), F.lit(False).alias("halo"))
    ahead = F.struct(F.get(to, F.col("__at")).alias("at"), F.lit(True).alias("halo"))
    sent = rows.withColumn("__to", F.explode(F.when(F.col("__k") == F.get(head, F.col("__at")), F.array(own, ahead)).otherwise(F.array(own))))
    sent = sent.withColumns({"__at": F.col("__to.at"), "__halo": F.col("__to.halo")}).drop("__to")
    window = Window.partitionBy("__at").orderBy("__halo", F.desc("__k"), "h")
    return sent.withColumn("next", F.lead(F.struct(*carried)).over(window)).where("not __halo").drop("__k", "__at", "__halo")


def _edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/3) code points replaced by the first as many, or all, of ``following``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text, edited, and h, a, b, sha of the text and of the next one's."""
    rows = _keyed(docs, id_col, text_col)
    return with_next(rows, ["id", "text", "h", "a", "b", "sha"]).withColumn("edited", _edited(F.col("text"), F.col("next.text")))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of the texts and of their edited forms, and their likeness.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The digest
    is exact, so a likeness is 1 for equal canonical texts and else 0. A document that is alone is its own
    next one. Nulls, repeats and empty tables: see ``fingerprints``.
    """
    ea, eb = wide_hash(F.col("canon"))
    with short_plans(docs.sparkSession):
        light = stored(
            edited_documents(docs, id_col, text_col)
            .withColumn("canon", canonical(F.col("edited")))
            .select(
                "id", "h",
                F.length("text").cast("long").alias("n_chars"),
                F.sha2("edited", 256).alias("edited_sha256"),
                "a", "b", "sha",
                ea.alias("ea"), eb.alias("eb"), F.sha2("canon", 256).alias("esha"),
                F.col("next.id").alias("nid"), F.col("next.h").alias("nh"), F.col("next.a").alias("na"), F.col("next.b").alias("nb"), F.col("next.sha").alias("nsha"),
            ),
            "fingerprints",
        )
    mixed = mixed_buckets(docs, light, id_col, text_col, edits=True)
    for a, b, sha, out in (("a", "b", "sha", "fingerprint"), ("ea", "eb", "esha", "edited_fingerprint"), ("na", "nb", "nsha", "next_fingerprint")):
        light = _resolved(light, mixed, a, b, sha, out)
    same = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return light.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
