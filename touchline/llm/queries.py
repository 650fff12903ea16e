"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import exact_dedup, fingerprint, kd_shards, line_dedup, merkle, mixing, near_dedup, page_text, piece_codec, substring_dedup, token_align, toxicity, warc_zip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Domains of the documents table (SQL): the sources' numbers by threes, and their weights and the languages'.
DOMAIN = "concat('domain', pmod(try_cast(substring(source, 4) as int), 3))"
MIX_WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.document_chain(docs, labels))
    return scored.select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), F.expr(DOMAIN), 60, MIX_WEIGHTS, max_epochs=4, seed=7)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_piece_codec(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """``model_file`` is a SentencePiece model; by default the installed public one."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.round_trip(_table(spark, sf_dir, "documents"), model_file).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    suspect = F.when(tampered, merkle.leaf_hash(n_chars=F.col("n_chars") + 1))
    return merkle.prove(_table(spark, sf_dir, "documents"), suspect, with_way=False)


def op13_token_align(spark: SparkSession, sf_dir: str, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """``a_file`` is a byte-level BPE, ``b_file`` a SentencePiece model; by default the installed public ones."""
    if a_file is None or b_file is None:
        import public_tokenizers

        a_file, b_file = a_file or public_tokenizers.path("byte_bpe_50k.json"), b_file or public_tokenizers.path("piece_bpe_32k.model")
    return token_align.alignment_report(_table(spark, sf_dir, "documents"), a_file, b_file)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_piece_codec": op4_piece_codec,
    "op5_warc": op5_warc,
    "op6_page_text": op6_page_text,
    "op7_mixing": op7_mixing,
    "op8_fingerprint": op8_fingerprint,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_kd_shards": op11_kd_shards,
    "op12_merkle": op12_merkle,
    "op13_token_align": op13_token_align,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": """
with l as (
  select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
w as (
  select doc_id, pos, line, lead(line) over d as l2, lead(line, 2) over d as l3
  from l window d as (partition by doc_id order by pos)),
f as (
  select doc_id, pos, row_number() over (partition by line, l2, l3 order by doc_id, pos) > 1 as later
  from w where l3 is not null),
c as (
  select w.doc_id, w.pos, w.line, max(coalesce(f.later, false)) over (partition by w.doc_id order by w.pos rows between 2 preceding and current row) as gone
  from w left join f on f.doc_id = w.doc_id and f.pos = w.pos)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from c group by doc_id""",
    "op3_exact_dedup": """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id = max(doc_id) over t as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))""",
    "op12_merkle": """
with recursive given as (
  select doc_id, coalesce('=' || lang, '-') as tree, n_chars,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
         coalesce(strlen(text) || ':' || text, '-') as tail,
         list_reduce(list_transform(range(length(doc_id::varchar)), lambda k: ascii(substr(doc_id::varchar, k + 1, 1))::bigint),
                     lambda crc, c: list_reduce(range(8), lambda t, k: xor(t >> 1, 3988292384 * (t & 1)), xor(crc, c)), 4294967295::bigint) as crc
  from documents),
leaf as (
  select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
         case when xor(crc, 4294967295) % 7 = 0 then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as changed
  from given),
bottom as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from leaf),
up as (
  select tree, 0 as level, idx, n, leaf as h from bottom
  union all
  select tree, min(level) + 1, idx // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' order by idx)) from up where n > 1 group by tree, idx // 2),
sub as (select tree, h, level, row_number() over (order by tree) - 1 as idx, count(*) over () as n from up where n = 1),
top as (
  select 0 as level, idx, n, h from sub
  union all
  select min(level) + 1, idx // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' order by idx)) from top where n > 1 group by idx // 2),
way as (
  select b.tree, b.idx, u.level, b.idx >> u.level as pos, s.h as sibling
  from bottom b join up u on u.tree = b.tree and u.idx = b.idx >> u.level and u.n > 1
  left join up s on s.tree = u.tree and s.level = u.level and s.idx = xor(u.idx, 1)
  union all
  select b.tree, b.idx, sub.level + t.level, t.idx, s.h
  from bottom b join sub on sub.tree = b.tree join top t on t.idx = sub.idx >> t.level and t.n > 1
  left join top s on s.level = t.level and s.idx = xor(t.idx, 1)),
listed as (select tree, idx, list({'pos': pos, 'sibling': sibling} order by level) as steps from way group by tree, idx),
folded as (
  select b.doc_id, b.leaf, sub.h as subroot, (select h from top where n = 1) as root, coalesce(w.steps, []) as steps,
         list_reduce(list_transform(coalesce(w.steps, []), lambda s: {'pos': s.pos, 'h': s.sibling}),
                     lambda x, s: {'pos': 0::bigint, 'h': sha256(case when s.pos % 2 = 1 then coalesce(s.h, '') || x.h else x.h || coalesce(s.h, '') end)},
                     {'pos': 0::bigint, 'h': coalesce(b.changed, b.leaf)}).h as folded_root
  from bottom b join sub using (tree) left join listed w on w.tree = b.tree and w.idx = b.idx)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: coalesce(s.sibling, '')), '')) as proof_sha256,
       folded_root, folded_root = root as verified
from folded""",
    "op7_mixing": """
with r as (
  select doc_id, 'domain' || (cast(substr(source, 4) as int) % 3) as domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens
  from documents),
leaf as (
  select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) * 4 as bigint) as cap
  from r group by all),
n1 as (
  select domain, cast(sum(cap) as bigint) as cap, case domain when 'domain0' then 5 when 'domain1' then 3 when 'domain2' then 2 else 1 end as weight,
         (select cast(sum(tokens) as bigint) * 60 // 100 from leaf) as budget
  from leaf group by domain),
r1 as (
  select *, (budget - coalesce(sum(cap) over (order by cap / weight, domain rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, domain rows between current row and unbounded following) as rate
  from n1),
a1 as (
  select domain, cast(case when cap <= rate * weight then cap else floor(max(case when cap > rate * weight then rate end) over () * weight) end as bigint) as alloc
  from r1),
n2 as (
  select domain, lang, cast(sum(cap) as bigint) as cap, case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end as weight, any_value(alloc) as budget
  from leaf join a1 using (domain) group by domain, lang),
r2 as (
  select *, (budget - coalesce(sum(cap) over (partition by domain order by cap / weight, lang rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (partition by domain order by cap / weight, lang rows between current row and unbounded following) as rate
  from n2),
a2 as (
  select domain, lang, cast(case when cap <= rate * weight then cap else floor(max(case when cap > rate * weight then rate end) over (partition by domain) * weight) end as bigint) as alloc
  from r2),
n3 as (
  select leaf.*, 1 as weight, alloc as budget from leaf join a2 using (domain, lang)),
r3 as (
  select *, (budget - coalesce(sum(cap) over (partition by domain, lang order by cap / weight, source rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (partition by domain, lang order by cap / weight, source rows between current row and unbounded following) as rate
  from n3),
a3 as (
  select domain, lang, source, tokens, cast(case when cap <= rate * weight then cap else floor(max(case when cap > rate * weight then rate end) over (partition by domain, lang) * weight) end as bigint) as alloc
  from r3),
o as (
  select r.*, alloc, alloc // tokens as epochs, alloc % tokens as rest, md5('7:' || (alloc // tokens + 1) || ':' || doc_id) as h
  from r join a3 using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens, alloc,
       cast(epochs + case when rest > 0 and sum(n_tokens) over (partition by domain, lang, source order by h) <= rest then 1 else 0 end as bigint) as copies
from o""",
}
