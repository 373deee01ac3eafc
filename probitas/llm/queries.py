"""The operators over whole tables, as the queries ``opN_<name>``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, small_batches
from . import debruijn, decontam, jaccard, langid, licenses, merkle, packing, pii, quality, sharding, store, suffix, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_shingles", "n_shared")


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.find_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_offset_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op8_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document by checksum claims one character more than it has."""
    docs = table(spark, sf_dir, "documents")
    more = merkle.leaf_digest(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    checked = merkle.verify(merkle.prove(docs, claim=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, more)))
    text = {c: F.lower(F.hex(c)).alias(c) for c in ("subroot", "root")}
    return checked.select("doc_id", F.lower(F.hex("digest")).alias("leaf"), text["subroot"], text["root"], "proof_sha256", "folded_root", (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lpt_sharding, op2_adaptive_quality, op3_minhash_containment, op4_suffix_levels, op5_partition_jaccard, op6_offset_pii, op7_hierarchical_langid, op8_debruijn_spans, op9_bm25_packing, op10_content_store, op11_license_join, op12_merkle_traversal, op13_conversation_trie, pipeline)
    return {f.__name__: f for f in own}


#: Words, base measures and the sketch's fences, as they are defined in quality.py.
OP2_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, lang, source from documents),
w as (select rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
five as (select rid, p, list_slice(ws, p, p + 4) as g from (select rid, ws, unnest(range(1, len(ws) - 3)) as p from w where len(ws) >= 5) x),
twice as (select rid, p from (select rid, p, count(*) over (partition by rid, g) as n from five) x where n > 1),
cover as (select rid, sum(least(5, gap)) as n from (select rid, coalesce(lead(p) over (partition by rid order by p) - p, 5) as gap from twice) x group by rid),
m as (select d.rid, doc_id, lang, source, len(ws) as n_words,
  length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') <> '')) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') <> ''))) as n_dup_lines,
  cast(coalesce(cover.n, 0) as bigint) as n_repeat_words
  from d join w using (rid) left join cover using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, coalesce('=' || lang, '') as lk, coalesce('=' || source, '') as sk from m),
v as (select rid, lk, sk, base_failed, unnest([{'k': 1, 'f': 30, 'x': n_repeat_words * 1000 // greatest(n_words, 1)}, {'k': 2, 'f': 40, 'x': n_symbols * 1000 // greatest(n_words, 1)},
  {'k': 3, 'f': 40, 'x': n_dup_lines * 1000 // greatest(n_words, 1)}, {'k': 4, 'f': 1500, 'x': word_chars * 1000 // greatest(n_words, 1)}]) as s from b),
c as (select rid, lk, sk, s.k as k, s.f as f, s.x as x, case when s.x < 64 then s.x else ((s.x >> (len(bin(s.x)) - 6)) + 1) * (1 << (len(bin(s.x)) - 6)) - 1 end as top from v where not base_failed),
g as (select case when grouping(lk) = 1 then 2 when grouping(sk) = 1 then 1 else 0 end as level, lk, sk, k, count(*) as docs,
  quantile_disc(top, 0.75) + 6 * greatest(quantile_disc(top, 0.75) - quantile_disc(top, 0.25), any_value(f)) as fence
  from c group by grouping sets ((lk, sk, k), (lk, k), (k))),
j as (select v.rid, bool_or(v.s.x > coalesce(g0.fence, g1.fence, g2.fence)) as beyond from v
  left join g g0 on g0.level = 0 and g0.docs >= 100 and g0.lk = v.lk and g0.sk = v.sk and g0.k = v.s.k
  left join g g1 on g1.level = 1 and g1.docs >= 100 and g1.lk = v.lk and g1.k = v.s.k
  left join g g2 on g2.level = 2 and g2.k = v.s.k group by v.rid)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  n_repeat_words, base_failed, not base_failed and not coalesce(beyond, false) as kept from b join j using (rid)
"""

OP3_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
iw as (select row_number() over () as r, item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from benchmark),
ig as (select distinct r, item_id, k, list_slice(ws, p, p + k - 1) as g from (select r, item_id, ws, least(len(ws), 5) as k, unnest(range(1, greatest(len(ws) - 3, 2))) as p from iw where len(ws) > 0) x),
sets as (select distinct item_id, k, list_sort(list(g)) as gs from ig group by r, item_id, k),
q as (select row_number() over () as item, item_id, k, gs, len(gs) as n_shingles from sets),
i as (select item, unnest(gs) as g from q),
s as (select distinct doc_id, list_slice(ws, p, p + k - 1) as g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as p from w, (select distinct k from q) z where len(ws) >= k) x)
select doc_id, item_id, n_shingles, count(*) as n_shared from s join i using (g) join q using (item) group by doc_id, item, item_id, n_shingles having 100 * count(*) >= 80 * n_shingles
"""

#: crc32 of a decimal number's text, byte by byte and bit by bit.
CRC32_SQL = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast({0} as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)))"

#: Levels by recursion, siblings by the neighbour's number; a path is folded as a list.
OP12_SQL = """
with recursive d as (select row_number() over () as rid, *, case when n_chars is null or {crc} % 7 <> 0 then n_chars::hugeint else n_chars::hugeint + 1 end as told from documents),
s as (select rid, doc_id, lang, {fields} || {text} as a, {told} || {text} as b from d),
l as (select rid, doc_id, lang, sha256(a) as leaf, sha256(b) as claim, row_number() over (partition by lang order by doc_id nulls first, sha256(a)) - 1 as idx, count(*) over (partition by lang) as n from s),
t as (select 0 as lev, lang, idx, n, leaf as h from l
  union all select lev + 1, lang, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from t where n > 1 group by lev, lang, idx // 2, n),
r as (select lang, h as subroot, lev as height, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from t where n = 1),
u as (select 0 as lev, idx, n, subroot as h from r
  union all select lev + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from u where n > 1 group by lev, idx // 2, n),
steps as (
  select l.rid, a.lev as step, (l.idx >> a.lev) % 2 as odd, b.h from l join t a on a.lang is not distinct from l.lang and a.idx = l.idx >> a.lev and a.n > 1
    left join t b on b.lev = a.lev and b.lang is not distinct from a.lang and b.idx = xor(a.idx, 1)
  union all
  select l.rid, r.height + a.lev, (r.idx >> a.lev) % 2, b.h from l join r on r.lang is not distinct from l.lang join u a on a.idx = r.idx >> a.lev and a.n > 1 left join u b on b.lev = a.lev and b.idx = xor(a.idx, 1)),
paths as (select rid, list({{'odd': odd, 'h': coalesce(h, '')}} order by step) as path, string_agg(h, '' order by step) as proof from steps group by rid)
select *, folded_root = root as verified from (select doc_id, leaf, subroot, (select h from u where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
  list_reduce(list_concat([{{'odd': 0::bigint, 'h': claim}}], coalesce(path, [])), lambda x, y: {{'odd': 0::bigint, 'h': sha256(case when y.odd = 1 then y.h || x.h else x.h || y.h end)}}).h as folded_root
from l join r on r.lang is not distinct from l.lang left join paths using (rid)) x
"""


def _field_sql(name: str) -> str:
    return f"case when {name} is null then '-' else strlen({name}::varchar)::varchar || ':' || {name}::varchar end"


OP12_SQL = OP12_SQL.format(crc=CRC32_SQL.format("doc_id"), fields=" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars"))), told=" || ".join(map(_field_sql, ("doc_id", "source", "lang", "told"))), text=_field_sql("text"))

#: Each turn's sequence so far as text with lengths before its parts: one begins another as their texts do.
OP13_SQL = """
with turns as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, substr(sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 as i from conversations where conv_id is not null),
convs as (select c, {crc} % 6 as h, count(*) as n from turns group by c),
heads as (select convs.c, t.i, role, text from convs join turns t on t.c = convs.c - convs.c % 100 and t.i < h),
rebuilt as (select c, 0 as part, i, role, text from heads union all select c, 1, i, role, text from turns join convs using (c) where i >= h),
seq as (select c, row_number() over w as depth, length(text) as chars, string_agg(length(role)::varchar || ':' || role || length(text)::varchar || ':' || text, '') over w as key from rebuilt window w as (partition by c order by part, i)),
every as (select c, depth, chars, key, lag(key, 1, '') over (partition by c order by depth) as up, max(depth) over (partition by c) = depth as last from seq
  union all select c, 0, 0, '', null, c not in (select c from rebuilt) from convs),
nodes as (select key, any_value(depth) as depth, any_value(up) as up, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as own, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) as ends_sha256 from every group by key),
children as (select up, count(*) as n from nodes where up is not null group by up),
leaf as (select nodes.*, coalesce(children.n, 0) as n_children from nodes left join children on children.up = nodes.key),
below as (select a.key, sum(b.own) as saved, count(*) filter (b.n_children = 0) as leaves from leaf a join leaf b on starts_with(b.key, a.key) group by a.key)
select a.conv_id, a.depth, p.conv_id as parent_conv_id, a.n_convs, a.n_children, leaves as n_leaves, saved::bigint as saved_tokens, a.ends_sha256 from leaf a join below using (key) left join nodes p on p.key = a.up
""".format(crc=CRC32_SQL.format("c"))


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op2_adaptive_quality": OP2_SQL, "op3_minhash_containment": OP3_SQL, "op11_license_join": licenses.sql(), "op12_merkle_traversal": OP12_SQL, "op13_conversation_trie": OP13_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
