"""The numbered queries: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import (
    brown_lm,
    exact_dedup,
    filter_audit,
    language_gru,
    mixing,
    packing,
    prob_minhash,
    quality_rules,
    secrets,
    suffix_dedup,
    url_filter,
    vector_codes,
    warc,
)
from gaugeworks.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages))


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judge(docs, rules).select("doc_id", *base, "base_failed", "kept", "rule")


@_query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = r"""
with normal as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
)
select doc_id,
       min(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id is not distinct from min(doc_id) over same as kept,
       sha256(norm) as text_sha256
from normal
window same as (partition by norm)
"""


@_query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_gru.identify(docs, language_gru.fit(docs))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.plan_mix(table(spark, sf_dir, "documents")))


@_query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query
def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_classes(table(spark, sf_dir, "documents"))


@_query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    both = F.array_sort(F.concat("base", "added"))
    counts = [secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind, *_ in secrets.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(both).alias("spans"),
        F.size(F.filter("told", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("told", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


@_query
def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(table(spark, sf_dir, "documents"))


@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op11_warc"] = """
with p as (select page_id, coalesce(html, '') as payload from pages),
hashed as (select *, sha1(payload) as hex, max(page_id) over (partition by payload) as last from p)
select page_id, strlen(payload) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)),
    'string_agg', '') as payload_digest,
  case when page_id is not distinct from last then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from last then last end as refers_to
from hashed
"""


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
with docs as (
  select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
flags as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end as fails
  from docs left join flags using (doc_id)),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select filter_order, cast(step as int) as step, substr(filter_order, step, 1) as f,
    substr(filter_order, 1, step - 1) as earlier from orders, generate_series(1, 5) as s(step)),
told as (
  select part, filter_order, step, f, n, good, toxic, fails,
    length(translate(earlier, fails, '')) = length(earlier) as reached, contains(fails, f) as fails_here
  from steps, cells),
counted as (
  select part, filter_order, step, any_value(f) as f,
    coalesce(sum(n) filter (reached and not fails_here), 0) as kept,
    coalesce(sum(n) filter (reached and fails_here), 0) as removed,
    coalesce(sum(n) filter (not reached and fails_here), 0) as redundant,
    coalesce(sum(n) filter (fails = f), 0) as unique_fails,
    coalesce(sum(good) filter (reached and fails_here), 0) as good_lost,
    coalesce(sum(toxic) filter (reached and fails_here), 0) as toxic_lost
  from told group by 1, 2, 3)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _lloyd_sql(rounds: int) -> str:
    """Every round as its own tables: entries c, nearest entries a."""
    nearest = """a{r} as materialized (
      select vec_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d
      from (select vec_id, part, entry, sum((x - y) * (x - y)) as d from comps join c{r} using (part, i) group by 1, 2, 3)
      group by 1, 2)"""
    moved = """c{n} as materialized (
      select part, entry, i, coalesce(z, y) as y
      from c{r} left join (
        select part, entry, i, floor(sum(x) / count(*))::bigint as z from comps join a{r} using (vec_id, part) group by 1, 2, 3)
      using (part, entry, i))"""
    tables = [nearest.format(r=0)]
    for r in range(rounds):
        tables += [moved.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return ",\n".join(tables)


ORACLES["op13_vector_codes"] = f"""
with vectors as (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comps as materialized (
  select vec_id, (place * 8) // n as part, place % (n // 8) as i, x
  from (select vec_id, len(q) as n, unnest(q) as x, generate_subscripts(q, 1) - 1 as place from vectors)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from vectors qualify entry < 16),
c0 as materialized (select part, entry, i, x as y from comps join first using (vec_id)),
{_lloyd_sql(6)},
coded as (
  select vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, sum(d)::bigint as error
  from a6 group by 1),
books as (select sha256(string_agg(y::varchar, ',' order by part, entry, i)) as codebooks_sha256 from c6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join vectors using (vec_id), books
"""
