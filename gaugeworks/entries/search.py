"""Search queries: tokens, evidence search, BM25, vectors, the knowledge corpus."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gaugeworks.entries.registry import ORACLES, query
from gaugeworks.entries.twin import CURATED, QUALITY, SIMILARITY, SUMMARY, twin
from gaugeworks.entries.warehouse import Warehouse, load
from gaugeworks.functions.text import FOLD_FROM, FOLD_TO, LIGATURES, matches_any
from gaugeworks.operators import cell_index, postings_index
from gaugeworks.operators.bitmap_search import (
    MUST,
    SHOULD,
    clause_of,
    keyword,
    search_batch,
    search_evidence_batch,
    union_of,
    write_bitmaps,
)
from gaugeworks.operators.bm25 import bm25_topk
from gaugeworks.operators.search import EVIDENCE_TEXT_FIELDS, bool_query, by_potency, postings, search_evidence, terms_aggregation
from gaugeworks.operators.vectors import (
    EMBEDDING_DIM,
    build_cells,
    hashed_embedding,
    knn_cells,
    knn_cosine,
)
from gaugeworks.plans import corpus, relationships, serving
from gaugeworks.session import materialize, scratch_path, spread


def fold_sql(column: str) -> str:
    out = f"translate(lower({column}), '{FOLD_FROM}', '{FOLD_TO}')"
    for letter, ascii_form in LIGATURES.items():
        out = f"replace({out}, '{letter}', '{ascii_form}')"
    return out


def tokens_sql(column: str) -> str:
    pattern = "[\\p{L}\\p{M}\\p{N}_]+(?:[.''’][\\p{L}\\p{M}\\p{N}_]+)*"
    return f"regexp_extract_all({fold_sql(column)}, '{pattern}')"


@query(
    "token_postings",
    f"""select field, term, doc_id, count(*) as tf from (
         select 'text' as field, doc_id, unnest({tokens_sql("text")}) as term from documents
         union all
         select 'source' as field, doc_id, unnest({tokens_sql("source")}) as term from documents)
       group by all""",
)
def token_postings(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return postings(docs, "doc_id", {"text": "text", "source": "source"})


EVIDENCE_COLUMNS = (
    "activity_id, compound_name, target_name, assay_description, standard_type, standard_value_nm, pchembl_value, "
    "confidence_score"
)


def any_token(column: str, words: str) -> str:
    return f"list_has_any({tokens_sql(column)}, {tokens_sql(repr(words))})"


@query(
    "evidence_search",
    twin(
        f"""select {EVIDENCE_COLUMNS} from curated
            where ({any_token("assay_description", "Urgent RING")} or {any_token("compound_name", "Urgent RING")}
                   or {any_token("target_name", "Urgent RING")})
              and standard_type = 'IC50' and standard_value_nm <= 50000000 and confidence_score >= 8
            order by pchembl_value desc, standard_value_nm asc, activity_id limit 500""",
        CURATED,
    ),
)
def evidence_search(spark, sf_dir):
    hits = search_evidence(
        Warehouse(spark, sf_dir).curated,
        query="Urgent RING",
        standard_type="IC50",
        max_value_nm=50_000_000,
        min_confidence=8,
        limit=500,
    )
    return hits.select(*EVIDENCE_COLUMNS.split(", "))


@query(
    "bool_must_filter_sort",
    twin(
        f"""select {EVIDENCE_COLUMNS} from curated
            where {any_token("assay_description", "high urgent")} and standard_type = 'Ki' and standard_value_nm < 1e9""",
        CURATED,
    ),
)
def bool_must_filter_sort(spark, sf_dir):
    wanted = bool_query(
        must=[matches_any("assay_description", "high urgent")],
        filters=[F.col("standard_type") == "Ki", F.col("standard_value_nm") < 1e9],
    )
    rows = Warehouse(spark, sf_dir).curated.filter(wanted)
    return rows.select(*EVIDENCE_COLUMNS.split(", ")).orderBy("standard_value_nm", "activity_id")


@query(
    "bool_should_minimum",
    twin(
        f"""select {EVIDENCE_COLUMNS} from curated
            where {any_token("assay_description", "medium")}
              and (case when {any_token("compound_name", "bolt anvil")} then 1 else 0 end
                   + case when {any_token("target_name", "NATION_3 nation_7")} then 1 else 0 end) >= 1""",
        CURATED,
    ),
)
def bool_should_minimum(spark, sf_dir):
    wanted = bool_query(
        must=[matches_any("assay_description", "medium")],
        should=[
            matches_any("compound_name", "bolt anvil"),
            matches_any("target_name", "NATION_3 nation_7"),
        ],
        minimum_should_match=1,
    )
    return Warehouse(spark, sf_dir).curated.filter(wanted).select(*EVIDENCE_COLUMNS.split(", "))


@query(
    "bool_match_filter_multisort",
    twin(
        f"""select {EVIDENCE_COLUMNS} from curated
            where {any_token("compound_name", "Gear")} and confidence_score >= 8 and pchembl_value > 2""",
        CURATED,
    ),
)
def bool_match_filter_multisort(spark, sf_dir):
    wanted = bool_query(
        filters=[
            matches_any("compound_name", "Gear"),
            F.col("confidence_score") >= 8,
            F.col("pchembl_value") > 2,
        ]
    )
    rows = Warehouse(spark, sf_dir).curated.filter(wanted).select(*EVIDENCE_COLUMNS.split(", "))
    return rows.orderBy(F.col("confidence_score").desc(), F.col("pchembl_value").desc())


EVIDENCE_KEYWORDS = ("target_chembl_id", "standard_type")

REQUESTS = """requests as (
  select s_suppkey as request, case s_suppkey % 4 when 0 then 'Urgent RING' when 2 then 'high bolt' when 3 then 'medium' end as query,
    case when s_suppkey % 2 = 0 then s_nationkey end as target_chembl_id,
    case when s_suppkey % 3 = 0 then n_name end as target_name,
    case s_suppkey % 5 when 0 then 'IC50' when 1 then 'Ki' end as standard_type,
    case when s_suppkey % 2 = 1 then 50000000 end as max_value_nm,
    case when s_suppkey % 3 = 1 then 8 end as min_confidence,
    1 + s_suppkey % 20 as hits
  from supplier left join nation on s_nationkey = n_nationkey)"""


def _evidence_bitmaps(spark, sf_dir):
    evidence = Warehouse(spark, sf_dir).curated.select("target_chembl_id", *EVIDENCE_COLUMNS.split(", "))
    return write_bitmaps(evidence, "activity_id", EVIDENCE_TEXT_FIELDS, EVIDENCE_KEYWORDS, scratch_path(spark, "bitmaps"), by_potency())


@query(
    "evidence_search_batch",
    twin(
        f"""select request, rank, {EVIDENCE_COLUMNS} from (
              select request, hits, {", ".join(f"e.{c}" for c in EVIDENCE_COLUMNS.split(", "))},
                cast(row_number() over (partition by request order by pchembl_value desc nulls last,
                  standard_value_nm asc nulls last, activity_id) as int) as rank
              from asked r join evidence e on
                (r.query is null or list_has_any(r.words, e.a) or list_has_any(r.words, e.c) or list_has_any(r.words, e.t))
                and (r.target_chembl_id is null or r.target_chembl_id = e.target_chembl_id)
                and (r.target_chembl_id is not null or r.target_name is null or list_has_any(r.names, e.t))
                and (r.standard_type is null or r.standard_type = e.standard_type)
                and (r.max_value_nm is null or e.standard_value_nm <= r.max_value_nm)
                and (r.min_confidence is null or e.confidence_score >= r.min_confidence))
            where rank <= hits""",
        CURATED,
        REQUESTS,
        f"asked as (select *, {tokens_sql('query')} as words, {tokens_sql('target_name')} as names from requests)",
        f"""evidence as (select *, {tokens_sql("assay_description")} as a, {tokens_sql("compound_name")} as c,
            {tokens_sql("target_name")} as t from curated)""",
    ),
)
def evidence_search_batch(spark, sf_dir):
    """One request per supplier, answered together from bitmaps."""
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = F.col("s_suppkey")
    words = F.when(s % 4 == 0, "Urgent RING").when(s % 4 == 2, "high bolt").when(s % 4 == 3, "medium")
    requests = load(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select(
        s.alias("request"),
        words.alias("query"),
        F.when(s % 2 == 0, F.col("s_nationkey")).alias("target_chembl_id"),
        F.when(s % 3 == 0, F.col("n_name")).alias("target_name"),
        F.when(s % 5 == 0, "IC50").when(s % 5 == 1, "Ki").alias("standard_type"),
        F.when(s % 2 == 1, F.lit(50_000_000)).alias("max_value_nm"),
        F.when(s % 3 == 1, F.lit(8)).alias("min_confidence"),
        (1 + s % 20).alias("hits"),
    )
    fields = {"query": EVIDENCE_TEXT_FIELDS, "target": ["target_name"]}
    hits = search_evidence_batch(_evidence_bitmaps(spark, sf_dir), requests, fields)
    return hits.select("request", "rank", *EVIDENCE_COLUMNS.split(", "))


@query(
    "bool_should_batch",
    twin(
        f"""select n_nationkey as request, {EVIDENCE_COLUMNS} from nation join curated on
              {any_token("assay_description", "medium low")}
              and (case when {any_token("compound_name", "bolt anvil")} then 1 else 0 end
                   + case when list_has_any({tokens_sql("target_name")}, {tokens_sql("n_name")}) then 1 else 0 end
                   + case when standard_type = 'Ki' then 1 else 0 end) >= 1 + n_nationkey % 3""",
        CURATED,
    ),
)
def bool_should_batch(spark, sf_dir):
    """Per nation: medium or low priority, and one, two or all three of name, nation and type."""
    nations = load(spark, sf_dir, "nation")
    requests = nations.select(
        F.col("n_nationkey").alias("request"),
        (1 + F.col("n_nationkey") % 3).alias("least_should"),
        "n_name",
        F.lit("medium low").alias("priority"),
        F.lit("bolt anvil").alias("compound"),
    )
    clauses = union_of(
        [
            clause_of(requests, 0, MUST, "priority", ["assay_description"]),
            clause_of(requests, 1, SHOULD, "compound", ["compound_name"]),
            clause_of(requests, 2, SHOULD, "n_name", ["target_name"]),
            keyword(requests, 3, SHOULD, F.lit("Ki"), "standard_type"),
        ]
    )
    asked = requests.select("request", "least_should")
    hits = search_batch(_evidence_bitmaps(spark, sf_dir), asked, clauses)
    return hits.select("request", *EVIDENCE_COLUMNS.split(", "))


@query(
    "terms_agg",
    twin(
        """select target_chembl_id, count(*) as doc_count from curated where target_chembl_id is not null group by 1""",
        CURATED,
    ),
)
def terms_agg(spark, sf_dir):
    return terms_aggregation(Warehouse(spark, sf_dir).curated, "target_chembl_id")


@query(
    "evidence_documents",
    twin(
        """select cast(activity_id as varchar) as doc_id, activity_id, molecule_chembl_id, compound_name, canonical_smiles,
             target_chembl_id, target_name, assay_chembl_id, assay_description, standard_type, standard_value_nm,
             pchembl_value, confidence_score, journal, year from curated""",
        CURATED,
    ),
)
def evidence_documents(spark, sf_dir):
    return serving.evidence_documents(Warehouse(spark, sf_dir).curated)


# ------------------------------------------------------------------------- BM25


def bm25_sql(docs: str, fields: dict[str, float], queries: str, k: int, id_type: str) -> str:
    """Ranking over CTEs ``docs`` (doc_id, fields) and ``queries`` (query_id, text)."""
    words = " union all ".join(
        f"select doc_id, '{f}' as field, {boost}::double as boost, {tokens_sql(f)} as words from {docs}"
        for f, boost in fields.items()
    )
    return f"""
words as (select * from ({words}) where len(words) > 0),
lengths as (select field, count(*) as n, sum(len(words))::double / count(*) as avgdl from words group by 1),
tf as (select doc_id, field, boost, len(words) as dl, term, count(*) as tf
       from (select *, unnest(words) as term from words) group by all),
df as (select field, term, count(*) as df from tf group by 1, 2),
wanted as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens_sql("text")}) as term
           from {queries}) group by 1, 2),
gains as (
  select query_id, doc_id, field, sum(boost * qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from wanted join tf using (term) join df using (field, term) join lengths using (field) group by 1, 2, 3),
best as (select query_id, doc_id, round(max(score), 6) as score from gains group by 1, 2),
ranked_docs as (
  select query_id, doc_id as item_id, score,
    cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank
  from best qualify rank <= {k})"""


@query(
    "bm25_topk",
    f"""with docs as (select doc_id, split_part(text, chr(10), 1) as title, text from documents),
       queries as (select item_id as query_id, text from benchmark),
       {bm25_sql("docs", {"title": 2.0, "text": 1.0}, "queries", 10, "bigint")}
       select query_id, item_id, rank, score from ranked_docs""",
)
def bm25_topk_entry(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), "text"
    )
    return bm25_topk(
        docs,
        "doc_id",
        {"title": "title", "text": "text"},
        load(spark, sf_dir, "benchmark"),
        "item_id",
        "text",
        10,
        {"title": 2.0, "text": 1.0},
    )


def _document_index(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", "lang"
    )
    fields = {"title": "title", "text": "text"}
    return postings_index.write_index(docs, "doc_id", fields, scratch_path(spark, "postings"), cluster="lang")


@query("bm25_indexed", ORACLES["bm25_topk"])
def bm25_indexed(spark, sf_dir):
    """The benchmark questions again, from a stored index; no text is read after it is built."""
    index = _document_index(spark, sf_dir)
    return postings_index.bm25_indexed(index, load(spark, sf_dir, "benchmark"), "item_id", "text", 10, {"title": 2.0, "text": 1.0})


@query(
    "related_documents",
    f"""with docs as (select doc_id, split_part(text, chr(10), 1) as title, text from documents),
       queries as (select doc_id as query_id, title as text from docs where doc_id % 20 = 0),
       {bm25_sql("docs", {"title": 2.0, "text": 1.0}, "queries", 10, "bigint")}
       select query_id, item_id, rank, score from ranked_docs""",
)
def related_documents(spark, sf_dir):
    """Documents like the first line of every twentieth document, itself included: as many queries as the table asks for."""
    asked = load(spark, sf_dir, "documents").filter("doc_id % 20 = 0")
    asked = asked.select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return postings_index.bm25_indexed(_document_index(spark, sf_dir), asked, "doc_id", "title", 10, {"title": 2.0, "text": 1.0})


# ---------------------------------------------------------------------- vectors

MOST_CELLS = 1024


def _label_queries(items):
    """One query per label: the mean vector of the label's items."""
    parts = items.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["x"]).alias("embedding")
    )


KNN_SQL = """with parts as (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim
                      from embeddings),
       means as (select label as query_id, dim, avg(x) as x from parts group by 1, 2),
       qnorm as (select query_id, sqrt(sum(x * x)) as n from means group by 1),
       vnorm as (select vec_id, sqrt(sum(x * x)) as n from parts group by 1),
       dots as (select query_id, vec_id, sum(p.x * m.x) as dot from parts p join means m using (dim) group by 1, 2),
       scored as (select query_id, vec_id as item_id, round(dot / (q.n * v.n), 6) as score
                  from dots join qnorm q using (query_id) join vnorm v using (vec_id))
       select query_id, item_id, score,
         cast(row_number() over (partition by query_id order by score desc, item_id) as int) as rank
       from scored qualify rank <= 20"""


@query("knn_cosine", KNN_SQL)
def knn_cosine_entry(spark, sf_dir):
    items = load(spark, sf_dir, "embeddings")
    return knn_cosine(items.withColumnRenamed("vec_id", "item_id"), _label_queries(items), 20)


@query("knn_cells", KNN_SQL)
def knn_cells_entry(spark, sf_dir):
    """The cell index with every cell probed, which must give the exact answer."""
    items = load(spark, sf_dir, "embeddings")
    index = build_cells(items.select(F.col("vec_id").alias("item_id"), "embedding"), cells=8)
    return knn_cells(index, _label_queries(items), 20, probes=8)


def _cell_index(spark, sf_dir):
    items = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    cells = math.ceil(math.sqrt(items.count())) or 1
    return cell_index.write_cells(items, min(cells, MOST_CELLS), scratch_path(spark, "cells"))


def _some_cells(index):
    return math.ceil(len(index.codec.centres) * 0.4)


@query("knn_indexed", KNN_SQL)
def knn_indexed(spark, sf_dir):
    """The label means again, from the stored index: four cells in ten, then what could still change the answer."""
    index = _cell_index(spark, sf_dir)
    probes = _some_cells(index)
    return cell_index.search(index, _label_queries(load(spark, sf_dir, "embeddings")), 20, probes, exact=True).hits


@query(
    "knn_every_twentieth",
    """with parts as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings),
       norms as (select vec_id, sqrt(sum(x * x)) as n from parts group by 1),
       dots as (select q.vec_id as query_id, p.vec_id as item_id, sum(q.x * p.x) as dot
                from parts q join parts p using (dim) where q.vec_id % 20 = 0 group by 1, 2),
       scored as (select query_id, item_id, round(dot / (a.n * b.n), 6) as score
                  from dots join norms a on a.vec_id = query_id join norms b on b.vec_id = item_id)
       select query_id, item_id, score,
         cast(row_number() over (partition by query_id order by score desc, item_id) as int) as rank
       from scored qualify rank <= 10""",
)
def knn_every_twentieth(spark, sf_dir):
    """The neighbours of every twentieth vector, itself included: as many queries as the table asks for."""
    index = _cell_index(spark, sf_dir)
    queries = load(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = _some_cells(index)
    return cell_index.search(index, queries, 10, probes, exact=True).hits


def buckets_sql(column: str) -> str:
    return (
        f"list_transform({tokens_sql(column)}, "
        f"lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % {EMBEDDING_DIM})"
    )


@query(
    "embed_documents",
    f"""with hits as (select doc_id, unnest({buckets_sql("text")}) as dim from documents),
       counts as (select doc_id, dim, count(*) as n from hits group by 1, 2),
       norms as (select doc_id, sqrt(sum(n * n)) as norm from counts group by 1)
       select doc_id, cast(dim as int) as dim, round(cast(n / norm as float)::double, 5) as weight from counts join norms using (doc_id)""",
)
def embed_documents(spark, sf_dir):
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    # the vector takes the text's place, so no text goes through Python
    vectors = hashed_embedding(docs.withColumnRenamed("text", "embedding"), F.col("embedding"))
    weights = vectors.select("doc_id", F.posexplode("embedding").alias("dim", "w"))
    return weights.filter("w > 0").select("doc_id", "dim", F.round(F.col("w").cast("double"), 5).alias("weight"))


# ------------------------------------------------------------- knowledge corpus


def _text_sql(column: str) -> str:
    return f"coalesce(cast({column} as varchar), 'None')"


GLOSSARY_SQL = " union all ".join(
    "select 'metric:{0}', 'metric_glossary', null, '{0}', 'Metric: {0}', '{0}: {1}'".format(
        term, definition.replace("'", "''")
    )
    for term, definition in corpus.PASSAGE_GLOSSARY.items()
)

PASSAGES_SQL = f"""
per_assay as (
  select *, row_number() over (partition by assay_chembl_id order by curated_measurements desc,
    total_measurements desc, cast(target_chembl_id as int) asc nulls last) as pick
  from quality where assay_description is not null),
top_assay as (
  select * from per_assay where pick = 1 order by curated_measurements desc, assay_chembl_id),
passages(doc_id, doc_type, target_chembl_id, entity_id, title, text) as (
  select 'target:' || target_chembl_id, 'target_summary', cast(target_chembl_id as varchar),
    cast(target_chembl_id as varchar), target_name || ' (' || target_chembl_id || ') activity summary',
    target_name || ' (' || organism || '): ' || total_measurements || ' measurements in total, ' || curated_measurements
    || ' of them curated and comparable, over ' || total_compounds_tested || ' tested compounds (' || active_compounds
    || ' active). Median curated potency ' || {_text_sql("round(median_potency_nm, 4)")} || ' nM, median pChEMBL '
    || {_text_sql("round(median_pchembl, 4)")} || ', best pChEMBL ' || {_text_sql("best_pchembl")} || '.'
  from summary
  union all
  select 'rel:' || target_a || ':' || target_b, 'target_relationship', null, target_a || '|' || target_b,
    'Relationship: ' || target_a_name || ' and ' || target_b_name,
    target_a_name || ' (' || target_a || ') and ' || target_b_name || ' (' || target_b || ') have ' || shared_compounds
    || ' curated compounds in common, Jaccard similarity ' || {_text_sql("jaccard")}
    || '; shared compounds hint at related chemistry and polypharmacology.'
  from similarity
  union all
  select 'assay:' || assay_chembl_id, 'assay', cast(target_chembl_id as varchar), cast(assay_chembl_id as varchar),
    'Assay ' || assay_chembl_id || ' (' || {_text_sql("target_name")} || ')',
    assay_description || ' Type ' || {_text_sql("assay_type")} || ', confidence ' || {_text_sql("confidence_score")}
    || '; ' || total_measurements || ' measurements of which ' || curated_measurements || ' curated.'
  from top_assay
  union all {GLOSSARY_SQL})"""

MARTS = (CURATED, SUMMARY, SIMILARITY, QUALITY)


def _passages(spark, sf_dir):
    w = Warehouse(spark, sf_dir, replicates=True)
    medians = {c: F.round(c, 4) for c in ("median_potency_nm", "median_pchembl")}
    similarity = relationships.target_similarity(w.curated_table, w.dims.target)
    return corpus.passages(w.summary.withColumns(medians), similarity, w.quality)


@query("knowledge_passages", twin("select * from passages", *MARTS, PASSAGES_SQL, replicates=True))
def knowledge_passages(spark, sf_dir):
    return _passages(spark, sf_dir)


def _questions(spark, sf_dir):
    """One question per nation."""
    name = F.col("n_name")
    return load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("query_id"),
        F.concat(F.lit("Which compounds are curated and potent against "), name, F.lit("?")).alias("text"),
    )


QUESTIONS_SQL = """questions as (
  select n_nationkey as query_id, 'Which compounds are curated and potent against ' || n_name || '?' as text from nation)"""


@query(
    "knowledge_search_keyword",
    twin(
        """select query_id, rank, 'keyword' as retrieval, p.doc_id, p.doc_type, p.title, p.text, round(score, 3) as score
           from ranked_docs join passages p on item_id = p.doc_id""",
        *MARTS,
        PASSAGES_SQL,
        QUESTIONS_SQL,
        bm25_sql("passages", {"title": 2.0, "text": 1.0}, "questions", 5, "varchar"),
        replicates=True,
    ),
)
def knowledge_search_keyword(spark, sf_dir):
    return corpus.search_passages(materialize(_passages(spark, sf_dir)), _questions(spark, sf_dir), mode="keyword")


def vector_sql(table: str, key: str, text: str, out: str) -> str:
    return f"""{out}_counts as (
         select {key}, dim, count(*) as n from (select {key}, unnest({buckets_sql(text)}) as dim from {table}) group by 1, 2),
       {out} as (select {key}, dim, cast(n / sqrt(sum(n * n) over (partition by {key})) as float)::double as w
                 from {out}_counts)"""


@query(
    "knowledge_search_semantic",
    twin(
        """select query_id, rank, 'semantic' as retrieval, p.doc_id, p.doc_type, p.title, p.text,
             round((1.0::double + score) / 2, 3) as score
           from (select query_id, doc_id, score,
                   cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank
                 from (select query_id, doc_id, round(sum(p.w * q.w) / (sqrt(any_value(p.nn)) * sqrt(any_value(q.nn))), 6)
                         as score
                       from (select *, sum(w * w) over (partition by doc_id) as nn from pvec) p
                       join (select *, sum(w * w) over (partition by query_id) as nn from qvec) q using (dim) group by 1, 2)
                 qualify rank <= 5)
           join passages p using (doc_id)""",
        *MARTS,
        PASSAGES_SQL,
        QUESTIONS_SQL,
        "typed as (select doc_id, title || '. ' || text as body from passages where doc_type = 'target_summary')",
        vector_sql("typed", "doc_id", "body", "pvec"),
        vector_sql("questions", "query_id", "text", "qvec"),
        replicates=True,
    ),
)
def knowledge_search_semantic(spark, sf_dir):
    vectors = materialize(corpus.embed_passages(_passages(spark, sf_dir)))
    asked = hashed_embedding(_questions(spark, sf_dir), F.col("text"))
    return corpus.search_passages(vectors, asked, doc_type="target_summary")
