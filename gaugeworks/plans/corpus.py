"""The knowledge corpus: short passages built from the marts, embedded and searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.clean import number_text, value_text
from gaugeworks.operators.bm25 import PASSAGE_BOOSTS, bm25_topk
from gaugeworks.operators.dedup import keep_first
from gaugeworks.operators.postings_index import PostingsIndex, bm25_indexed, write_index
from gaugeworks.operators.search import asked_for
from gaugeworks.operators.vectors import EMBEDDING_DIM, hashed_embedding, knn_cosine

# Passage kinds, the default result size.
DOC_TYPES = ("target_summary", "assay", "target_relationship", "metric_glossary")
DEFAULT_PASSAGES = 5
PASSAGE_FIELDS = {"title": "title", "text": "text"}

PASSAGE_COLUMNS = ("doc_id", "doc_type", "target_chembl_id", "entity_id", "title", "text")

# The terms are fixed values; the wording is ours.
PASSAGE_GLOSSARY = {
    "IC50": "Concentration that halves a biological process; a lower value means more potent.",
    "Ki": "Equilibrium constant of inhibitor binding; a lower value means stronger binding.",
    "Kd": "Equilibrium dissociation constant; a lower value means tighter binding.",
    "EC50": "Concentration with half of the maximal effect; a lower value means more potent.",
    "pChEMBL": "Minus log10 of the molar activity; a higher value means more potent, 7 is 100 nM.",
    "confidence_score": "How directly an assay measures its target, 0 to 9; curation asks for 7.",
    "standard_relation": "Sign of the measured value; '=' or no sign is comparable, others are not.",
}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def target_passages(summary: DataFrame) -> DataFrame:
    name, target = value_text("target_name"), F.col("target_chembl_id")
    return summary.select(
        _text("target:", target).alias("doc_id"),
        F.lit("target_summary").alias("doc_type"),
        target.alias("target_chembl_id"),
        target.alias("entity_id"),
        _text(name, " (", target, ") activity summary").alias("title"),
        _text(
            name,
            " (",
            value_text("organism"),
            "): ",
            value_text("total_measurements"),
            " measurements in total, ",
            value_text("curated_measurements"),
            " of them curated and comparable, over ",
            value_text("total_compounds_tested"),
            " tested compounds (",
            value_text("active_compounds"),
            " active). Median curated potency ",
            number_text("median_potency_nm"),
            " nM, median pChEMBL ",
            number_text("median_pchembl"),
            ", best pChEMBL ",
            number_text("best_pchembl"),
            ".",
        ).alias("text"),
    )


def relationship_passages(similarity: DataFrame) -> DataFrame:
    a, b = F.col("target_a"), F.col("target_b")
    name_a, name_b = value_text("target_a_name"), value_text("target_b_name")
    return similarity.select(
        _text("rel:", a, ":", b).alias("doc_id"),
        F.lit("target_relationship").alias("doc_type"),
        F.lit(None).cast("string").alias("target_chembl_id"),
        _text(a, "|", b).alias("entity_id"),
        _text("Relationship: ", name_a, " and ", name_b).alias("title"),
        _text(
            name_a,
            " (",
            a,
            ") and ",
            name_b,
            " (",
            b,
            ") have ",
            value_text("shared_compounds"),
            " curated compounds in common, Jaccard similarity ",
            number_text("jaccard"),
            "; shared compounds hint at related chemistry and polypharmacology.",
        ).alias("text"),
    )


def assay_passages(quality: DataFrame, limit: int | None = None) -> DataFrame:
    """One passage per assay id: all assays, or the ``limit`` ones with most curated rows."""
    strongest = [
        F.col("curated_measurements").desc_nulls_last(),
        F.col("total_measurements").desc_nulls_last(),
        F.col("target_chembl_id").asc_nulls_last(),
    ]
    described = quality.filter(F.col("assay_description").isNotNull())
    chosen = keep_first(described, ["assay_chembl_id"], strongest)
    if limit is not None:
        most = [F.col("curated_measurements").desc_nulls_last(), F.col("assay_chembl_id").asc()]
        chosen = chosen.orderBy(*most).limit(limit)
    assay = F.col("assay_chembl_id")
    return chosen.select(
        _text("assay:", assay).alias("doc_id"),
        F.lit("assay").alias("doc_type"),
        "target_chembl_id",
        assay.alias("entity_id"),
        _text("Assay ", assay, " (", value_text("target_name"), ")").alias("title"),
        _text(
            F.col("assay_description"),
            " Type ",
            value_text("assay_type"),
            ", confidence ",
            value_text("confidence_score"),
            "; ",
            value_text("total_measurements"),
            " measurements of which ",
            value_text("curated_measurements"),
            " curated.",
        ).alias("text"),
    )


def glossary_passages(spark: SparkSession) -> DataFrame:
    rows = [
        (f"metric:{term}", "metric_glossary", None, term, f"Metric: {term}", f"{term}: {definition}")
        for term, definition in PASSAGE_GLOSSARY.items()
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PASSAGE_COLUMNS))


def passages(
    summary: DataFrame,
    similarity: DataFrame,
    quality: DataFrame,
    assay_limit: int | None = None,
) -> DataFrame:
    """All passages, one row per ``doc_id``."""
    text = "string"
    parts = [
        target_passages(summary),
        relationship_passages(similarity),
        assay_passages(quality, assay_limit),
        glossary_passages(summary.sparkSession),
    ]
    out = None
    for part in parts:
        same = part.select(*[F.col(c).cast(text).alias(c) for c in PASSAGE_COLUMNS])
        out = same if out is None else out.unionByName(same)
    return out


def passage_text() -> Column:
    return F.concat_ws(". ", "title", "text")


def embed_passages(corpus: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    return hashed_embedding(corpus, passage_text(), dim)


def index_passages(corpus: DataFrame, path: str) -> PostingsIndex:
    """A stored index of the passages' titles and texts."""
    return write_index(corpus, "doc_id", PASSAGE_FIELDS, path, cluster="doc_type")


def search_passages(
    corpus: DataFrame,
    queries: DataFrame,
    doc_type: str | None = None,
    limit: int | None = DEFAULT_PASSAGES,
    mode: str = "semantic",
    index: PostingsIndex | None = None,
) -> DataFrame:
    """Passages for a table of queries (query_id, text[, embedding]).

    With an ``index`` of the corpus, as ``index_passages`` writes it, lexical ranking reads no text.

    Semantic search is cosine over ``embedding`` and scores (1 + cosine) / 2; queries without a
    vector, or all of them in keyword mode, are ranked lexically. ``retrieval`` says which.
    """
    if doc_type and doc_type not in DOC_TYPES:
        raise ValueError(f"unknown doc_type {doc_type!r}; use one of {', '.join(sorted(DOC_TYPES))}")
    k = asked_for(limit, DEFAULT_PASSAGES)
    pool = corpus.filter(F.col("doc_type") == doc_type) if doc_type else corpus

    def lexical(asked: DataFrame, label: str) -> DataFrame:
        if index is not None:
            allowed = pool.select(F.col("doc_id").alias("item_id")) if doc_type else None
            hits = bm25_indexed(index, asked, "query_id", "text", k, PASSAGE_BOOSTS, matching=allowed)
        else:
            hits = bm25_topk(corpus, "doc_id", PASSAGE_FIELDS, asked, "query_id", "text", k, PASSAGE_BOOSTS, matching=pool)
        return hits.withColumn("retrieval", F.lit(label))

    if mode == "keyword":
        ranked = lexical(queries, "keyword")
    else:
        with_vector = "embedding" in queries.columns
        asked = queries if with_vector else queries.withColumn("embedding", F.lit(None).cast("array<float>"))
        nearest = knn_cosine(pool.withColumnRenamed("doc_id", "item_id"), asked, k)
        semantic = nearest.withColumn("score", (F.lit(1.0) + F.col("score")) / 2).withColumn(
            "retrieval", F.lit("semantic")
        )
        unembedded = asked.filter(F.col("embedding").isNull()).drop("embedding")
        ranked = semantic
        if not unembedded.isEmpty():
            ranked = ranked.unionByName(lexical(unembedded, "keyword_fallback"))
    found = corpus.select("doc_id", "doc_type", "title", "text")
    return ranked.join(found, ranked["item_id"] == found["doc_id"]).select(
        "query_id",
        "rank",
        "retrieval",
        "doc_id",
        "doc_type",
        "title",
        "text",
        F.round("score", 3).alias("score"),
    )
