"""Relationship queries over the replicate binding of the curated mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.entries.registry import query
from gaugeworks.entries.twin import CURATED, EDGES, SIMILARITY, twin
from gaugeworks.entries.warehouse import Warehouse
from gaugeworks.operators.graph import group_sizes, memberships, shared_members, similar_groups
from gaugeworks.operators.graph import jaccard_similarity as set_similarity
from gaugeworks.plans import relationships


def _warehouse(spark, sf_dir):
    return Warehouse(spark, sf_dir, replicates=True)


def _pairs(spark, sf_dir):
    return memberships(_warehouse(spark, sf_dir).curated_ids, "molecule_chembl_id", "target_chembl_id")


@query("edge_mart", twin("select * from edges", CURATED, EDGES, replicates=True))
def edge_mart(spark, sf_dir):
    return _warehouse(spark, sf_dir).edges


@query(
    "set_sizes",
    twin(
        "select target_chembl_id as grp, count(distinct molecule_chembl_id) as n_members from curated group by 1",
        CURATED,
        replicates=True,
    ),
)
def set_sizes(spark, sf_dir):
    return group_sizes(_pairs(spark, sf_dir))


@query(
    "cooccurrence",
    twin(
        "select target_a as group_a, target_b as group_b, shared_compounds as shared from similarity",
        CURATED,
        SIMILARITY,
        replicates=True,
    ),
)
def cooccurrence(spark, sf_dir):
    return shared_members(_pairs(spark, sf_dir))


@query(
    "cooccurrence_split",
    twin(
        "select target_a as group_a, target_b as group_b, shared_compounds as shared from similarity",
        CURATED,
        SIMILARITY,
        replicates=True,
    ),
)
def cooccurrence_split(spark, sf_dir):
    """The same pairs with every member of more than two groups on the blocked route."""
    return shared_members(_pairs(spark, sf_dir), light_degree=2, heavy_block=2)


@query("jaccard_similarity", twin("select * from similarity", CURATED, SIMILARITY, replicates=True))
def jaccard_similarity(spark, sf_dir):
    return _warehouse(spark, sf_dir).similarity


@query(
    "neighbors",
    twin(
        """select target_a as target_chembl_id, target_b as neighbor_chembl_id, target_b_name as neighbor_name,
             shared_compounds, jaccard from similarity
           union all select target_b, target_a, target_a_name, shared_compounds, jaccard from similarity""",
        CURATED,
        SIMILARITY,
        replicates=True,
    ),
)
def neighbors(spark, sf_dir):
    return relationships.all_neighbors(_warehouse(spark, sf_dir).similarity)


@query(
    "member_targets",
    twin(
        """select molecule_chembl_id, target_chembl_id, best_pchembl, best_potency_nm, n_measurements,
             cast(row_number() over (partition by molecule_chembl_id order by best_pchembl desc nulls last,
               best_potency_nm asc nulls last, target_chembl_id) as int) as place
           from edges""",
        CURATED,
        EDGES,
        replicates=True,
    ),
)
def member_targets(spark, sf_dir):
    return relationships.ranked_targets(_warehouse(spark, sf_dir).edges)


@query(
    "promiscuous_topk",
    twin(
        """select molecule_chembl_id, compound_name, count(*) as targets_hit, round(max(best_pchembl), 2) as best_pchembl
           from edges group by 1, 2 having count(*) > 1
           order by targets_hit desc, best_pchembl desc, molecule_chembl_id limit 50""",
        CURATED,
        EDGES,
        replicates=True,
    ),
)
def promiscuous_topk(spark, sf_dir):
    return relationships.most_promiscuous(_warehouse(spark, sf_dir).edges)


@query(
    "pair_labels",
    twin(
        """select target_a_name || ' <-> ' || target_b_name as pair, shared_compounds, jaccard from similarity""",
        CURATED,
        SIMILARITY,
        replicates=True,
    ),
)
def pair_labels(spark, sf_dir):
    return relationships.labelled_pairs(_warehouse(spark, sf_dir).similarity)


@query(
    "similarity_matrix",
    twin(
        "select target_a_name, target_b_name, shared_compounds, jaccard from similarity",
        CURATED,
        SIMILARITY,
        replicates=True,
    ),
)
def similarity_matrix(spark, sf_dir):
    return relationships.similarity_matrix(_warehouse(spark, sf_dir).similarity)


_SUPPLIED = """with ct as (select distinct l_partkey, s_nationkey from lineitem join supplier on l_suppkey = s_suppkey),
       size as (select s_nationkey, count(*) as n from ct group by 1)
       select a.s_nationkey as group_a, b.s_nationkey as group_b, count(*) as shared,
         round(count(*)::double / (any_value(x.n) + any_value(y.n) - count(*)), 4) as jaccard
       from ct a join ct b on a.l_partkey = b.l_partkey and a.s_nationkey < b.s_nationkey
       join size x on a.s_nationkey = x.s_nationkey join size y on b.s_nationkey = y.s_nationkey
       group by 1, 2"""


def _supplied(spark, sf_dir):
    w = _warehouse(spark, sf_dir)
    nation = w.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return w.table("lineitem").select("l_partkey", "l_suppkey").join(nation, "l_suppkey")


@query("nation_part_similarity", _SUPPLIED)
def nation_part_similarity(spark, sf_dir):
    return set_similarity(_supplied(spark, sf_dir), "l_partkey", "s_nationkey")


SIMILAR = 0.5


@query(
    "similar_nations_sketched",
    f"{_SUPPLIED} having count(*)::double / (any_value(x.n) + any_value(y.n) - count(*)) >= {SIMILAR}",
)
def similar_nations_sketched(spark, sf_dir):
    """At this coefficient a pair is missed with probability 1e-6."""
    return similar_groups(_supplied(spark, sf_dir), "l_partkey", "s_nationkey", SIMILAR)
