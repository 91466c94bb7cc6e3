"""The measurement warehouse bound to the benchmark tables.

Line items are measurements: part = compound, supplier nation = target, order (or,
in the replicate binding, supplier) = assay, customer = document. Keys keep
their native integer types. The id of a measurement is its content, so no numbering and no
shuffle is needed to make it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.plans import gold, relationships, silver
from gaugeworks.plans.bronze import with_base_value
from gaugeworks.session import configure, materialize, spread

# Declared, so that reading a table starts no job to look at its footer.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def line_id() -> Column:
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", *[F.col(c).cast("string") for c in parts], cents.cast("string"))


def raw_type() -> Column:
    flag, even = F.col("l_returnflag"), F.col("l_linenumber") % 2 == 0
    kind = F.col("l_suppkey") % 5
    return (
        F.when((flag == "A") & even, "IC50")
        .when(flag == "A", "Ki")
        .when((flag == "N") & even, "Kd")
        .when(flag == "N", "EC50")
        .when(kind == 0, " ")
        .when(kind == 1, "Inhibition")
        .otherwise("IC50")
    )


def raw_units() -> Column:
    line = F.col("l_linenumber")
    # looked up by place: a chain of conditions is repeated wherever the unit is used, and makes the scan's code too long
    first = F.array(*[F.lit(u) for u in (None, "nM", " uM ", "mM", "pM", "%", "")])
    last = F.when(F.col("l_suppkey") % 2 == 0, "nM")
    return F.when(line == 7, last).otherwise(F.get(first, line))


def raw_relation() -> Column:
    tax = F.col("l_tax")
    return (
        F.when(F.col("l_linestatus") != "O", "=").when(tax < 0.02, ">").when(tax < 0.03, "~")
    )


def priority_confidence(priority: str = "o_orderpriority") -> Column:
    first = F.substring(priority, 1, 1)
    return (
        F.when(first == "1", 9).when(first == "2", 8).when(first == "3", 7).when(first == "4", 5)
    )


def measured(lines: DataFrame, *keep: str | Column) -> DataFrame:
    """Id, type, value, unit and base value of line items, after the columns to ``keep``."""
    told = lines.select(
        *keep,
        line_id().alias("activity_id"),
        raw_type().alias("standard_type"),
        raw_relation().alias("standard_relation"),
        F.when(F.col("l_quantity") != 1, F.col("l_extendedprice")).alias("standard_value"),
        raw_units().alias("standard_units"),
        "l_discount",
        F.when(F.col("l_quantity") >= 48, "flag").alias("data_validity_comment"),
    )
    potency = F.round(9 - F.log10("standard_value_nm"), 2)
    return with_base_value(told).withColumn("pchembl_value", F.when(F.col("l_discount") != 0, potency))


def _activity_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "activity_id",
        "molecule_chembl_id",
        "target_chembl_id",
        "assay_chembl_id",
        "document_chembl_id",
        "standard_type",
        "standard_relation",
        "standard_value",
        "standard_units",
        "standard_value_nm",
        "units_note",
        "pchembl_value",
        F.lit(None).cast("string").alias("activity_comment"),
        "data_validity_comment",
    )


class Warehouse:
    """Bronze, silver and gold of one benchmark directory, each a lazy DataFrame.

    ``replicates=True`` takes the supplier as the assay, which gives many repeated
    measurements of the same compound, target, assay and type. ``shared=True`` writes the
    curated rows once for all marts that are made of their ids and values.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, replicates: bool = False, shared: bool = False):
        self.spark, self.sf_dir, self.replicates, self.shared = configure(spark), sf_dir, replicates, shared

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    # ---- bronze

    @cached_property
    def measured_lines(self) -> DataFrame:
        """Line items with type, value, unit and base value, before any join."""
        keys = ("l_orderkey", "l_suppkey", F.col("l_partkey").alias("molecule_chembl_id"))
        return measured(spread(self.table("lineitem"), "l_orderkey"), *keys)

    @cached_property
    def measurements(self) -> DataFrame:
        """Line items with compound, target and assay ids; no document yet."""
        nation = self.table("supplier").select(
            F.col("s_suppkey").alias("_supp"), F.col("s_nationkey").alias("target_chembl_id")
        )
        lines = self.measured_lines
        assay = "l_suppkey" if self.replicates else "l_orderkey"
        return lines.join(nation, lines["l_suppkey"] == nation["_supp"], "left").withColumn(
            "assay_chembl_id", F.col(assay)
        )

    @cached_property
    def activity(self) -> DataFrame:
        customer = self.table("orders").select(
            F.col("o_orderkey").alias("_order"), F.col("o_custkey").alias("document_chembl_id")
        )
        lines = self.measurements
        # on the assay id where it is the order, so that the join with the assays needs no further shuffle
        order = "l_orderkey" if self.replicates else "assay_chembl_id"
        return _activity_columns(lines.join(customer, lines[order] == customer["_order"], "left"))

    @cached_property
    def molecule(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("molecule_chembl_id"),
            F.col("p_name").alias("pref_name"),
            F.col("p_type").alias("canonical_smiles"),
            F.col("p_retailprice").alias("molecular_weight"),
            (F.col("p_retailprice") / 500).alias("alogp"),
            size.alias("hba"),
            (size % 5).cast("int").alias("hbd"),
            (size % 3).cast("int").alias("ro5_violations"),
        )

    @cached_property
    def target(self) -> DataFrame:
        region = self.table("region")
        return (
            self.table("nation")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                F.col("n_nationkey").alias("target_chembl_id"),
                F.col("n_name").alias("target_name"),
                F.col("r_name").alias("organism"),
                F.lit("SINGLE PROTEIN").alias("target_type"),
            )
        )

    @cached_property
    def assay(self) -> DataFrame:
        none = F.lit(None).cast("int").alias("target_chembl_id")
        if self.replicates:
            return self.table("supplier").select(
                F.col("s_suppkey").alias("assay_chembl_id"),
                F.lit("B").alias("assay_type"),
                F.concat(F.lit("Binding measured by "), F.col("s_name")).alias("assay_description"),
                (F.col("s_suppkey") % 10).cast("int").alias("confidence_score"),
                none,
            )
        return self.table("orders").select(
            F.col("o_orderkey").alias("assay_chembl_id"),
            F.col("o_orderstatus").alias("assay_type"),
            F.concat(F.lit("Assay run at priority "), F.col("o_orderpriority")).alias(
                "assay_description"
            ),
            priority_confidence().cast("int").alias("confidence_score"),
            none,
        )

    @cached_property
    def document(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("document_chembl_id"),
            F.col("c_custkey").try_cast("int").alias("pubmed_id"),
            F.col("c_mktsegment").alias("journal"),
            (F.lit(1990) + F.col("c_nationkey")).cast("int").alias("year"),
        )

    # ---- silver
    #
    # The benchmark tables have unique keys, so the dimensions come from them
    # directly; the staging of repeated keys is shown by its own queries.

    @cached_property
    def stg_activity(self) -> DataFrame:
        return silver.stage_activity(self.activity)

    @cached_property
    def stg_undocumented(self) -> DataFrame:
        """Staged measurements for the marts that do not look at documents."""
        none = F.lit(None).cast("bigint")
        return silver.stage_activity(
            _activity_columns(self.measurements.withColumn("document_chembl_id", none))
        )

    # ---- gold

    @cached_property
    def dims(self) -> gold.Dimensions:
        return gold.Dimensions(
            gold.dim_compound(self.molecule),
            gold.dim_target(self.target),
            gold.dim_assay(self.assay),
            gold.dim_document(self.document),
        )

    @cached_property
    def facts(self) -> DataFrame:
        return gold.fact(self.stg_activity, self.dims)

    @cached_property
    def graded(self) -> DataFrame:
        """Measurements with their assay's confidence: all the contract and counts need."""
        return gold.attach(self.stg_undocumented, self.dims, ("assay",))

    @cached_property
    def curated(self) -> DataFrame:
        return gold.curated_from_activity(self.stg_activity, self.dims)

    @cached_property
    def curated_ids(self) -> DataFrame:
        """Curated rows with ids and values only."""
        return gold.curated_rows(self.graded)

    @cached_property
    def curated_table(self) -> DataFrame:
        """Curated ids and values as a written table, for marts that read them more than once."""
        return materialize(
            self.curated_ids.select(
                "activity_id",
                "molecule_chembl_id",
                "target_chembl_id",
                "standard_value_nm",
                "pchembl_value",
            )
        )

    @property
    def curated_source(self) -> DataFrame:
        """What the marts of curated ids and values read."""
        return self.curated_table if self.shared else self.curated_ids

    @cached_property
    def curated_named(self) -> DataFrame:
        """Curated rows with compound and target names."""
        compound = self.dims.compound.select(
            "molecule_chembl_id", F.col("pref_name").alias("compound_name")
        )
        target = self.dims.target.select("target_chembl_id", "target_name")
        return self.curated_source.join(compound, "molecule_chembl_id", "left").join(
            target, "target_chembl_id", "left"
        )

    @cached_property
    def summary(self) -> DataFrame:
        return gold.target_activity_summary(
            self.stg_undocumented, self.curated_table, self.dims.target
        )

    @cached_property
    def profile(self) -> DataFrame:
        return gold.compound_profile(self.stg_undocumented, self.curated_source, self.dims.compound)

    @cached_property
    def quality(self) -> DataFrame:
        keyed = gold.attach(self.stg_undocumented, self.dims, ("assay", "target"))
        return gold.assay_quality(keyed, self.dims.assay, self.dims.target)

    @cached_property
    def dq(self) -> DataFrame:
        documents = self.stg_activity.select("document_chembl_id")
        return gold.data_quality_summary(self.graded, measurements=self.stg_undocumented, documents=documents)

    @cached_property
    def edges(self) -> DataFrame:
        return relationships.compound_target_edges(self.curated_named)

    @cached_property
    def similarity(self) -> DataFrame:
        return relationships.target_similarity(self.curated_source, self.dims.target)
