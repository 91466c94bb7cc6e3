"""Bronze queries: units, JSON records, seeds, scoped extracts, catalog."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.entries.registry import ORACLES, query
from gaugeworks.entries.twin import activity_cte
from gaugeworks.entries.warehouse import TABLES, Warehouse, load, measured
from gaugeworks.functions.clean import empty_to_null, to_double, to_int
from gaugeworks.functions.units import NANOMOLAR
from gaugeworks.plans import bronze
from gaugeworks.session import configure, spread
from gaugeworks.sources.catalog import describe_tables
from gaugeworks.sources.json_pages import RAW_RECORDS, filter_records
from gaugeworks.sources.lake import row_counts


@query(
    "unit_normalization",
    f"""with {activity_cte()}
       select activity_id, raw_value as standard_value, raw_unit as standard_units, nm as standard_value_nm, units_note,
         case when raw_value is null then trim(raw_unit) when trim(raw_unit) = '' then null
              when nm is not null then 'nM' else trim(raw_unit) end as unit_clean
       from unit_line""",
)
def unit_normalization(spark, sf_dir):
    return Warehouse(spark, sf_dir).measured_lines.select(
        "activity_id",
        "standard_value",
        "standard_units",
        "standard_value_nm",
        "units_note",
        NANOMOLAR.base_unit("standard_value", "standard_units").alias("unit_clean"),
    )


def _records(df, entity):
    """Parse a JSON text column as raw records, every leaf as text."""
    schema = T.StructType.fromDDL(RAW_RECORDS[entity])
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


@query(
    "json_activity_projection",
    f"""with {activity_cte()}
       select l_partkey as molecule_part, cast(l_orderkey as varchar) as assay_chembl_id,
         nullif(raw_type, '') as standard_type, raw_value as standard_value, nullif(raw_unit, '') as standard_units,
         raw_value * (case trim(raw_unit) when 'nM' then 1.0::double when 'uM' then 1e3::double when 'mM' then 1e6::double
           when 'pM' then 1e-3::double end) as standard_value_nm,
         case when raw_value is null then 'missing_standard_value'
              when nullif(raw_unit, '') is null then 'missing_standard_units'
              when trim(raw_unit) in ('nM', 'uM', 'mM', 'pM') then null
              else 'unconvertible_units:' || trim(raw_unit) end as units_note
       from unit_line""",
)
def json_activity_projection(spark, sf_dir):
    lines = Warehouse(spark, sf_dir).measured_lines
    as_text = F.to_json(
        F.struct(
            F.col("molecule_chembl_id").alias("activity_id"),
            F.col("l_orderkey").cast("string").alias("assay_chembl_id"),
            "standard_type",
            # half of the numbers as JSON strings, half as JSON numbers
            F.when(F.col("l_suppkey") % 2 == 0, F.col("standard_value").cast("string")).alias("text_value"),
            F.when(F.col("l_suppkey") % 2 == 1, F.col("standard_value")).alias("number_value"),
            "standard_units",
        )
    )
    renamed = F.regexp_replace(as_text, '"(text|number)_value"', '"standard_value"')
    projected = bronze.project_activities(_records(lines.select(renamed.alias("json")), "activity"))
    return projected.select(
        F.col("activity_id").alias("molecule_part"),
        "assay_chembl_id",
        "standard_type",
        "standard_value",
        "standard_units",
        "standard_value_nm",
        "units_note",
    )


@query(
    "json_molecule_projection",
    """select cast(p_partkey as varchar) as molecule_chembl_id, p_name as pref_name, p_type as canonical_smiles,
         case when p_size % 2 = 0 then p_retailprice else p_retailprice + 1 end as molecular_weight,
         cast(p_size as double) as alogp, p_size as hba, cast(null as int) as hbd,
         case when p_size % 3 = 0 then null else p_size end as ro5_violations
       from part""",
)
def json_molecule_projection(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    record = F.struct(
        F.col("p_partkey").cast("string").alias("molecule_chembl_id"),
        F.col("p_name").alias("pref_name"),
        F.struct(F.col("p_type").alias("canonical_smiles")).alias("molecule_structures"),
        F.struct(
            F.when(size % 2 == 0, price.cast("string")).alias("full_mwt"),
            (price + 1).cast("string").alias("mw_freebase"),
            size.alias("alogp"),
            size.cast("string").alias("hba"),
            F.concat(size.cast("string"), F.lit(".0")).alias("hbd"),
            F.when(size % 3 == 0, "").otherwise(size.cast("string")).alias("num_ro5_violations"),
        ).alias("molecule_properties"),
    )
    rows = load(spark, sf_dir, "part").select(F.to_json(record).alias("json"))
    return bronze.project_molecules(_records(rows, "molecule"))


@query(
    "json_assay_projection",
    """select cast(o_orderkey as varchar) as assay_chembl_id, o_orderstatus as assay_type,
         nullif(case when o_orderstatus = 'P' then '' else o_orderpriority end, '') as assay_description,
         cast(substr(o_orderpriority, 1, 1) as int) as confidence_score, cast(o_custkey as varchar) as target_chembl_id
       from orders""",
)
def json_assay_projection(spark, sf_dir):
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("assay_chembl_id"),
        F.col("o_orderstatus").alias("assay_type"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("description"),
        F.substring("o_orderpriority", 1, 1).alias("confidence_score"),
        F.col("o_custkey").cast("string").alias("target_chembl_id"),
    )
    rows = load(spark, sf_dir, "orders").select(F.to_json(record).alias("json"))
    return bronze.project_assays(_records(rows, "assay"))


@query(
    "json_document_projection",
    """select cast(c_custkey as varchar) as document_chembl_id, cast(c_custkey as int) as pubmed_id,
         c_mktsegment as journal, cast(null as int) as year
       from customer""",
)
def json_document_projection(spark, sf_dir):
    record = F.struct(
        F.col("c_custkey").cast("string").alias("document_chembl_id"),
        F.col("c_custkey").alias("pubmed_id"),
        F.col("c_mktsegment").alias("journal"),
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("year"),
    )
    rows = load(spark, sf_dir, "customer").select(F.to_json(record).alias("json"))
    return bronze.project_documents(_records(rows, "document"))


@query(
    "json_props_projection",
    """select event_id, nullif(case when event_type = 'error' then '' else event_type end, '') as event_type,
         try_cast(json_extract_string(props, '$.k') as int) as k_int,
         try_cast(json_extract_string(props, '$.k') as double) as k_double
       from events""",
)
def json_props_projection(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select(
        "event_id",
        empty_to_null(kind).alias("event_type"),
        to_int(k).alias("k_int"),
        to_double(k).alias("k_double"),
    )


@query(
    "record_filter_in",
    "select event_id, event_type, user_id from events where event_type in ('click', 'purchase')",
)
def record_filter_in(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return filter_records(events, {"event_type__in": "click, purchase", "limit": "20", "offset": "0"})


# ------------------------------------------------- the relational source tables

SOURCE_SQL = """
seeds as (select distinct n_name as target_chembl_id from nation join supplier on n_nationkey = s_nationkey
          where s_acctbal < 5000),
targets as (select n_nationkey as tid, n_name as chembl_id from nation),
assays as (select s_suppkey as assay_id, s_name as chembl_id, cast(s_suppkey % 10 as int) as confidence_score,
             s_nationkey as tid, s_suppkey as doc_id from supplier),
scope as (select a.*, t.chembl_id as target_chembl_id from assays a join targets t on a.tid = t.tid
          where t.chembl_id in (select target_chembl_id from seeds)),
docs as (select o_orderkey as doc_id, 'D' || o_orderkey as chembl_id, cast(o_custkey as int) as pubmed_id,
           o_orderpriority as journal, cast(year(o_orderdate) as int) as year from orders where o_orderstatus <> 'P')"""


class Source:
    """The source tables the extracts expect, taken from the benchmark tables."""

    def __init__(self, spark, sf_dir):
        def table(name):
            return load(spark, sf_dir, name)

        supplier, part, orders = table("supplier"), table("part"), table("orders")
        nation = table("nation")
        size = F.col("p_size")
        owners = supplier.filter("s_acctbal < 5000").select(F.col("s_nationkey").alias("n_nationkey"))
        self.seeds = nation.join(owners, "n_nationkey", "left_semi").select(
            F.col("n_name").alias("target_chembl_id")
        )
        self.targets = nation.select(
            F.col("n_nationkey").alias("tid"),
            F.col("n_name").alias("chembl_id"),
            F.col("n_name").alias("pref_name"),
            F.lit("organism").alias("organism"),
            F.lit("SINGLE PROTEIN").alias("target_type"),
        )
        self.assays = supplier.select(
            F.col("s_suppkey").alias("assay_id"),
            F.col("s_name").alias("chembl_id"),
            F.lit("B").alias("assay_type"),
            F.col("s_name").alias("description"),
            (F.col("s_suppkey") % 10).alias("confidence_score"),
            F.col("s_nationkey").alias("tid"),
            F.col("s_suppkey").alias("doc_id"),
        )
        self.molecules = part.select(
            F.col("p_partkey").alias("molregno"),
            F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("chembl_id"),
            F.col("p_name").alias("pref_name"),
        )
        self.structures = part.filter(size > 5).select(
            F.col("p_partkey").alias("molregno"), F.col("p_type").alias("canonical_smiles")
        )
        self.properties = part.filter(size < 45).select(
            F.col("p_partkey").alias("molregno"),
            F.when(size % 2 == 0, F.col("p_retailprice")).alias("full_mwt"),
            (F.col("p_retailprice") + 1).alias("mw_freebase"),
            F.lit(None).cast("double").alias("alogp"),
            size.alias("hba"),
            size.alias("hbd"),
            size.alias("num_ro5_violations"),
        )
        self.docs = orders.filter("o_orderstatus <> 'P'").select(
            F.col("o_orderkey").alias("doc_id"),
            F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("chembl_id"),
            F.col("o_custkey").alias("pubmed_id"),
            F.col("o_orderpriority").alias("journal"),
            F.year("o_orderdate").alias("year"),
        )
        configure(spark)
        keys = {"l_suppkey": "assay_id", "l_partkey": "molregno", "l_orderkey": "doc_id"}
        lines = spread(table("lineitem"), "l_orderkey")
        self.activities = lines.drop("l_shipdate").withColumnsRenamed(keys)

    @staticmethod
    def measured(lines):
        """Type, value and unit of line items; the source does not store them."""
        keys = {"assay_id": "l_suppkey", "molregno": "l_partkey", "doc_id": "l_orderkey"}
        ids = [f"{kind}_chembl_id" for kind in ("molecule", "target", "assay", "document")]
        comment = F.lit(None).cast("string").alias("activity_comment")
        return measured(lines.withColumnsRenamed(keys), *ids, comment)

    @property
    def scope(self):
        return bronze.scope_assays(self.assays, self.targets, self.seeds)


@query(
    "target_scope",
    f"""with {SOURCE_SQL} select chembl_id as target_chembl_id, chembl_id as target_name, 'organism' as organism,
         'SINGLE PROTEIN' as target_type
       from targets where chembl_id in (select target_chembl_id from seeds)""",
)
def target_scope(spark, sf_dir):
    source = Source(spark, sf_dir)
    return bronze.extract_targets(source.targets, source.seeds)


@query(
    "assay_scope",
    f"""with {SOURCE_SQL} select chembl_id as assay_chembl_id, 'B' as assay_type, chembl_id as assay_description,
         confidence_score, target_chembl_id from scope""",
)
def assay_scope(spark, sf_dir):
    return bronze.extract_assays(Source(spark, sf_dir).scope)


@query(
    "scope_semi_join",
    """select p_partkey as molecule_id, p_name as pref_name from part
       where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45)""",
)
def scope_semi_join(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("molecule_id"), F.col("p_name").alias("pref_name"))
    seen = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45")
    return bronze.only_seen(part, "molecule_id", seen, "l_partkey")


@query(
    "activity_extract",
    f"""with {SOURCE_SQL}, {activity_cte()}
       select a.activity_id, 'M' || p_partkey as molecule_chembl_id, s.target_chembl_id, s.chembl_id as assay_chembl_id,
         d.chembl_id as document_chembl_id, raw_type as standard_type, raw_relation as standard_relation,
         raw_value as standard_value, raw_unit as standard_units, nm as standard_value_nm, units_note,
         case when l_discount <> 0 then round(9 - log10(nm), 2) end as pchembl_value,
         cast(null as varchar) as activity_comment, raw_validity as data_validity_comment
       from unit_line a join scope s on l_suppkey = s.assay_id join part on l_partkey = p_partkey
       left join docs d on l_orderkey = d.doc_id""",
)
def activity_extract(spark, sf_dir):
    source = Source(spark, sf_dir)
    return bronze.extract_activities(
        source.activities, source.scope, source.molecules, source.docs, measured=source.measured
    )


@query(
    "molecule_scope",
    f"""with {SOURCE_SQL}
       select distinct 'M' || p_partkey as molecule_chembl_id, p_name as pref_name,
         case when p_size > 5 then p_type end as canonical_smiles,
         case when p_size < 45 then (case when p_size % 2 = 0 then p_retailprice else p_retailprice + 1 end) end
           as molecular_weight,
         cast(null as double) as alogp, case when p_size < 45 then p_size end as hba,
         case when p_size < 45 then p_size end as hbd, case when p_size < 45 then p_size end as ro5_violations
       from part where p_partkey in (select l_partkey from lineitem where l_suppkey in (select assay_id from scope))""",
)
def molecule_scope(spark, sf_dir):
    s = Source(spark, sf_dir)
    return bronze.extract_molecules(s.molecules, s.structures, s.properties, s.activities, s.scope)


@query(
    "document_scope_union",
    f"""with {SOURCE_SQL}
       select distinct chembl_id as document_chembl_id, pubmed_id, journal, year from docs where doc_id in (
         select doc_id from scope
         union select l_orderkey from lineitem where l_suppkey in (select assay_id from scope))""",
)
def document_scope_union(spark, sf_dir):
    source = Source(spark, sf_dir)
    return bronze.extract_documents(source.docs, source.activities, source.scope)


@query(
    "extracted_entities",
    f"""with {SOURCE_SQL}, in_scope as (select * from lineitem where l_suppkey in (select assay_id from scope))
       select 'target' as table_name, count(*) as row_count from targets where chembl_id in (select * from seeds)
       union all select 'assay', count(*) from scope
       union all select 'activity', count(*) from in_scope join part on l_partkey = p_partkey
       union all select 'molecule', count(*) from part where p_partkey in (select l_partkey from in_scope)
       union all select 'document', count(*) from docs where doc_id in (
         select doc_id from scope union select l_orderkey from in_scope)""",
)
def extracted_entities(spark, sf_dir):
    """Row counts of all five extracts over one shared scope."""
    return row_counts(_entities(Source(spark, sf_dir)))


def _entities(s: Source):
    return bronze.extract_entities(
        seeds=s.seeds,
        targets=s.targets,
        assays=s.assays,
        activities=s.activities,
        molecules=s.molecules,
        structures=s.structures,
        properties=s.properties,
        docs=s.docs,
        measured=s.measured,
    )


# Columns of each entity that are written alike as text by both engines.
_CHECKED = {
    "target": ("target_chembl_id", "target_name", "organism", "target_type"),
    "assay": ("assay_chembl_id", "assay_type", "assay_description", "confidence_score", "target_chembl_id"),
    "activity": (
        "activity_id",
        "molecule_chembl_id",
        "target_chembl_id",
        "assay_chembl_id",
        "document_chembl_id",
        "standard_type",
        "standard_relation",
        "standard_units",
        "units_note",
        "data_validity_comment",
    ),
    "molecule": ("molecule_chembl_id", "pref_name", "canonical_smiles", "hba", "hbd", "ro5_violations"),
    "document": ("document_chembl_id", "pubmed_id", "journal", "year"),
}


def _checksum_sql() -> str:
    bodies = {
        "target": ORACLES["target_scope"],
        "assay": ORACLES["assay_scope"],
        "activity": ORACLES["activity_extract"],
        "molecule": ORACLES["molecule_scope"],
        "document": ORACLES["document_scope_union"],
    }
    parts = []
    for name, columns in _CHECKED.items():
        text = " || '|' || ".join(f"coalesce(cast({c} as varchar), '~')" for c in columns)
        parts.append(
            f"""select '{name}' as table_name, count(*) as row_count,
              cast(sum(('0x' || substr(md5({text}), 1, 8))::bigint) as bigint) as checksum from ({bodies[name]})"""
        )
    return " union all ".join(parts)


@query("extracted_checksums", _checksum_sql())
def extracted_checksums(spark, sf_dir):
    """Rows and a checksum of the contents of all five extracts over one shared scope."""
    sums = []
    for name, df in _entities(Source(spark, sf_dir)).items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in _CHECKED[name]])
        lead = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        sums.append(
            df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(lead).alias("checksum")).select(
                F.lit(name).alias("table_name"), "row_count", "checksum"
            )
        )
    return functools.reduce(lambda a, b: a.unionByName(b), sums)


@query(
    "seed_enrichment",
    """with fetched as (
         select *, row_number() over (partition by s_nationkey order by
           nullif(case when s_suppkey % 2 = 0 then s_name else '' end, '') asc nulls last,
           case when s_suppkey % 3 = 0 then s_name end asc nulls last) as rn
         from supplier)
       select n_nationkey as target_chembl_id,
         coalesce(nullif(case when s_suppkey % 2 = 0 then s_name else '' end, ''), n_name) as target_name,
         coalesce(case when s_suppkey % 3 = 0 then s_name end, 'seed organism') as organism, 'seed type' as target_type
       from nation left join fetched on n_nationkey = s_nationkey and rn = 1""",
)
def seed_enrichment(spark, sf_dir):
    seeds = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("target_chembl_id"),
        F.col("n_name").alias("target_name"),
        F.lit("seed organism").alias("organism"),
        F.lit("seed type").alias("target_type"),
    )
    key = F.col("s_suppkey")
    fetched = load(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("target_chembl_id"),
        F.when(key % 2 == 0, F.col("s_name")).otherwise("").alias("pref_name"),
        F.when(key % 3 == 0, F.col("s_name")).alias("organism"),
        F.lit(None).cast("string").alias("target_type"),
    )
    return bronze.enrich_targets(seeds, fetched)


# ----------------------------------------------------------------------- catalog

COUNTS_SQL = " union all ".join(
    f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES
)


@query("row_counts", COUNTS_SQL)
def row_counts_entry(spark, sf_dir):
    return row_counts({t: load(spark, sf_dir, t) for t in TABLES})


@query(
    "describe_tables",
    f"""with counts as ({COUNTS_SQL}), cols as (
         select table_name, column_name, cast(ordinal_position as int) as ordinal, data_type,
           cast(count(*) over (partition by table_name) as int) as column_count
         from information_schema.columns)
       select table_name, column_name, ordinal,
         case when data_type like 'TIMESTAMP%' then 'timestamp_ntz' when data_type = 'BIGINT' then 'bigint'
              when data_type = 'INTEGER' then 'int' when data_type = 'DOUBLE' then 'double'
              when data_type = 'VARCHAR' then 'string' when data_type = 'FLOAT[]' then 'array<float>'
              else data_type end as data_type, column_count, row_count
       from counts join cols using (table_name)""",
)
def describe_tables_entry(spark, sf_dir):
    """Columns as the files have them, not as they are declared here."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return describe_tables(spark, tables).join(row_counts(tables), "table_name")


