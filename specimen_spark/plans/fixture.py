"""Specimens, geography, annotation edits, sessions and audit rows derived from the driver tables.

Each list holds (column, expression) pairs whose text is valid in Spark and in DuckDB, so
the check SQL reads the same rows. All rows of the source tables are used.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.functions.storage import identity, written_once

SPECIMEN_SOURCE = (
    "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation ON s_nationkey = n_nationkey"
)

# The rows of a part are spread over 1 + partkey % 16 species, which gives species of
# 1 to 30 records.
SLOT = [("slot", "cast(l_orderkey % (1 + l_partkey % 16) as int)")]
NAMES = [
    ("genus", "concat(upper(substr(p_type,1,1)), lower(substr(p_type,2)))"),
    (
        "epithet",
        "concat(translate(cast(l_partkey as string),'0123456789','abcdefghij'), "
        "case when slot = 0 then '' else substr('klmnopqrstuvwxyz', slot, 1) end, 'us')",
    ),
    ("tag", "case when slot = 0 then '' else substr('KLMNOPQRSTUVWXYZ', slot, 1) end"),
]
SPECIMEN = [
    ("processid", "concat('SP', lpad(cast(l_orderkey as string),8,'0'), '-', cast(l_linenumber as string))"),
    ("sampleid", "concat('SMP-', cast(l_orderkey as string))"),
    ("genus", "genus"),
    (
        "species",
        "case when l_linenumber=6 and l_partkey%2=0 then null "
        "when l_linenumber=6 then genus "
        "when l_linenumber=5 and l_partkey%11=0 then concat(genus,' cf. ',epithet) "
        "when l_linenumber=5 and l_partkey%11=1 then concat(genus,' sp. ',cast(l_partkey as string)) "
        "when l_linenumber=5 and l_partkey%11=2 then concat(genus,' nr ',epithet) "
        "when l_linenumber=5 and l_partkey%11=3 then concat(genus,' aff.',genus,' ',epithet) "
        "when l_linenumber=5 and l_partkey%11=4 then concat(genus,' aff. ',epithet) "
        "when l_linenumber=4 and l_partkey%13=0 then concat(' ',genus,' ',epithet,' ') "
        "when l_linenumber=7 and l_partkey%19=0 then '' "
        "else concat(genus,' ',epithet) end",
    ),
    (
        "identification",
        "case when l_linenumber=6 then genus when l_suppkey%29=0 then '' "
        "when l_suppkey%31=0 then null else concat(genus,' ',epithet) end",
    ),
    (
        "identification_rank",
        "case when l_linenumber=6 then 'genus' when l_partkey%23=5 and l_linenumber=3 then null "
        "when l_partkey%17=0 then 'subspecies' else 'species' end",
    ),
    (
        "bin_uri",
        "case when l_linenumber=7 and l_partkey%3=0 then '' "
        "when l_linenumber=7 and l_partkey%3=1 then null "
        "when l_partkey%10=7 then concat('BIN:',lpad(cast(l_partkey-1 as string),7,'0'),tag) "
        "when l_partkey%10=3 and l_suppkey%2=1 then concat('BIN:',lpad(cast(l_partkey+5000000 as string),7,'0'),tag) "
        "when l_linenumber=2 and l_partkey%5=0 then concat(' BIN:',lpad(cast(l_partkey as string),7,'0'),tag,' ') "
        "else concat('BIN:',lpad(cast(l_partkey as string),7,'0'),tag) end",
    ),
    ("family", "case when p_size%13=12 then null when p_size%13=11 then '' else concat('Family',cast(p_size%13 as string)) end"),
    ("order", "concat('Order',cast(p_size%4 as string))"),
    ("country_ocean", "case when l_suppkey%23=0 then '' when l_suppkey%19=0 then null when l_suppkey%11=0 then concat(' ',n_name) else n_name end"),
    ("nuc_basecount", "case when l_linenumber=3 and l_partkey%7=0 then 'n/a' when l_linenumber=4 and l_partkey%7=1 then '' else cast(400+cast(l_quantity as int)*5 as string) end"),
    (
        "nuc",
        "case when l_linenumber=2 then null when l_linenumber=5 then '' else "
        "translate(concat(cast(l_orderkey as string),cast(l_partkey as string),cast(l_suppkey as string)),'0123456789','ACGTACGTAC') end",
    ),
    ("voucher_type", "case l_linenumber when 1 then 'museum registered' when 2 then 'None' when 3 then 'DNA voucher' when 4 then case when l_partkey%29=0 then 'holotype' else 'herbarium sheet' end when 5 then 'pinned' else '' end"),
    ("identified_by", "case l_suppkey%5 when 0 then 'BOLD ID Engine' when 1 then 'Kate Perez' when 2 then '' else s_name end"),
    ("identification_method", "case l_suppkey%4 when 0 then 'morphology' when 1 then 'DNA barcoding' when 2 then 'NA' else 'dissection' end"),
    ("inst", "case l_suppkey%3 when 0 then 'Mined from GenBank' when 1 then s_name else '' end"),
    ("collectors", "case when l_returnflag='R' then '' else concat('Collector ',l_returnflag) end"),
    ("collection_date_start", "case when l_suppkey%37=0 then null else cast(cast(l_shipdate as date) as string) end"),
    ("collection_date_end", "case when l_returnflag='N' then cast(cast(l_shipdate as date) as string) else '' end"),
    ("coord", "case when l_linestatus='F' then '45.5,-73.5' else null end"),
    ("site", "case when l_discount>0.05 then 'Site' else '' end"),
    ("sector", "case when l_suppkey%7=0 then 'NA' when l_suppkey%7<4 then concat('Sector ',cast(l_suppkey%7 as string)) else null end"),
    ("region", "case when l_tax<0.03 then 'North' else null end"),
    ("museumid", "case when l_suppkey%6=0 then concat('MUS-',cast(l_suppkey as string)) else ' ' end"),
    ("taxonomy_notes", "case when l_partkey%31=0 then concat('Paratype of <i>',genus,'</i>') when l_partkey%37=0 then 'None' else null end"),
    ("short_note", "case when l_suppkey%41=0 then 'Cotype series' else '' end"),
    ("collection_notes", "case when l_tax>0.07 then 'light trap' else null end"),
    ("notes", "case when l_linenumber=1 and l_partkey%43=0 then 'HAPANTOTYPE' else '' end"),
    ("bold_recordset_code_arr", "concat('DS-',upper(replace(p_brand,'#','')),case when l_suppkey%4=0 then ',DS-SHARED' else '' end,',PRJ',cast(s_nationkey as string))"),
    ("has_image", "l_linenumber%2=0"),
    (
        "rec_key",
        "concat(lpad(cast(l_partkey as string),8,'0'),lpad(cast(l_suppkey as string),6,'0'),"
        "lpad(cast(cast(round(l_extendedprice*100) as bigint) as string),12,'0'))",
    ),
]

ANNOTATION_EVENT = [
    ("event_id", "event_id"),
    ("ts", "ts"),
    (
        "processid",
        "concat('SP',lpad(cast(user_id*100+event_id%10 as string),8,'0'),'-',cast(1+event_id%10%7 as string))",
    ),
    (
        "kind",
        "case event_type when 'error' then 'flag' when 'purchase' then 'updated_id' "
        "when 'signup' then 'curator_notes' else 'selected' end",
    ),
    (
        "value",
        "case event_type "
        "when 'click' then case when k%3=0 then '{\"selected\":\"true\"}' else 'true' end "
        "when 'view' then '' "
        "when 'error' then case k%7 when 0 then '' "
        "when 1 then concat('{\"flag\":\"misidentification\",\"user\":\"u',cast(user_id as string),'\"}') "
        "when 2 then '{\"value\":\"synonym\"}' when 3 then 'id_uncertain' "
        "when 4 then '{\"flag\":null,\"value\":\"data_issue\"}' "
        "when 5 then '{\"user\":\"nobody\"}' else 'bogus' end "
        "when 'purchase' then case k%4 when 0 then '' when 1 then concat('{\"text\":\"Genus e',cast(k as string),'\"}') "
        "when 2 then concat('{\"value\":\"Genus v',cast(k as string),'\"}') else concat('Genus b',cast(k as string)) end "
        "else case k%6 when 0 then '' when 1 then '{\"text\":\"Check voucher\"}' when 2 then '{\"note\":\"Possible hybrid\"}' "
        "when 3 then repeat('x',1001) when 4 then concat('{broken ',cast(k as string)) else 'see image' end end",
    ),
    ("user", "concat('user',cast(user_id as string),'@example.org')"),
]
EVENT_K = "cast(regexp_replace(props,'[^0-9]','{g}') as int)"

SESSION = [
    ("session_id", "concat('S',lpad(cast(c_custkey as string),9,'0'))"),
    ("created_at", "cast(cast(o_orderdate as date) as string)"),
    ("updated_at", "concat(cast(cast(o_orderdate as date) as string),'T',lpad(cast(o_orderkey%24 as string),2,'0'),':00:00')"),
    ("user_email", "concat(' ',replace(c_name,'#','.'),'@Example.org')"),
    ("user_name", "c_name"),
    ("user_orcid", "case when c_custkey%3=0 then '' else concat('0000-',lpad(cast(c_custkey as string),8,'0')) end"),
    ("specimen_count", "cast(floor(o_totalprice) as bigint)"),
    ("species_count", "cast(o_orderkey%97 as bigint)"),
    ("search_taxa", "o_orderpriority"),
    ("seq", "o_orderkey"),
]
AUDIT = [
    ("event_id", "o_orderkey"),
    ("timestamp", "cast(o_orderdate as timestamp)"),
    ("level", "case o_orderpriority when '1-URGENT' then 'ERROR' when '2-HIGH' then 'WARNING' when '3-MEDIUM' then 'INFO' else 'EXPORT' end"),
    ("message", "concat('Export ',cast(o_orderkey as string))"),
    ("session_id", "concat('S',lpad(cast(o_custkey as string),9,'0'))"),
    ("user_email", "concat('user',cast(o_custkey as string),'@example.org')"),
    ("export_type", "case o_orderstatus when 'F' then 'excel' when 'O' then 'tsv' else 'fasta' end"),
    ("file_name", "concat('export_',cast(o_orderkey as string))"),
    ("record_count", "cast(o_orderkey%1000 as bigint)"),
    ("file_size", "cast(floor(o_totalprice*64) as bigint)"),
    ("format", "case o_orderstatus when 'F' then 'xlsx' when 'O' then 'tsv' else 'fasta' end"),
    ("success", "o_orderkey%9<>0"),
]


_SCHEMAS = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its footers are read for the schema once, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    mark = identity(spark, path)
    if mark not in _SCHEMAS:
        _SCHEMAS[mark] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[mark]).parquet(path)


def _with(df: DataFrame, pairs) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in pairs})


def _select(df: DataFrame, pairs) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in pairs])


#: What a specimen is derived from. Tables and shuffles hold these columns in place of the wide text.
BASE = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate", "p_brand", "p_type", "p_size", "s_name", "s_nationkey", "n_name",
]


def lines_from(lineitem, part, supplier, nation, *more: str) -> DataFrame:
    """``BASE`` of the four source frames, and more columns of ``lineitem``, which may be a stream."""
    return (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select(*BASE, *more)
    )


def compact(lines: DataFrame, *columns: str) -> DataFrame:
    """Lines with some columns of their specimens."""
    named, texts = _with(_with(lines, SLOT), NAMES), dict(SPECIMEN)
    return named.select(*lines.columns, *[F.expr(texts[c]).alias(c) for c in columns])


def widen(lines: DataFrame) -> DataFrame:
    """Specimens of lines; columns that the frame already has stay as they are, further ones follow.

    Row-wise, so it goes after joins, windows and sorts: those then move lines only.
    """
    more = [c for c in lines.columns if c not in BASE]
    texts = dict(SPECIMEN)
    named = _with(_with(lines.withColumnsRenamed({c: "_" + c for c in more}), SLOT), NAMES)
    own = [F.col("_" + c).alias(c) if c in more else F.expr(text).alias(c) for c, text in SPECIMEN]
    return named.select(*own, *[F.col("_" + c).alias(c) for c in more if c not in texts])


def specimens_from(lineitem, part, supplier, nation) -> DataFrame:
    """Specimens from the four source frames; ``lineitem`` may be a stream."""
    return widen(lines_from(lineitem, part, supplier, nation))


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specimen universe: all lines of the driver tables."""
    return widen(lines(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the universe is derived from, joined and written once as a table."""
    return written_once(spark, "lines", source(spark, sf_dir), lambda: join_lines(spark, sf_dir))


def source(spark: SparkSession, sf_dir: str) -> str:
    """Names the state of the tables specimens are derived from."""
    tables = ("lineitem", "part", "supplier", "nation")
    return "\n".join(identity(spark, f"{sf_dir}/{t}.parquet") for t in tables)


def join_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None, *more: str) -> DataFrame:
    """Lines, by default all, meet their parts in a hash join at every size: they are dealt out once and never sorted."""
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    lineitem = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    return lines_from(lineitem, part.hint("shuffle_hash"), supplier, nation, *more)


def annotation_events_from(events: DataFrame) -> DataFrame:
    keyed = events.withColumn("k", F.expr(EVENT_K.replace("'{g}'", "''")))
    return _select(keyed, ANNOTATION_EVENT)


def annotation_events(spark, sf_dir) -> DataFrame:
    return annotation_events_from(table(spark, sf_dir, "events"))


def geography(spark, sf_dir) -> DataFrame:
    """(continent, country) of the driver tables."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("continent"), F.col("n_name").alias("country")
    )


def session_rows(spark, sf_dir) -> DataFrame:
    """One row per save of a session."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return _select(orders.join(customer, orders.o_custkey == customer.c_custkey), SESSION)


def audit_rows(spark, sf_dir) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), AUDIT)


# --- the same derivations as check SQL ---------------------------------------------------


def _sql_list(pairs) -> str:
    return ", ".join(f'{text} AS "{name}"' for name, text in pairs)


def prelude_sql() -> str:
    """WITH items for the derived inputs (DuckDB)."""
    k = EVENT_K.replace("'{g}'", "'', 'g'")
    return ",\n".join(
        [
            f"sp_slot AS (SELECT *, {_sql_list(SLOT)} FROM {SPECIMEN_SOURCE})",
            f"sp_named AS (SELECT *, {_sql_list(NAMES)} FROM sp_slot)",
            f"raw AS (SELECT {_sql_list(SPECIMEN)} FROM sp_named)",
            f"ev_k AS (SELECT *, {k} AS k FROM events)",
            f"edits AS (SELECT {_sql_list(ANNOTATION_EVENT)} FROM ev_k)",
            "geo AS (SELECT r_name AS continent, n_name AS country FROM nation "
            "JOIN region ON n_regionkey = r_regionkey)",
            f"saves AS (SELECT {_sql_list(SESSION)} FROM orders JOIN customer ON o_custkey = c_custkey)",
            f"audit AS (SELECT {_sql_list(AUDIT)} FROM orders)",
        ]
    )
