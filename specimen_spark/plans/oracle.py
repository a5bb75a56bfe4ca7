"""Check SQL (DuckDB) for the registered queries.

The rules are written out here a second time, on purpose: text generated from the same
constants would agree with a wrong rule.
"""

from specimen_spark.plans import fixture as fx
from specimen_spark.plans.catalog import PART_NAMES, TAXON_LINE


def _trim(c):
    return f"trim({c}, chr(32)||chr(9)||chr(10)||chr(13))"


def _filled(c):
    return f"(coalesce(upper({_trim(c)}),'') NOT IN ('','NONE','NA'))"


def _has(c, pattern, flags=""):
    opt = f", '{flags}'" if flags else ""
    return f"coalesce(regexp_matches({c}, '{pattern}'{opt}), false)"


_TYPE_WORDS = ("holotype|lectotype|isotype|syntype|paratype|neotype|allotype|paralectotype|"
               "hapantotype|cotype")
_NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
_COUNT = f"CASE WHEN {_has(_trim('nuc_basecount'), _NUMBER)} THEN TRY_CAST({_trim('nuc_basecount')} AS DOUBLE) END"

_CRITERIA = {
    "species_id": _filled("species") + " AND NOT " + _has("species", r"sp\.|spp\.|[0-9]|^sp$|aff\.|cf\.| nr ", "i"),
    "type_specimen": f"({_filled('voucher_type')} AND {_has('voucher_type', 'type', 'i')}) OR "
    + " OR ".join(
        f"({_filled(c)} AND {_has(c, _TYPE_WORDS, 'i')})"
        for c in ("taxonomy_notes", "short_note", "collection_notes", "voucher_type", "notes")
    ),
    "seq_quality": f"{_filled('bin_uri')} AND {_filled('nuc_basecount')} AND coalesce(({_COUNT}) >= 500, false)",
    "public_voucher": _filled("voucher_type") + " AND ("
    + _has("voucher_type", "herb|museum|registered|type|national|CBG|INHS|deposit|harbarium|hebarium|holot", "i")
    + " OR NOT "
    + _has("voucher_type", "DNA|e-vouch|privat|no voucher|unvouchered|destr|lost|missing|no specimen|none|"
           "not vouchered|person|Photo Voucher Only|not registered", "i") + ")",
    "has_image": "coalesce(has_image, false)",
    "identifier": _filled("identified_by") + " AND NOT "
    + _has("identified_by", r"\bKate Perez\b|\bAngela Telfer\b|\bBOLD\b|\bBLAST\b|\bBIN\b|\bNone\b", "i"),
    "id_method": _filled("identification_method") + " AND NOT "
    + _has("identification_method", "barco|BOLD|mBRAVE|SINTAX|CO1|COI|COX|DNA|mole|phylo|sequ|tree|image|bin|"
           "silva|ncbi|ncbl|engine|blast|genbank|genetic|unspecified|its|^None$|^NA$|^$", "i"),
    "collectors": _filled("collectors"),
    "collection_date": f"{_filled('collection_date_start')} OR {_filled('collection_date_end')}",
    "country": _filled("country_ocean"),
    "site": _filled("site"),
    "sector": _filled("sector"),
    "region": _filled("region"),
    "coord": _filled("coord"),
    "institution": _filled("inst") + " AND NOT "
    + _has("inst", "genbank|no voucher|personal|private|research collection of|unknown|unvouchered", "i"),
    "museum_id": _filled("museumid"),
}
_NAMES = list(_CRITERIA)
_BAD = f"{_filled('bin_uri')} AND {_filled('nuc_basecount')} AND ({_COUNT}) IS NULL"


def _scoring(source, name):
    """CTEs: the criteria of a table, then score, list and rank."""
    met = ", ".join(f"(({sql}) AND NOT ({_BAD})) AS m_{n}" for n, sql in _CRITERIA.items())
    total = " + ".join(f"m_{n}::INT" for n in _NAMES)
    listed = ", ".join(f"CASE WHEN m_{n} THEN '{n.upper()}' END" for n in _NAMES)
    place = "(m_site OR m_sector OR m_region OR m_coord)"
    owner = "(m_institution OR m_public_voucher OR m_museum_id)"
    rank = (
        "CASE WHEN m_species_id AND m_type_specimen THEN 1 "
        "WHEN m_species_id AND m_seq_quality AND m_has_image AND m_collectors AND m_collection_date "
        f"AND m_country AND {place} AND m_identifier AND m_id_method AND {owner} THEN 2 "
        f"WHEN m_species_id AND m_seq_quality AND m_country AND m_identifier AND m_id_method AND {owner} THEN 3 "
        "WHEN m_species_id AND m_seq_quality AND m_country THEN 4 "
        "WHEN m_species_id AND m_seq_quality THEN 5 WHEN m_species_id THEN 6 ELSE 7 END"
    )
    drop = ", ".join(f"m_{n}" for n in _NAMES)
    return (
        f"{name}_met AS (SELECT *, {met} FROM {source}),\n"
        f"{name} AS (SELECT * EXCLUDE ({drop}), {_FLAGS}, ({total})::DOUBLE AS quality_score, "
        f"concat_ws('; ', {listed}) AS criteria_met, ({rank})::INT AS \"rank\" FROM {name}_met)"
    )


_FLAGS = (
    "(species IS NOT NULL AND species <> '' AND NOT "
    + _has("species", r"sp\.|spp\.|[0-9]|^sp$|aff\.|cf\.")
    + ") AS valid_species, (species IS NOT NULL AND species <> '') AS species_id, "
    "(bin_uri IS NOT NULL AND bin_uri <> '') AS valid_bin"
)
_CLEAN_SPECIES = (
    f"CASE WHEN {_trim('species')} <> '' AND NOT "
    + _has(_trim("species"), r"^sp\.|spp\.|[0-9]|^sp$|aff\.|cf\.") + f" THEN {_trim('species')} END"
)
_IS_LEVEL = (
    "(species IS NOT NULL AND species <> '' AND " + _has("species", r"^\S+\s+\S+")
    + " AND coalesce(identification_rank IN ('species','subspecies'), false))"
)
_RANKED = "coalesce(identification_rank IN ('species','subspecies'), false)"
_GRADE = (
    "CASE WHEN {n} IS NULL OR {b} IS NULL OR {n} < 0 OR {b} < 0 OR coalesce({s}, false) THEN 'E' "
    "WHEN {b} > 1 THEN 'C' WHEN {n} < 3 THEN 'D' WHEN {n} >= 11 THEN 'A' ELSE 'B' END"
)


def _is_object(c="value"):
    return f"(ltrim({c}) LIKE '{{%' AND json_valid({c}))"


def _extract(fields, c="value"):
    parts = ", ".join(f"json_extract_string({c}, '$.{f}')" for f in fields)
    return f"CASE WHEN {_is_object(c)} THEN coalesce({parts}, '') ELSE coalesce({c}, '') END"


_BY_KIND = (
    f"CASE kind WHEN 'selected' THEN {_extract(['selected', 'value'])} "
    f"WHEN 'flag' THEN {_extract(['flag', 'value'])} "
    f"WHEN 'updated_id' THEN {_extract(['text', 'value'])} "
    f"ELSE {_extract(['text', 'note', 'value'])} END"
)


def _prelude():
    key = "concat('SP', lpad(cast({o} as string),8,'0'), '-', cast({l} as string))"
    plain = ("concat(lower(p_type),' ',translate(cast(p_partkey as string),"
             "'0123456789','abcdefghij'),'us')")
    codes = "list_transform(string_split(bold_recordset_code_arr, ','), lambda x: trim(x))"
    ranks = "[family, genus, species, \"order\"]"
    return ",\n".join(
        [
            fx.prelude_sql(),
            "deduped AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY processid ORDER BY rec_key) = 1)",
            f"imported AS (SELECT * REPLACE ({_CLEAN_SPECIES} AS species, "
            f"nullif({_trim('bin_uri')},'') AS bin_uri, nullif({_trim('country_ocean')},'') AS country_ocean) FROM deduped)",
            _scoring("imported", "scored"),
            _scoring("deduped", "unclean"),
            # grades
            f"lvl AS (SELECT * FROM imported WHERE {_IS_LEVEL})",
            "shared AS (SELECT bin_uri, count(DISTINCT species) AS species_count, "
            "count(DISTINCT species) > 1 AS is_shared FROM lvl WHERE bin_uri <> '' GROUP BY 1)",
            "counted AS (SELECT l.species, count(*) AS specimen_count, "
            "count(DISTINCT nullif(l.bin_uri,'')) AS bin_count, coalesce(bool_or(s.is_shared), false) AS shared_bins "
            "FROM lvl l LEFT JOIN shared s ON l.bin_uri = s.bin_uri GROUP BY 1)",
            "grades AS (SELECT species, "
            + _GRADE.format(n="specimen_count", b="bin_count", s="shared_bins")
            + " AS bags_grade, specimen_count, bin_count, shared_bins FROM counted)",
            f"mem_sp AS (SELECT x.*, g.bags_grade FROM scored x JOIN grades g ON x.species = g.species WHERE x.bin_uri <> '' AND {_RANKED})",
            "mem_bins AS (SELECT DISTINCT bin_uri, bags_grade FROM mem_sp)",
            f"members AS (SELECT * FROM mem_sp UNION ALL SELECT x.*, b.bags_grade FROM scored x JOIN mem_bins b ON x.bin_uri = b.bin_uri WHERE NOT {_RANKED})",
            f"abd AS (SELECT *, {_IS_LEVEL} AS is_level FROM members WHERE bags_grade IN ('A','B','D'))",
            "abd_pairs AS (SELECT DISTINCT species AS group_species, bin_uri FROM abd WHERE is_level AND bin_uri <> '')",
            "g_abd AS (SELECT species AS group_key, processid, bags_grade, quality_score FROM abd WHERE is_level "
            "UNION ALL SELECT p.group_species, a.processid, a.bags_grade, a.quality_score FROM abd a JOIN abd_pairs p ON a.bin_uri = p.bin_uri WHERE NOT a.is_level)",
            f"gc AS (SELECT *, {_IS_LEVEL} AS is_level FROM members WHERE bags_grade = 'C')",
            "c_pairs AS (SELECT DISTINCT species AS group_species, bin_uri FROM gc WHERE is_level)",
            "g_c AS (SELECT species AS group_species, bin_uri AS group_bin, processid FROM gc WHERE is_level "
            "UNION ALL SELECT p.group_species, a.bin_uri, a.processid FROM gc a JOIN c_pairs p ON a.bin_uri = p.bin_uri WHERE NOT a.is_level)",
            f"ge AS (SELECT *, {_IS_LEVEL} AS is_level FROM members WHERE bags_grade = 'E')",
            "e_bins AS (SELECT bin_uri FROM ge WHERE is_level GROUP BY 1 HAVING count(DISTINCT species) > 1)",
            "g_e AS (SELECT * FROM ge WHERE bin_uri IN (SELECT bin_uri FROM e_bins))",
            # annotations
            f"flat AS (SELECT event_id, ts, processid, kind, {_BY_KIND} AS value, \"user\" FROM edits)",
            "last_edit AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY processid, kind ORDER BY ts DESC, event_id DESC) = 1)",
            "ann AS (SELECT processid, kind, value, \"user\", ts FROM last_edit WHERE CASE WHEN kind = 'selected' THEN lower(value) = 'true' ELSE value <> '' END)",
            "wide AS (SELECT processid, bool_or(kind = 'selected') AS selected, max(value) FILTER (kind = 'flag') AS flag, "
            "max(value) FILTER (kind = 'updated_id') AS updated_id, max(value) FILTER (kind = 'curator_notes') AS curator_notes, "
            "max(\"user\") FILTER (kind = 'flag') AS flag_user, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) FILTER (kind = 'flag') AS flag_timestamp FROM ann GROUP BY 1)",
            "merged AS (SELECT coalesce(w.selected, false) AS selected, coalesce(w.flag,'') AS flag, coalesce(w.updated_id,'') AS updated_id, "
            "coalesce(w.curator_notes,'') AS curator_notes, coalesce(w.flag_user,'') AS flag_user, coalesce(w.flag_timestamp,'') AS flag_timestamp, "
            "s.* FROM scored s LEFT JOIN wide w ON s.processid = w.processid)",
            "export AS (SELECT * REPLACE (regexp_replace(taxonomy_notes, '<[^>]+>', '', 'g') AS taxonomy_notes) FROM merged)",
            "touched AS (SELECT DISTINCT processid FROM ann WHERE kind IN ('flag','curator_notes','updated_id'))",
            "picked AS (SELECT DISTINCT processid FROM ann WHERE kind = 'selected')",
            # retrieval
            f"u_codes AS (SELECT *, {codes} AS codes FROM raw)",
            "by_ds AS (SELECT * EXCLUDE (codes) FROM u_codes WHERE list_contains(codes,'DS-BRAND7') OR list_contains(codes,'DS-SHARED'))",
            "prj AS (SELECT concat('PRJ', cast(n_nationkey as string)) AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA')",
            "by_pr AS (SELECT * EXCLUDE (codes) FROM u_codes WHERE list_has_any(codes, (SELECT list(code) FROM prj)))",
            f"wanted_names AS (SELECT {plain} AS name FROM part WHERE p_brand IN ('Brand#3','Brand#14') UNION SELECT concat('family', cast(p_size%13 as string)) FROM part WHERE p_size > 48 UNION SELECT concat('nomen absens ', p_name) FROM part)",
            "titled AS (SELECT concat(upper(substr(name,1,1)), substr(name,2)) AS name FROM wanted_names)",
            f"rank_names AS (SELECT DISTINCT processid, unnest({ranks}) AS name FROM raw)",
            "tax_ids AS (SELECT DISTINCT processid FROM rank_names WHERE name IN (SELECT name FROM titled))",
            "by_tx AS (SELECT * FROM raw WHERE processid IN (SELECT processid FROM tax_ids))",
            "imgs AS (SELECT DISTINCT " + key.format(o="l_orderkey", l="l_linenumber") + " AS processid FROM lineitem WHERE l_linestatus = 'F')",
            "src AS (SELECT 0 AS p, * FROM by_ds UNION ALL SELECT 1, * FROM by_pr UNION ALL SELECT 2, * FROM by_tx)",
            "src1 AS (SELECT * EXCLUDE (p) FROM src QUALIFY row_number() OVER (PARTITION BY processid ORDER BY p, rec_key) = 1)",
            "seed AS (SELECT * FROM src1 WHERE country_ocean IN (SELECT country FROM geo WHERE continent IN ('EUROPE','ASIA')))",
            "cur AS (SELECT * FROM by_ds WHERE country_ocean IN (SELECT country FROM geo WHERE continent = 'EUROPE'))",
            # taxon groups
            f"lines AS (SELECT p_partkey AS line_no, {TAXON_LINE} AS text FROM (SELECT *, {fx._sql_list(PART_NAMES)} FROM part))",
            "names AS (SELECT line_no, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS names FROM lines)",
            "tgroups AS (SELECT line_no AS group_id, array_to_string(names, ', ') AS label, unnest(range(len(names)))::INT AS pos, unnest(names) AS name FROM names WHERE len(names) > 0)",
            "by_name AS (SELECT lower(species) AS lname, min(species) AS matched, count(*) AS n FROM imported WHERE species IS NOT NULL GROUP BY 1)",
            "hit AS (SELECT t.group_id, t.pos, t.name, b.matched, b.n FROM tgroups t JOIN by_name b ON lower(t.name) = b.lname QUALIFY row_number() OVER (PARTITION BY t.group_id ORDER BY t.pos) = 1)",
            "gaps AS (SELECT t.group_id, t.label AS input_taxon, CASE WHEN h.n IS NULL THEN 'Missing' ELSE 'Found' END AS status, "
            "coalesce(h.matched,'') AS matched_species, coalesce(h.n,0) AS specimen_count, "
            "CASE WHEN h.name <> t.name THEN concat('Matched via synonym: ', h.name) ELSE '' END AS notes "
            "FROM tgroups t LEFT JOIN hit h ON t.group_id = h.group_id WHERE t.pos = 0)",
            # bins
            *_bins("raw", "cr"), *_bins("binned", "cb", "binned AS (SELECT * FROM imported WHERE bin_uri <> '')"),
            # sessions
            "listed AS (SELECT session_id, min(created_at) OVER (PARTITION BY session_id) AS created_at, updated_at, user_email, user_name, user_orcid, specimen_count, species_count "
            "FROM saves QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, seq DESC) = 1)",
        ]
    )


def _bins(source, p, *first):
    valid = "species <> '' AND NOT " + _has("species", r"sp\.|spp\.|cf\.|aff\.")
    aff = _has("species", r"cf\.|aff\.")
    return [
        *first,
        f"{p}_rows AS (SELECT * FROM {source} WHERE bin_uri <> '')",
        f"{p}_valid AS (SELECT bin_uri, count(DISTINCT species) AS nv, min(species) AS ref FROM {p}_rows WHERE {valid} GROUP BY 1)",
        # 'cf\.|aff\.S' as written: any cf. passes, aff. needs the name at once
        f"{p}_conf AS (SELECT DISTINCT r.bin_uri FROM {p}_rows r JOIN {p}_valid v ON r.bin_uri = v.bin_uri "
        f"WHERE v.nv = 1 AND {aff} AND NOT (contains(species, 'cf.') OR contains(species, 'aff.' || v.ref)))",
        f"{p}_up AS (SELECT bin_uri, count(DISTINCT nullif(genus,'')) AS ng, count(DISTINCT nullif(family,'')) AS nf, count(DISTINCT nullif(\"order\",'')) AS no FROM {p}_rows GROUP BY 1)",
        f"{p}_conc AS (SELECT u.bin_uri, CASE WHEN coalesce(v.nv,0) > 1 OR u.bin_uri IN (SELECT bin_uri FROM {p}_conf) OR ng > 1 "
        f"OR (ng = 0 AND nf > 1) OR (ng = 0 AND nf = 0 AND no > 1) THEN 'Discordant' ELSE 'Concordant' END AS concordance "
        f"FROM {p}_up u LEFT JOIN {p}_valid v ON u.bin_uri = v.bin_uri)",
        f"{p}_list AS (SELECT bin_uri, list_sort(list(DISTINCT species)) AS l FROM {p}_rows WHERE species <> '' AND NOT {_has('species', r'sp\.|spp\.')} GROUP BY 1)",
        f"{p}_geo AS (SELECT bin_uri, list_sort(list(DISTINCT country_ocean)) AS l FROM {p}_rows WHERE country_ocean IS NOT NULL GROUP BY 1)",
        f"{p}_content AS (SELECT r.bin_uri, count(*) AS total_records, coalesce(len(any_value(s.l)),0) AS unique_species, "
        f"coalesce(array_to_string(any_value(s.l),'; '),'') AS species_list, coalesce(array_to_string(any_value(g.l),'; '),'') AS countries, "
        f"any_value(c.concordance) AS concordance, count(*) / (SELECT count(*) FROM {source}) AS bin_coverage, "
        f"CASE WHEN any_value(c.concordance) = 'Concordant' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS concordant_bins "
        f"FROM {p}_rows r JOIN {p}_conc c ON r.bin_uri = c.bin_uri LEFT JOIN {p}_list s ON r.bin_uri = s.bin_uri LEFT JOIN {p}_geo g ON r.bin_uri = g.bin_uri GROUP BY 1)",
    ]


def _r2(x):
    """Two decimals, halves away from zero, on the decimal value."""
    return f"CAST(round(CAST({x} AS DECIMAL(18,10)), 2) AS DOUBLE)"


_SUMMARY_COUNTS = (
    "count(DISTINCT species) + coalesce(max(CASE WHEN species IS NULL THEN 1 ELSE 0 END), 0)"
)
_CHECKLIST = (
    "SELECT s.species, count(*) AS specimen_count, count(DISTINCT nullif(bin_uri,'')) AS bin_count, "
    "coalesce(array_to_string(list_sort(list(DISTINCT bin_uri) FILTER (bin_uri <> '')),'; '),'') AS bin_uris, "
    "coalesce(any_value(g.bags_grade),'') AS bags_grade, "
    "coalesce(array_to_string(list_sort(list(DISTINCT country_ocean) FILTER (country_ocean <> '')),'; '),'') AS countries, "
    + _r2("avg(quality_score)")
    + " AS mean_quality_score FROM scored s LEFT JOIN grades g ON s.species = g.species WHERE s.species IS NOT NULL GROUP BY 1"
)
_SOME = "CASE WHEN voucher_type <> '' THEN {} END"
_LISTED = "SELECT unnest(string_split(criteria_met,'; ')) AS c FROM scored WHERE criteria_met <> ''"
_CRIT_NAMES = "SELECT unnest([" + ", ".join(f"'{n.upper()}'" for n in _NAMES) + "]) AS criterion"
_E_INFO = (
    "SELECT bin_uri AS group_key, bin_uri AS group_bin, count(*) AS specimen_count, "
    "count(DISTINCT species) FILTER (is_level) AS species_count, "
    "array_to_string(list_sort(list(DISTINCT species) FILTER (is_level)), ', ') AS group_species FROM g_e GROUP BY 1"
)
_EDITS_PICKED = "SELECT i.species, e.processid, e.event_id, e.ts FROM edits e JOIN imported i ON e.processid = i.processid WHERE e.kind = 'selected' AND e.value <> '' AND i.species IS NOT NULL"
_AUDIT_RANGE = "timestamp >= DATE '1996-03-01' AND timestamp < DATE '1999-11-01'"
_FASTA_ROWS = "FROM imported WHERE nuc <> ''"
_FASTA_HEAD = "concat('>', processid, '|', CASE WHEN coalesce(identification,'') = '' THEN 'Unknown' ELSE identification END)"
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
_ANN = f"SELECT processid, kind, value, \"user\", {_TS} FROM ann"
_LABELS = {
    "misidentification": "Misidentification", "synonym": "Synonym", "id_uncertain": "ID Uncertain",
    "data_issue": "Data Issue", "other_issue": "Other Issue",
}


def _label():
    return "CASE value " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " ELSE value END"


def _tsv(c, kind="s"):
    if kind == "b":
        return f"coalesce(upper(cast({c} as varchar)),'NA') AS {c}"
    if kind == "n":
        return f"coalesce(cast({c} as varchar),'NA') AS {c}"
    return f"coalesce(translate({c}, chr(9)||chr(13)||chr(10), '   '),'NA') AS {c}"


def _tsv_annotated():
    names = (
        ["flag", "updated_id", "curator_notes", "flag_user", "flag_timestamp"]
        + [f'"{n}"' for n, _ in fx.SPECIMEN if n != "has_image"] + ["criteria_met"]
    )
    flags = ["selected", "has_image", "valid_species", "species_id", "valid_bin"]
    parts = [_tsv(n) for n in names] + [_tsv(n, "b") for n in flags]
    parts += [_tsv("quality_score", "n"), _tsv('"rank"', "n")]
    return f"SELECT {', '.join(parts)} FROM export WHERE processid IN (SELECT processid FROM touched)"


_TERM_MSG_TAXON = ("a taxon name may hold letters, digits, spaces, hyphens, underscores and periods only")
_TERM_MSG_DATASET = "a dataset code starts with DS-"
_TERM_MSG_PROJECT = ("a project code may hold letters, digits, hyphens and underscores only")
_TERM_LONG = "check this taxon name: it is long"
_TERMS = (
    "SELECT 'taxon' AS kind, concat(' ', p_name, case when p_size > 40 then '#' when p_size > 30 then repeat(' abcdefghij', 10) else '' end) AS term FROM part "
    "UNION ALL SELECT 'dataset', case when p_size > 25 then concat('DS-', upper(replace(p_brand,'#',''))) else p_brand end FROM part "
    "UNION ALL SELECT 'project', case when c_acctbal > 0 then concat(c_mktsegment,'-',cast(c_nationkey as string),'_x') else c_name end FROM customer "
    "UNION ALL SELECT 'country', case when n_nationkey > 20 then concat(n_name, '?') else n_name end FROM nation "
    "UNION ALL SELECT 'project', '  ' FROM part"
)
_TERM_CHECK = f"""
SELECT kind, term, bad IS NULL AS valid, concat_ws('; ', bad, warning) AS message FROM (
  SELECT kind, term,
    CASE WHEN kind = 'taxon' AND regexp_matches(term, '[^A-Za-z0-9\\s\\-_., ]') THEN '{_TERM_MSG_TAXON}'
         WHEN kind = 'dataset' AND NOT regexp_matches(term, '^DS-[A-Z0-9]+$') THEN '{_TERM_MSG_DATASET}'
         WHEN kind = 'project' AND regexp_matches(term, '[^A-Za-z0-9_-]') THEN '{_TERM_MSG_PROJECT}' END AS bad,
    CASE WHEN kind = 'taxon' AND length(term) > 100 THEN '{_TERM_LONG}'
         WHEN kind = 'country' AND term NOT IN (SELECT country FROM geo) THEN concat('unknown country: ', term) END AS warning
  FROM (SELECT kind, trim(term) AS term FROM ({_TERMS})) WHERE term <> '')
"""


def _processid(o, l):
    return f"concat('SP', lpad(cast({o} as string),8,'0'), '-', cast({l} as string))"


_SQL = {
    # sources
    "src_specimens": "SELECT * FROM raw",
    "src_by_dataset": "SELECT * FROM by_ds",
    "src_by_project": "SELECT * FROM by_pr",
    "src_by_taxon": "SELECT * FROM by_tx",
    "src_by_processid": f"SELECT * FROM raw WHERE processid IN (SELECT {_processid('o_orderkey', '1+o_custkey%7')} FROM orders WHERE o_orderstatus = 'P')",
    "src_bin_expand": "SELECT * FROM cur UNION ALL SELECT * FROM raw WHERE bin_uri <> '' AND bin_uri IN (SELECT bin_uri FROM cur WHERE bin_uri <> '') AND processid NOT IN (SELECT processid FROM cur)",
    "src_images": "SELECT processid, processid IN (SELECT processid FROM imgs) AS has_image FROM imported",
    "src_images_if_needed": "SELECT processid, processid IN (SELECT processid FROM imgs) AS has_image FROM imported",
    "src_taxa_list": "SELECT * FROM tgroups",
    "src_code_list": "SELECT DISTINCT code FROM (SELECT concat('DS-', upper(replace(p_brand,'#',''))) AS code FROM part UNION ALL SELECT trim(p_type) FROM part UNION ALL SELECT 'PRJ1' FROM part) WHERE code <> ''",
    "src_continents": "SELECT continent, country FROM geo",
    "src_annotations": f"SELECT processid, kind, {_BY_KIND} AS value, CASE WHEN {_is_object()} THEN coalesce(json_extract_string(value,'$.user'),'') ELSE '' END AS \"user\", "
    f"CASE WHEN {_is_object()} THEN coalesce(json_extract_string(value,'$.timestamp'),'') ELSE '' END AS ts FROM edits",
    # merge, clean, validate
    "merge_first_wins": "SELECT * FROM by_ds UNION ALL SELECT * FROM by_pr WHERE processid NOT IN (SELECT processid FROM by_ds)",
    "merge_sources": "SELECT * FROM src1",
    "retrieve_specimens": "SELECT *, 'BOLD' AS data_source FROM (SELECT * REPLACE (" + _CLEAN_SPECIES
    + f" AS species, nullif({_trim('bin_uri')},'') AS bin_uri, nullif({_trim('country_ocean')},'') AS country_ocean) FROM "
    "(SELECT * FROM seed UNION ALL SELECT * FROM raw WHERE bin_uri <> '' AND bin_uri IN (SELECT bin_uri FROM seed WHERE bin_uri <> '') AND processid NOT IN (SELECT processid FROM seed)) "
    "QUALIFY row_number() OVER (PARTITION BY processid ORDER BY rec_key) = 1)",
    "dedupe_processid": "SELECT * FROM deduped",
    "clean_species": f"SELECT processid, rec_key, {_CLEAN_SPECIES} AS species FROM raw",
    "clean_bin": f"SELECT processid, rec_key, nullif({_trim('bin_uri')},'') AS bin_uri FROM raw",
    "clean_country": f"SELECT processid, rec_key, nullif({_trim('country_ocean')},'') AS country_ocean FROM raw",
    "add_provenance": "SELECT processid, rec_key, 'BOLD' AS data_source FROM raw",
    "process_import": "SELECT *, 'BOLD' AS data_source FROM imported",
    "validate_flags": f"SELECT processid, rec_key, {_FLAGS} FROM raw",
    "validate_counts": f"SELECT count(*) AS total, count_if(valid_species) AS valid_species, count_if(species_id) AS species_id, count_if(valid_bin) AS valid_bin FROM (SELECT {_FLAGS} FROM raw)",
    "filter_bin_valid": "SELECT processid, rec_key, bin_uri FROM raw WHERE bin_uri <> ''",
    "filter_species_id": "SELECT processid, rec_key, species FROM raw WHERE species <> ''",
    "check_required": "SELECT count(bin_uri) > 0 AS valid, CASE WHEN count(*) = 0 THEN 'the table has no rows' WHEN count(bin_uri) = 0 THEN 'no row has a BIN' ELSE '' END AS message FROM imported",
    "check_results": "SELECT count(*) > 0 AND blank = 0 AS valid, CASE WHEN count(*) = 0 THEN 'nothing was retrieved' WHEN blank > 0 THEN concat(cast(blank as string), ' rows have no processid') ELSE '' END AS message "
    "FROM raw, (SELECT count_if(coalesce(voucher_type,'') = '') AS blank FROM raw) GROUP BY blank",
    "validate_search_terms": _TERM_CHECK,
    "geo_countries": "SELECT country FROM geo WHERE continent IN ('EUROPE','AFRICA') UNION SELECT 'NATION_3' UNION SELECT 'Atlantis'",
    "continents_of_countries": "SELECT DISTINCT continent FROM geo WHERE country IN (SELECT n_name FROM nation WHERE n_name < 'NATION_17')",
    "filter_geo": "SELECT * FROM raw WHERE country_ocean IN (SELECT country FROM geo WHERE continent IN ('EUROPE','ASIA'))",
    "geo_report": "SELECT count(*) AS records_before, count_if(k) AS records_after, count(*) - count_if(k) AS records_removed FROM (SELECT coalesce(country_ocean IN (SELECT country FROM geo WHERE continent IN ('EUROPE','ASIA')), false) AS k FROM raw)",
    "size_gate": "SELECT count(*) AS records, count(DISTINCT nullif(bin_uri,'')) AS bins, count(*) > 10000 OR count(DISTINCT nullif(bin_uri,'')) > 1000 AS over_limit FROM raw",
    "search_metrics": "SELECT count(*) AS total_records, count(DISTINCT species) AS unique_species, count(DISTINCT bin_uri) AS unique_bins, count(DISTINCT country_ocean) AS countries FROM imported",
    # scoring
    **{f"crit_{n}": f"SELECT processid, ({sql}) AS met FROM imported" for n, sql in _CRITERIA.items()},
    "score_specimens": "SELECT processid, quality_score, criteria_met FROM scored",
    "rank_specimens": 'SELECT processid, "rank" FROM scored',
    "check_scores": "SELECT count_if(s IS NULL) AS missing_scores, count_if(s < 0 OR s > 16) AS invalid_scores, count_if(s IS NULL) = 0 AND count_if(s < 0 OR s > 16) = 0 AS valid FROM (SELECT CASE \"rank\" WHEN 7 THEN NULL WHEN 1 THEN 17.0 ELSE quality_score END AS s FROM scored)",
    "fill_defaults": f"SELECT processid, coalesce({_SOME.format('quality_score')}, 0.0)::DOUBLE AS quality_score, coalesce({_SOME.format(chr(34) + 'rank' + chr(34))}, 7)::INT AS \"rank\", coalesce({_SOME.format('criteria_met')}, '') AS criteria_met FROM scored",
    "process_specimens": "SELECT * FROM scored",
    "quality_metrics": f"SELECT count(*) AS total_specimens, avg(quality_score) AS avg_quality_score, median(quality_score) AS median_quality_score, {_SUMMARY_COUNTS} AS species_count FROM scored",
    "rank_distribution": 'SELECT "rank", count(*) AS count FROM scored GROUP BY 1',
    "criteria_coverage": f"SELECT n.criterion, count(l.c) AS count, (SELECT count(*) FROM ({_LISTED})) / (SELECT count(*) FROM scored) AS avg_criteria_per_specimen FROM ({_CRIT_NAMES}) n LEFT JOIN ({_LISTED}) l ON n.criterion = l.c GROUP BY 1",
    # filters
    "filter_rank": 'SELECT * FROM scored WHERE "rank" = 3',
    "filter_min_score": "SELECT * FROM scored WHERE quality_score >= 9",
    "filter_criteria": "SELECT * FROM scored WHERE list_has_all(string_split(criteria_met,'; '), ['SPECIES_ID','COUNTRY','ID_METHOD'])",
    "filter_selected": "SELECT * FROM scored WHERE processid IN (SELECT processid FROM picked)",
    "filter_annotated": "SELECT * FROM scored WHERE processid IN (SELECT processid FROM touched)",
    "filtered_metrics": f"SELECT count(*) AS total_specimens, {_SUMMARY_COUNTS} AS unique_species, count(DISTINCT bin_uri) AS unique_bins, avg(quality_score) AS avg_quality, count_if(coalesce(bin_uri,'') <> '') * 100.0::DOUBLE / count(*) AS bin_coverage FROM unclean WHERE quality_score >= 5",
    "order_columns": "SELECT * FROM scored",
    # grades
    "species_level": "SELECT * FROM lvl",
    "shared_bins": "SELECT * FROM shared",
    "grade_rule": "SELECT l_partkey, l_returnflag, " + _GRADE.format(n="n", b="b", s="s")
    + " AS bags_grade FROM (SELECT l_partkey, l_returnflag, count(*) - 6 AS n, CASE WHEN max(l_linenumber) > 6 THEN NULL ELSE max(l_linenumber) - 4 END AS b, CASE WHEN min(l_quantity) > 20 THEN NULL ELSE min(l_quantity) < 3 END AS s FROM lineitem GROUP BY 1, 2)",
    "bags_grades": "SELECT * FROM grades",
    "check_grades": "SELECT m = '' AS valid, m AS message FROM (SELECT concat_ws('; ', CASE WHEN count_if(bags_grade = 'C') > 0 THEN 'a grade is not one of A to E' END, CASE WHEN count_if(bin_count < 1) > 0 THEN 'a BIN count is below 0' END) AS m FROM grades)",
    "grade_counts": "SELECT bags_grade, count(*) AS species FROM grades GROUP BY 1",
    "auto_select": "SELECT processid, species, quality_score, 'auto' AS \"user\", true AS selected, true AS auto_selected FROM scored WHERE bin_uri <> '' AND species <> '' "
    "QUALIFY row_number() OVER (PARTITION BY bin_uri, coalesce(nullif(country_ocean,''),'Unknown') ORDER BY quality_score DESC, processid) = 1",
    "representative_per_species": f"SELECT species, processid, event_id FROM ({_EDITS_PICKED}) QUALIFY row_number() OVER (PARTITION BY species ORDER BY ts DESC, event_id DESC) = 1",
    "grade_members": "SELECT * FROM members",
    "group_abd": "SELECT group_key, group_key AS group_species, processid, bags_grade FROM g_abd",
    "group_c": "SELECT concat(group_species,'_',group_bin) AS group_key, group_species, group_bin, processid FROM g_c",
    "group_e": "SELECT bin_uri AS group_key, bin_uri AS group_bin, processid FROM g_e",
    "group_order": "SELECT group_key, processid, quality_score, row_number() OVER (PARTITION BY group_key ORDER BY quality_score DESC, processid) AS pos FROM g_abd",
    "group_info": _E_INFO,
    "group_caption": f"SELECT group_key, concat('Shared BIN: ', group_bin, ' (', cast(species_count as string), ' species)') AS caption FROM ({_E_INFO}) "
    "UNION ALL SELECT DISTINCT concat(group_species,'_',group_bin), concat('Species: ', group_species, ' - BIN: ', group_bin) FROM g_c "
    "UNION ALL SELECT DISTINCT group_key, concat('Species: ', group_key, ' (>10 specimens, single BIN)') FROM g_abd WHERE bags_grade = 'A'",
    "grade_metrics": f"SELECT bags_grade, {_SUMMARY_COUNTS} AS total_species, count(*) AS total_specimens, avg(quality_score) AS avg_quality, "
    + _SUMMARY_COUNTS.replace("species", "country_ocean") + " AS countries FROM members GROUP BY 1",
    # BINs, species
    "bin_concordance": "SELECT * FROM cr_conc",
    "bin_content": "SELECT * FROM cr_content",
    "bin_summary": "SELECT count(*) AS total_bins, count_if(concordance = 'Concordant') AS concordant_bins, count_if(concordance = 'Discordant') AS discordant_bins, count_if(unique_species > 1) AS shared_bins FROM cb_content",
    "species_checklist": _CHECKLIST,
    "checklist_summary": f"SELECT count(*) AS total_species, count_if(bin_count > 0) AS species_with_bins, count_if(bin_count = 0) AS species_without_bins FROM ({_CHECKLIST})",
    "gap_analysis": "SELECT * FROM gaps",
    "gap_summary": "SELECT count_if(status = 'Found') AS found, count(*) AS total FROM gaps",
    "family_summary": "SELECT family, min(\"order\") AS \"order\", count(DISTINCT species) AS species_count, count(*) AS specimen_count, count(DISTINCT nullif(bin_uri,'')) AS bin_count, "
    + _r2("avg(quality_score)") + " AS mean_quality_score, count(DISTINCT country_ocean) AS countries FROM scored WHERE family IS NOT NULL GROUP BY 1",
    # annotations
    "annot_extract": f"SELECT event_id, {_extract(['flag', 'value'])} AS flag, {_extract(['text', 'note', 'value'])} AS note FROM edits",
    "annot_merge": "SELECT * EXCLUDE (flag_user, flag_timestamp) REPLACE (\"rank\"::DOUBLE AS \"rank\") FROM merged",
    "annot_merge_export": "SELECT * FROM export",
    "annot_fold": _ANN,
    "annot_validate": "SELECT processid, kind, 'unknown flag' AS problem FROM ann WHERE kind = 'flag' AND value NOT IN ('misidentification','synonym','id_uncertain','data_issue','other_issue') "
    "UNION ALL SELECT processid, kind, 'note is too long' FROM ann WHERE kind = 'curator_notes' AND length(value) > 1000 "
    "UNION ALL SELECT processid, kind, 'selected specimen is not in the table' FROM ann WHERE kind = 'selected' AND processid NOT IN (SELECT processid FROM imported)",
    "annot_flag_labels": f"SELECT processid, value AS flag, {_label()} AS label FROM ann WHERE kind = 'flag'",
    "annot_counts": "SELECT kind, count(*) AS specimens FROM ann GROUP BY 1",
    # sinks
    "out_csv": "SELECT processid, species, bin_uri, country_ocean, identified_by, quality_score, concat_ws('; ', genus, family) AS lineage FROM scored",
    "out_tsv_all": "SELECT processid, species, selected, flag, updated_id, curator_notes, flag_user, flag_timestamp, country_ocean, \"rank\" FROM export",
    "out_tsv_filtered": 'SELECT * FROM export WHERE "rank" = 4',
    "out_tsv_selected": "SELECT * FROM export WHERE processid IN (SELECT processid FROM picked)",
    "out_tsv_annotated": _tsv_annotated(),
    "out_curation_report": "SELECT sampleid, processid, identification, flag, updated_id, flag_user, curator_notes FROM export WHERE processid IN (SELECT processid FROM touched)",
    "out_export_columns": 'SELECT processid, species, genus, family, "order", bin_uri, identified_by, identification_method, collectors, collection_date_start, country_ocean, coord, inst AS institution, voucher_type, quality_score, criteria_met, nuc, selected, flag, updated_id, curator_notes FROM export',
    "out_fasta": f"SELECT value, count(*) AS lines FROM (SELECT {_FASTA_HEAD} AS value {_FASTA_ROWS} UNION ALL SELECT nuc {_FASTA_ROWS}) GROUP BY 1",
    "out_fasta_selected": f"SELECT concat({_FASTA_HEAD}, chr(10), nuc) AS record {_FASTA_ROWS} AND processid IN (SELECT processid FROM picked)",
    "out_fasta_full": f"SELECT concat('>', processid, '|', coalesce(species,'NA'), '|', coalesce(bin_uri,'NA'), '|', coalesce(country_ocean,'NA'), '|', coalesce(collection_date_start,'NA'), chr(10), nuc) AS record {_FASTA_ROWS}",
    "out_bundle": "SELECT \"table\", records, (sum(records) OVER ())::BIGINT AS total, content::BIGINT AS content FROM ("
    "SELECT 'Summary' AS \"table\", count(DISTINCT family) AS records, count_if(family IS NOT NULL) AS content FROM scored "
    "UNION ALL SELECT 'Specimens', count(*), sum(length(nuc)) FROM scored "
    "UNION ALL SELECT 'BIN_Content', count(*), sum(total_records) FROM cb_content "
    "UNION ALL SELECT 'BAGS_Summary', count(*), sum(specimen_count) FROM grades UNION ALL SELECT 'Quality_Summary', 1, count(*) FROM scored)",
    "out_export_log": f"SELECT 'EXPORT' AS level, 'Export completed: sequences.fasta' AS message, 'fasta' AS export_type, 'fasta' AS format, count(*) AS record_count, true AS success, NULL::VARCHAR AS error_message {_FASTA_ROWS} "
    "UNION ALL SELECT 'EXPORT', 'Export failed: grades.tsv', 'tsv', 'tsv', 0, false, 'no space'",
    # sessions, audit
    "sess_save": f"SELECT '2024-01-01T00:00:00' AS created_at, '2024-03-01T00:00:00' AS updated_at, 'a@example.org' AS user_email, 'A' AS user_name, '0000-1' AS user_orcid, count(*) AS specimen_count, {_SUMMARY_COUNTS} AS species_count, '[]' AS search_taxa, 'one' AS session_id FROM scored "
    "UNION ALL SELECT '2024-02-01T00:00:00', '2024-02-01T00:00:00', '', '', '', 0, 0, '', 'two'",
    "sess_load": "SELECT processid, species, bin_uri, quality_score FROM scored",
    "sess_list": "SELECT * FROM listed",
    "sess_filter_user": "SELECT * FROM listed WHERE lower(trim(user_email)) = 'customer.000000017@example.org' OR trim(user_orcid) = '0000-00000025' OR lower(trim(user_name)) = 'customer#000000041' "
    "OR session_id IN (md5('customer.000000017@example.org'), md5('0000-00000025'), md5('customer#000000041'))",
    "sess_expire": "SELECT * FROM listed WHERE updated_at >= '2001-05-31T12:00:00'",
    "audit_filter": "SELECT * REPLACE (strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp) FROM audit WHERE level = 'WARNING'",
    "audit_export_history": f"SELECT * REPLACE (strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp) FROM (SELECT * FROM audit WHERE {_AUDIT_RANGE} AND export_type = 'tsv' AND format = 'tsv' ORDER BY timestamp DESC, event_id DESC LIMIT 100)",
    "audit_export_stats": "SELECT count(*) AS total_exports, count_if(success) AS successful_exports, round(count_if(success) / count(*) * 100, 1) AS success_rate, sum(record_count)::BIGINT AS total_records_exported, round(sum(file_size) / count(*) / 1048576, 2) AS avg_size_mb "
    f"FROM audit WHERE {_AUDIT_RANGE}",
    # streams
    "stream_annot_fold": _ANN,
    "stream_snapshot": _ANN,
    "stream_score_images": "SELECT processid, rec_key, has_image, quality_score, criteria_met, \"rank\" FROM image_scored",
    "stream_score": "SELECT processid, rec_key, quality_score, criteria_met, \"rank\" FROM stream_scored",
}
for _name in ("src_by_dataset", "src_by_project", "src_by_taxon", "src_bin_expand"):
    _SQL[f"{_name}_stored"] = _SQL[_name]
_SQL["auto_select_if_empty"] = (
    f"SELECT 'none' AS branch, processid, \"user\" FROM ({_SQL['auto_select']}) "
    "UNION ALL SELECT 'some', processid, \"user\" FROM ann WHERE kind = 'selected'"
)


def oracle_sql() -> dict[str, str]:
    pictured = "(SELECT * REPLACE (processid IN (SELECT processid FROM imgs) AS has_image) FROM raw)"
    head = "WITH " + ",\n".join([_prelude(), _scoring("raw", "stream_scored"), _scoring(pictured, "image_scored")]) + "\n"
    return {name: _counts(head + sql) for name, sql in _SQL.items()}


def _counts(sql: str) -> str:
    """``count_if(x)`` -> ``count(CASE WHEN x THEN 1 END)``, which is a BIGINT."""
    while (start := sql.find("count_if(")) >= 0:
        end, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + len("count_if("):end - 1]
        sql = f"{sql[:start]}count(CASE WHEN {inner} THEN 1 END){sql[end:]}"
    return sql
