"""Scoring on 16 criteria, ranking 1-7, quality metrics.

Every criterion is a boolean Column built from the rule set, so scoring is a projection:
no shuffle, no Python UDF, the same on a batch and on a stream.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark import rules
from specimen_spark.functions.text import count_distinct_null_as_value
from specimen_spark.operators.validate import validate_flags
from specimen_spark.schema import column_or_null
from specimen_spark.sources.dumps import with_images, with_images_if_needed

_MET = "_met_"
_BAD = "_unreadable"


# --- criteria ----------------------------------------------------------------------------
#
# A criterion is one SQL expression made from its rule. The text is parsed once by Spark;
# composing the same from Column calls costs hundreds of calls per query.


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}`" if name in df.columns else "cast(null as string)"


def _trimmed(field: str) -> str:
    return f"btrim(cast({field} as string), ' \\t\\r\\n')"


def _filled(field: str) -> str:
    return f"coalesce(upper({_trimmed(field)}) not in ('', 'NONE', 'NA'), false)"


def _matches(field: str, pattern: str) -> str:
    return f"coalesce({field} rlike {_quote('(?i)' + pattern)}, false)"


def _general(df: DataFrame, rule: dict) -> str:
    """Any field that is filled, hits no negative pattern and, if there is one, a positive one."""
    tests = []
    for name in rule["fields"]:
        field = _field(df, name)
        test = _filled(field)
        if rule.get("negative"):
            test += f" and not {_matches(field, rule['negative'])}"
        if rule.get("positive"):
            test += f" and {_matches(field, rule['positive'])}"
        tests.append(f"({test})")
    return " or ".join(tests)


def _type_specimen(df: DataFrame, rule: dict) -> str:
    voucher = _field(df, "voucher_type")
    return f"({_filled(voucher)} and {_matches(voucher, 'type')}) or {_general(df, rule)}"


# digits only: Java number literals such as 1d must not pass
_NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?$"


def _base_count(df: DataFrame) -> str:
    text = _trimmed(_field(df, "nuc_basecount"))
    return f"(case when {_matches(text, _NUMBER)} then try_cast({text} as double) end)"


def _seq_quality(df: DataFrame, rule: dict) -> str:
    long_enough = f"coalesce({_base_count(df)} >= {rule['min_length']}, false)"
    return f"{_filled(_field(df, 'bin_uri'))} and {long_enough}"


def _public_voucher(df: DataFrame, rule: dict) -> str:
    voucher = _trimmed(_field(df, "voucher_type"))
    positive = _matches(voucher, rule["positive"])
    negative = _matches(voucher, rule["negative"])
    return f"{_filled(voucher)} and ({positive} or not {negative})"


def _has_image(df: DataFrame, rule: dict) -> str:
    return f"coalesce(try_cast({_field(df, 'has_image')} as boolean), false)"


_SPECIAL = {
    "TYPE_SPECIMEN": _type_specimen,
    "SEQ_QUALITY": _seq_quality,
    "PUBLIC_VOUCHER": _public_voucher,
    "HAS_IMAGE": _has_image,
}


def _criterion_sql(df: DataFrame, name: str, scoring: dict) -> str:
    return _SPECIAL.get(name, _general)(df, scoring[name])


def criterion(df: DataFrame, name: str, scoring=None) -> Column:
    """The boolean Column of one criterion; a field the frame lacks counts as empty."""
    return F.expr(_criterion_sql(df, name, scoring or rules.SCORING))


def _unreadable_sql(df: DataFrame) -> str:
    filled = f"{_filled(_field(df, 'bin_uri'))} and {_filled(_field(df, 'nuc_basecount'))}"
    return f"{filled} and {_base_count(df)} is null"


def unreadable_base_count(df: DataFrame) -> Column:
    """A BIN and a filled base count that is no number: the whole record scores zero."""
    return F.expr(_unreadable_sql(df))


def criterion_flags(df: DataFrame, scoring=None) -> DataFrame:
    """One boolean column per criterion, named after it in lower case with a ``crit_`` prefix."""
    scoring = scoring or rules.SCORING
    return df.withColumns({f"crit_{n.lower()}": criterion(df, n, scoring) for n in scoring})


# --- score and rank ------------------------------------------------------------------------


def _with_met(df: DataFrame, scoring) -> DataFrame:
    """Evaluate every criterion once; score, list and rank then only read the booleans."""
    usable = df.withColumn(_BAD, unreadable_base_count(df))
    return usable.withColumns(
        {
            _MET + n: F.expr(f"not {_BAD} and ({_criterion_sql(df, n, scoring)})")
            for n in scoring
        }
    )


def _score_columns(scoring) -> dict:
    total = " + ".join(f"cast({_MET}{n} as int)" for n in scoring)
    listed = ", ".join(f"case when {_MET}{n} then '{n}' end" for n in scoring)
    return {
        "quality_score": F.expr(f"cast({total} as double)"),
        "criteria_met": F.expr(f"concat_ws('; ', {listed})"),
    }


def _rank_column(met, ranks) -> Column:
    """``met`` turns a criterion name into SQL."""
    def requirement(r):
        return met(r) if isinstance(r, str) else "(" + " or ".join(met(x) for x in r) + ")"

    cases = " ".join(
        f"when {' and '.join(requirement(r) for r in ranks[rank])} then {rank}"
        for rank in sorted(ranks)
    )
    return F.expr(f"cast(case {cases} else {rules.DEFAULT_RANK} end as int)")


def _drop_met(df: DataFrame) -> DataFrame:
    return df.drop(_BAD, *[c for c in df.columns if c.startswith(_MET)])


def score_specimens(df: DataFrame, scoring=None) -> DataFrame:
    """Adds ``quality_score`` (number of criteria met) and ``criteria_met``."""
    scoring = scoring or rules.SCORING
    return _drop_met(_with_met(df, scoring).withColumns(_score_columns(scoring)))


def rank_specimens(df: DataFrame, ranks=None) -> DataFrame:
    """Adds ``rank`` to a scored frame: the first rank whose requirements are all listed."""
    listed = "split(coalesce(criteria_met, ''), '; ')"
    return df.withColumn(
        "rank", _rank_column(lambda n: f"array_contains({listed}, '{n}')", ranks or rules.RANKS)
    )


def score_and_rank(df: DataFrame, scoring=None, ranks=None) -> DataFrame:
    """``score_specimens`` and ``rank_specimens`` in one projection over the booleans."""
    scoring = scoring or rules.SCORING
    return _drop_met(
        _with_met(df, scoring).withColumns(
            {
                **_score_columns(scoring),
                "rank": _rank_column(lambda n: _MET + n, ranks or rules.RANKS),
            }
        )
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    """Absent or null score -> 0, rank -> 7, criteria -> ''."""
    return df.withColumns(
        {
            "quality_score": F.coalesce(
                column_or_null(df, "quality_score").cast("double"), F.lit(0.0)
            ),
            "rank": F.coalesce(
                column_or_null(df, "rank").cast("int"), F.lit(rules.DEFAULT_RANK)
            ),
            "criteria_met": F.coalesce(column_or_null(df, "criteria_met"), F.lit("")),
        }
    )


def process_specimens(
    df: DataFrame, images: DataFrame | None = None, scoring=None, ranks=None,
    check_images: bool = False,
) -> DataFrame:
    """Validate, look images up, score, rank, fill defaults.

    Stays lazy: with ``images`` the image flag is joined in only when the column is absent;
    ``check_images`` also tests an existing column for nulls (an action). Without images a
    missing flag counts as false.
    """
    flagged = validate_flags(df)
    if images is not None and check_images:
        flagged = with_images_if_needed(flagged, images)
    elif images is not None and "has_image" not in df.columns:
        flagged = with_images(flagged, images)
    else:
        flagged = flagged.withColumn("has_image", F.expr(_has_image(flagged, {})))
    return fill_defaults(score_and_rank(flagged, scoring, ranks))


def already_processed(df: DataFrame) -> bool:
    """Score, rank and criteria columns exist: scoring may be skipped."""
    return all(c in df.columns for c in ("quality_score", "rank", "criteria_met"))


# --- checks and metrics --------------------------------------------------------------------


def check_scores(df: DataFrame, max_score: int = len(rules.SCORING)) -> DataFrame:
    """(missing_scores, invalid_scores, valid)."""
    score = F.col("quality_score")
    return df.agg(
        F.count_if(score.isNull()).alias("missing_scores"),
        F.count_if((score < 0) | (score > max_score)).alias("invalid_scores"),
    ).withColumn("valid", (F.col("missing_scores") == 0) & (F.col("invalid_scores") == 0))


def quality_metrics(df: DataFrame) -> DataFrame:
    """Total, mean and exact median score, species count (null counts as one value).

    Aggregated per (species, score) first, so the median works on weighted scores - of
    which there are 17 - and the distinct count on species, not on rows.
    """
    combos = df.groupBy("species", "quality_score").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("quality_score")
    return combos.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_specimens"),
        F.try_divide(F.sum(score * F.col("n")), F.sum(F.when(score.isNotNull(), F.col("n"))))
        .alias("avg_quality_score"),
        F.percentile("quality_score", 0.5, F.col("n")).alias("median_quality_score"),
        count_distinct_null_as_value("species").cast("long").alias("species_count"),
    )


def rank_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("rank").agg(F.count(F.lit(1)).alias("count"))


def criteria_coverage(df: DataFrame, scoring=None) -> DataFrame:
    """(criterion, count, avg_criteria_per_specimen), criteria met by nobody included."""
    scoring = scoring or rules.SCORING
    lists = df.groupBy("criteria_met").agg(F.count(F.lit(1)).alias("n"))
    listed = F.split(F.coalesce("criteria_met", F.lit("")), "; ")
    length = F.size(F.filter(listed, lambda x: x != ""))
    totals = lists.agg(
        *[
            F.coalesce(F.sum(F.when(F.array_contains(listed, n), F.col("n"))), F.lit(0)).alias(n)
            for n in scoring
        ],
        F.try_divide(F.sum(length * F.col("n")), F.sum("n")).alias("_avg"),
    )
    pairs = ", ".join(f"'{n}', `{n}`" for n in scoring)
    return totals.select(
        F.expr(f"stack({len(scoring)}, {pairs}) as (criterion, count)"),
        F.col("_avg").alias("avg_criteria_per_specimen"),
    )
