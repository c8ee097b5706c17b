"""Rules that are specified for the directory beyond the basic matcher.

Precedence ranking, approval gate, scenario evaluation, freshness, broken links, coverage,
conformance, fallback rows, sensitive text and facets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schemas as S
from signpost import vocabulary as V
from signpost.functions import safety
from signpost.functions.text import blank, is_missing
from signpost.operators import matching as M
from signpost.operators.asof import as_of_join
from signpost.operators.ordering import top_per_key
from signpost.session import written

SAFETY_CATEGORY = "safety_urgent"


def approved(records: DataFrame, statuses: Sequence[str] = ("approved",)) -> DataFrame:
    """Only reviewed records may be recommended; apply ahead of ranking."""
    return records.where(F.col("review_status").isin(*statuses))


# -- precedence ranking ----------------------------------------------------------------------

PROFILE = ("_need", "_emergency", "_student_type", "_location")
FIT = ("_safety", "_for_type", "_at")
ANY = "\x00any"  # stands for every need, student type or place; no real value contains it


def _shortlists(exact: DataFrame, base: Sequence, limit: int) -> DataFrame:
    """Records a profile can possibly be shown, keyed by ``need_key, type_key, at_key``.

    A profile sees a record's student type as its own, open or other, and its place as its own or
    other; among records it sees alike, only the base order counts and ``limit`` of them suffice.
    ``exact`` holds the first ``limit`` per need, safety flag, type and place. "Any other place" is
    served by one list per type: the profile's own place can fill at most ``limit`` of it, so
    2 x ``limit`` entries always leave ``limit`` others. By the same count a list per place over other
    types (own and open type excluded) needs 3 x ``limit``, and the list over both needs
    2 + 2 + 3 + 1 = 8 x ``limit``. No list grows with the number of types or places.
    """
    group = ["_need", "_safety"]
    by_type = top_per_key(exact, [*group, "_for_type"], base, 2 * limit)
    by_place = top_per_key(exact, [*group, "_at"], base, 3 * limit)
    both = by_type.join(by_place.select("_need", "record_id"), ["_need", "record_id"], "left_semi")
    anywhere = top_per_key(both, group, base, 8 * limit)

    def keyed(df: DataFrame, type_key: Column, at_key: Column) -> DataFrame:
        return df.withColumns({"need_key": F.col("_need"), "type_key": type_key, "at_key": at_key}).drop("_need")

    own_type, own_place, wild = F.col("_for_type"), F.col("_at"), F.lit(ANY)
    return (
        keyed(exact, own_type, own_place)
        .unionByName(keyed(by_type, own_type, wild))
        .unionByName(keyed(by_place, wild, own_place))
        .unionByName(keyed(anywhere, wild, wild))
    )


def _probes(profiles: DataFrame) -> DataFrame:
    """The list keys of each profile; an emergency also looks at the safety records of any need."""
    needs = F.when(F.col("_emergency"), F.array(F.col("_need"), F.lit(ANY))).otherwise(F.array("_need"))
    types = F.array_distinct(F.array(F.col("_student_type"), F.lit(""), F.lit(ANY)))
    places = F.array(F.col("_location"), F.lit(ANY))
    return (
        profiles.withColumn("need_key", F.explode(needs))
        .withColumn("type_key", F.explode(types))
        .withColumn("at_key", F.explode(places))
    )


def rank_with_precedence(
    intakes: DataFrame,
    records: DataFrame,
    authority: DataFrame,
    limit: int = 3,
    safety_category: str = SAFETY_CATEGORY,
    high_risk: Sequence[str] = V.HIGH_RISK_CATEGORIES,
) -> DataFrame:
    """Ranking by urgency fit, match strength, authority, eligibility, place, recency, name, id.

    ``intakes(main_need, urgency_level, student_type, location, …)``;
    ``records(record_id, category_id, …, authority_level, student_type, location, last_verified_date)``;
    ``authority(authority_level, authority_rank)``, unlisted levels rank last. An emergency puts safety
    records first, whatever the need. Student type fits exactly, openly (record names none) or not;
    the place fits when equal.

    Ranked once per distinct profile, against short lists found by equality of need, type and place.
    ``records`` is read several times and should be a table.
    """
    keyed = intakes.withColumns({
        "_need": M.need_key("main_need"),
        "_emergency": safety.is_emergency("urgency_level"),
        "_student_type": blank("student_type"),
        "_location": blank("location"),
    })
    profiles = written(keyed.select(*PROFILE).distinct(), "profiles")
    graded = records.join(authority, "authority_level", "left").withColumns({
        "_authority": F.coalesce("authority_rank", F.lit(99)),
        "_safety": F.col("category_id") == safety_category,
        "_for_type": blank("student_type"),
        "_at": blank("location"),
    })
    narrow = M._searchable(graded, "record_id", ["_authority", "last_verified_date", *FIT])
    inner = ["_authority", F.col("last_verified_date").desc_nulls_last(), "service_name", "record_id"]
    base = [F.desc("score"), *inner]
    best = top_per_key(narrow, ["_category", *FIT], inner, limit)
    needs = profiles.groupBy("_need").agg(F.max("_emergency").alias("_any_emergency"))
    columns = ["_need", "record_id", "service_name", "_authority", "last_verified_date", *FIT, "score"]
    equal = written(M.equal_matches(needs, best).select(*columns), "equal")
    filled = equal.groupBy("_need").count().where(F.col("count") >= limit).select("_need")
    short = needs.join(filled.withColumn("_filled", F.lit(True)), "_need", "left").where(
        (F.col("_filled").isNull() | F.col("_any_emergency")) & (F.col("_need") != "")).select("_need")
    found = equal.unionByName(M.containment_matches(
        short, narrow, "record_id", inner, FIT, limit).select(*columns))
    # Safety records as candidates of any need. Where one also matches the need, the match's score counts.
    pool = narrow.where("_safety").withColumns({"_need": F.lit(ANY), "score": F.lit(0)}).select(*columns)
    exact = written(top_per_key(found.unionByName(pool), ["_need", *FIT], base, limit), "exact")
    seen = [c for c in columns if c not in ("_need", "score")]
    fit = (
        _probes(profiles).join(_shortlists(exact, base, limit), ["need_key", "type_key", "at_key"])
        .groupBy(*PROFILE, *seen).agg(F.max("score").alias("score"))
        .withColumns({
            "urgency_fit": F.when(F.col("_emergency") & ~F.col("_safety"), 1).otherwise(0),
            "eligibility_fit": F.when((F.col("_student_type") != "") & (F.col("_for_type") == F.col("_student_type")), 0)
            .when(F.col("_for_type") == "", 1).otherwise(2),
            "place_fit": F.when((F.col("_location") != "") & (F.col("_at") == F.col("_location")), 0).otherwise(1),
        })
    )
    order = [
        "urgency_fit", F.desc("score"), "_authority", "eligibility_fit", "place_fit", *inner[1:],
    ]
    ranked = top_per_key(fit, list(PROFILE), order, limit, rank="rank").select(
        *PROFILE, "record_id", "score", "urgency_fit", F.col("_authority").alias("authority_rank"),
        "eligibility_fit", "place_fit", "rank")
    kept = records.drop("student_type", "location")
    detail = kept.join(ranked, "record_id")
    return keyed.join(detail, list(PROFILE)).drop(*PROFILE).withColumns({
        "match_reason": safety.match_reason("main_need"),
        "limitation_required": safety.limitation_required("category_id", high_risk),
    })


def primary_and_backup(matches: DataFrame, key: str) -> DataFrame:
    """First and second recommendation per intake side by side."""
    def at(position: int, name: str) -> Column:
        return F.max(F.when(F.col("rank") == position, F.col(name)))

    return matches.where(F.col("rank") <= 2).groupBy(key).agg(
        at(1, "record_id").alias("primary_record_id"), at(1, "service_name").alias("primary_service"),
        at(2, "record_id").alias("backup_record_id"), at(2, "service_name").alias("backup_service"))


NO_MATCH_MESSAGE = "No reviewed service matches this need; please contact the responsible office."
UNSUPPORTED_MESSAGE = "This need is outside the directory; please contact the responsible office."


def with_fallback(intakes: DataFrame, matches: DataFrame, key: str, taxonomy: DataFrame, need: str = "main_need") -> DataFrame:
    """Every intake: its matches, or one fallback row that names no service.

    ``outcome`` is ``matched``, ``no_match`` (a supported need without a record) or ``unsupported``.
    """
    known = taxonomy.select(F.lower("category_id").alias("_need"), F.lit(True).alias("_known")).distinct()
    found = matches.select(key, "rank", "record_id", "service_name", "score")
    joined = intakes.join(found, key, "left").withColumn("_need", M.need_key(need)).join(known, "_need", "left")
    matched, supported = F.col("record_id").isNotNull(), F.col("_known").isNotNull()
    return joined.select(
        key, need, F.coalesce("rank", F.lit(0)).alias("rank"), "record_id", "service_name",
        F.coalesce("score", F.lit(0)).alias("score"),
        F.when(matched, "matched").when(supported, "no_match").otherwise("unsupported").alias("outcome"),
        F.when(matched, F.lit("")).when(supported, NO_MATCH_MESSAGE).otherwise(UNSUPPORTED_MESSAGE).alias("fallback"))


# -- evaluation ------------------------------------------------------------------------------


LABELS = ("expected_categories", "acceptable_services", "must_include_safety_note", "must_include_source_link")


def evaluate_scenarios(scenarios: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per scenario with the outcome of every check and whether it passes.

    ``scenarios(scenario_id, expected_categories array, acceptable_services array,
    must_include_safety_note, must_include_source_link)``; ``matches`` holds the top rows per
    ``scenario_id``. A hit is a row whose category and service are both labelled acceptable.
    """
    joined = scenarios.join(
        matches.select("scenario_id", "category_id", "service_name", "official_source_url", "limitation_required"),
        "scenario_id", "left")
    returned = F.col("service_name").isNotNull()
    hit = returned & F.array_contains("expected_categories", F.col("category_id")) & F.array_contains(
        "acceptable_services", F.col("service_name"))
    checked = joined.groupBy("scenario_id").agg(
        F.count_if(returned).alias("returned"),
        F.count_if(hit).alias("hits"),
        F.count_if(returned & is_missing("official_source_url")).alias("without_source"),
        F.count_if(returned & F.col("limitation_required")).alias("with_limitation"),
        F.first("must_include_safety_note").alias("_note"), F.first("must_include_source_link").alias("_link"),
    )
    top_hit = F.col("hits") > 0
    source_ok = ~F.col("_link") | (F.col("without_source") == 0)
    note_ok = ~F.col("_note") | (F.col("with_limitation") > 0)
    return checked.select(
        "scenario_id", "returned", "hits", top_hit.alias("top_hit"), source_ok.alias("source_ok"),
        note_ok.alias("safety_ok"), (top_hit & source_ok & note_ok).alias("passed"))


def scenario_cases(scenarios: DataFrame, need: str = "main_need") -> DataFrame:
    """Scenarios that ask for and expect the same are one case: its least ``scenario_id`` and its number of ``scenarios``.

    A case is ranked and evaluated like a scenario; the sums are made before the shuffle, which follows the cases.
    """
    return scenarios.groupBy(need, *LABELS).agg(F.min("scenario_id").alias("scenario_id"), F.count("*").alias("scenarios"))


def results_of_cases(scenarios: DataFrame, cases: DataFrame, results: DataFrame, need: str = "main_need") -> DataFrame:
    """Every scenario with the result of its case, as of :func:`evaluate_scenarios`."""
    found = cases.drop("scenarios").join(results, "scenario_id").drop("scenario_id")
    alike = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (need, *LABELS)]
    return scenarios.alias("s").join(found.alias("c"), alike).select(
        "s.scenario_id", *(f"c.{c}" for c in results.columns if c != "scenario_id"))


def evaluation_by(results: DataFrame, key: str, target: float = 0.9, scenarios: str | None = None) -> DataFrame:
    """Scenarios, passes and failures per value of ``key``, and whether the hit rate meets the target.

    A row stands for one scenario, or for as many as its column ``scenarios`` says.
    """
    n = F.col(scenarios) if scenarios else F.lit(1)

    def those(test: Column | str) -> Column:
        return F.sum(F.when(test, n).otherwise(0))

    return results.groupBy(key).agg(
        F.sum(n).alias("scenarios"), those(F.col("passed")).alias("passed"), those(~F.col("passed")).alias("failed"),
        (those(F.col("top_hit")) >= F.lit(target) * F.sum(n)).alias("meets_target"))


# -- maintenance -----------------------------------------------------------------------------


def stale_records(records: DataFrame, run_date: Column, max_days: int, key: str = "record_id",
                  verified: str = "last_verified_date") -> DataFrame:
    """Records never verified, or verified more than ``max_days`` before the run."""
    date = F.try_to_date(F.col(verified)) if dict(records.dtypes)[verified] == "string" else F.col(verified).cast("date")
    age = F.datediff(run_date, date)
    return records.select(key, age.alias("age_days")).where(F.col("age_days").isNull() | (F.col("age_days") > max_days))


def page_dates(value: Column | str) -> Column:
    """Date of an update text such as ``June 9, 2026``; null when it is not one."""
    return F.try_to_timestamp(value, F.lit("MMMM d, yyyy")).cast("date")


def _by(fetches: DataFrame, key: str, url: str, own: bool) -> tuple[DataFrame, str]:
    """Fetches with the column by which they belong to records, and its name."""
    return (fetches, key) if own else (fetches.withColumn(url, F.col("url")), url)


def broken_links(records: DataFrame, fetches: DataFrame, key: str = "record_id", url: str = "official_source_url",
                 own: bool = False) -> DataFrame:
    """Record URLs whose fetch failed or that were never fetched; ``fetches`` has one row per URL.

    With ``own`` it has one row per record instead, under ``key``: records may share a URL.
    """
    known, on = _by(fetches, key, url, own)
    joined = records.where(~is_missing(url)).select(key, url).join(known.select(on, "http_status"), on, "left")
    return joined.where(F.coalesce("http_status", F.lit(-1)) != 200).select(
        key, url, F.coalesce("http_status", F.lit(-1)).alias("http_status"))


def _at_moments(records: DataFrame, fetches: DataFrame, moments: Sequence[str], key: str, url: str,
                tie: Sequence[str], values: Sequence[str], own: bool) -> DataFrame:
    """``key, url, as_of, in_force`` of every record with a URL, at every moment."""
    instants = F.array(*[F.lit(m).cast(dict(fetches.dtypes)["retrieved_at"]) for m in moments])
    asked = records.where(~is_missing(url)).select(key, url, F.explode(instants).alias("as_of"))
    known, on = _by(fetches, key, url, own)
    return as_of_join(asked, known.select(on, "retrieved_at", *values, *tie), [on], "as_of", "retrieved_at", tie)


def broken_links_as_of(records: DataFrame, fetches: DataFrame, moments: Sequence[str], key: str = "record_id",
                       url: str = "official_source_url", tie: Sequence[str] = (), own: bool = False) -> DataFrame:
    """As :func:`broken_links`, at each of several moments, by the fetch in force then.

    ``fetches(url, http_status, retrieved_at)`` is the whole history of fetches.
    """
    status = F.coalesce("in_force.http_status", F.lit(-1))
    found = _at_moments(records, fetches, moments, key, url, tie, ["http_status"], own)
    return found.where(status != 200).select(key, url, "as_of", status.alias("http_status"))


def stale_records_as_of(records: DataFrame, fetches: DataFrame, moments: Sequence[str], max_days: int,
                        key: str = "record_id", url: str = "official_source_url", own: bool = False) -> DataFrame:
    """Records whose last successful fetch lay more than ``max_days`` before the moment, or was none."""
    good = fetches.where(F.col("http_status") == 200)
    age = F.datediff("as_of", "in_force.retrieved_at")
    return _at_moments(records, good, moments, key, url, (), (), own).select(key, "as_of", age.alias("age_days")).where(
        F.col("age_days").isNull() | (F.col("age_days") > max_days))


def missing_by_rule(df: DataFrame, record_type: str, fields: Sequence[str], rules: DataFrame) -> DataFrame:
    """Missing values per record type and field, marked required, optional or not applicable.

    ``rules(record_type, field, kind)``; a field without a rule is optional.
    """
    per_type = df.groupBy(F.col(record_type).alias("record_type")).agg(
        *[F.count_if(is_missing(F.col(f).cast("string"))).alias(f) for f in fields])
    long = per_type.unpivot("record_type", list(fields), "field", "missing")
    return long.join(rules, ["record_type", "field"], "left").select(
        "record_type", "field", F.coalesce("kind", F.lit("optional")).alias("kind"), "missing")


def category_coverage(records: DataFrame, taxonomy: DataFrame, own: Column) -> DataFrame:
    """Records and own-organisation records per taxonomy category, empty categories included."""
    counted = records.groupBy("category_id").agg(
        F.count("*").alias("records"), F.count_if(own).alias("own_records"))
    return taxonomy.join(counted, "category_id", "left").select(
        "category_id", F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("own_records", F.lit(0)).alias("own_records"))


def directory_targets(records: DataFrame, own: Column, health: Sequence[str],
                      targets=V.DIRECTORY_TARGETS) -> DataFrame:
    """Directory-size measures against their minimum."""
    row = records.agg(
        F.count("*").alias("records"), F.count_distinct("category_id").alias("categories"),
        F.count_if(own).alias("own_records"), F.count_if(F.col("category_id").isin(*health)).alias("health_records"))
    wanted = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.lit(t).cast("bigint").alias("target"))
        for m, t in targets])
    return row.select(F.inline(wanted)).withColumn("met", F.col("value") >= F.col("target"))


def outside_taxonomy(df: DataFrame, taxonomy: DataFrame, category: str = "category_id",
                     category_map: DataFrame | None = None) -> DataFrame:
    """Categories (after an optional ``category_map(category, category_id)``) the taxonomy lacks, with rows."""
    used = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("records"))
    if category_map is not None:
        used = used.join(category_map, "category", "left").withColumn(
            "category_id", F.coalesce("category_id", "category"))
    else:
        used = used.withColumn("category_id", F.col("category"))
    return used.join(taxonomy.select("category_id"), "category_id", "left_anti").select("category", "records")


def incomplete_provenance(facilities: DataFrame, key: str = "facility_id",
                          fields: Sequence[str] = S.PROVENANCE_FIELDS) -> DataFrame:
    """Facilities that lack a provenance field, with the fields that are missing."""
    lacking = F.concat_ws(",", *[F.when(is_missing(F.col(f).cast("string")), F.lit(f)) for f in fields])
    return facilities.select(key, lacking.alias("missing_fields")).where(F.col("missing_fields") != "")


# -- fixed values: identifiers that must not be kept in logged text --------------------------
SENSITIVE_PATTERNS = (
    ("social_insurance_number", r"\b[0-9]{3}[- ][0-9]{3}[- ][0-9]{3}\b"),
    ("nine_digit_identifier", r"\b[0-9]{9}\b"),
    ("passport_number", r"\b[A-Z]{2}[0-9]{6}\b"),
    ("health_card_number", r"\b[A-Z]{4} ?[0-9]{4} ?[0-9]{4}\b"),
    ("account_number", r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b"),
    ("email_address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
)


def sensitive_text(df: DataFrame, keys: Sequence[str], text: str, patterns=SENSITIVE_PATTERNS) -> DataFrame:
    """Rows of logged text that hold an identifier, one row per rule that fires."""
    fired = F.filter(
        F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns]), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(fired).alias("rule"))


def conflicting_claims(claims: DataFrame, entity: Sequence[str], field: str, value: str) -> DataFrame:
    """Entities whose sources give more than one value for a field."""
    return claims.where(~is_missing(value)).groupBy(*entity, field).agg(
        F.count_distinct(value).alias("values"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
    ).where(F.col("values") > 1)


def facet_counts(records: DataFrame, facets: Sequence[str], chosen: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Directory rows under the chosen facet values, counted per value of every facet in one pass."""
    for name, values in (chosen or {}).items():
        records = records.where(F.col(name).isin(*values))
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), blank(F.col(f).cast("string")).alias("value")) for f in facets])
    return records.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("records"))
