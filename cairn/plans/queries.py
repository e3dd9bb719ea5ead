"""Registered queries: every operator on the driver tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import cohort, columns, failure, filters, joins, metrics, models, pairing, pooling, splits, text
from cairn.plans import fits
from cairn.plans import views as V
from cairn.plans.views import with_views
from cairn.sources import cache, dumps, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Cohort ------------------------------------------------------------------------------------------


def _flags(spark, d, **options):
    return cohort.cohort_flags(V.studies(spark, d), V.measurements(spark, d), V.records(spark, d), V.stays(spark, d), **options)


def _rows(spark, d, **options):
    return cohort.cohort(_flags(spark, d, **options), V.patients(spark, d), V.files(spark, d)).drop("segment", "nation")


_LABELS = f"""
readings AS (
  SELECT *, list_position({V._list(V.NAMES)}, name) AS place, TRY_CAST(trim(replace(result, '%', '')) AS DOUBLE) AS value FROM measurements),
labels AS (
  SELECT measurement_id, value, name AS label_source, place <= 5 AS accepted FROM readings WHERE value BETWEEN 5 AND 95
  QUALIFY row_number() OVER (PARTITION BY measurement_id ORDER BY least(place, 6), name, ts, result) = 1),
labelled AS (SELECT s.*, value, label_source, accepted FROM studies s LEFT JOIN labels USING (measurement_id)),
eligible AS (SELECT * FROM labelled WHERE accepted AND subject_id IN (SELECT subject_id FROM records))"""


def _window(before: int, after: int) -> str:
    return f"""{_LABELS},
pairs AS (
  SELECT e.study_id, e.subject_id, e.ts, record_id, record_ts, path, date_diff('second', e.ts, record_ts) AS gap
  FROM eligible e JOIN records r ON e.subject_id = r.subject_id AND date_diff('second', e.ts, record_ts) BETWEEN -{before} AND {after}
  QUALIFY row_number() OVER (PARTITION BY e.study_id ORDER BY abs(date_diff('second', e.ts, record_ts)), record_ts, record_id) = 1),
held AS (
  SELECT p.study_id, stay_id, start_ts, end_ts FROM pairs p JOIN stays t ON p.subject_id = t.subject_id AND p.ts BETWEEN start_ts AND end_ts
  QUALIFY row_number() OVER (PARTITION BY p.study_id ORDER BY start_ts, stay_id) = 1)"""


_STAY = f"""{_LABELS},
held AS (
  SELECT e.study_id, e.subject_id, e.ts, stay_id, start_ts, end_ts FROM eligible e JOIN stays t ON e.subject_id = t.subject_id AND e.ts BETWEEN start_ts AND end_ts
  QUALIFY row_number() OVER (PARTITION BY e.study_id ORDER BY start_ts, stay_id) = 1),
pairs AS (
  SELECT h.study_id, record_id, record_ts, path, date_diff('second', h.ts, record_ts) AS gap
  FROM held h JOIN records r ON h.subject_id = r.subject_id AND record_ts BETWEEN start_ts AND end_ts
  QUALIFY row_number() OVER (PARTITION BY h.study_id ORDER BY abs(date_diff('second', h.ts, record_ts)), record_ts, record_id) = 1)"""
_VIEWS = ("studies", "measurements", "records", "stays", "file_counts", "patients")


def _final(join: str) -> str:
    return f"""
SELECT e.subject_id, study_id, record_id, e.ts, record_ts, round(gap / 3600.0, 4) AS delta_hours, value AS label, label_source, value <= 40 AS gate, path,
       coalesce(n_files, 0) AS n_files, stay_id, start_ts, end_ts, sex, age, race
FROM eligible e JOIN (SELECT study_id, record_id, record_ts, path, gap FROM pairs) USING (study_id) {join} JOIN (SELECT study_id, stay_id, start_ts, end_ts FROM held) USING (study_id)
LEFT JOIN patients USING (subject_id) LEFT JOIN file_counts USING (study_id)"""


@query(with_views(_final(""), *_VIEWS, more=_window(86400, 86400)))
def cohort_window(spark, d):
    return _rows(spark, d)


@query(with_views(_final(""), *_VIEWS, more=_window(2592000, 86400)))
def cohort_window_asym(spark, d):
    return _rows(spark, d, before=2592000, bucketed=True)


@query(with_views(_final(""), *_VIEWS, more=_STAY))
def cohort_admission(spark, d):
    return _rows(spark, d, pair_by="stay")


@query(with_views(_final("LEFT"), *_VIEWS, more=_window(86400, 86400)))
def cohort_optional_stay(spark, d):
    return _rows(spark, d, require_stay=False)


def _funnel_sql(stages: list[tuple[str, str]], body: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS step, '{name}' AS stage, study_id, subject_id FROM labelled s WHERE {test}" for i, (name, test) in enumerate(stages))
    tail = f"""
SELECT step, stage, n_studies, n_subjects, n_files, coalesce(lag(n_studies) OVER (ORDER BY step) - n_studies, 0) AS excluded_studies, CAST(coalesce(lag(n_files) OVER (ORDER BY step) - n_files, 0) AS BIGINT) AS excluded_files
FROM (SELECT step, stage, count(*) AS n_studies, count(DISTINCT subject_id) AS n_subjects, CAST(coalesce(sum(n_files), 0) AS BIGINT) AS n_files
      FROM ({parts}) LEFT JOIN file_counts USING (study_id) GROUP BY step, stage)"""
    return with_views(tail, *_VIEWS, more=body)


_COMMON = [("all", "true"), ("linked", "measurement_id IS NOT NULL"), ("any_label", "value IS NOT NULL"), ("accepted", "accepted"), ("overlap", "study_id IN (SELECT study_id FROM eligible)")]
_PAIRED, _HELD = ("paired", "study_id IN (SELECT study_id FROM pairs)"), ("in_stay", "study_id IN (SELECT study_id FROM held)")


@query(_funnel_sql([*_COMMON, _PAIRED, _HELD], _window(86400, 86400)))
def funnel_window(spark, d):
    flags = _flags(spark, d).join(cohort.file_counts(V.files(spark, d)), "study_id", "left")
    return cohort.funnel(flags, cohort.WINDOW_STAGES)


@query(_funnel_sql([*_COMMON, _HELD, _PAIRED], _STAY))
def funnel_admission(spark, d):
    flags = _flags(spark, d, pair_by="stay").join(cohort.file_counts(V.files(spark, d)), "study_id", "left")
    return cohort.funnel(flags, cohort.STAY_STAGES)


@query(
    with_views(
        f"""
SELECT label_source, accepted, count(*) AS n, avg(value) AS mean_label, CASE WHEN accepted THEN 100.0 * count(*) / sum(CASE WHEN accepted THEN count(*) END) OVER () END AS pct,
       label_source <> 'lvef' AS fallback, CAST(least(list_position({V._list(V.NAMES)}, label_source) - 1, 5) AS INT) AS "rank"
FROM labelled WHERE value IS NOT NULL GROUP BY label_source, accepted""",
        *_VIEWS,
        more=_LABELS,
    )
)
def label_sources(spark, d):
    return cohort.label_sources(_flags(spark, d))


def _count(body: str) -> str:
    return "(" + with_views("SELECT count(*) AS final_rows, count(DISTINCT e.subject_id) AS final_subjects FROM eligible e WHERE study_id IN (SELECT study_id FROM pairs) AND study_id IN (SELECT study_id FROM held)", *_VIEWS, more=body) + ")"


@query(
    f"""
WITH runs AS (SELECT 0 AS step, 'window_24h' AS scenario, * FROM {_count(_window(86400, 86400))} UNION ALL SELECT 1, 'window_48h', * FROM {_count(_window(172800, 172800))} UNION ALL SELECT 2, 'same_stay', * FROM {_count(_STAY)})
SELECT scenario, (SELECT count(*) FROM orders) AS start_rows, final_rows, final_subjects, (SELECT count(*) FROM orders) - final_rows AS excluded, final_rows - first(final_rows) OVER (ORDER BY step) AS gain,
       100.0 * (final_rows - first(final_rows) OVER (ORDER BY step)) / first(final_rows) OVER (ORDER BY step) AS gain_pct
FROM runs"""
)
def sensitivity(spark, d):
    rows = cohort.labelled(V.studies(spark, d), V.measurements(spark, d), V.records(spark, d))
    options = {"window_24h": {}, "window_48h": {"before": 172800, "after": 172800}, "same_stay": {"pair_by": "stay"}}
    rows = rows.select("study_id", "subject_id", "ts", "s_overlap")
    return cohort.sensitivity(cohort.scenarios(rows, V.records(spark, d), V.stays(spark, d), options), list(options))


_FINAL = f"final AS ({_final('')})"


@query(
    with_views(
        """
SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(label) AS n_valid, count(*) - count(label) AS n_missing, avg(label) AS mean_label, round(stddev_samp(label), 9) AS std_label,
       min(label) AS min_label, max(label) AS max_label, count(*) FILTER (gate) AS n_positive, CAST(count(*) FILTER (gate) AS DOUBLE) / count(label) AS prevalence
FROM final""",
        *_VIEWS,
        more=f"{_window(86400, 86400)},\n{_FINAL}",
    )
)
def cohort_summary(spark, d):
    return cohort.cohort_summary(_rows(spark, d)).withColumn("std_label", F.round("std_label", 9))


@query(
    with_views(
        """
SELECT field, present, n - present AS missing, CAST(present AS DOUBLE) / n AS coverage
FROM (SELECT count(*) AS n, count(sex) AS sex, count(age) AS age, count(*) FILTER (race IS NOT NULL AND upper(trim(race)) NOT IN ('UNKNOWN', 'UNABLE TO OBTAIN', 'PATIENT DECLINED TO ANSWER', '')) AS race FROM patients)
UNPIVOT (present FOR field IN (sex, age, race))""",
        "patients",
    )
)
def coverage(spark, d):
    return cohort.coverage(V.patients(spark, d), ["sex", "age", "race"])


@query(with_views("SELECT 'sex' AS field, sex AS value, count(*) AS n FROM patients GROUP BY sex UNION ALL SELECT 'race', race, count(*) FROM patients GROUP BY race UNION ALL SELECT 'segment', segment, count(*) FROM patients GROUP BY segment", "patients"))
def value_counts(spark, d):
    return cohort.value_counts(V.patients(spark, d), ["sex", "race", "segment"])


# Scalars -----------------------------------------------------------------------------------------


@query(with_views("SELECT age_band, race AS race_group, sex, count(*) AS n FROM strata GROUP BY ALL", "strata"))
def age_race_bands(spark, d):
    return V.patients(spark, d).groupBy(S.age_band("age").alias("age_band"), S.race_group("race").alias("race_group"), "sex").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        r"""
SELECT record_id, TRY_CAST(regexp_extract(path, '(?:^|/)p\d+/p(\d+)/s(\d+)/', 1) AS BIGINT) AS subject, TRY_CAST(regexp_extract(path, '(?:^|/)p\d+/p(\d+)/s(\d+)/', 2) AS BIGINT) AS study,
       CASE WHEN length(CAST(subject_id AS VARCHAR)) >= 3 THEN subject_id END AS subject_2, record_id AS study_2, 's' || record_id || '/rec.mp4' AS key, '' || record_id AS canonical
FROM records""",
        "records",
    )
)
def path_ids(spark, d):
    rows = V.records(spark, d).withColumn("file", F.replace("path", F.lit(".dat"), F.lit(".dcm")))
    a, b = S.path_ids(F.col("path"))
    c, e = S.path_ids_fallback(F.col("path"))
    return rows.select("record_id", a.alias("subject"), b.alias("study"), c.alias("subject_2"), e.alias("study_2"), F.array_join(F.slice(F.split(S.path_key(F.col("file")), "/"), 2, 9), "/").alias("key"), S.canonical_id(F.concat(F.lit("x/9/s"), "record_id")).alias("canonical"))


@query(with_views("SELECT name, result, count(*) AS n, TRY_CAST(trim(replace(result, '%', '')) AS DOUBLE) AS value FROM measurements GROUP BY ALL", "measurements"))
def percent_parse(spark, d):
    return V.measurements(spark, d).groupBy("name", "result").agg(F.count(F.lit(1)).alias("n")).withColumn("value", S.percent("result"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber % 3 AS k, count(*) AS n, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS flag, l_linenumber % 3 <> 0 AS number FROM lineitem GROUP BY ALL")
def bool_normalize(spark, d):
    rows = V._t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.expr("l_linenumber % 3").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    text_ = F.element_at(F.create_map(*[F.lit(x) for kv in {"A": " Yes", "N": "FALSE", "R": "maybe"}.items() for x in kv]), F.col("l_returnflag"))
    return rows.withColumn("flag", S.boolean(text_)).withColumn("number", S.boolean(F.col("k")))


def _written(x):
    return F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: e.cast("decimal(20,12)").cast("string")), ", "), F.lit("]"))


@query("SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024 + 0.5) / 1024) AS v, true AS same FROM embeddings")
def parse_vectors(spark, d):
    rows = V.vectors(spark, d).select("vec_id", F.col("v").alias("x"))
    rows = rows.withColumn("v", S.parse_vector(_written("x")))
    return rows.select("vec_id", "v", (F.col("v") == F.col("x")).alias("same"))


@query("SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024 + 0.5) / 1024) AS v, 8 AS n_rows, 8 AS n_columns FROM embeddings")
def parse_matrices(spark, d):
    """Vectors written as nested lists of eight rows and read as matrices."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: _written(F.slice("v", k * 8 + 1, F.lit(8))))
    m = V.vectors(spark, d).select("vec_id", S.parse_matrix(F.concat(F.lit("["), F.array_join(pieces, ", "), F.lit("]"))).alias("m"))
    return m.select("vec_id", F.flatten("m").alias("v"), F.size("m").alias("n_rows"), F.size(F.col("m")[7]).alias("n_columns"))


@query("SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS place FROM embeddings ORDER BY label DESC, vec_id LIMIT 50")
def first_rows(spark, d):
    """The first 50 rows in an order."""
    rows = V._t(spark, d, "embeddings").select("vec_id", "label").orderBy(F.desc("label"), "vec_id").limit(50)
    return rows.select("vec_id", F.row_number().over(W.orderBy(F.desc("label"), "vec_id")).cast("long").alias("place"))


# Pairing and joins -------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_quantity) = 1")
def keep_first(spark, d):
    rows = V._t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return pairing.keep_first(rows, "l_orderkey", [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_quantity")])


_PURCHASES = "anchors AS (SELECT event_id AS anchor_id, user_id AS subject_id, ts FROM events WHERE event_type = 'purchase')"


def _anchors(spark, d):
    return V._t(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("anchor_id"), F.col("user_id").alias("subject_id"), "ts")


def _nearest_sql(join: str) -> str:
    return f"""
SELECT a.anchor_id, a.subject_id, record_id, record_ts, gap_seconds FROM anchors a {join} JOIN (
  SELECT anchor_id, record_id, record_ts, date_diff('second', a.ts, record_ts) AS gap_seconds FROM anchors a JOIN records r ON a.subject_id = r.subject_id AND date_diff('second', a.ts, record_ts) BETWEEN -43200 AND 86400
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY abs(date_diff('second', a.ts, record_ts)), record_ts, record_id) = 1) USING (anchor_id)"""


@query(with_views(_nearest_sql("LEFT"), "records", more=_PURCHASES))
def nearest_window(spark, d):
    out = pairing.nearest_join(_anchors(spark, d), V.records(spark, d), on="subject_id", anchor_id="anchor_id", anchor_ts="ts", record_ts="record_ts", record_id="record_id", before=43200, after=86400, how="left")
    return out.select("anchor_id", "subject_id", "record_id", "record_ts", "gap_seconds")


@query(with_views(_nearest_sql(""), "records", more=_PURCHASES))
def nearest_bucketed(spark, d):
    out = pairing.nearest_join(_anchors(spark, d), V.records(spark, d), on="subject_id", anchor_id="anchor_id", anchor_ts="ts", record_ts="record_ts", record_id="record_id", before=43200, after=86400, bucketed=True)
    return out.select("anchor_id", "subject_id", "record_id", "record_ts", "gap_seconds")


@query(with_views("SELECT anchor_id, stay_id, start_ts, end_ts FROM anchors a LEFT JOIN stays s ON a.subject_id = s.subject_id AND a.ts BETWEEN start_ts AND end_ts QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY start_ts, stay_id) = 1", "stays", more=_PURCHASES))
def interval_first(spark, d):
    out = pairing.interval_join(_anchors(spark, d), V.stays(spark, d), on="subject_id", point_id="anchor_id", ts="ts", start="start_ts", end="end_ts", span_id="stay_id", how="left")
    return out.select("anchor_id", "stay_id", "start_ts", "end_ts")


@query(with_views("SELECT stay_id, s.subject_id, record_id, record_ts FROM stays s JOIN records r ON s.subject_id = r.subject_id AND record_ts BETWEEN start_ts AND end_ts QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY abs(date_diff('second', start_ts, record_ts)), record_ts, record_id) = 1", "stays", "records"))
def nearest_to_start(spark, d):
    out = pairing.nearest_to_start(V.stays(spark, d), V.records(spark, d), on="subject_id", span_id="stay_id", start="start_ts", end="end_ts", record_ts="record_ts", record_id="record_id")
    return out.select("stay_id", "subject_id", "record_id", "record_ts")


@query(
    """
WITH o AS (SELECT o_orderkey AS study, o_custkey % 40 AS value FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS study, CASE WHEN o_orderkey % 10 = 1 THEN o_custkey % 40 + 1 ELSE o_custkey % 40 END AS value FROM orders WHERE o_orderkey % 4 <> 0)
SELECT count(*) FILTER (o.study IS NOT NULL AND n.study IS NOT NULL) AS shared, count(*) FILTER (n.study IS NULL) AS only_old, count(*) FILTER (o.study IS NULL) AS only_new,
       count(*) FILTER (o.study IS NOT NULL AND n.study IS NOT NULL AND o.value IS DISTINCT FROM n.value) AS changed
FROM o FULL JOIN n ON o.study = n.study"""
)
def drift(spark, d):
    o = V._t(spark, d, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS study", "o_custkey % 40 AS value")
    n = V._t(spark, d, "orders").where("o_orderkey % 4 <> 0").selectExpr("o_orderkey AS study", "CASE WHEN o_orderkey % 10 = 1 THEN o_custkey % 40 + 1 ELSE o_custkey % 40 END AS value")
    return joins.drift(o, n, "study", "value")


@query(
    with_views(
        """
SELECT count(DISTINCT s.subject_id) AS shared_subjects, count(DISTINCT study_id) AS studies_of_shared, (SELECT count(*) FROM studies JOIN records USING (subject_id)) AS candidate_pairs,
       (SELECT count(*) FROM (SELECT study_id FROM studies INTERSECT SELECT record_id FROM records)) AS same_ids
FROM studies s WHERE subject_id IN (SELECT subject_id FROM records)""",
        "studies",
        "records",
    )
)
def overlap(spark, d):
    return joins.overlap(V.studies(spark, d), V.records(spark, d), "subject_id", "study_id", "record_id")


@query("SELECT 's' || o_custkey % 3 AS scenario, count(*) AS n, count(*) FILTER (o_orderkey IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)) AS with_a, count(*) FILTER (o_custkey IN (SELECT vec_id FROM embeddings)) AS with_b, count(*) FILTER (o_orderkey IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) AND o_custkey IN (SELECT vec_id FROM embeddings)) AS with_both FROM orders GROUP BY 1")
def coverage_by_scenario(spark, d):
    rows = V._t(spark, d, "orders").selectExpr("concat('s', cast(o_custkey % 3 AS string)) AS scenario", "o_orderkey AS study", "o_custkey AS record")
    v = V._t(spark, d, "embeddings")
    return joins.vector_coverage(rows, "scenario", v.where("vec_id % 2 = 0").selectExpr("vec_id AS study"), v.selectExpr("vec_id AS record"), "study", "record")


@query(
    with_views(
        "SELECT path, subject_id, record_id AS study_id, record_id % 3 = 0 AS by_record, CASE WHEN record_id % 2 = 0 THEN record_ts END AS study_ts FROM records WHERE length(CAST(subject_id AS VARCHAR)) >= 2 OR record_id % 3 = 0".replace(">= 2", ">= 3"),
        "records",
    )
)
def enrich(spark, d):
    r = V.records(spark, d)
    known = r.where("record_id % 3 = 0").selectExpr("path", "subject_id", "record_id AS study_id")
    times = r.where("record_id % 2 = 0").selectExpr("subject_id", "record_id AS study_id", "record_ts AS study_ts")
    return joins.enrich(r.select("path"), known, times).where("subject_id is not null").select("path", "subject_id", "study_id", "by_record", "study_ts")


@query(
    with_views(
        "SELECT count(*) AS n, count(*) FILTER (record_id % 3 = 0) AS n_by_record, count(*) FILTER (record_id % 3 <> 0 AND length(CAST(subject_id AS VARCHAR)) >= 3) AS n_by_path, count(*) FILTER (record_id % 3 <> 0 AND length(CAST(subject_id AS VARCHAR)) < 3) AS n_without_ids, count(*) FILTER (record_id % 2 = 0 AND (record_id % 3 = 0 OR length(CAST(subject_id AS VARCHAR)) >= 3)) AS n_with_time FROM records",
        "records",
    )
)
def enrichment_counts(spark, d):
    r = V.records(spark, d)
    known = r.where("record_id % 3 = 0").selectExpr("path", "subject_id", "record_id AS study_id")
    times = r.where("record_id % 2 = 0").selectExpr("subject_id", "record_id AS study_id", "record_ts AS study_ts")
    return joins.enrichment_counts(joins.enrich(r.select("path"), known, times))


@query("SELECT l_returnflag, count(*) AS n, coalesce(CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END, false) AS flag FROM lineitem GROUP BY l_returnflag")
def bool_strict(spark, d):
    """A flag column as cohorts need it: null is false, and any other text an error."""
    rows = V._t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    text_ = F.element_at(F.create_map(*[F.lit(x) for kv in {"A": " Yes", "N": "FALSE"}.items() for x in kv]), F.col("l_returnflag"))
    return rows.withColumn("flag", S.strict_boolean(F.try_element_at(F.array(text_), F.lit(1))))


@query("SELECT k AS key, arg_max(v, part) AS v FROM (SELECT c_custkey % 500 AS k, max(c_acctbal) AS v, 0 AS part FROM customer GROUP BY 1 UNION ALL SELECT s_suppkey * 3, s_acctbal, 1 FROM supplier) GROUP BY k")
def merge_parts(spark, d):
    a = V._t(spark, d, "customer").groupBy(F.expr("c_custkey % 500").alias("key")).agg(F.max("c_acctbal").alias("v"))
    return cache.merge_parts([a, V._t(spark, d, "supplier").selectExpr("s_suppkey * 3 AS key", "s_acctbal AS v")], "key")


def _cached(spark, d):
    """A cache of every third vector, of which every sixth was written again with the opposite sign."""
    found = cache.VectorCache(spark, cache.scratch(spark, "vectors"), "v", "2")
    v = V.vectors(spark, d).select(F.col("vec_id").cast("string").alias("id"), F.col("v").alias("embedding"), "vec_id")
    found.append(v.where("vec_id % 3 = 0"))
    found.append(v.where("vec_id % 6 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), overwrite=True)
    return found, v


@query(with_views("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(v) AS INT) AS dim, '2' AS encoder_version, CAST(CASE WHEN vec_id % 6 = 0 THEN -v[1] ELSE v[1] END AS DOUBLE) AS first, CAST(CASE WHEN vec_id % 6 = 0 THEN -v[64] ELSE v[64] END AS DOUBLE) AS last FROM vectors WHERE vec_id % 3 = 0", "vectors"))
def cache_round_trip(spark, d):
    """Write, write over, read: of ids written twice the last write counts."""
    found, _ = _cached(spark, d)
    return found.read().select("id", "dim", "encoder_version", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 6 = 0 THEN 2 ELSE 1 END AS writes FROM embeddings WHERE vec_id % 3 = 0")
def cache_compacted(spark, d):
    """The cache after its two writes became one: every id once, with the number of the write it came from."""
    found, _ = _cached(spark, d)
    found.compact()
    found.clean()
    return found._rows().select("id", F.col("written").cast("int").alias("writes"))


@query("SELECT count(*) AS n, sum(256) AS bytes, max(64) AS dim, true AS on_disk FROM embeddings WHERE vec_id % 3 = 0")
def cache_stats(spark, d):
    """How many vectors a cache holds, and their bytes."""
    found, _ = _cached(spark, d)
    return found.stats().select("n", "bytes", "dim", (F.col("disk_bytes") > 0).alias("on_disk"))


@query(with_views("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(v[1] AS DOUBLE) * CASE WHEN vec_id % 6 = 0 THEN -1 ELSE 1 END AS first FROM vectors WHERE vec_id % 15 = 0", "vectors"))
def cache_lookup(spark, d):
    """Some ids, known or not, from the buckets they lie in."""
    found, v = _cached(spark, d)
    return found.lookup(v.where("vec_id % 5 = 0").select("id")).select("id", F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id % 3 <> 0")
def cache_resume(spark, d):
    """What is still to be encoded."""
    found, v = _cached(spark, d)
    return found.missing(v.select("id"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, label FROM embeddings WHERE vec_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def encode_missing(spark, d):
    done = V._t(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_custkey AS vec_id").distinct()

    def encoder(frame):
        return frame.assign(dim=frame["embedding"].map(len))[["vec_id", "dim", "label"]]

    return models.encode_missing(V._t(spark, d, "embeddings"), done, "vec_id", encoder, "vec_id long, dim long, label int")


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) + least(1, count(*) - count({c})) AS n_unique, count(*) - count(DISTINCT {c}) - least(1, count(*) - count({c})) AS n_duplicate FROM patients" for c in ("subject_id", "sex", "age", "race"))


@query(with_views("SELECT example_id, condition, y, pred, gate FROM predictions", "predictions"))
def prediction_dump(spark, d):
    """Predictions written as JSON dumps of parallel arrays and read again."""
    path = cache.scratch(spark, "dumps")
    dumps.write_dumps(V.predictions(spark, d), path, conditions=list(V.CONDITIONS))
    return dumps.read_dumps(spark, path, list(V.CONDITIONS), {"example_id": "long"} | dumps.FIELDS).select("example_id", "condition", "y", "pred", "gate")


@query(with_views(_PROFILE, "patients"))
def profile(spark, d):
    return tables.profile(V.patients(spark, d), ["subject_id", "sex", "age", "race"])


@query("SELECT p_partkey AS subject_id, p_partkey * 2 AS study_id, [CAST(p_size AS FLOAT), CAST(p_partkey % 7 AS FLOAT)] AS embedding, 'm' AS model FROM part")
def wide_to_vector(spark, d):
    wide = V._t(spark, d, "part").selectExpr("concat('files/p0/p', p_partkey, '/s', p_partkey * 2, '/r') AS file", "p_partkey % 7 AS ve10", "p_size AS VE2")
    return tables.wide_to_vector(wide, prefix="ve", model="m", path="file")


# Vectors -----------------------------------------------------------------------------------------


@query(with_views("SELECT key, list(m ORDER BY i) AS embedding, max(n) AS n_clips FROM (SELECT key, i, round(CAST(CAST(sum(x) / count(*) AS FLOAT) AS DOUBLE), 6) AS m, count(*) AS n FROM (SELECT key, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM clips WHERE v IS NOT NULL) GROUP BY key, i) GROUP BY key", "clips"))
def mean_pool(spark, d):
    return pooling.mean_pool(V.clips(spark, d), ["key"], "v").withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)))


@query(
    with_views(
        "SELECT key, vec_id, n_clips FROM (SELECT key, vec_id, v, count(*) OVER (PARTITION BY key) AS n_clips, count(v) OVER (PARTITION BY key ORDER BY vec_id) - 1 AS i FROM clips) WHERE v IS NOT NULL AND (n_clips <= 3 OR i * 3 % n_clips < 3)", "clips"
    )
)
def stride_subsample(spark, d):
    return pooling.stride_subsample(V.clips(spark, d), ["key"], "v", ["vec_id"], 3).select("key", "vec_id", "n_clips")


@query("SELECT count(*) FILTER (vec_id % 17 <> 0 AND vec_id % 19 <> 0 AND vec_id % 23 <> 0) AS n_kept, count(*) FILTER (vec_id % 17 = 0 OR vec_id % 19 = 0 OR vec_id % 23 = 0) AS n_dropped FROM embeddings")
def nonfinite_drop(spark, d):
    bad = F.expr("CASE WHEN vec_id % 17 = 0 THEN double('NaN') WHEN vec_id % 19 = 0 THEN double('Infinity') WHEN vec_id % 23 = 0 THEN cast(NULL AS double) ELSE 0D END")
    return filters.drop_non_finite(V.vectors(spark, d).withColumn("v", F.concat("v", F.array(bad))), "y", ["v"])[1]


def _manifest(spark, d):
    v = V.vectors(spark, d)
    rows = V._t(spark, d, "orders").selectExpr("o_orderkey AS study_id", "o_custkey AS record_id", "o_custkey % 60 AS subject_id", "CASE WHEN o_orderkey % 9 <> 0 THEN cast(o_orderkey % 80 AS double) END AS label")
    rows = rows.withColumn("split", F.expr("CASE WHEN study_id % 31 = 0 THEN NULL WHEN subject_id < 40 THEN 'train' WHEN subject_id < 48 THEN 'val' ELSE 'test' END"))
    return joins.build_manifest(rows, v.where("vec_id % 3 <> 0").selectExpr("vec_id AS study_id", "a"), v.where("vec_id % 5 <> 0").selectExpr("vec_id AS record_id", "b"), ["study_id"], ["record_id"])


_MANIFEST = """
rows_ AS (SELECT o_orderkey AS study_id, o_custkey AS record_id, o_custkey % 60 AS subject_id, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 80 AS DOUBLE) END AS label,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_custkey % 60 < 40 THEN 'train' WHEN o_custkey % 60 < 48 THEN 'val' ELSE 'test' END AS split FROM orders),
va AS (SELECT vec_id AS study_id, a FROM vectors WHERE vec_id % 3 <> 0), vb AS (SELECT vec_id AS record_id, b FROM vectors WHERE vec_id % 5 <> 0),
manifest AS (SELECT r.*, a, b FROM rows_ r LEFT JOIN va USING (study_id) LEFT JOIN vb USING (record_id))"""


@query(with_views("SELECT study_id, record_id, subject_id, label, split, a IS NOT NULL AS has_a, b IS NOT NULL AS has_b, a IS NOT NULL AND b IS NOT NULL AS has_both, a[1] AS a1, b[32] AS b32 FROM manifest", "vectors", more=_MANIFEST))
def manifest_join(spark, d):
    return _manifest(spark, d).select("study_id", "record_id", "subject_id", "label", "split", "has_a", "has_b", "has_both", F.try_element_at("a", F.lit(1)).alias("a1"), F.try_element_at("b", F.lit(32)).alias("b32"))


@query(
    with_views(
        """
SELECT count(*) AS n_rows, count(a) AS with_a, count(b) AS with_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS with_both, count(*) FILTER (label IS NULL) AS missing_label, count(*) FILTER (split IS NULL) AS missing_split,
       count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, CAST(max(len(a)) AS INT) AS dim_a, CAST(max(len(b)) AS INT) AS dim_b
FROM manifest""",
        "vectors",
        more=_MANIFEST,
    )
)
def manifest_summary(spark, d):
    return cohort.manifest_summary(_manifest(spark, d), "a", "b")


@query(with_views("SELECT m.study_id, m.record_id, m.label, w.v[40] AS a1, w.vec_id IS NOT NULL AS has_a, m.b[1] AS b1 FROM manifest m LEFT JOIN (SELECT * FROM vectors WHERE vec_id % 4 = 0) w ON m.study_id = w.vec_id", "vectors", more=_MANIFEST))
def replace_vectors(spark, d):
    new = V.vectors(spark, d).where("vec_id % 4 = 0").select(F.col("vec_id").alias("study_id"), F.slice("v", 40, 8).alias("a"))
    out = joins.replace_vectors(_manifest(spark, d), new, ["study_id"], ["a"])
    return out.select("study_id", "record_id", "label", F.try_element_at("a", F.lit(1)).alias("a1"), "has_a", F.try_element_at("b", F.lit(1)).alias("b1"))


@query(with_views("SELECT count(DISTINCT vec_id) AS n_vectors, count(*) AS n_elements, avg(x) AS mean, round(sqrt(greatest(0.0, sum(x * x) / count(*) - avg(x) * avg(x))), 9) AS std, true AS all_finite FROM (SELECT vec_id, unnest(v) AS x FROM vectors)", "vectors"))
def vector_stats(spark, d):
    return pooling.vector_stats(V.vectors(spark, d), "v").withColumn("std", F.round("std", 9))


def _tokens(spark, d):
    return V.vectors(spark, d).select("vec_id", S.let("v", lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))).alias("tokens"))


@query(
    with_views(
        f"""
SELECT vec_id, list(p ORDER BY i) AS pooled FROM (
  SELECT vec_id, i, round(sum(e * x) / max(total), 9) AS p FROM (
    SELECT vec_id, e, sum(e) OVER (PARTITION BY vec_id) AS total, t FROM (
      SELECT vec_id, t, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM (SELECT vec_id, t, list_sum(list_transform(list_zip(t, {V.QUERY}), lambda z: z[1] * z[2])) / sqrt(8) AS s FROM (SELECT vec_id, v[k * 8 + 1:k * 8 + 8] AS t FROM vectors, range(8) r(k))))),
    LATERAL (SELECT unnest(t) AS x, generate_subscripts(t, 1) AS i) GROUP BY vec_id, i) GROUP BY vec_id""",
        "vectors",
    )
)
def attentive_pool(spark, d):
    out = pooling.attentive_pool(_tokens(spark, d), "tokens", V.QUERY)
    return out.select("vec_id", F.transform("pooled", lambda x: F.round(x, 9)).alias("pooled"))


@query(
    with_views(
        f"""
SELECT round(avg(r), 9) AS mean_range, round(max(r), 9) AS max_range, round(avg(s), 9) AS mean_std, round(max(s), 9) AS max_std FROM (
  SELECT vec_id, max(w) - min(w) AS r, stddev_pop(w) AS s FROM (
    SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM (SELECT vec_id, exp(list_sum(list_transform(list_zip(v[k * 8 + 1:k * 8 + 8], {V.QUERY}), lambda z: z[1] * z[2])) / sqrt(8)) AS e FROM vectors, range(8) r(k))) GROUP BY vec_id)""",
        "vectors",
    )
)
def attention_spread(spark, d):
    out = pooling.attention_spread(pooling.attentive_pool(_tokens(spark, d), "tokens", V.QUERY), "weights")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


_SCORES = with_views(
    f"""
SELECT vec_id, y, 'full' AS condition, sa + sb AS pred FROM s UNION ALL SELECT vec_id, y, 'a_dropped', sb FROM s UNION ALL SELECT vec_id, y, 'b_dropped', sa FROM s""",
    "vectors",
    more=f"s AS (SELECT vec_id, y, 2 + list_sum(list_transform(list_zip(a, {V.WEIGHTS_A}), lambda z: z[1] * z[2])) AS sa, list_sum(list_transform(list_zip(b, {V.WEIGHTS_B}), lambda z: z[1] * z[2])) AS sb FROM vectors)",
)


@query(_SCORES.replace("'a_dropped', sb", "'a_dropped', 2 + sb"))
def masked_linear_scores(spark, d):
    model = models.Fusion({"a": V.WEIGHTS_A, "b": V.WEIGHTS_B}, 2.0)
    return models.score_conditions(V.vectors(spark, d), model, {"a": "a", "b": "b"}, ["vec_id", "y"]).select("vec_id", "y", "condition", "pred")


# Splits ------------------------------------------------------------------------------------------

_SPLIT = """
order_ AS (SELECT c_custkey AS subject_id, row_number() OVER (ORDER BY md5('42:' || c_custkey)) AS k, count(*) OVER () AS n FROM customer),
split_ AS (SELECT subject_id, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.7, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM order_)"""


def _split(spark, d):
    return splits.subject_split(V._t(spark, d, "customer").select(F.col("c_custkey").alias("subject_id")))


@query(f"WITH {_SPLIT} SELECT * FROM split_")
def subject_split(spark, d):
    return _split(spark, d)


@query(
    with_views(
        """
SELECT coalesce(split, 'overall') AS split, count(*) AS n, count(DISTINCT subject_id) AS n_subjects, count(*) FILTER (gate) AS n_positive, count(*) FILTER (NOT gate) AS n_negative, CAST(count(*) FILTER (gate) AS DOUBLE) / count(gate) AS prevalence,
       count(*) FILTER (gate) > 0 AND count(*) FILTER (NOT gate) > 0 AS both_classes, least(count(*) FILTER (gate), count(*) FILTER (NOT gate)) >= 30 AS enough
FROM examples JOIN split_ USING (subject_id) GROUP BY GROUPING SETS ((split), ())""",
        "examples",
        more=_SPLIT,
    )
)
def split_prevalence(spark, d):
    return splits.split_prevalence(V.examples(spark, d).select("subject_id", "gate").join(_split(spark, d), "subject_id"))


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) <= round_even(count(*) OVER (PARTITION BY o_orderstatus) * CAST(0.7 AS DOUBLE), 0) AS is_train FROM orders")
def stratified_mask(spark, d):
    return splits.stratified_mask(V._t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 0.7)


@query("SELECT o_custkey AS subject_id, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def leakage(spark, d):
    return splits.leaking_subjects(V._t(spark, d, "orders").selectExpr("o_custkey AS subject_id", "o_orderstatus AS split"))


@query("SELECT source AS split, count(*) AS n, sha256(string_agg(i, chr(10) ORDER BY i)) AS sha256 FROM (SELECT DISTINCT source, 'd-' || doc_id AS i FROM documents) GROUP BY 1")
def text_id_fingerprint(spark, d):
    """The digest of ids that are texts."""
    return splits.sha256_of_ids(V._t(spark, d, "documents").selectExpr("source AS split", "concat('d-', doc_id) AS id"), "id", "split")


@query(
    """
WITH RECURSIVE ids AS (
  SELECT split, i, row_number() OVER (PARTITION BY split ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY split) AS n FROM (SELECT DISTINCT o_orderstatus AS split, o_custkey AS i FROM orders WHERE o_custkey IS NOT NULL)),
tree AS (
  SELECT split, n, r // 100000 AS piece, (n - 1) // 100000 AS last, sha256(string_agg(i::VARCHAR, chr(10) ORDER BY i)) AS d FROM ids GROUP BY split, n, r // 100000
  UNION ALL
  SELECT split, n, piece // 1024, last // 1024, CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, chr(10) ORDER BY piece)) END FROM tree WHERE last > 0 GROUP BY split, n, piece // 1024, last // 1024)
SELECT split, n, d AS sha256 FROM tree WHERE last = 0"""
)
def id_fingerprint(spark, d):
    return splits.sha256_of_ids(V._t(spark, d, "orders").selectExpr("o_orderstatus AS split", "o_custkey AS subject_id"), "subject_id", "split")


@query(
    f"""
WITH {_SPLIT}, joined AS (SELECT o_custkey AS subject_id, split FROM orders JOIN split_ ON o_custkey = subject_id)
SELECT split, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, CAST(0 AS BIGINT) AS n_overlap,
       CAST((SELECT sum(CAST('0x' || substr(md5(i::VARCHAR), 1, 12) AS BIGINT)) FROM (SELECT DISTINCT subject_id AS i FROM joined j2 WHERE j2.split = joined.split)) AS VARCHAR) AS sum_hash
FROM joined GROUP BY split"""
)
def split_manifest(spark, d):
    rows = V._t(spark, d, "orders").selectExpr("o_custkey AS subject_id").join(_split(spark, d), "subject_id")
    return splits.split_manifest(rows)


# Metrics -----------------------------------------------------------------------------------------


def _auc(by: str, gate: str = "gate", score: str = "score", where: str = "true", source: str = "predictions") -> str:
    """Area by average ranks."""
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {comma}sum(CASE WHEN g THEN 1 ELSE 0 END) AS n_pos, sum(CASE WHEN g THEN 0 ELSE 1 END) AS n_neg,
  CASE WHEN sum(CASE WHEN g THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN g THEN 0 ELSE 1 END) > 0 THEN (sum(CASE WHEN g THEN r ELSE 0 END) - sum(CASE WHEN g THEN 1 ELSE 0 END) * (sum(CASE WHEN g THEN 1 ELSE 0 END) + 1) / 2.0) / (CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN g THEN 0 ELSE 1 END)) END AS auroc
  FROM (SELECT {comma}{gate} AS g, CAST(rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({part + (', ' if by else 'PARTITION BY ')}{score}) - 1) / 2.0 AS DOUBLE) AS r FROM {source} WHERE {where}) {'GROUP BY ' + by if by else ''})"""


_MAE = "SELECT condition, count(*) AS n, avg(abs(pred - y)) AS mae, avg(abs(m - y)) AS baseline_mae FROM (SELECT *, avg(y) OVER (PARTITION BY condition) AS m FROM predictions) GROUP BY condition"


@query(with_views(f"SELECT condition, n, round(mae, 9) AS mae, round(baseline_mae, 9) AS baseline_mae FROM ({_MAE})", "predictions"))
def mae_by_condition(spark, d):
    out = metrics.mae(V.predictions(spark, d), ["condition"])
    return out.select("condition", "n", F.round("mae", 9).alias("mae"), F.round("baseline_mae", 9).alias("baseline_mae"))


@query(with_views(f"SELECT condition, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auroc, 9) AS auroc FROM {_auc('condition')}", "predictions"))
def auroc_by_condition(spark, d):
    return metrics.auroc(V.predictions(spark, d), ["condition"]).withColumn("auroc", F.round("auroc", 9))


@query(with_views(f"SELECT CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auroc, 9) AS auroc FROM {_auc('')}", "predictions"))
def auroc_global(spark, d):
    return metrics.auroc_global(V.predictions(spark, d)).withColumn("auroc", F.round("auroc", 9))


@query(
    with_views(
        """
SELECT condition, round(sum(CAST(pos AS DOUBLE) / total * tp / (tp + fp)), 9) AS average_precision FROM (
  SELECT condition, pos, sum(pos) OVER (PARTITION BY condition) AS total, sum(pos) OVER (PARTITION BY condition ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY condition ORDER BY score DESC) AS fp
  FROM (SELECT condition, score, count(*) FILTER (gate) AS pos, count(*) FILTER (NOT gate) AS neg FROM predictions GROUP BY ALL)) GROUP BY condition""",
        "predictions",
    )
)
def avg_precision(spark, d):
    return metrics.average_precision(V.predictions(spark, d), ["condition"]).withColumn("average_precision", F.round("average_precision", 9))


@query(with_views("SELECT condition, round(avg((p - CAST(gate AS INT)) * (p - CAST(gate AS INT))), 9) AS brier FROM predictions GROUP BY condition", "predictions"))
def brier(spark, d):
    return metrics.brier(V.predictions(spark, d), ["condition"]).withColumn("brier", F.round("brier", 9))


_LONG = """
wide AS (SELECT p.*, sex, age_band, race FROM predictions p LEFT JOIN strata USING (subject_id)),
long AS (SELECT condition, y, pred, gate, -pred AS score, 'overall' AS stratum, 'all' AS value FROM wide UNION ALL SELECT condition, y, pred, gate, -pred, 'sex', coalesce(sex, 'unknown') FROM wide
  UNION ALL SELECT condition, y, pred, gate, -pred, 'age_band', coalesce(age_band, 'unknown') FROM wide UNION ALL SELECT condition, y, pred, gate, -pred, 'race', coalesce(race, 'unknown') FROM wide)"""


@query(
    with_views(
        f"""
SELECT condition, stratum, value, n, round(mae, 9) AS mae, round(baseline_mae, 9) AS baseline_mae, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auroc, 9) AS auroc, n < 20 AS small_n
FROM (SELECT condition, stratum, value, count(*) AS n, avg(abs(pred - y)) AS mae, avg(abs(m - y)) AS baseline_mae FROM (SELECT *, avg(y) OVER (PARTITION BY condition, stratum, value) AS m FROM long) GROUP BY condition, stratum, value)
JOIN {_auc("condition, stratum, value", source="long")} USING (condition, stratum, value)""",
        "predictions",
        "strata",
        more=_LONG,
    )
)
def fairness(spark, d):
    rows = V.predictions(spark, d).join(V.strata(spark, d), "subject_id", "left")
    out = metrics.stratified_metrics(rows, ["sex", "age_band", "race"], ["condition"])
    return out.withColumns({c: F.round(c, 9) for c in ("mae", "baseline_mae", "auroc")})


@query(
    with_views(
        f"""
SELECT target, stratum, value, CAST(n_pos + n_neg AS BIGINT) AS n, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_pos AS DOUBLE) / (n_pos + n_neg) AS prevalence, round(auroc, 9) AS auroc
FROM {_auc("target, stratum, value", score="score", source="pairs")} WHERE n_pos >= 5 AND n_neg >= 5""",
        "examples",
        "strata",
        more="""
wide AS (SELECT e.*, y > 60 AS high, sex, race FROM examples e LEFT JOIN strata USING (subject_id)),
pairs AS (SELECT 'gate' AS target, gate, -a_dropped AS score, 'sex' AS stratum, sex AS value FROM wide WHERE sex IS NOT NULL UNION ALL SELECT 'gate', gate, -a_dropped, 'race', race FROM wide WHERE race IS NOT NULL
  UNION ALL SELECT 'high', high, b_dropped, 'sex', sex FROM wide WHERE sex IS NOT NULL UNION ALL SELECT 'high', high, b_dropped, 'race', race FROM wide WHERE race IS NOT NULL)""",
    )
)
def gate_fairness(spark, d):
    rows = V.examples(spark, d).join(V.strata(spark, d), "subject_id", "left").withColumn("high", F.col("y") > 60).withColumn("low_score", -F.col("a_dropped"))
    return metrics.gate_fairness(rows, {"gate": "low_score", "high": "b_dropped"}, ["sex", "race"]).withColumn("auroc", F.round("auroc", 9))


_EDGES = metrics.bin_edges(10)
_BINS = f"""
binned AS (SELECT condition, least(len(list_filter({_EDGES}, lambda e: p >= e)), 10) - 1 AS bin, count(*) AS n, round(avg(CAST(gate AS DOUBLE)), 4) AS accuracy, round(avg(p), 4) AS confidence FROM predictions GROUP BY 1, 2),
bins AS (SELECT c.condition, CAST(k AS INT) AS bin, {_EDGES}[k + 1] AS lo, {_EDGES}[k + 2] AS hi, coalesce(n, 0) AS n, accuracy, confidence FROM (SELECT DISTINCT condition FROM predictions) c, range(10) r(k) LEFT JOIN binned b ON b.condition = c.condition AND b.bin = k)"""


@query(with_views("SELECT * FROM bins", "predictions", more=_BINS))
def reliability(spark, d):
    return metrics.reliability_bins(V.predictions(spark, d), ["condition"])


@query(with_views("SELECT condition, round(coalesce(sum(n * abs(accuracy - confidence)), 0) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY condition", "predictions", more=_BINS))
def ece(spark, d):
    return metrics.ece(metrics.reliability_bins(V.predictions(spark, d), ["condition"]), ["condition"]).withColumn("ece", F.round("ece", 9))


@query(with_views("SELECT source, count(*) AS n, round(avg(abs(full_ - y)), 9) AS mae FROM examples GROUP BY source", "examples"))
def error_by_source(spark, d):
    return metrics.group_error(V.examples(spark, d), "source", pred="full").withColumn("mae", F.round("mae", 9))


_REPLICATES = """
base AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY md5('42:' || example_id), example_id) - 1 AS i, count(*) OVER (PARTITION BY condition) AS n FROM predictions),
picks AS (SELECT condition, rep, CAST('0x' || substr(md5('42:' || rep || ':' || i), 1, 12) AS BIGINT) % n AS pick FROM base, range({b}) r(rep)),
drawn AS (SELECT p.condition, p.rep, b.y, b.pred, b.gate FROM picks p JOIN base b ON p.condition = b.condition AND p.pick = b.i)"""
_DRAWS = _REPLICATES.replace("{b}", "20")


@query(
    with_views(
        f"""
SELECT condition, round(quantile_cont(mae, 0.025), 6) AS mae_lo, round(quantile_cont(mae, 0.975), 6) AS mae_hi, round(quantile_cont(auroc, 0.025), 6) AS auroc_lo, round(quantile_cont(auroc, 0.975), 6) AS auroc_hi,
       count(auroc) AS auroc_replicates, count(*) - count(auroc) AS auroc_discarded
FROM (SELECT condition, rep, avg(abs(pred - y)) AS mae FROM drawn GROUP BY condition, rep) JOIN {_auc("condition, rep", score="-pred", source="drawn")} USING (condition, rep) GROUP BY condition""",
        "predictions",
        more=_DRAWS,
    )
)
def bootstrap_ci(spark, d):
    out = metrics.bootstrap_ci(V.predictions(spark, d), ["condition"], b=20, mode="exact")
    return out.select("condition", *[F.round(c, 6).alias(c) for c in ("mae_lo", "mae_hi", "auroc_lo", "auroc_hi")], "auroc_replicates", "auroc_discarded")


@query()
def bootstrap_intervals(spark, d):
    """1,000 replicates of every condition, dealt by multinomials."""
    return metrics.bootstrap_ci(V.predictions(spark, d), ["condition"], b=1000)


@query(
    with_views(
        f"""
SELECT round(quantile_cont(d_mae, 0.025), 6) AS d_mae_lo, round(quantile_cont(d_mae, 0.975), 6) AS d_mae_hi, round(quantile_cont(a.auroc - c.auroc, 0.025), 6) AS d_auroc_lo, round(quantile_cont(a.auroc - c.auroc, 0.975), 6) AS d_auroc_hi, count(a.auroc - c.auroc) AS auroc_replicates
FROM (SELECT rep, avg(abs(full_ - y) - abs(a_dropped - y)) AS d_mae FROM drawn GROUP BY rep) JOIN {_auc("rep", score="-full_", source="drawn")} a USING (rep) JOIN {_auc("rep", score="-a_dropped", source="drawn")} c USING (rep)""",
        "examples",
        more="""
base AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || example_id), example_id) - 1 AS i, count(*) OVER () AS n FROM examples),
picks AS (SELECT rep, CAST('0x' || substr(md5('7:' || rep || ':' || i), 1, 12) AS BIGINT) % n AS pick FROM base, range(20) r(rep)),
drawn AS (SELECT rep, b.* FROM picks JOIN base b ON pick = b.i)""",
    )
)
def paired_delta(spark, d):
    out = metrics.paired_delta(V.examples(spark, d), [], pred_a="full", pred_b="a_dropped", b=20, seed=7)
    return out.select(*[F.round(c, 6).alias(c) for c in ("d_mae_lo", "d_mae_hi", "d_auroc_lo", "d_auroc_hi")], "auroc_replicates")


def _poisson_steps() -> list[float]:
    term, total, steps = 0.36787944117144233, 0.0, []
    for k in range(1, 12):
        total += term
        steps.append(total)
        term /= k
    return steps


_POISSON = f"""
base AS (SELECT *, CAST('0x' || substr(md5('42:' || rep || ':' || example_id), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM predictions, range(20) r(rep)),
drawn AS (SELECT condition, rep, pred, y, gate, {' + '.join(f'CAST(u >= CAST({x!r} AS DOUBLE) AS INT)' for x in _poisson_steps())} AS w FROM base),
scores AS (SELECT condition, rep, -pred AS s, CAST(sum(w) FILTER (gate) AS BIGINT) AS pos, CAST(sum(w) FILTER (NOT gate) AS BIGINT) AS neg FROM drawn WHERE w > 0 GROUP BY ALL),
areas AS (
  SELECT condition, rep, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(coalesce(pos, 0) * (coalesce(below, 0) + coalesce(neg, 0) / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auroc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY condition, rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM scores) GROUP BY condition, rep),
errors AS (SELECT condition, rep, sum(abs(pred - y) * w) / sum(w) AS mae FROM drawn GROUP BY condition, rep)"""


@query(
    with_views(
        """
SELECT condition, round(quantile_cont(mae, 0.025), 6) AS mae_lo, round(quantile_cont(mae, 0.975), 6) AS mae_hi, round(quantile_cont(auroc, 0.025), 6) AS auroc_lo, round(quantile_cont(auroc, 0.975), 6) AS auroc_hi,
       count(auroc) AS auroc_replicates, count(*) - count(auroc) AS auroc_discarded
FROM errors JOIN areas USING (condition, rep) GROUP BY condition""",
        "predictions",
        more=_POISSON,
    )
)
def bootstrap_poisson(spark, d):
    """Intervals with Poisson weights."""
    out = metrics.bootstrap_ci(V.predictions(spark, d), ["condition"], b=20, mode="poisson")
    return out.select("condition", *[F.round(c, 6).alias(c) for c in ("mae_lo", "mae_hi", "auroc_lo", "auroc_hi")], "auroc_replicates", "auroc_discarded")


@query(
    with_views(
        """
SELECT condition, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(v) AS replicates, count(*) - count(v) AS discarded, 'average_precision' AS metric
FROM (
  SELECT condition, rep, sum(CAST(pos AS DOUBLE) / total * tp / (tp + fp)) AS v FROM (
    SELECT condition, rep, pos, sum(pos) OVER (PARTITION BY condition, rep) AS total, sum(pos) OVER (PARTITION BY condition, rep ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY condition, rep ORDER BY s DESC) AS fp
    FROM (SELECT condition, rep, -pred AS s, count(*) FILTER (gate) AS pos, count(*) FILTER (NOT gate) AS neg FROM drawn GROUP BY ALL)) GROUP BY condition, rep) GROUP BY condition
UNION ALL
SELECT condition, round(quantile_cont(v, 0.025), 6), round(quantile_cont(v, 0.975), 6), count(v), count(*) - count(v), 'brier'
FROM (SELECT condition, rep, avg((p - CAST(gate AS INT)) * (p - CAST(gate AS INT))) AS v FROM drawn GROUP BY condition, rep) GROUP BY condition""",
        "predictions",
        more=_REPLICATES.replace("{b}", "1000").replace("b.gate FROM", "b.gate, b.p FROM"),
    )
)
def bootstrap_metrics(spark, d):
    """Intervals of metrics handed in, from 1,000 replicates: average precision and Brier score."""
    rows = V.predictions(spark, d).select("example_id", "condition", "gate", "score", "p")
    given = {"average_precision": lambda df, keys, w: metrics.average_precision(df, keys, weight=w), "brier": lambda df, keys, w: metrics.brier(df, keys, weight=w)}
    return metrics.bootstrap_metrics(rows, ["condition"], given, b=1000).select("condition", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "replicates", "discarded", "metric")


@query(
    with_views(
        "SELECT split, count(*) AS n, round(avg(abs(label * 8 + 2 - y)), 9) AS mae, round(avg(abs(y - (SELECT avg(y) FROM vectors WHERE split = 'train'))), 9) AS baseline_mae FROM vectors WHERE split <> 'train' GROUP BY split", "vectors"
    )
)
def train_mean_baseline(spark, d):
    """Metrics by split against the mean of the training labels."""
    v = V.vectors(spark, d).withColumn("pred", F.col("label") * 8.0 + 2)
    mean = v.where("split = 'train'").agg(F.avg("y")).first()[0]
    out = metrics.mae(v.where("split <> 'train'"), ["split"], baseline=mean)
    return out.select("split", "n", F.round("mae", 9).alias("mae"), F.round("baseline_mae", 9).alias("baseline_mae"))


def _metric_rows(spark, d):
    p = V.predictions(spark, d)
    return metrics.mae(p, ["condition"]).join(metrics.auroc(p, ["condition"]), "condition")


_METRIC_ROWS = f"rows_ AS (SELECT condition, mae, auroc FROM ({_MAE}) JOIN {_auc('condition')} USING (condition))"


@query(
    with_views(
        """
SELECT condition, round(mae - m, 9) AS delta_mae, round(auroc - a, 9) AS delta_auroc, row_number() OVER (ORDER BY mae - m DESC, condition) = 1 AS largest
FROM rows_, (SELECT mae AS m, auroc AS a FROM rows_ WHERE condition = 'full') WHERE condition <> 'full'""",
        "predictions",
        more=_METRIC_ROWS,
    )
)
def degradation(spark, d):
    out = metrics.degradation(_metric_rows(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("delta_mae", "delta_auroc")})


@query(with_views(f"SELECT condition, round(mae, 9) AS mae, NULL::DOUBLE AS brier, 'errors' AS kind FROM ({_MAE}) UNION ALL SELECT condition, NULL, round(avg((p - CAST(gate AS INT)) * (p - CAST(gate AS INT))), 9), 'brier' FROM predictions GROUP BY condition", "predictions"))
def unified_results(spark, d):
    p = V.predictions(spark, d)
    out = metrics.unified({"errors": metrics.mae(p, ["condition"]).select("condition", "mae"), "brier": metrics.brier(p, ["condition"]), "absent": None})
    return out.select("condition", F.round("mae", 9).alias("mae"), F.round("brier", 9).alias("brier"), "kind")


# Failure analysis --------------------------------------------------------------------------------


@query(with_views("SELECT condition, count(*) AS n, count(*) FILTER ((pred <= 40) = gate AND abs(pred - y) <= 5) AS n_correct, count(*) FILTER ((pred <= 40) = gate AND abs(pred - y) > 5) AS n_imprecise, count(*) FILTER ((pred <= 40) <> gate) AS n_critical FROM predictions GROUP BY condition", "predictions"))
def taxonomy(spark, d):
    return failure.taxonomy(V.predictions(spark, d))


def _subsets(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {"full": "a+b", "a_dropped": "b", "b_dropped": "a"}.items() for x in kv])
    return V.predictions(spark, d).withColumn("subset", names[F.col("condition")])


@query(
    with_views(
        "SELECT subset, round(avg(abs(pred - y)), 9) AS mae FROM (SELECT y, 'a' AS subset, a_dropped AS pred FROM examples UNION ALL SELECT y, 'b', b_dropped FROM examples UNION ALL SELECT y, 'c', full_ FROM examples UNION ALL SELECT y, 'a+b', (a_dropped + b_dropped) / 2 FROM examples UNION ALL SELECT y, 'a+c', (a_dropped + full_) / 2 FROM examples UNION ALL SELECT y, 'b+c', (b_dropped + full_) / 2 FROM examples UNION ALL SELECT y, 'a+b+c', (a_dropped + b_dropped + full_) / 3 FROM examples) GROUP BY subset",
        "examples",
    )
)
def subset_scores(spark, d):
    """A scorer handed in: the mean of the modalities that are there."""
    columns = {"a": "a_dropped", "b": "b_dropped", "c": "full"}
    mean = lambda present: sum((F.col(columns[m]) for m in sorted(present)), F.lit(0.0)) / len(present)
    scored = failure.score_subsets(V.examples(spark, d), list(columns), mean, ["example_id", "y"])
    return failure.by_subset(scored).withColumn("mae", F.round("mae", 9))


_SUBSET = "m AS (SELECT CASE condition WHEN 'full' THEN 'a+b' WHEN 'a_dropped' THEN 'b' ELSE 'a' END AS subset, avg(abs(pred - y)) AS mae FROM predictions GROUP BY 1)"


@query(with_views("SELECT a, b, round(mae, 9) AS mae FROM (VALUES ('a', 'a', 'a'), ('a', 'b', 'a+b'), ('b', 'a', 'a+b'), ('b', 'b', 'b')) g(a, b, subset) JOIN m USING (subset)", "predictions", more=_SUBSET))
def complementarity(spark, d):
    return failure.complementarity(_subsets(spark, d), ["a", "b"]).withColumn("mae", F.round("mae", 9))


@query(
    with_views(
        """
SELECT modality, round(solo, 9) AS solo_mae, round(rest - f, 9) AS marginal_value, round(least(x, y) - f, 9) AS fusion_gain
FROM (SELECT 'a' AS modality, x AS solo, y AS rest, * FROM q UNION ALL SELECT 'b', y, x, * FROM q)""",
        "predictions",
        more=_SUBSET + ", q AS (SELECT max(mae) FILTER (subset = 'a+b') AS f, max(mae) FILTER (subset = 'a') AS x, max(mae) FILTER (subset = 'b') AS y FROM m)",
    )
)
def modality_values(spark, d):
    out = failure.modality_values(_subsets(spark, d), ["a", "b"])
    return out.select("modality", *[F.round(c, 9).alias(c) for c in ("solo_mae", "marginal_value", "fusion_gain")])


_WINNER = "CASE WHEN abs(a_dropped - y) >= abs(b_dropped - y) THEN 'a' ELSE 'b' END"


@query(with_views(f"SELECT {_WINNER} AS modality, count(*) AS n FROM examples GROUP BY 1", "examples"))
def winners(spark, d):
    return failure.winners(V.predictions(spark, d), {"a": "a_dropped", "b": "b_dropped"})


@query(with_views(f"SELECT source, {_WINNER} AS modality, count(*) AS n FROM examples GROUP BY 1, 2", "examples"))
def winners_by_group(spark, d):
    return failure.winners(V.predictions(spark, d), {"a": "a_dropped", "b": "b_dropped"}, ["source"])


@query(
    with_views(
        """
SELECT condition, count(*) AS n, count(*) FILTER (induced) AS n_induced, count(*) FILTER (induced AND abs(pred - 40) >= 5) AS n_silent, count(*) FILTER (induced AND abs(pred - 40) < 5) AS n_loud,
       CASE WHEN count(*) FILTER (induced) > 0 THEN CAST(count(*) FILTER (induced AND abs(pred - 40) >= 5) AS DOUBLE) / count(*) FILTER (induced) END AS silent_rate, round(avg(pred - full_), 9) AS mean_shift, round(avg(abs(pred - y) - abs(full_ - y)), 9) AS mae_increase
FROM (SELECT p.*, full_, (full_ <= 40) = p.gate AND (pred <= 40) <> p.gate AS induced FROM predictions p JOIN (SELECT example_id, full_ FROM examples) USING (example_id) WHERE condition <> 'full') GROUP BY condition""",
        "predictions",
    )
)
def dropout_profile(spark, d):
    return failure.dropout_profile(V.predictions(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_shift", "mae_increase")})


@query(
    with_views(
        """
SELECT condition, count(*) AS n_positive, count(*) FILTER (f AND p < 0.5) AS n_missed, count(*) FILTER (f AND p < 0.35) AS n_silent, CAST(count(*) FILTER (f AND p < 0.35) AS DOUBLE) / greatest(1, count(*) FILTER (f AND p < 0.5)) AS silent_rate
FROM (SELECT p.*, (96 - full_) / 128 >= 0.5 AS f FROM predictions p JOIN (SELECT example_id, full_ FROM examples) USING (example_id) WHERE condition <> 'full' AND p.gate) GROUP BY condition""",
        "predictions",
    )
)
def missed_positive_profile(spark, d):
    return failure.missed_positive_profile(V.predictions(spark, d))


@query(with_views("SELECT count(*) AS n_runs, round(avg(f), 9) AS f_mean, round(stddev_pop(f), 9) AS f_std, round(avg(a), 9) AS a_mean, round(stddev_pop(a), 9) AS a_std, avg(CAST(f < a AS DOUBLE)) AS holds FROM (SELECT subject_id % 50 AS run, avg(abs(full_ - y)) AS f, avg(abs(a_dropped - y)) AS a FROM examples GROUP BY 1)", "examples"))
def recovery(spark, d):
    runs = V.examples(spark, d).groupBy(F.expr("subject_id % 50").alias("run")).agg(F.avg(F.abs(F.col("full") - F.col("y"))).alias("f"), F.avg(F.abs(F.col("a_dropped") - F.col("y"))).alias("a"))
    out = failure.recovery(runs, ["f", "a"], F.col("f") < F.col("a"))
    return out.select("n_runs", *[F.round(c, 9).alias(c) for c in ("f_mean", "f_std", "a_mean", "a_std")], "holds")


# Models (tested against closed forms in numpy as well) --------------------------------------------


def _rounded(df):
    """Errors of fits to six digits, which all engines agree on."""
    return df.withColumns({c: F.round(c, 6) for c in ("mae", "baseline_mae")})


def _errors_sql(by: str, source: str, more: str = "") -> str:
    """``metrics.mae`` of rows (by, y, pred)."""
    return f"""SELECT {by}, n, round(avg(abs(pred - y)), 6) AS mae, round(avg(abs(m - y)), 6) AS baseline_mae{more} FROM (SELECT *, avg(y) OVER w AS m, count(*) OVER w AS n FROM ({source}) WINDOW w AS (PARTITION BY {by})) GROUP BY {by}, n"""


_TRAIN = "SELECT vec_id AS id, {x} AS x, y FROM vectors WHERE split = 'train'"


@query(with_views(_errors_sql("split", "SELECT split, y, list_dot_product(v, w) + r_model.b AS pred FROM vectors, r_model"), "vectors", more=f"train AS ({_TRAIN.format(x='v')}), {fits.ridge('r', 'train', [1.0])}"))
def ridge_fit(spark, d):
    v = V.vectors(spark, d)
    model = models.fit_ridge(v.where("split = 'train'"), "v", "y")
    return _rounded(metrics.mae(v.withColumn("pred", model.predict("v")), ["split"]))


@query(
    with_views(
        _errors_sql("split", "SELECT split, y, list_dot_product(z, w) + b AS pred FROM scaled, r_best", ", (SELECT alpha FROM r_best) AS alpha"),
        "vectors",
        more=f"""
parts AS (SELECT vec_id, split, y, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM vectors),
scales AS (SELECT j, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM parts WHERE split = 'train' GROUP BY j),
scaled AS (SELECT vec_id, split, y, list((x - m) / s ORDER BY j) AS z FROM parts JOIN scales USING (j) GROUP BY ALL),
train AS (SELECT vec_id AS id, z AS x, y FROM scaled WHERE split = 'train'), {fits.ridge("r", "train", models.ALPHAS)}""",
    )
)
def ridge_loo(spark, d):
    v = V.vectors(spark, d)
    scaler = models.fit_scaler(v.where("split = 'train'"), "v")
    v = v.withColumn("z", scaler.apply("v"))
    model, alpha, _ = models.fit_ridge_loo(v.where("split = 'train'"), "z", "y")
    return _rounded(metrics.mae(v.withColumn("pred", model.predict("z")), ["split"])).withColumn("alpha", F.lit(alpha))


_PROBES = 4


@query(
    with_views(
        _errors_sql(
            "probe",
            """SELECT 'single' AS probe, any_value(y) AS y, avg(list_dot_product(x, w) + b) AS pred FROM clip_rows, s_best WHERE key % 10 >= 7 GROUP BY key
            UNION ALL SELECT 'pooled', y, list_dot_product(x, w) + b FROM pooled, p_best WHERE id % 10 >= 7""",
        ),
        "vectors",
        more=f"""
goals AS (SELECT key, CAST(min(label) * 8 AS DOUBLE) AS y FROM vectors GROUP BY key),
clip_rows AS (SELECT vec_id AS id, key, v AS x, goals.y FROM vectors JOIN goals USING (key) WHERE vec_id % 6 <> 1),
pooled AS (SELECT key AS id, y, list(CAST(CAST(m AS FLOAT) AS DOUBLE) ORDER BY j) AS x
  FROM (SELECT key, y, j, avg(x) AS m FROM (SELECT key, y, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM clip_rows) GROUP BY ALL) GROUP BY key, y),
s_train AS (SELECT * FROM clip_rows WHERE key % 10 < 7), p_train AS (SELECT * FROM pooled WHERE id % 10 < 7),
{fits.ridge("s", "s_train", models.ALPHAS)}, {fits.ridge("p", "p_train", models.ALPHAS)}""",
    )
)
def pooled_probe(spark, d):
    """Ridge probes fitted on single clips and on pooled studies, scored on the same studies: (probe, n, mae, baseline_mae)."""
    v = V.vectors(spark, d)
    goals = v.groupBy("key").agg((F.min("label") * 8.0).alias("y"))
    clips = V.clips(spark, d).join(goals, "key")
    out = models.pooled_and_single(clips.where("key % 10 < 7"), clips.where("key % 10 >= 7"), "key", "v", "y")
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("probe"), F.col(c).alias("pred")) for c in ("single", "pooled")]))
    return _rounded(metrics.mae(out.select("y", told.alias("t")).select("y", "t.*"), ["probe"]))


@query(
    with_views(
        """
SELECT probe, round(first, 9) AS first, round(second, 9) AS second, round(second - first, 9) AS difference, CASE WHEN second - first < 0 THEN 'second' WHEN second - first > 0 THEN 'first' ELSE 'equal' END AS better
FROM (SELECT probe, avg(abs(x * 64 + 36 - y)) AS first FROM clip_rows GROUP BY probe) JOIN (SELECT probe, avg(abs(x * 64 + 36 - y)) AS second FROM pooled GROUP BY probe) USING (probe)""",
        "vectors",
        more=f"""
goals AS (SELECT key, CAST(min(label) * 8 AS DOUBLE) AS y FROM vectors GROUP BY key),
clip_rows AS (SELECT key, goals.y, 'element ' || i AS probe, v[i] AS x FROM vectors JOIN goals USING (key), range(1, {_PROBES + 1}) r(i) WHERE vec_id % 6 <> 1),
pooled AS (SELECT key, y, probe, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS x FROM clip_rows GROUP BY ALL)""",
    )
)
def pooling_ablation(spark, d):
    """The same probes on single clips and on the pooled vector of their study."""
    v = V.vectors(spark, d)
    goals = v.groupBy("key").agg((F.min("label") * 8.0).alias("y"))
    clips = V.clips(spark, d).where("v is not null").join(goals, "key")
    pooled = pooling.mean_pool(V.clips(spark, d), ["key"], "v", "v").join(goals, "key")

    def probed(rows):
        told = F.explode(F.array(*[F.struct(F.lit(f"element {i + 1}").alias("probe"), (F.col("v")[i].cast("double") * 64 + 36).alias("pred")) for i in range(_PROBES)]))
        return metrics.mae(rows.select("y", told.alias("p")).select("y", "p.*"), ["probe"])

    out = models.ablation(probed(clips), probed(pooled))
    return out.select("probe", *[F.round(c, 9).alias(c) for c in ("first", "second", "difference")], "better")


@query(
    with_views(
        """
SELECT split, count(*) AS n, round(avg(abs(my + w * (x - mx) - y)), 6) AS mae FROM (SELECT *, v[1] AS x FROM vectors),
  (SELECT avg(v[1]) AS mx, avg(y) AS my, (avg(v[1] * y) - avg(v[1]) * avg(y)) * count(*) / ((avg(v[1] * v[1]) - avg(v[1]) * avg(v[1])) * count(*) + 1) AS w FROM vectors WHERE split = 'train')
GROUP BY split""",
        "vectors",
    )
)
def ridge_one(spark, d):
    """Ridge on one feature, where the closed form fits in SQL."""
    v = V.vectors(spark, d).withColumn("x", F.slice("v", 1, 1))
    model = models.fit_ridge(v.where("split = 'train'"), "x", "y", 1.0)
    return metrics.mae(v.withColumn("pred", model.predict("x")), ["split"]).select("split", "n", F.round("mae", 6).alias("mae"))


@query(
    with_views(
        _errors_sql(
            "split, condition",
            """SELECT split, y, unnest(['full', 'b_dropped', 'a_dropped']) AS condition, unnest([of_a + of_b + b, of_a + b, of_b + b]) AS pred
            FROM (SELECT split, y, r_model.b, list_dot_product(vectors.a, w[:32]) AS of_a, list_dot_product(vectors.b, w[33:]) AS of_b FROM vectors, r_model)""",
        ),
        "vectors",
        more=f"train AS ({_TRAIN.format(x='a || b')}), {fits.ridge('r', 'train', [1.0])}",
    )
)
def fusion_conditions(spark, d):
    v = V.vectors(spark, d)
    model = models.fit_fusion(v.where("split = 'train'"), {"a": "a", "b": "b"}, "y")
    scored = models.score_conditions(v, model, {"a": "a", "b": "b"}, ["vec_id", "split", "y"])
    return _rounded(metrics.mae(scored, ["split", "condition"]))


@query()
def logistic_cv(spark, d):
    v = V.vectors(spark, d).withColumn("gate", F.col("label") <= 4)
    model, c = models.fit_logistic_cv(v.where("split = 'train'"), "v", "gate", "vec_id")
    return metrics.auroc(v.withColumn("score", model.predict("v")), ["split"]).withColumn("c", F.lit(c))


_TARGETS = {"low": "label <= 4", "least": "label <= 1", "odd": "label % 2 = 1"}


@query()
def multi_target(spark, d):
    """A classifier per target on one scaled vector, all fitted together; the second target is unknown for some rows."""
    v = V.vectors(spark, d).withColumns({t: F.expr(f"CASE WHEN '{t}' <> 'least' OR vec_id % 7 <> 0 THEN {e} END") for t, e in _TARGETS.items()})
    train = v.where("split = 'train'")
    scaled = v.withColumn("z", models.fit_scaler(train, "v").apply("v"))
    found = models.fit_targets(scaled.where("split = 'train'"), "z", list(_TARGETS), "vec_id")
    told = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("c"), F.col(t).alias("gate"), m.predict("z").alias("score")) for t, (m, c) in found.items()]))
    return metrics.auroc(scaled.select("split", told.alias("t")).select("split", "t.*"), ["target", "c", "split"])


@query(
    with_views(
        "SELECT vec_id, gate, round(1 / (1 + exp(-(s * a + b))), 6) AS p, false AS in_sample FROM scored, f_model WHERE split = 'test'",
        "vectors",
        more=f"""
scored AS (SELECT vec_id, split, label <= 4 AS gate, list_dot_product(a, {V.WEIGHTS_A}::DOUBLE[]) AS s FROM vectors),
fit_rows AS (SELECT s, gate::INT AS t FROM scored WHERE split = 'val'), {fits.platt("f", "fit_rows")}""",
    )
)
def platt(spark, d):
    v = V.vectors(spark, d).withColumn("gate", F.col("label") <= 4).withColumn("s", S.weighted("a", V.WEIGHTS_A))
    out = models.platt(v.where("split = 'val'"), v.where("split = 'test'"), "s", "gate")
    return out.select("vec_id", "gate", F.round("p", 6).alias("p"), "in_sample")


@query(
    with_views(
        _errors_sql("probe", " UNION ALL ".join(f"SELECT '{n}' AS probe, y, list_dot_product({x}, w) + {p}_model.b AS pred FROM vectors, {p}_model WHERE split = 'test'" for n, x, p in (("a", "a", "p"), ("b", "vectors.b", "q"), ("concat", "v", "r")))),
        "vectors",
        more=", ".join(f"{p}_train AS ({_TRAIN.format(x=x)}), {fits.ridge(p, f'{p}_train', [1.0])}" for x, p in (("a", "p"), ("b", "q"), ("v", "r"))),
    )
)
def probe_comparison(spark, d):
    v = V.vectors(spark, d)
    return _rounded(models.compare_probes(v.where("split = 'train'"), v.where("split = 'test'"), {"a": "a", "b": "b"}, "y"))


# Text --------------------------------------------------------------------------------------------


def _relevant_sql() -> str:
    test = " OR ".join(f"contains(lower(x), '{k}')" for k in text.KEYWORDS)
    return f"list_filter(string_split(text, chr(10)), lambda x: {test})"


@query(f"SELECT doc_id, len(r) AS n_lines, CASE WHEN len(r) > 0 THEN md5(array_to_string(list_transform(r, lambda x: trim(x)), ' ')) END AS digest FROM (SELECT doc_id, {_relevant_sql()} AS r FROM documents)")
def keyword_lines(spark, d):
    docs = V._t(spark, d, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: S.any_of([F.lower(x).contains(k) for k in text.KEYWORDS]))
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(text.relevant("text").cast("binary")).alias("digest"))


def _note_grades(n: int) -> dict:
    """Grades of the planted findings, worked out by hand: (as, mr, tr, ef)."""
    return [(3, 0, None, None), (None, 2, 0, None), (None, 1, None, 55.0), (3, None, None, 35.0), (None, None, None, 60.0), (3, None, 2, None), (None, 0, None, None), (None, None, None, None)][n]


def _note_evidence(n: int) -> tuple:
    """The sentences that give the planted findings their grades: (as, mr, tr)."""
    q = text.QUANTITATIVE
    return [
        ("echo: severe aortic stenosis is seen", "no mitral regurgitation", None), (None, "mild to moderate mitral regurgitation", "trace tricuspid regurgitation"), (None, "mitral valve insufficiency", None), (q, None, None),
        (None, None, None), (q, None, "mean gradient of 45 mm hg, moderate tricuspid insufficiency"), (None, "the mitral valve is normal, without mitral regurgitation", None), (None, None, None),
    ][n]


_literal = lambda x: "NULL" if x is None else repr(x)
_GRADES = "grades(k, g_as, g_mr, g_tr, ef, e_as, e_mr, e_tr) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, (*_note_grades(i), *_note_evidence(i))))})" for i in range(8)) + ")"
_EVIDENCE = ", ".join(f"CASE WHEN a.g_{x} >= coalesce(b.g_{x}, -1) THEN a.e_{x} ELSE b.e_{x} END AS {x}_evidence" for x in ("mr", "tr"))
_GRADED = f"""{_GRADES},
graded AS (SELECT doc_id AS note_id, doc_id % 300 AS subject_id, CAST(greatest(a.g_as, b.g_as) AS INT) AS as_grade, CAST(greatest(a.g_mr, b.g_mr) AS INT) AS mr_grade, CAST(greatest(a.g_tr, b.g_tr) AS INT) AS tr_grade,
  CASE WHEN '{text.QUANTITATIVE}' IN (a.e_as, b.e_as) THEN '{text.QUANTITATIVE}' WHEN a.g_as >= coalesce(b.g_as, -1) THEN a.e_as ELSE b.e_as END AS as_evidence, {_EVIDENCE},
  CAST(coalesce(a.ef, b.ef) AS DOUBLE) AS ef_percent
  FROM documents JOIN grades a ON doc_id % 8 = a.k JOIN grades b ON doc_id // 8 % 8 = b.k)"""
_FOUND = ["note_id", "as_grade", "mr_grade", "tr_grade", "as_evidence", "mr_evidence", "tr_evidence", "ef_percent"]


@query(f"WITH {_GRADED} SELECT {', '.join(_FOUND)} FROM graded")
def findings(spark, d):
    return text.extract_findings(V.notes(spark, d)).select(*_FOUND)


_FLAGS = ", ".join(f"max(CAST(code IN ({', '.join(repr(x) for x in c)}) AS INT)) AS has_{n}" for n, c in text.CODES.items())


@query(with_views(f"SELECT stay_id, {_FLAGS} FROM diagnoses GROUP BY stay_id", "diagnoses"))
def code_flags(spark, d):
    return text.code_flags(V.diagnoses(spark, d))


def _gated(spark, d):
    rows = text.extract_findings(V.notes(spark, d)).withColumn("stay_id", F.col("note_id")).join(text.code_flags(V.diagnoses(spark, d)), "stay_id", "left")
    return text.gates(rows)


_GATED = f"""{_GRADED}, flags AS (SELECT stay_id AS note_id, {_FLAGS} FROM diagnoses GROUP BY 1),
gated AS (SELECT *, coalesce(as_grade >= 2, false) OR coalesce(has_as, 0) = 1 AS as_gate, coalesce(mr_grade >= 2, false) OR coalesce(has_mr, 0) = 1 AS mr_gate, coalesce(tr_grade >= 2, false) OR coalesce(has_tr, 0) = 1 AS tr_gate,
  as_grade IS NOT NULL OR mr_grade IS NOT NULL OR tr_grade IS NOT NULL OR greatest(has_as, has_mr, has_tr) = 1 AS any_label FROM graded LEFT JOIN flags USING (note_id))"""


@query(with_views("SELECT note_id, as_gate, mr_gate, tr_gate FROM gated WHERE any_label", "diagnoses", more=_GATED))
def note_gates(spark, d):
    return _gated(spark, d).where("any_label").select("note_id", "as_gate", "mr_gate", "tr_gate")


_SUMMARY = ", ".join(f"count(*) FILTER ({n}_gate) AS {n}_positive, " + ", ".join(f"count(*) FILTER ({n}_grade = {g}) AS {n}_grade_{g}" for g in range(4)) for n in ("as", "mr", "tr"))


@query(with_views(f"SELECT count(*) AS n_notes, count(DISTINCT subject_id) AS n_patients, {_SUMMARY} FROM gated WHERE any_label", "diagnoses", more=_GATED))
def extraction_summary(spark, d):
    return text.extraction_summary(_gated(spark, d).where("any_label"), "subject_id")


@query(
    with_views(
        f"""
SELECT note_id, stay_id, record_id, {', '.join(f'coalesce(has_{n}, 0) AS has_{n}' for n in text.CODES)} FROM notes n
JOIN (SELECT stay_id, record_id FROM stays s JOIN records r ON s.subject_id = r.subject_id AND record_ts BETWEEN start_ts AND end_ts
      QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY abs(date_diff('second', start_ts, record_ts)), record_ts, record_id) = 1) p ON n.note_id = p.stay_id
LEFT JOIN (SELECT stay_id, {_FLAGS} FROM diagnoses GROUP BY stay_id) f USING (stay_id)
WHERE contains(lower(text), 'aortic valve') OR contains(lower(text), 'mitral valve') OR contains(lower(text), 'tricuspid valve') OR contains(lower(text), 'echocardiogram')""",
        "notes",
        "stays",
        "records",
        "diagnoses",
    )
)
def notes_with_records(spark, d):
    near = pairing.nearest_to_start(V.stays(spark, d), V.records(spark, d), on="subject_id", span_id="stay_id", start="start_ts", end="end_ts", record_ts="record_ts", record_id="record_id")
    notes = V.notes(spark, d).withColumn("stay_id", F.col("note_id"))
    out = text.notes_with_records(notes, near.select("stay_id", "record_id"), text.code_flags(V.diagnoses(spark, d)))
    return out.select("note_id", "stay_id", "record_id", *[f"has_{n}" for n in text.CODES])


@query(with_views("SELECT note_id, [as_gate, mr_gate, tr_gate] AS flags, [coalesce(as_grade, -1), coalesce(mr_grade, -1), coalesce(tr_grade, -1)] AS grades FROM gated", "diagnoses", more=_GATED))
def label_arrays(spark, d):
    flags, grades = S.label_array(["as_gate", "mr_gate", "tr_gate"], ["as_grade", "mr_grade", "tr_grade"])
    return _gated(spark, d).select("note_id", flags.alias("flags"), grades.alias("grades"))


_MASKED = "CASE WHEN vec_id % 3 <> 0 AND vec_id % 7 <> 0 THEN a ELSE list_transform(range(32), lambda x: CAST(0 AS DOUBLE)) END"


@query(with_views(f"SELECT vec_id, vec_id % 3 <> 0 AND vec_id % 7 <> 0 AS has_a, {_MASKED} AS a, list_sum(b) / 32 AS mean_b, 8 AS n_tokens FROM vectors", "vectors"))
def modality_masks(spark, d):
    rows = V.vectors(spark, d).withColumn("a", F.expr("CASE WHEN vec_id % 7 <> 0 THEN a END"))
    keep = F.expr("vec_id % 3 <> 0")
    out = rows.select("vec_id", (keep & F.col("a").isNotNull()).alias("has_a"), S.masked("a", keep, 32).cast("array<double>").alias("a"), S.mean_of("b").alias("mean_b"), S.tile("b", 8).alias("tokens"))
    return out.select("vec_id", "has_a", "a", "mean_b", F.size("tokens").alias("n_tokens"))


@query("SELECT o_orderkey, vec_id, label FROM (SELECT o_orderkey, o_custkey FROM orders) LEFT JOIN (SELECT vec_id, label FROM embeddings) ON o_custkey = vec_id")
def join_canonical(spark, d):
    left = V._t(spark, d, "orders").selectExpr("o_orderkey", "concat('files/p1/s', o_custkey) AS ref")
    right = V._t(spark, d, "embeddings").selectExpr("concat('x/rec', vec_id) AS ref2", "vec_id", "label")
    return joins.join_canonical(left, right, "ref", "ref2").select("o_orderkey", "vec_id", "label")


@query(with_views("SELECT o_orderkey AS study, o_custkey AS record, v.a[1] AS a1, w.b[1] AS b1 FROM orders JOIN vectors v ON o_orderkey = v.vec_id JOIN vectors w ON o_custkey = w.vec_id", "vectors"))
def join_three(spark, d):
    v = V.vectors(spark, d)
    rows = V._t(spark, d, "orders").selectExpr("o_orderkey AS study", "o_custkey AS record")
    out = joins.join_three(rows, v.selectExpr("vec_id AS study", "a"), v.selectExpr("vec_id AS record", "b"), "study", "record")
    return out.select("study", "record", F.col("a")[0].alias("a1"), F.col("b")[0].alias("b1"))


@query("SELECT o.o_orderkey, e.event_id FROM orders o LEFT JOIN events e ON o.o_custkey = e.user_id AND e.event_type = 'signup'")
def subject_fanout(spark, d):
    left = V._t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS subject_id")
    right = V._t(spark, d, "events").where("event_type = 'signup'").selectExpr("user_id AS subject_id", "event_id")
    return joins.join_m2o(left, right, ["subject_id"], allow_fanout=True).select("o_orderkey", "event_id")


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return joins.duplicate_keys(V._t(spark, d, "orders").selectExpr("o_custkey AS key"), ["key"])


@query(with_views("SELECT study_id, record_id, label FROM manifest WHERE split = 'train' AND a IS NOT NULL AND b IS NOT NULL", "vectors", more=_MANIFEST))
def split_view(spark, d):
    out = tables.split_view(_manifest(spark, d), "train", ["a", "b"], ["study_id", "record_id", "label"])
    return out.select("meta.study_id", "meta.record_id", "meta.label")


@query(with_views("SELECT CAST(sum(CAST('0x' || substr(md5(i::VARCHAR), 1, 12) AS BIGINT)) AS VARCHAR) AS sum_hash, count(*) AS n FROM (SELECT DISTINCT subject_id AS i FROM studies)", "studies"))
def set_fingerprint(spark, d):
    return splits.fingerprint(V.studies(spark, d), "subject_id")


# Tables and columns -------------------------------------------------------------------------------


_STATUS = "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY o_orderstatus"


@query(f"SELECT kind, t.* FROM ({_STATUS}) t, (VALUES ('csv'), ('parquet')) k(kind)")
def table_round_trip(spark, d):
    """Tables written and read by extension."""
    rows, out = V._t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), None
    for kind in ("csv", "parquet"):
        path = f"{cache.scratch(spark, 'table')}.{kind}"
        tables.write_table(rows, path)
        one = tables.read_table(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_linenumber AS line, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def shards_round_trip(spark, d):
    """A table written in folders, read from all of them with two columns."""
    path = cache.scratch(spark, "shards")
    rows = V._t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber AS line", "cast(l_quantity AS double) AS quantity", "concat('f', l_returnflag) AS folder")
    tables.write_shards(rows, path, order="l_orderkey")
    return tables.read_parquet(spark, path, ["line", "quantity"]).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def summary_round_trip(spark, d):
    """A small result written as JSON lines and read again."""
    path = cache.scratch(spark, "summary")
    rows = V._t(spark, d, "customer").join(V._t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tables.write_summary(rows.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("nation string, n long").json(path)


@query("SELECT count(*) AS rows, CAST(64 AS INT) AS dim, '' AS missing, 'split' AS missing_recommended, true AS ready FROM embeddings")
def readiness(spark, d):
    """Whether a table can be used."""
    told = tables.readiness(V._t(spark, d, "embeddings"), ["vec_id", "embedding"], ["label", "split"], "embedding")
    row = (told["rows"], told["dim"], ",".join(told["missing"]), ",".join(told["missing_recommended"]), told["ready"])
    return spark.createDataFrame([row], "rows long, dim int, missing string, missing_recommended string, ready boolean")


@query(
    with_views(
        "SELECT subject_id, example_id AS study_id, example_id AS record_id, y AS label, CAST(NULL AS VARCHAR) AS split, CAST(NULL AS VARCHAR) AS age, source AS sex, CAST(NULL AS VARCHAR) AS race, CASE WHEN example_id % 3 = 0 THEN y <= 40 ELSE gate END AS gate FROM examples", "examples"
    )
)
def normalize_cohort(spark, d):
    """Columns found by candidate names in any case; a missing gate comes from the label."""
    rows = V.examples(spark, d).selectExpr("subject_id AS Subject", "example_id AS STUDY_ID", "example_id AS rec", "y AS Value", "source AS gender", "CASE WHEN example_id % 3 <> 0 THEN gate END AS gate")
    return columns.metadata(columns.normalize_cohort(rows, record_id="rec"), ("subject_id", "study_id", "record_id", "label", "split", "age", "sex", "race", "gate"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS ve0, CAST(embedding[2] AS DOUBLE) AS ve1, CAST(embedding[3] AS DOUBLE) AS ve2, CAST(3 AS INT) AS dim, CAST(2 AS INT) AS tokens, embedding[1] = embedding[1] AS same FROM embeddings")
def spread_and_tile(spark, d):
    """A vector as columns, and as repeated tokens."""
    v = V._t(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("e"))
    dim = columns.vector_dim(v, "e")
    rows = columns.spread(v.withColumn("t", S.tile("e", 2)), "e", dim)
    same = (F.col("t")[0][0] == F.col("ve0")) & (F.col("t")[0] == F.col("t")[1])
    return rows.select("vec_id", *[F.col(f"ve{i}").cast("double").alias(f"ve{i}") for i in range(3)], F.lit(dim).alias("dim"), F.size("t").alias("tokens"), same.alias("same"))


@query(with_views("SELECT record_id, 's' || record_id || '/rec.mp4' AS key FROM records", "records").replace("'/rec.mp4' AS key", "'/rec.mp4' AS key"))
def path_key(spark, d):
    return V.records(spark, d).select("record_id", S.path_key(F.replace("path", F.lit("rec.dat"), F.lit("rec.dcm"))).alias("key")).select("record_id", F.substring_index("key", "/", -2).alias("key"))


@query(
    with_views(
        "SELECT example_id, condition, CASE condition WHEN 'full' THEN 0 WHEN 'a_dropped' THEN 1 ELSE 2 END AS place, CASE WHEN y >= 8 THEN 64 / y END AS ratio FROM predictions",
        "predictions",
    )
)
def report_values(spark, d):
    """The order of conditions in reports, and infinite ratios as null."""
    rows = V.predictions(spark, d)
    ratio = F.when(F.col("y") >= 8, 64 / F.col("y")).otherwise(F.lit(float("inf")))
    return rows.select("example_id", "condition", S.condition_order("condition").alias("place"), S.null_safe(ratio).alias("ratio"))


@query("SELECT CASE l_returnflag WHEN 'R' THEN 'maybe' WHEN 'A' THEN 'x1' END AS value, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def bad_booleans(spark, d):
    """Texts that are no boolean, with counts."""
    told = F.when(F.col("l_returnflag") == "R", "maybe").when(F.col("l_returnflag") == "A", "x1").otherwise(F.when(F.col("l_linenumber") > 2, "yes"))
    return filters.bad_booleans(V._t(spark, d, "lineitem").select(told.alias("flag")), "flag")


@query(with_views("SELECT vec_id, split FROM vectors", "vectors"))
def checked_splits(spark, d):
    """Rows whose splits and conditions have passed their checks."""
    rows = V.vectors(spark, d).select("vec_id", "split")
    filters.check_splits(rows)
    filters.check_conditions(["full", "b_dropped"])
    return filters.require_vectors(rows, ["vec_id"])


@query(with_views("SELECT example_id, max(y) AS y, CAST(count(*) AS INT) AS n FROM predictions GROUP BY example_id", "predictions"))
def aligned_predictions(spark, d):
    """Predictions that hold the same examples and labels under every condition."""
    rows = V.predictions(spark, d)
    joins.check_aligned(rows)
    return rows.groupBy("example_id").agg(F.max("y").alias("y"), F.count(F.lit(1)).cast("int").alias("n"))
