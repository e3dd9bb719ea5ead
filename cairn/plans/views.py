"""The operators' inputs as views on the star-schema tables: Spark frames, and the same views in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["lvef", "biplane_lvef", "rest_lvef", "rest_biplane_lvef", "lvef_3d", "lvef_upper", "rest_lvef_upper"]
RACES = ["WHITE - OTHER", "BLACK/CARIBBEAN", "asian", "HISPANIC/LATINO", "UNKNOWN", "PATIENT DECLINED TO ANSWER", "Portuguese"]
CONDITIONS = ("full", "a_dropped", "b_dropped")
#: Fixed weights of the linear scorer, multiples of 1/8.
WEIGHTS_A = [((i * 7) % 11 - 5) / 8 for i in range(32)]
WEIGHTS_B = [((i * 5) % 13 - 6) / 8 for i in range(32)]
QUERY = [((i * 3) % 7 - 3) / 8 for i in range(8)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def studies(spark, d):
    return _t(spark, d, "orders").selectExpr(
        "o_orderkey AS study_id", "o_custkey AS subject_id", "timestampadd(MINUTE, cast(o_orderkey * 37 % 43200 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts", "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS measurement_id"
    )


def measurements(spark, d):
    names = ", ".join(f"'{n}'" for n in NAMES)
    return _t(spark, d, "lineitem").selectExpr(
        "l_orderkey AS measurement_id", f"array({names})[cast((l_orderkey + l_linenumber) % 7 AS int)] AS name", "CASE WHEN l_partkey % 11 = 0 THEN 'n/a' ELSE concat(cast(cast(l_quantity AS int) AS string), ' %') END AS result", "l_shipdate AS ts"
    )


def records(spark, d, kind="view"):
    return _t(spark, d, "events").where(F.col("event_type") == kind).selectExpr(
        "event_id AS record_id", "user_id AS subject_id", "ts AS record_ts", "concat('files/p', cast(10 + user_id % 10 AS string), '/p', cast(user_id AS string), '/s', cast(event_id AS string), '/rec.dat') AS path"
    )


def stays(spark, d):
    return _t(spark, d, "events").where("event_type = 'signup'").selectExpr("event_id AS stay_id", "user_id AS subject_id", "ts AS start_ts", "timestampadd(SECOND, cast(floor(value * 3600) AS int), ts) AS end_ts")


def files(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("study_id"))


def patients(spark, d):
    races = ", ".join(f"'{r}'" for r in RACES)
    nation = _t(spark, d, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS nation")
    return _t(spark, d, "customer").join(nation, "c_nationkey", "left").selectExpr(
        "c_custkey AS subject_id", "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex", "CASE WHEN c_custkey % 40 <> 0 THEN cast(10 + c_custkey % 90 AS int) END AS age",
        f"CASE WHEN c_custkey % 23 <> 0 THEN array({races})[cast(c_custkey % 7 AS int)] END AS race", "c_mktsegment AS segment", "nation",
    )


def examples(spark, d):
    """One row per study: label, gate and predictions with each condition; all values are multiples of 1/16."""
    rows = _t(spark, d, "orders").selectExpr("o_orderkey AS example_id", "o_custkey AS subject_id", "o_orderpriority AS source", "cast(floor(o_totalprice / 1000) % 80 AS double) + cast(o_custkey % 8 AS double) / 8 AS y")
    return rows.selectExpr(
        "*", "y <= 40 AS gate", "y + cast((example_id * 31 + subject_id * 17) % 65 - 32 AS double) / 4 AS full", "40 + (y - 40) / 4 + cast((example_id * 13 + subject_id) % 49 - 24 AS double) / 2 AS a_dropped",
        "y / 2 + 22 + cast((example_id * 7 + subject_id * 3) % 81 - 40 AS double) / 4 AS b_dropped",
    )


def predictions(spark, d):
    """(example_id, subject_id, source, y, gate, condition, pred, score, p), long."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("pred")) for c in CONDITIONS]))
    rows = examples(spark, d).select("example_id", "subject_id", "source", "y", "gate", pairs.alias("c")).select("example_id", "subject_id", "source", "y", "gate", "c.*")
    return rows.withColumn("score", -F.col("pred")).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (96 - F.col("pred")) / 128)))


def strata(spark, d):
    from cairn.functions import scalars as S

    return patients(spark, d).select("subject_id", "sex", S.age_band("age").alias("age_band"), S.race_group("race").alias("race"))


def vectors(spark, d):
    """Vectors rounded to multiples of 1/1024, with halves a and b, a key, a subject and a split."""
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024 + 0.5) / 1024).alias("v"))
    return v.select(
        "vec_id", "label", "v", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"), F.expr("vec_id % 97").alias("key"), F.expr("vec_id % 60").alias("subject_id"),
        F.expr("CASE WHEN vec_id % 60 < 40 THEN 'train' WHEN vec_id % 60 < 48 THEN 'val' ELSE 'test' END").alias("split"), F.expr("cast(label * 8 + vec_id % 5 AS double)").alias("y"),
    )


def clips(spark, d):
    """Clips of a study: the vectors of a key, in id order, some of them missing."""
    return vectors(spark, d).select("key", "vec_id", F.expr("CASE WHEN vec_id % 6 <> 1 THEN v END").alias("v"))


NOTES = (
    "Echo: severe aortic stenosis is seen. No mitral regurgitation.",
    "trace tricuspid regurgitation; mild to moderate mitral regurgitation.",
    "Father had aortic stenosis. LVEF is 55%. mitral valve insufficiency.",
    "aortic valve area is 0.8 cm2. ejection fraction of 35%.",
    "possible aortic sclerosis. lvef > 55%.",
    "mean gradient of 45 mm Hg, moderate tricuspid insufficiency.",
    "the mitral valve is normal, without mitral regurgitation.",
    "discharged in good health.",
)


def notes(spark, d):
    """The documents as notes: the whole text of each, with two of the findings planted in it."""
    texts = ", ".join("'" + n + "'" for n in NOTES)
    return _t(spark, d, "documents").selectExpr(
        "doc_id AS note_id", "doc_id % 300 AS subject_id", f"concat(array({texts})[cast(doc_id % 8 AS int)], '\\n', coalesce(text, ''), '\\nseen by clerk.\\n. ', array({texts})[cast(doc_id div 8 % 8 AS int)]) AS text"
    )


def diagnoses(spark, d):
    codes = ", ".join(f"'{c}'" for c in ("I350", "4240", "I361", "I071", "4019", "3950", "25000"))
    return _t(spark, d, "lineitem").selectExpr("l_orderkey AS stay_id", f"array({codes})[cast((l_partkey + l_linenumber) % 7 AS int)] AS code")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


SQL = {
    "studies": "SELECT o_orderkey AS study_id, o_custkey AS subject_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(o_orderkey * 37 % 43200 AS INT)) AS ts, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS measurement_id FROM orders",
    "measurements": f"SELECT l_orderkey AS measurement_id, {_list(NAMES)}[CAST((l_orderkey + l_linenumber) % 7 AS INT) + 1] AS name, CASE WHEN l_partkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' %' END AS result, l_shipdate AS ts FROM lineitem",
    "records": "SELECT event_id AS record_id, user_id AS subject_id, ts AS record_ts, 'files/p' || (10 + user_id % 10) || '/p' || user_id || '/s' || event_id || '/rec.dat' AS path FROM events WHERE event_type = 'view'",
    "stays": "SELECT event_id AS stay_id, user_id AS subject_id, ts AS start_ts, ts + to_seconds(CAST(floor(value * 3600) AS INT)) AS end_ts FROM events WHERE event_type = 'signup'",
    "file_counts": "SELECT l_orderkey AS study_id, count(*) AS n_files FROM lineitem GROUP BY 1",
    "patients": f"SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, CASE WHEN c_custkey % 40 <> 0 THEN CAST(10 + c_custkey % 90 AS INT) END AS age, CASE WHEN c_custkey % 23 <> 0 THEN {_list(RACES)}[CAST(c_custkey % 7 AS INT) + 1] END AS race, c_mktsegment AS segment, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "examples": "SELECT *, y <= 40 AS gate, y + CAST((example_id * 31 + subject_id * 17) % 65 - 32 AS DOUBLE) / 4 AS full_, 40 + (y - 40) / 4 + CAST((example_id * 13 + subject_id) % 49 - 24 AS DOUBLE) / 2 AS a_dropped, y / 2 + 22 + CAST((example_id * 7 + subject_id * 3) % 81 - 40 AS DOUBLE) / 4 AS b_dropped FROM (SELECT o_orderkey AS example_id, o_custkey AS subject_id, o_orderpriority AS source, CAST(floor(o_totalprice / 1000) AS BIGINT) % 80 + CAST(o_custkey % 8 AS DOUBLE) / 8 AS y FROM orders)",
    "predictions": "SELECT *, -pred AS score, greatest(0.0, least(1.0, (96 - pred) / 128)) AS p FROM (SELECT example_id, subject_id, source, y, gate, 'full' AS condition, full_ AS pred FROM examples UNION ALL SELECT example_id, subject_id, source, y, gate, 'a_dropped', a_dropped FROM examples UNION ALL SELECT example_id, subject_id, source, y, gate, 'b_dropped', b_dropped FROM examples)",
    "strata": "SELECT subject_id, sex, CASE WHEN age >= 90 THEN '90+' WHEN age >= 75 THEN '75-89' WHEN age >= 65 THEN '65-74' WHEN age >= 55 THEN '55-64' WHEN age >= 40 THEN '40-54' WHEN age >= 18 THEN '18-39' END AS age_band, CASE WHEN upper(race) LIKE 'WHITE%' THEN 'WHITE' WHEN upper(race) LIKE 'BLACK%' THEN 'BLACK' WHEN upper(race) LIKE 'ASIAN%' THEN 'ASIAN' WHEN upper(race) LIKE '%HISPANIC%' THEN 'HISPANIC' ELSE 'OTHER/UNKNOWN' END AS race FROM patients",
    "vectors": "SELECT *, v[1:32] AS a, v[33:64] AS b, vec_id % 97 AS key, vec_id % 60 AS subject_id, CASE WHEN vec_id % 60 < 40 THEN 'train' WHEN vec_id % 60 < 48 THEN 'val' ELSE 'test' END AS split, CAST(label * 8 + vec_id % 5 AS DOUBLE) AS y FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024 + 0.5) / 1024) AS v FROM embeddings)",
    "clips": "SELECT key, vec_id, CASE WHEN vec_id % 6 <> 1 THEN v END AS v FROM vectors",
    "notes": "SELECT doc_id AS note_id, doc_id % 300 AS subject_id, {n}[CAST(doc_id % 8 AS INT) + 1] || chr(10) || coalesce(text, '') || chr(10) || 'seen by clerk.' || chr(10) || '. ' || {n}[CAST(doc_id // 8 % 8 AS INT) + 1] AS text FROM documents".replace("{n}", _list(NOTES)),
    "diagnoses": "SELECT l_orderkey AS stay_id, ['I350', '4240', 'I361', 'I071', '4019', '3950', '25000'][CAST((l_partkey + l_linenumber) % 7 AS INT) + 1] AS code FROM lineitem",
}
_NEEDS = {"predictions": ["examples"], "strata": ["patients"], "clips": ["vectors"]}


def with_views(body: str, *names: str, more: str = "") -> str:
    """A query with the views it names in front; ``more`` may hold recursive ones."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}{',' + chr(10) + more if more else ''}\n{body}"
