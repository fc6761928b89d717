"""Model versions, metrics, gates and stage transitions."""

from pyspark.sql import functions as F

from checks import shapes
from checks.registry import query
from panelgate import sinks, sources
from panelgate.functions.numbers import relative_difference, version_number
from panelgate.operators import metrics, versions as mv
from panelgate.operators.models import score_stored
from panelgate.plans import monitor, validate_and_promote
from panelgate.sources import explode_split_json

_V = "CAST(version AS BIGINT)"


def _newest(stage):
    return f"""
    (SELECT name, version, description, run_id FROM (
       SELECT *, row_number() OVER (PARTITION BY name ORDER BY {_V} DESC) AS rn
       FROM {shapes.VERSIONS} WHERE stage = '{stage}') WHERE rn = 1)"""


@query(f"SELECT * FROM {shapes.VERSIONS} WHERE stage = 'Staging'")
def pf13_in_stage(spark, sf_dir):
    return mv.in_stage(shapes.versions(spark, sf_dir), "Staging")


@query(f"SELECT * FROM {shapes.VERSIONS} WHERE contains(description, 'Already Exported ')")
def pf14_already_exported(spark, sf_dir):
    return mv.already_exported(shapes.versions(spark, sf_dir))


@query(f"SELECT name, version, {_V} AS number FROM {shapes.VERSIONS}")
def pf15_version_number(spark, sf_dir):
    versions = shapes.versions(spark, sf_dir)
    return versions.select("name", "version", version_number("version").alias("number"))


@query(f"""
    SELECT name, CAST(max({_V}) AS VARCHAR) AS version FROM {shapes.VERSIONS}
    WHERE stage = 'None' GROUP BY name HAVING max({_V}) > 0""")
def ag4_latest_version(spark, sf_dir):
    return mv.latest_version(shapes.versions(spark, sf_dir))


@query(f"""
    SELECT name,
           v IS NOT NULL AND NOT contains(coalesce(d, ''), 'Already Exported ') AS should_export,
           coalesce(CAST(v AS VARCHAR), '-1000') AS version,
           CASE WHEN v IS NULL THEN 'error, this model does not have any production stages'
                || ' and should not be exported' ELSE d END AS description
    FROM (SELECT DISTINCT name FROM {shapes.VERSIONS})
    LEFT JOIN (SELECT name, {_V} AS v, description AS d FROM {_newest('Production')})
      USING (name)""")
def ag5_export_candidates(spark, sf_dir):
    return mv.export_candidates(shapes.versions(spark, sf_dir))


@query(f"SELECT name, {_V} AS version FROM {shapes.VERSIONS} WHERE stage = 'Production'")
def ag6_versions_in_stage(spark, sf_dir):
    return mv.versions_in_stage(shapes.versions(spark, sf_dir))


_LATEST = f"""
    (SELECT name, stage, version, description, run_id FROM (
       SELECT *, row_number() OVER (PARTITION BY name, stage ORDER BY {_V} DESC) AS rn
       FROM {shapes.VERSIONS}) WHERE rn = 1)"""


@query(f"SELECT * FROM {_LATEST}")
def ag7_latest_per_stage(spark, sf_dir):
    return mv.latest_per_stage(shapes.versions(spark, sf_dir))


@query(f"SELECT DISTINCT name FROM {shapes.VERSIONS} WHERE stage = 'Production'")
def ag8_models_having_stage(spark, sf_dir):
    return mv.models_having_stage(shapes.versions(spark, sf_dir))


@query(f"""
    SELECT c.name, c.version, l.run_id
    FROM (SELECT name, CAST(max({_V}) AS VARCHAR) AS version FROM {shapes.VERSIONS}
          GROUP BY name
          UNION ALL
          SELECT name, CAST(min({_V}) AS VARCHAR) FROM {shapes.VERSIONS} GROUP BY name) c
    LEFT JOIN {_LATEST} l USING (name, version)""")
def jn1_run_ids(spark, sf_dir):
    versions = shapes.versions(spark, sf_dir)
    number = version_number("version")
    ends = versions.groupBy("name").agg(F.max(number).alias("hi"), F.min(number).alias("lo"))
    candidates = ends.select(
        "name", F.explode(F.array("hi", "lo").cast("array<string>")).alias("version")
    )
    return mv.run_ids(candidates, versions)


def _incoming(spark, sf_dir):
    customers = shapes.table(spark, sf_dir, "customer")
    return customers.select(
        F.concat(F.lit("m"), (F.col("c_custkey") * 2).cast("string")).alias("name")
    )


_INCOMING = "(SELECT 'm' || CAST(c_custkey * 2 AS VARCHAR) FROM customer)"


@query(f"""
    SELECT name, version FROM {_newest('Production')} WHERE name IN {_INCOMING}""")
def jn2_to_archive(spark, sf_dir):
    return mv.to_archive(_incoming(spark, sf_dir), shapes.versions(spark, sf_dir))


_PAIRS = f"""
    (SELECT n.name, n.version, coalesce(p.version, CAST(n.v - 1 AS VARCHAR)) AS previous_version,
            p.name IS NOT NULL AS previous_found
     FROM (SELECT name, version, {_V} AS v FROM {_newest('Production')}) n
     LEFT JOIN (SELECT name, version, {_V} AS v FROM {shapes.VERSIONS}) p
       ON p.name = n.name AND p.v = n.v - 1
     WHERE n.v >= 2)"""


@query(f"SELECT * FROM {_PAIRS}")
def jn3_previous_version(spark, sf_dir):
    return mv.previous_version(shapes.versions(spark, sf_dir))


@query(f"""
    SELECT name, count(*) FILTER (WHERE stage = 'Production') AS n_versions,
           count(*) FILTER (WHERE stage = 'Production') > 0 AS ok
    FROM {shapes.VERSIONS} GROUP BY name""")
def gt3_require_stage(spark, sf_dir):
    return mv.require_stage(shapes.versions(spark, sf_dir))


_NEWEST_NUMBER = f"""
    (SELECT name, coalesce(max({_V}) FILTER (WHERE stage = 'Production'), -1000) AS v
     FROM {shapes.VERSIONS} GROUP BY name)"""


@query(f"SELECT name, CAST(v AS VARCHAR) AS version, v >= 2 AS ok FROM {_NEWEST_NUMBER}")
def gt4_require_two_versions(spark, sf_dir):
    return mv.require_two_versions(shapes.versions(spark, sf_dir))


_MSE1, _MSE2 = "avg(pow(y - y_hat1, 2))", "avg(pow(y - y_hat2, 2))"
_DIFFERENCE = f"abs(({_MSE1} - {_MSE2}) / {_MSE1})"


def _rounded(df, digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"SELECT name, round({_MSE1}, 1) AS mse FROM {shapes.SCORED} GROUP BY name")
def ag3_mse(spark, sf_dir):
    scored = shapes.scored(spark, sf_dir)
    return _rounded(metrics.mse(scored, y_hat="y_hat1", by=["name"]), {"mse": 1})


@query(f"SELECT round({_MSE2}, 1) AS mse FROM {shapes.SCORED}")
def ag3_mse_overall(spark, sf_dir):
    return _rounded(metrics.mse(shapes.scored(spark, sf_dir), y_hat="y_hat2"), {"mse": 1})


@query(f"""
    SELECT name, round({_MSE1}, 1) AS mse1, round({_MSE2}, 1) AS mse2
    FROM {shapes.SCORED} GROUP BY name""")
def jn4_score_two(spark, sf_dir):
    scores = metrics.score_two(shapes.scored(spark, sf_dir), by=["name"])
    return _rounded(scores, {"mse1": 1, "mse2": 1})


_GATE_DIGITS = {"mse1": 1, "mse2": 1, "difference": 9}
_GATE_COLUMNS = f"""
    name, round({_MSE1}, 1) AS mse1, round({_MSE2}, 1) AS mse2,
    round({_DIFFERENCE}, 9) AS difference"""


@query(f"""
    SELECT {_GATE_COLUMNS},
           CASE WHEN {_DIFFERENCE} < 0.01 THEN 'passed' ELSE 'failed' END AS outcome
    FROM {shapes.SCORED} GROUP BY name""")
def gt1_validate_pair(spark, sf_dir):
    scores = metrics.score_two(shapes.scored(spark, sf_dir), by=["name"])
    return _rounded(metrics.validate_pair(scores), _GATE_DIGITS)


@query(f"""
    SELECT {_GATE_COLUMNS},
           CASE WHEN {_DIFFERENCE} < 0.01 THEN 'similar'
                WHEN {_MSE1} > {_MSE2} THEN 'worse' ELSE 'better' END AS outcome
    FROM {shapes.SCORED} GROUP BY name""")
def gt2_monitor_pair(spark, sf_dir):
    scores = metrics.score_two(shapes.scored(spark, sf_dir), by=["name"])
    return _rounded(metrics.monitor_pair(scores), _GATE_DIGITS)


@query("""
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_discount <> 0 THEN abs((l_discount - l_tax) / l_discount) END AS difference
    FROM lineitem""")
def sc6_relative_difference(spark, sf_dir):
    lines = shapes.table(spark, sf_dir, "lineitem")
    difference = relative_difference("l_discount", "l_tax")
    return lines.select("l_orderkey", "l_linenumber", difference.alias("difference"))


# Gate results per model, from the two predictions of its examples.
_CLOSE = """
    (SELECT name FROM {examples} GROUP BY name
     HAVING abs((avg(pow(y - "Daily_ICU_occupancy", 2)) - avg(pow(y - a, 2)))
                / avg(pow(y - "Daily_ICU_occupancy", 2))) < 0.01)""".format(
    examples=f"""(SELECT *, CASE WHEN "Daily_hospital_occupancy" % 2 = 0 AND name <> 'hot'
                  THEN 0 ELSE "Daily_ICU_occupancy" END AS a FROM {shapes.EXAMPLES})"""
)


def _two_predictions(spark, sf_dir):
    examples = explode_split_json(
        shapes.documents(spark, sf_dir), "document", shapes.EXAMPLE_COLUMNS
    )
    icu = F.col("Daily_ICU_occupancy")
    off = (F.col("Daily_hospital_occupancy") % 2 == 0) & (F.col("name") != "hot")
    return examples.select(
        "name", "y", icu.alias("y_hat1"), F.when(off, 0.0).otherwise(icu).alias("y_hat2")
    )


def _changed(stage, description, targets):
    return f"""
    SELECT v.name, v.version,
           CASE WHEN t.name IS NOT NULL THEN {stage} ELSE v.stage END AS stage,
           CASE WHEN t.name IS NOT NULL THEN {description} ELSE v.description END AS description,
           v.run_id
    FROM {shapes.VERSIONS} v LEFT JOIN ({targets}) t
      ON t.name = v.name AND t.version = v.version"""


_PROMOTED = "'Tests passed, ready to transition to ''Production'''"


@query(_changed("'Staging'", _PROMOTED,
                f"SELECT name, version FROM {_newest('None')} WHERE name IN {_INCOMING}"))
def tr1_promote(spark, sf_dir):
    gate = _incoming(spark, sf_dir).select("name", F.lit("passed").alias("outcome"))
    return mv.promote(shapes.versions(spark, sf_dir), gate)


@query(_changed("'Staging'", _PROMOTED,
                f"SELECT name, version FROM {_newest('None')} WHERE name IN {_CLOSE}"))
def tr1_validate_and_promote(spark, sf_dir):
    return validate_and_promote(
        shapes.versions(spark, sf_dir), _two_predictions(spark, sf_dir)
    )


@query(_changed("'Staging'", _PROMOTED,
                f"SELECT name, version FROM {_newest('None')} WHERE name IN {_INCOMING}"))
def tr1_promote_published(spark, sf_dir):
    """As ``tr1_promote``, with only the changed rows written to a published table."""
    path = shapes.scratch(spark)
    sinks.publish(shapes.versions(spark, sf_dir), path)
    gate = _incoming(spark, sf_dir).select("name", F.lit("passed").alias("outcome"))
    now = sources.read_published(spark, path)
    sinks.append_changes(mv.promotions(now, gate), path, ["name", "version"])
    return sources.read_published(spark, path)


@query(_changed("'Archived'", "v.description",
                f"SELECT name, version FROM {_newest('Production')} WHERE name IN {_INCOMING}"))
def tr2_archive_previous(spark, sf_dir):
    return mv.archive_previous(shapes.versions(spark, sf_dir), _incoming(spark, sf_dir))


@query(_changed("v.stage", "'Already Exported , old description: ' || coalesce(v.description, '')",
                f"SELECT name, version FROM {_newest('Production')}"))
def tr3_mark_exported(spark, sf_dir):
    versions = shapes.versions(spark, sf_dir)
    return mv.mark_exported(versions, mv.newest_in_stage(versions))


@query(f"""
    SELECT n.name, CAST(coalesce(k.v, 0) + 1 AS VARCHAR) AS version, 'None' AS stage,
           '' AS description, n.run_id
    FROM (SELECT 'm' || CAST(c_custkey * 2 AS VARCHAR) AS name,
                 'new' || CAST(c_custkey AS VARCHAR) AS run_id FROM customer) n
    LEFT JOIN (SELECT name, max({_V}) AS v FROM {shapes.VERSIONS} GROUP BY name) k
      USING (name)""")
def ml5_register(spark, sf_dir):
    runs = shapes.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("m"), (F.col("c_custkey") * 2).cast("string")).alias("name"),
        F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("run_id"),
    )
    return mv.register(shapes.versions(spark, sf_dir), runs)


@query(f"""
    SELECT n.name, CAST(coalesce(k.v, 0) + n.nth AS VARCHAR) AS version, 'None' AS stage,
           '' AS description, n.run_id
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY run_date, run_id) AS nth
          FROM (SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'hot'
                            ELSE 'm' || CAST(o_custkey AS VARCHAR) END AS name,
                       o_orderdate AS run_date, 'new' || CAST(o_orderkey AS VARCHAR) AS run_id
                FROM orders)) n
    LEFT JOIN (SELECT name, max({_V}) AS v FROM {shapes.VERSIONS} GROUP BY name) k
      USING (name)""")
def ml5_register_runs(spark, sf_dir):
    """A run per order, a third of them of one model, numbered by date."""
    orders = shapes.table(spark, sf_dir, "orders")
    customer = F.concat(F.lit("m"), F.col("o_custkey").cast("string"))
    runs = orders.select(
        F.when(F.col("o_orderkey") % 3 == 1, "hot").otherwise(customer).alias("name"),
        F.col("o_orderdate").alias("run_date"),
        F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("run_id"),
    )
    return mv.register(shapes.versions(spark, sf_dir), runs, ["run_date"])


def _y_hat(version):
    """Prediction of a version: every two numbers share a factor."""
    factor = (F.floor(F.col(version).cast("bigint") / 2) % 5 - 2) * 0.05 + 1
    return F.col("Daily_ICU_occupancy") * factor


def _y_hat_sql(version):
    return f'"Daily_ICU_occupancy" * ((CAST({version} AS BIGINT) // 2 % 5 - 2) * 0.05 + 1)'


def _monitored(y_hat1, y_hat2):
    return f"""
    WITH e AS (
      SELECT name, avg(pow(y - {y_hat1}, 2)) AS m1, avg(pow(y - {y_hat2}, 2)) AS m2
      FROM {shapes.EXAMPLES} JOIN {_PAIRS} USING (name) WHERE previous_found GROUP BY name)
    SELECT a.name, coalesce(p.version, CAST(a.v AS VARCHAR)) AS version, p.previous_version,
           round(m1, 4) AS mse1, round(m2, 4) AS mse2, round(abs((m1 - m2) / m1), 6) AS difference,
           CASE WHEN a.v < 2 THEN 'too few versions'
                WHEN NOT p.previous_found THEN 'no previous version'
                WHEN e.name IS NULL THEN 'no examples'
                WHEN abs((m1 - m2) / m1) < 0.01 THEN 'similar'
                WHEN m1 > m2 THEN 'worse' ELSE 'better' END AS outcome
    FROM {_NEWEST_NUMBER} a LEFT JOIN {_PAIRS} p USING (name) LEFT JOIN e USING (name)"""


@query(_monitored(_y_hat_sql("version"), _y_hat_sql("previous_version")))
def pl4_monitor(spark, sf_dir):
    examples = explode_split_json(
        shapes.documents(spark, sf_dir), "document", shapes.EXAMPLE_COLUMNS
    )

    def score(rows):
        return rows.withColumns(
            {"y_hat1": _y_hat("version"), "y_hat2": _y_hat("previous_version")}
        )

    result = monitor(shapes.versions(spark, sf_dir), examples, score)
    return _rounded(result, {"mse1": 4, "mse2": 4, "difference": 6})


@query(_monitored(_y_hat_sql("version"), _y_hat_sql("previous_version")))
def pl4_monitor_stored_models(spark, sf_dir):
    """As ``pl4_monitor``, with one Python model per version, loaded in the tasks."""
    examples = explode_split_json(
        shapes.documents(spark, sf_dir), "document", shapes.EXAMPLE_COLUMNS
    )

    def load(name, version):
        factor = (int(version) // 2 % 5 - 2) * 0.05 + 1

        class Scaled:
            def predict(self, frame):
                return frame["Daily_ICU_occupancy"] * factor

        return Scaled()

    score = score_stored(load, ["Daily_ICU_occupancy"])
    result = monitor(shapes.versions(spark, sf_dir), examples, score)
    return _rounded(result, {"mse1": 4, "mse2": 4, "difference": 6})
