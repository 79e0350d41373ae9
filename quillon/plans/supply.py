"""Queries on dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import lookup
from quillon.functions.text import version_core
from quillon.operators import supply
from quillon.sources.tables import table


def dependency_summary(spark: SparkSession, d: str) -> DataFrame:
    """A11, A14, M18."""
    return supply.summary(table(spark, d, "dependencies"))


def dependency_stats(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return supply.by_ecosystem(table(spark, d, "dependencies"))


def dependency_filter(spark: SparkSession, d: str) -> DataFrame:
    """ecosystem, kind and deprecation together."""
    return supply.filtered(table(spark, d, "dependencies"), "npm", "application", False).select("repo_id", "name", "version", "license")


def license_violations(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    return supply.violations(table(spark, d, "dependencies"), supply.default_policy(spark))


def license_health(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    return supply.license_health(license_violations(spark, d), table(spark, d, "repos"))


def dependency_compare(spark: SparkSession, d: str) -> DataFrame:
    """Common and unique packages of the first two repositories by name (a choice of two names, which are constants of the plan)."""
    a, b = (r.repo_id for r in table(spark, d, "dependencies").select("repo_id").distinct().orderBy("repo_id").limit(2).collect())
    return supply.compare(table(spark, d, "dependencies"), a, b)


def popular_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Packages by number of repositories."""
    return supply.most_used(table(spark, d, "dependencies"))


def version_cores(spark: SparkSession, d: str) -> DataFrame:
    """P24."""
    return table(spark, d, "dependencies").select("name", "version", version_core(F.col("version")).alias("core")).distinct()


def advisory_ecosystems(spark: SparkSession, d: str) -> DataFrame:
    """Names used by advisory databases, null if there is none."""
    from quillon.functions.paths import lit_map

    eco = F.lower("ecosystem")
    return table(spark, d, "dependencies").select("ecosystem", lit_map(lookup.ADVISORY_ECOSYSTEMS)[eco].alias("osv")).distinct()


def _advisories(spark: SparkSession, d: str) -> DataFrame:
    """Advisories made from the dependencies themselves, as the tables hold none: a tenth of the packages, by length of name."""
    deps = supply.clean(table(spark, d, "dependencies")).select("ecosystem", "name", "version").distinct()
    raw = F.to_json(F.struct(
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), (F.pmod(F.length("name") * 3, F.lit(11))).cast("double").alias("score"))).alias("severity"),
        F.array(F.struct(F.array(version_core(F.col("version"))).alias("versions"))).alias("affected"),
    ))
    return deps.where(F.col("version") != "any").select("ecosystem", "name", F.concat_ws("-", "name", "version").alias("advisory_id"), raw.alias("raw"))


def vulnerable_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Advisory join on package and version."""
    return supply.vulnerable(table(spark, d, "dependencies"), supply.advisories(_advisories(spark, d)))


def security_health(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return supply.security_health(vulnerable_dependencies(spark, d))


def repository_metadata(spark: SparkSession, d: str) -> DataFrame:
    """M1, S22."""
    return supply.metadata(table(spark, d, "repos"), table(spark, d, "dependencies"), table(spark, d, "source_files"))


def risky_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """F2 with a risk: npm packages with an advisory of high severity."""
    return supply.filtered(table(spark, d, "dependencies"), "npm", risk="high", found=vulnerable_dependencies(spark, d)).select("repo_id", "name", "version").distinct()


def health_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """A22, P20."""
    return supply.dashboard(table(spark, d, "repos"), vulnerable_dependencies(spark, d), license_violations(spark, d), table(spark, d, "dependencies"))


def dashboard_advice(spark: SparkSession, d: str) -> DataFrame:
    """M3, without its constant lines."""
    return supply.advice(health_dashboard(spark, d))


def compatibility_scores(spark: SparkSession, d: str) -> DataFrame:
    """The formula, on test files as runs and dirt counts of the files as stand-ins for results."""
    f = table(spark, d, "source_files").groupBy("repo_id").agg(F.count("*").alias("run"), F.count_if(F.col("detected_language").isNull()).alias("failed"), F.count_if(F.col("file_size_kb").isNull()).alias("breaking"))
    return f.select("repo_id", F.round(supply.compatibility(F.col("run"), F.col("failed"), F.col("breaking")), 6).alias("score"))


def _services(spark: SparkSession, d: str) -> DataFrame:
    """Services of every record's document, one row each."""
    from quillon.operators import shred

    return shred.entity_table(shred.stored(table(spark, d, "cortex_raw")), "service").where("parent_key is not null").select(F.col("parent_key").alias("repo_id"), "name", "version", "service_type").distinct()


def database_services(spark: SparkSession, d: str) -> DataFrame:
    """services of one type."""
    return supply.services_of_type(_services(spark, d), "database")


def architecture_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A15 on the services of nested records."""
    return supply.architecture(_services(spark, d))


def modernisation(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return supply.modernisation(table(spark, d, "dependencies"), table(spark, d, "source_files"))


QUERIES = {f.__name__: f for f in (risky_dependencies, health_dashboard, dashboard_advice, compatibility_scores, database_services, architecture_patterns, modernisation, dependency_summary, dependency_stats, dependency_filter, license_violations, license_health, dependency_compare, popular_dependencies, version_cores, advisory_ecosystems, vulnerable_dependencies, security_health, repository_metadata)}

_DEPS = "d AS (SELECT DISTINCT repo_id, name, coalesce(nullif(trim(version), ''), 'any') AS version, dependency_type, lower(ecosystem) AS ecosystem, nullif(trim(license), '') AS license, coalesce(deprecated, false) AS deprecated, version AS v0, ecosystem AS e0, license AS l0, deprecated AS d0 FROM dependencies)"
_POLICY = "p(license, r) AS (VALUES " + ", ".join(f"('{k}', {dict(allow=1, restrict=2, deny=3)[v]})" for k, v in lookup.LICENSE_POLICY.items()) + ")"
_VIOL = f"WITH {_DEPS}, {_POLICY}, v AS (SELECT repo_id, name, version, ecosystem, license, CASE WHEN license IS NULL THEN 'unknown' WHEN r = 3 THEN 'denied' WHEN r = 2 THEN 'restricted' WHEN r IS NULL THEN 'not_allowed' END AS violation_type FROM d LEFT JOIN p USING (license))"
_CORE = "CASE WHEN lower(trim(regexp_replace({v}, '[\\^~><=!]+', '', 'g'))) NOT IN ('', 'any') THEN trim(regexp_replace({v}, '[\\^~><=!]+', '', 'g')) END"
_VULN = f"WITH {_DEPS}, a AS (SELECT DISTINCT ecosystem, name, concat(name, '-', version) AS advisory_id, {_CORE.format(v='version')} AS core, length(name) * 3 % 11 AS s FROM d WHERE version <> 'any'), x AS (SELECT repo_id, ecosystem, name, version, advisory_id, CASE WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT *, {_CORE.format(v='version')} AS core FROM d) JOIN a USING (ecosystem, name, core) WHERE core IS NOT NULL)"
_OSV = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookup.ADVISORY_ECOSYSTEMS.items())
ORACLES = {
    "dependency_summary": f"WITH {_DEPS} SELECT repo_id, count(*) AS total, count(DISTINCT ecosystem) AS n_ecosystems, array_to_string(list_sort(list(DISTINCT ecosystem)), ',') AS ecosystems, CAST(count_if(deprecated) AS BIGINT) AS n_deprecated, round(100 - count_if(deprecated) / count(*) * 100, 4) AS health FROM d GROUP BY 1",
    "dependency_stats": f"WITH {_DEPS} SELECT repo_id, ecosystem, dependency_type, count(*) AS n, CAST(count_if(deprecated) AS BIGINT) AS n_deprecated FROM d GROUP BY 1, 2, 3",
    "dependency_filter": f"WITH {_DEPS} SELECT repo_id, name, version, license FROM d WHERE ecosystem = 'npm' AND dependency_type = 'application' AND NOT deprecated",
    "license_violations": f"{_VIOL} SELECT * FROM v WHERE violation_type IS NOT NULL",
    "license_health": f"{_VIOL}, w AS (SELECT repo_id, count(*) AS n, sum(CASE violation_type WHEN 'denied' THEN 50 WHEN 'restricted' THEN 20 ELSE 10 END) AS w FROM v WHERE violation_type IS NOT NULL GROUP BY 1) SELECT repo_id, coalesce(n, 0) AS n_violations, CAST(greatest(0, 100 - coalesce(w, 0)) AS BIGINT) AS license_health FROM (SELECT DISTINCT repo_id FROM repos) LEFT JOIN w USING (repo_id)",
    "dependency_compare": f"WITH {_DEPS}, r AS (SELECT repo_id, row_number() OVER (ORDER BY repo_id) AS n FROM (SELECT DISTINCT repo_id FROM dependencies)), i AS (SELECT DISTINCT name || '@' || version AS item, n FROM d JOIN r USING (repo_id) WHERE n <= 2) SELECT item, CASE WHEN count(*) = 2 THEN 'both' WHEN max(n) = 1 THEN 'left' ELSE 'right' END AS side FROM i GROUP BY 1",
    "popular_dependencies": f"WITH {_DEPS}, c AS (SELECT ecosystem, name, count(DISTINCT repo_id) AS n_repos FROM d GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY ecosystem ORDER BY n_repos DESC, name) AS rank FROM c QUALIFY rank <= 10",
    "version_cores": f"SELECT DISTINCT name, version, {_CORE.format(v='version')} AS core FROM dependencies",
    "advisory_ecosystems": f"SELECT DISTINCT ecosystem, CASE lower(ecosystem) {_OSV} END AS osv FROM dependencies",
    "vulnerable_dependencies": f"{_VULN} SELECT * FROM x",
    "security_health": f"{_VULN} SELECT repo_id, count(*) AS n, CAST(100 - least(100, sum(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 5 ELSE 1 END)) AS BIGINT) AS security_health FROM x GROUP BY 1",
    "repository_metadata": f"WITH {_DEPS}, n AS (SELECT repo_id, count(*) AS n_dependencies FROM d GROUP BY 1), f AS (SELECT repo_id, count(*) AS n_files FROM source_files GROUP BY 1) SELECT repo_id, coalesce(n_dependencies, 0) AS n_dependencies, coalesce(n_files, 0) AS n_files, coalesce(n_dependencies, 0) > 0 AS has_dependencies, '1.0.0' AS version FROM repos LEFT JOIN n USING (repo_id) LEFT JOIN f USING (repo_id)",
}
_BOARD = f"""{_VULN}, {_POLICY}, v AS (SELECT repo_id, CASE WHEN license IS NULL THEN 'unknown' WHEN r = 3 THEN 'denied' WHEN r = 2 THEN 'restricted' WHEN r IS NULL THEN 'not_allowed' END AS t FROM d LEFT JOIN p USING (license)),
    s AS (SELECT repo_id, count(*) AS n, count_if(severity = 'critical') AS c, count_if(severity = 'high') AS h, sum(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 5 ELSE 1 END) AS w FROM x GROUP BY 1),
    l AS (SELECT repo_id, count(*) AS n, count_if(t = 'denied') AS k, sum(CASE t WHEN 'denied' THEN 50 WHEN 'restricted' THEN 20 ELSE 10 END) AS w FROM v WHERE t IS NOT NULL GROUP BY 1),
    t AS (SELECT repo_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT ecosystem)), ',') AS e FROM d GROUP BY 1),
    g AS (SELECT r.repo_id, CAST(100 - least(100, coalesce(s.w, 0)) AS DOUBLE) AS security, CAST(greatest(0, 100 - coalesce(l.w, 0)) AS DOUBLE) AS license, CAST(85 AS DOUBLE) AS freshness, CAST(coalesce(c, 0) AS BIGINT) AS critical, CAST(coalesce(h, 0) AS BIGINT) AS high, coalesce(s.n, 0) AS vulnerabilities, coalesce(l.n, 0) AS n_violations, CAST(coalesce(k, 0) AS BIGINT) AS denied, coalesce(t.n, 0) AS dependencies, coalesce(e, '') AS ecosystems
        FROM (SELECT DISTINCT repo_id FROM repos) r LEFT JOIN s USING (repo_id) LEFT JOIN l USING (repo_id) LEFT JOIN t USING (repo_id)),
    o AS (SELECT *, least(security, license, freshness) AS overall FROM g), b AS (SELECT *, CASE WHEN overall >= 80 THEN 'green' WHEN overall >= 60 THEN 'yellow' ELSE 'red' END AS color, CASE WHEN overall >= 80 THEN 'Healthy' WHEN overall >= 60 THEN 'Needs Attention' ELSE 'Critical Issues' END AS status, 100 - overall AS overall_risk, 100 - security AS security_risk, 100 - license AS compliance_risk, 100 - freshness AS operational_risk FROM o)"""
ORACLES |= {
    "risky_dependencies": f"{_VULN} SELECT DISTINCT repo_id, name, version FROM x WHERE ecosystem = 'npm' AND severity = 'high'",
    "health_dashboard": f"{_BOARD} SELECT * FROM b",
    "dashboard_advice": f"{_BOARD} SELECT repo_id, 'critical_vulnerabilities' AS topic, critical AS n FROM b WHERE critical > 0 UNION ALL SELECT repo_id, 'high_vulnerabilities', high FROM b WHERE high > 0 UNION ALL SELECT repo_id, 'denied_licenses', denied FROM b WHERE denied > 0",
    "compatibility_scores": "SELECT repo_id, round(greatest(0, least(100, 100 - count_if(detected_language IS NULL) / count(*) * 50 - count_if(file_size_kb IS NULL) * 10)), 6) AS score FROM source_files GROUP BY 1",
    "modernisation": f"WITH {_DEPS} SELECT DISTINCT repo_id, 'framework_upgrade' AS suggestion FROM d WHERE ecosystem = 'python' AND name = 'Django' AND version LIKE '2.%' UNION ALL SELECT repo_id, 'containerization' FROM source_files GROUP BY 1 HAVING NOT coalesce(bool_or(regexp_matches(lower(file_path), '(^|/)(dockerfile|docker-compose\\.ya?ml)')), false)",
}
