"""Dependencies: summaries, filters, license policy, advisories, comparison and health figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lookup, paths
from quillon.functions.text import version_core


def clean(dependencies: DataFrame) -> DataFrame:
    """Distinct rows; ecosystems in lower case, blank licenses as null, a missing deprecation as false."""
    return dependencies.distinct().withColumns({
        "ecosystem": F.lower("ecosystem"), "license": F.nullif(F.trim("license"), F.lit("")), "deprecated": F.coalesce("deprecated", F.lit(False)), "version": F.coalesce(F.nullif(F.trim("version"), F.lit("")), F.lit("any")),
    })


def filtered(dependencies: DataFrame, ecosystem: str | None = None, category: str | None = None, deprecated: bool | None = None, risk: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """All given conditions hold. ``risk`` is a severity that one of the advisories ``found`` for the dependency has."""
    out = clean(dependencies)
    if ecosystem is not None:
        out = out.where(F.col("ecosystem") == ecosystem.lower())
    if category is not None:
        out = out.where(F.col("dependency_type") == category)
    if risk is not None and found is not None:
        out = out.join(found.where(F.col("severity") == risk).select("repo_id", "ecosystem", "name", "version").distinct(), ["repo_id", "ecosystem", "name", "version"], "left_semi")
    return out if deprecated is None else out.where(F.col("deprecated") == deprecated)


def summary(dependencies: DataFrame) -> DataFrame:
    """(repo_id, total, n_ecosystems, ecosystems, n_deprecated, health)."""
    d = clean(dependencies)
    agg = d.groupBy("repo_id").agg(F.count("*").alias("total"), F.countDistinct("ecosystem").alias("n_ecosystems"), F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("ecosystems"), F.count_if("deprecated").alias("n_deprecated"))
    return agg.withColumn("health", F.round(100 - F.col("n_deprecated") / F.col("total") * 100, 4))


def by_ecosystem(dependencies: DataFrame) -> DataFrame:
    return clean(dependencies).groupBy("repo_id", "ecosystem", "dependency_type").agg(F.count("*").alias("n"), F.count_if("deprecated").alias("n_deprecated"))


def license_rule(license: Column, policy: DataFrame | None = None) -> Column:
    """allow, deny, restrict, unlisted or missing; names match exactly."""
    return F.when(license.isNull(), "missing").otherwise(F.coalesce(paths.lit_map(lookup.LICENSE_POLICY)[license], F.lit("unlisted")))


def violations(dependencies: DataFrame, policy: DataFrame) -> DataFrame:
    """Left join with the policy; a license in several lists gets the hardest rule: missing, denied, restricted, not allowed.

    ``policy`` (license, rule) is a table of names kept by hand; it is broadcast below ``spark.sql.autoBroadcastJoinThreshold`` only.
    """
    rank = F.when(F.col("rule") == "deny", 3).when(F.col("rule") == "restrict", 2).when(F.col("rule") == "allow", 1)
    rules = policy.withColumn("r", rank).groupBy("license").agg(F.max("r").alias("r"))
    joined = clean(dependencies).join(rules, "license", "left")
    kind = F.when(F.col("license").isNull(), "unknown").when(F.col("r") == 3, "denied").when(F.col("r") == 2, "restricted").when(F.col("r").isNull(), "not_allowed")
    return joined.withColumn("violation_type", kind).where("violation_type is not null").select("repo_id", "name", "version", "ecosystem", "license", "violation_type")


def default_policy(spark) -> DataFrame:
    return spark.createDataFrame(list(lookup.LICENSE_POLICY.items()), "license string, rule string")


def license_health(found: DataFrame, repos: DataFrame) -> DataFrame:
    """100 less 50 per denied, 20 per restricted and 10 per other violation, at least 0."""
    weight = F.when(F.col("violation_type") == "denied", 50).when(F.col("violation_type") == "restricted", 20).otherwise(10)
    per = found.groupBy("repo_id").agg(F.sum(weight).alias("w"), F.count("*").alias("n_violations"))
    return repos.select("repo_id").distinct().join(per, "repo_id", "left").select("repo_id", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0))).cast("bigint").alias("license_health"))


ADVISORY = "severity array<struct<type string, score double>>, database_specific struct<severity string>, affected array<struct<versions array<string>, ranges array<struct<events array<struct<introduced string, fixed string>>>>>>"


def advisories(raw: DataFrame) -> DataFrame:
    """(ecosystem, name, advisory_id, severity, affected_versions, fixed_versions) from raw JSON."""
    doc = F.from_json("raw", ADVISORY)
    cvss = F.get(F.filter("doc.severity", lambda s: s["type"] == "CVSS_V3"), F.lit(0))["score"]
    named = F.lower(F.coalesce("doc.database_specific.severity", F.lit("medium")))
    severity = F.when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").when(cvss.isNotNull(), "low").when(named.isin("critical", "high", "medium", "low"), named).otherwise("medium")
    versions = F.flatten(F.transform("doc.affected", lambda a: F.coalesce(a["versions"], F.array().cast("array<string>"))))
    fixed = F.flatten(F.transform("doc.affected", lambda a: F.flatten(F.transform(F.coalesce(a["ranges"], F.array().cast("array<struct<events:array<struct<introduced:string,fixed:string>>>>")), lambda r: F.array_compact(F.transform(r["events"], lambda e: e["fixed"]))))))
    return raw.withColumn("doc", doc).select("ecosystem", "name", "advisory_id", severity.alias("severity"), versions.alias("affected_versions"), fixed.alias("fixed_versions"))


def vulnerable(dependencies: DataFrame, known: DataFrame) -> DataFrame:
    """Dependencies whose bare version an advisory of their package lists."""
    d = clean(dependencies).withColumn("core", version_core(F.col("version"))).where("core is not null")
    return d.join(known, ["ecosystem", "name"]).where(F.array_contains("affected_versions", F.col("core"))).select("repo_id", "ecosystem", "name", "version", "advisory_id", "severity")


def security_health(found: DataFrame) -> DataFrame:
    """(repo_id, n, security_health): 100 less the weights 40, 20, 5 and 1, at least 0."""
    w = F.when(F.col("severity") == "critical", 40).when(F.col("severity") == "high", 20).when(F.col("severity") == "medium", 5).otherwise(1)
    return found.groupBy("repo_id").agg(F.count("*").alias("n"), (100 - F.least(F.lit(100), F.sum(w))).alias("security_health"))


def compare(dependencies: DataFrame, left: str, right: str) -> DataFrame:
    """(item, side): name@version common to two repositories or in one of them."""
    d = clean(dependencies).select("repo_id", F.concat_ws("@", "name", "version").alias("item")).where(F.col("repo_id").isin(left, right)).distinct()
    per = d.groupBy("item").agg(F.bool_or(F.col("repo_id") == left).alias("l"), F.bool_or(F.col("repo_id") == right).alias("r"))
    return per.select("item", F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right").alias("side"))


def most_used(dependencies: DataFrame, k: int = 10) -> DataFrame:
    """(ecosystem, name, n_repos, rank) of the packages most repositories use; a top-k report."""
    per = clean(dependencies).select("ecosystem", "name", "repo_id").distinct().groupBy("ecosystem", "name").agg(F.count("*").alias("n_repos"))
    order = Window.partitionBy("ecosystem").orderBy(F.desc("n_repos"), "name")
    return per.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def metadata(repos: DataFrame, dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, has_dependencies, n_dependencies, n_files, version) of every repository."""
    dep = clean(dependencies).groupBy("repo_id").agg(F.count("*").alias("n_dependencies"))
    n = files.groupBy("repo_id").agg(F.count("*").alias("n_files"))
    out = repos.select("repo_id").join(dep, "repo_id", "left").join(n, "repo_id", "left").fillna(0, ["n_dependencies", "n_files"])
    return out.withColumn("has_dependencies", F.col("n_dependencies") > 0).withColumn("version", F.lit("1.0.0"))


#: Fixed value: how fresh dependencies are taken to be, as nothing tells their age.
FRESHNESS = 85.0


def health_color(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "yellow").otherwise("red")


def health_status(score: Column) -> Column:
    return F.when(score >= 80, "Healthy").when(score >= 60, "Needs Attention").otherwise("Critical Issues")


def dashboard(repos: DataFrame, found: DataFrame, broken: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row per repository: the three scores, the overall one (the least of them) with colour and status, the four risks (100 less a score) and the counts behind them.

    ``found`` are vulnerable dependencies, ``broken`` license violations. Both are counted per repository before anything is joined.
    """
    grave = found.groupBy("repo_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("vulnerabilities"))
    denied = broken.groupBy("repo_id").agg(F.count_if(F.col("violation_type") == "denied").alias("denied"))
    base = repos.select("repo_id").distinct().join(security_health(found).select("repo_id", "security_health"), "repo_id", "left").join(license_health(broken, repos), "repo_id", "left")
    all_ = base.join(grave, "repo_id", "left").join(denied, "repo_id", "left").join(summary(dependencies).select("repo_id", F.col("total").alias("dependencies"), "ecosystems"), "repo_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    security, license_, fresh = F.coalesce("security_health", F.lit(100)).cast("double"), F.coalesce("license_health", F.lit(100)).cast("double"), F.lit(FRESHNESS)
    overall = F.least(security, license_, fresh)
    return all_.select(
        "repo_id", overall.alias("overall"), health_color(overall).alias("color"), health_status(overall).alias("status"), security.alias("security"), license_.alias("license"), fresh.alias("freshness"),
        (100 - overall).alias("overall_risk"), (100 - security).alias("security_risk"), (100 - license_).alias("compliance_risk"), (100 - fresh).alias("operational_risk"),
        zero("critical"), zero("high"), zero("vulnerabilities"), zero("n_violations"), zero("denied"), zero("dependencies"), F.coalesce("ecosystems", F.lit("")).alias("ecosystems"),
    )


def advice(board: DataFrame) -> DataFrame:
    """(repo_id, topic, n): what a repository's dashboard asks to be done, and how often."""
    topics = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(c).alias("n")) for t, c in (("critical_vulnerabilities", "critical"), ("high_vulnerabilities", "high"), ("denied_licenses", "denied"))])
    return board.select("repo_id", F.explode(F.filter(topics, lambda x: x["n"] > 0)).alias("x")).select("repo_id", "x.topic", "x.n")


def compatibility(tests_run: Column, tests_failed: Column, n_breaking: Column) -> Column:
    """100 less 50 times the share of failed tests and 10 per breaking change, held between 0 and 100."""
    rate = F.when(tests_failed > 0, tests_failed / F.greatest(tests_run, F.lit(1))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - rate * 50 - n_breaking * 10))


def services_of_type(services: DataFrame, kind: str) -> DataFrame:
    return services.where(F.col("service_type") == kind)


def architecture(services: DataFrame) -> DataFrame:
    """(repo_id, pattern): what the kinds of a repository's services show."""
    of = lambda k: F.count_if(F.col("service_type") == k)
    agg = services.groupBy("repo_id").agg(of("database").alias("d"), of("cache").alias("c"), of("message_queue").alias("q"), F.count("*").alias("n"))
    rules = F.array(
        F.when((F.col("d") > 0) & (F.col("c") > 0), "Caching Layer"), F.when(F.col("q") > 0, "Message-Driven Architecture"), F.when(F.col("d") > 1, "Polyglot Persistence"), F.when(F.col("n") > 3, "Microservices Architecture")
    )
    return agg.select("repo_id", F.explode(F.array_compact(rules)).alias("pattern"))


def modernisation(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, suggestion): an outdated framework, no container description."""
    old = clean(dependencies).where((F.col("ecosystem") == "python") & (F.col("name") == "Django") & F.col("version").startswith("2.")).select("repo_id", F.lit("framework_upgrade").alias("suggestion")).distinct()
    bare = files.groupBy("repo_id").agg(F.bool_or(F.lower("file_path").rlike(r"(^|/)(dockerfile|docker-compose\.ya?ml)")).alias("boxed")).where("not coalesce(boxed, false)").select("repo_id", F.lit("containerization").alias("suggestion"))
    return old.unionByName(bare)


def service_type(image: Column) -> Column:
    """Kind of a service by the first known name in its image; ``application`` else."""
    out = F.lit("application")
    for key, kind in reversed(list(lookup.SERVICE_TYPES.items())):
        out = F.when(F.lower(image).contains(key), F.lit(kind)).otherwise(out)
    return out


def image_parts(image: Column) -> tuple[Column, Column]:
    """(name, version) of ``name:version``; latest if there is none."""
    parts = F.split(image, ":")
    return F.element_at(parts, 1), F.coalesce(F.get(parts, F.lit(1)), F.lit("latest"))
