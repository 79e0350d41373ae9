"""Dependency manifests as rows: requirements, pyproject, package.json, compose files and Dockerfiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators.supply import image_parts, service_type

def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(paths.basename(F.col("file_path")).rlike(pattern) & F.col("raw_content").isNotNull())


def requirements(files: DataFrame) -> DataFrame:
    """One row per requirement line; the version defaults to ``any``. Comments and options are left out."""
    lines = _named(files, r"^requirements.*\.txt$").select("repo_id", "file_path", F.explode(F.split("raw_content", r"\r?\n")).alias("l")).withColumn("l", F.trim("l"))
    parts = lines.where((F.col("l") != "") & ~F.col("l").rlike("^[#-]"))
    name = F.regexp_extract("l", r"^([A-Za-z0-9][\w.-]*)", 1)
    version = F.trim(F.regexp_extract("l", r"^[\w.-]+(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===)[^;#\s]*(?:\s*,\s*[=<>!~]+[^;#\s,]*)*)", 1))
    kind = F.when(F.col("file_path").rlike("(?i)dev"), "development").when(F.col("file_path").rlike("(?i)test"), "testing").otherwise("application")
    return parts.where(name != "").select("repo_id", name.alias("name"), F.when(version == "", "any").otherwise(version).alias("version"), kind.alias("dependency_type"), F.lit("python").alias("ecosystem"))


def package_json(files: DataFrame) -> DataFrame:
    """The four sections of package.json, read in the JVM; files that are no JSON give nothing."""
    sections = {"dependencies": "application", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}
    schema = ", ".join(f"{s} map<string, string>" for s in sections)
    doc = _named(files, r"^package\.json$").withColumn("doc", F.from_json("raw_content", schema))
    out = None
    for section, kind in sections.items():
        part = doc.select("repo_id", F.explode(F.col(f"doc.{section}")).alias("name", "version")).select("repo_id", "name", F.coalesce("version", F.lit("any")).alias("version"), F.lit(kind).alias("dependency_type"), F.lit("javascript").alias("ecosystem"))
        out = part if out is None else out.unionByName(part)
    return out


def toml_dependencies(name: str, text: str) -> list[tuple[str, str, str, str]]:
    """(name, version, kind, ecosystem) of a pyproject.toml or Cargo.toml."""
    import re
    import tomllib

    try:
        doc = tomllib.loads(text)
    except ValueError:
        return []
    out: list[tuple[str, str, str, str]] = []
    split = lambda s: (m := re.match(r"^([\w.-]+)(?:\[[^\]]*\])?\s*(.*)$", s.strip())) and (m[1], m[2].split(";")[0].strip() or "any")
    version = lambda v: v if isinstance(v, str) else (v.get("version") or "any") if isinstance(v, dict) else "any"

    def table(d, kind: str, eco: str) -> None:
        for k, v in (d or {}).items() if isinstance(d, dict) else []:
            if not (eco == "python" and k == "python"):
                out.append((k, version(v), "optional" if isinstance(v, dict) and v.get("optional") else kind, eco))

    def listed(items, kind: str) -> None:
        for s in items if isinstance(items, list) else []:
            if isinstance(s, str) and split(s):
                out.append((*split(s), kind, "python"))

    if name.lower() == "cargo.toml":
        table(doc.get("dependencies"), "application", "rust")
        table(doc.get("dev-dependencies"), "development", "rust")
        table(doc.get("build-dependencies"), "build", "rust")
        return out
    listed(doc.get("build-system", {}).get("requires"), "build")
    project = doc.get("project", {})
    listed(project.get("dependencies"), "application")
    for extra in (project.get("optional-dependencies") or {}).values():
        listed(extra, "optional")
    poetry = doc.get("tool", {}).get("poetry", {})
    table(poetry.get("dependencies"), "application", "python")
    table(poetry.get("dev-dependencies"), "development", "python")
    for group in (poetry.get("group") or {}).values():
        table(group.get("dependencies"), "development", "python")
    return out


_TOML = "repo_id string, name string, version string, dependency_type string, ecosystem string"


def toml_manifests(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, *x) for r, p, t in zip(*(c.to_pylist() for c in b.columns)) for x in toml_dependencies(p.rsplit("/", 1)[-1], t)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["repo_id", "name", "version", "dependency_type", "ecosystem"])

    return _named(files, r"(?i)^(pyproject|cargo)\.toml$").select("repo_id", "file_path", "raw_content").mapInArrow(run, _TOML)


def dockerfiles(files: DataFrame) -> DataFrame:
    """Base images of FROM lines; names of letters alone are left out, as stages and common bases."""
    images = _named(files, r"(?i)^dockerfile|\.dockerfile$").select("repo_id", F.explode(F.regexp_extract_all("raw_content", F.lit(r"(?mi)^FROM\s+(\S+)"), 1)).alias("image"))
    name, version = image_parts(F.split("image", "@")[0])
    return images.select("repo_id", name.alias("name"), version.alias("version"), service_type(name).alias("service_type")).where(~F.col("name").rlike(r"^[A-Za-z]+$"))


def compose_services(text: str) -> list[tuple[str, str]]:
    """(service, image) of a compose file, by its indentation: keys under ``services:`` and their ``image:``."""
    import re

    out: list[tuple[str, str]] = []
    inside, depth, service = False, None, None
    for line in text.replace("\r", "").split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        if indent == 0:
            inside, depth, service = line.strip().startswith("services:"), None, None
        elif inside:
            depth = depth or indent
            m = re.match(r"^\s*([\w.-]+):\s*(?:#.*)?$", line)
            if indent == depth and m:
                service = m[1]
                out.append((service, ""))
            elif service and (m := re.match(r"^\s*image:\s*['\"]?([^'\"\s#]+)", line)):
                out[-1] = (service, m[1])
    return out


def compose(files: DataFrame) -> DataFrame:
    """(repo_id, name, image, version, service_type) of every service."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, n, i or None) for r, t in zip(*(c.to_pylist() for c in b.columns)) for n, i in compose_services(t)]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["repo_id", "name", "image"])

    rows = _named(files, r"(?i)^docker-compose.*\.ya?ml$|^compose\.ya?ml$").select("repo_id", "raw_content").mapInArrow(run, "repo_id string, name string, image string")
    base, version = image_parts(F.coalesce("image", F.lit("")))
    return rows.select("repo_id", "name", "image", F.when(F.col("image").isNull(), "latest").otherwise(version).alias("version"), service_type(base).alias("service_type"))


def all_dependencies(files: DataFrame) -> DataFrame:
    return requirements(files).unionByName(package_json(files)).unionByName(toml_manifests(files))
