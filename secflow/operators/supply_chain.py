"""Software inventories and advisories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.functions.versions import BEFORE, in_range, is_fixed, known, limits, version_key, within
from secflow.operators.ranges import pairs, points_in_intervals
from secflow.sources.tables import written

SEVERITIES = ("low", "medium", "high", "critical")
CYCLONEDX = "bomFormat string, metadata struct<component: struct<name: string, `bom-ref`: string>>, components array<struct<type: string, name: string, version: string, purl: string, `bom-ref`: string, scope: string, licenses: array<struct<license: struct<id: string, name: string>, expression: string>>>>, dependencies array<struct<ref: string, dependsOn: array<string>>>"
SPDX = "spdxVersion string, name string, documentDescribes array<string>, packages array<struct<SPDXID: string, name: string, versionInfo: string, licenseConcluded: string, licenseDeclared: string, externalRefs: array<struct<referenceType: string, referenceLocator: string>>, primaryPackagePurpose: string>>"
#: Purposes of an SPDX package that the application depends on itself, if one is given.
DIRECT = ("APPLICATION", "LIBRARY")


def purl_parts(purl: Column) -> Column:
    """(ecosystem, name, version) of a package URL."""
    body = F.regexp_replace(purl, r"[?#].*$", "")
    path = F.regexp_replace(body, r"@[^@/]*$", "")
    return F.struct(F.lower(F.regexp_extract(purl, r"^pkg:([^/]+)/", 1)).alias("ecosystem"), F.substring_index(path, "/", -1).alias("name"), F.when(body.rlike(r"@[^@/]+$"), F.substring_index(body, "@", -1)).alias("version"))


def synthetic_purl(name: Column, version: Column, kind: Column | None = None) -> Column:
    """A package URL for a component that has none: of its own type, if it says so."""
    type_ = F.lit("generic") if kind is None else F.lower(F.coalesce(filled(kind), F.lit("generic")))
    return F.concat(F.lit("pkg:"), type_, F.lit("/"), name, F.coalesce(F.concat(F.lit("@"), filled(version)), F.lit("")))


def filled(text: Column) -> Column:
    """The text, null where it is empty."""
    return F.nullif(text, F.lit(""))


def from_cyclonedx(documents: DataFrame, text: str = "document") -> DataFrame:
    """Named components of CycloneDX documents, with their licences; direct ones are those that the application depends on itself, or all if the document doesn't say."""
    parsed = documents.withColumn("_d", F.from_json(text, CYCLONEDX)).where("_d.bomFormat = 'CycloneDX'")
    own = F.filter("_d.dependencies", lambda d: d["ref"] == F.col("_d.metadata.component.bom-ref"))
    named = F.flatten(F.transform(own, lambda d: F.coalesce(d["dependsOn"], F.array().cast("array<string>"))))
    direct = F.when(F.coalesce(F.size("_direct"), F.lit(-1)) <= 0, True).otherwise(F.coalesce(F.array_contains("_direct", F.coalesce("_c.bom-ref", "_c.purl")), F.lit(False)))
    found = parsed.withColumn("_direct", named).withColumn("_c", F.explode("_d.components")).where(filled(F.col("_c.name")).isNotNull())
    licenses = F.filter(F.transform(F.coalesce("_c.licenses", F.array().cast("array<struct<license:struct<id:string,name:string>,expression:string>>")), lambda x: F.coalesce(filled(x["license"]["id"]), filled(x["license"]["name"]), filled(x["expression"]))), lambda x: x.isNotNull())
    keep = [c for c in documents.columns if c != text]
    return found.select(*keep, F.col("_d.metadata.component.name").alias("application"), F.col("_c.name").alias("name"), F.col("_c.version").alias("version"), F.coalesce(filled(F.col("_c.purl")), synthetic_purl(F.col("_c.name"), F.col("_c.version"), F.col("_c.type"))).alias("purl"), direct.alias("direct"), licenses.alias("licenses"))


def from_spdx(documents: DataFrame, text: str = "document") -> DataFrame:
    """Packages of SPDX documents without the described root; direct unless their purpose is another than an application or library."""
    parsed = documents.withColumn("_d", F.from_json(text, SPDX)).where("_d.spdxVersion IS NOT NULL").withColumn("_p", F.explode("_d.packages"))
    ref = F.filter("_p.externalRefs", lambda r: r["referenceType"] == "purl")
    keep = [c for c in documents.columns if c != text]
    own = parsed.where(~F.coalesce(F.expr("array_contains(_d.documentDescribes, _p.SPDXID)"), F.lit(False)) & filled(F.col("_p.name")).isNotNull())
    licenses = F.filter(F.array("_p.licenseConcluded", "_p.licenseDeclared"), lambda x: (x != "") & (x != "NOASSERTION"))
    return own.select(*keep, F.col("_d.name").alias("application"), F.col("_p.name").alias("name"), F.col("_p.versionInfo").alias("version"), F.coalesce(F.get(ref, F.lit(0))["referenceLocator"], synthetic_purl(F.col("_p.name"), F.col("_p.versionInfo"))).alias("purl"), (F.col("_p.primaryPackagePurpose").isNull() | F.col("_p.primaryPackagePurpose").isin(*DIRECT)).alias("direct"), licenses.alias("licenses"))


def newest_inventory(components: DataFrame, order: str, keys: list[str], unique: list[str]) -> DataFrame:
    """Rows of each application's newest document, each component once."""
    newest = F.max(order).over(Window.partitionBy(*keys))
    return components.withColumn("_newest", newest).where(F.col(order) == F.col("_newest")).drop("_newest").dropDuplicates(unique)


def with_parsed(rows: DataFrame, name: str, value: Column, *texts: str) -> DataFrame:
    """Rows with ``value``, a column over ``texts``, under a name; it is parsed once for each of the texts that differ.

    Rows are dealt out to all cores first: a table of a few megabytes is a single file, and would stay one task.
    """
    specs = rows.select(*(F.col(t).alias(f"_{t}") for t in texts)).distinct()
    named = specs.select(*(F.col(f"_{t}").alias(t) for t in texts)).withColumn(name, value).select(*(F.col(t).alias(f"_{t}") for t in texts), name)
    met = reduce(Column.__and__, (F.col(t).eqNullSafe(F.col(f"_{t}")) for t in texts))
    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.join(named, met).drop(*(f"_{t}" for t in texts))


def with_bounds(advisories: DataFrame, bounds: Column, *texts: str) -> DataFrame:
    """Advisories with ``bounds``, a column over ``texts``."""
    return with_parsed(advisories, "bounds", bounds, *texts)


def in_groups(components: DataFrame) -> DataFrame:
    """Components in ``_group``: in that of their ecosystem, and in that of advisories that name none."""
    return components.withColumn("_group", F.explode(F.array_distinct(F.array(F.coalesce("ecosystem", F.lit("")), F.lit("")))))


def versions_in(components: DataFrame, ranges: DataFrame) -> DataFrame:
    """(package, ecosystem, version) of components with the columns of every range that holds them.

    ``ranges``: package, ecosystem (null for any) and ``bounds`` as :func:`limits` makes them.
    Each distinct version of a package is parsed and ranked once; a range meets only the
    versions inside it.
    """
    spark = components.sparkSession
    own = components.where(known(F.col("version")).isNotNull()).select("package", "ecosystem", "version").distinct()
    keyed = spark.read.parquet(written(in_groups(own).withColumn("_key", version_key(F.col("version"))), "versions"))
    asked = spark.read.parquet(written(ranges, "limits")).withColumn("_group", F.coalesce("ecosystem", F.lit(""))).drop("ecosystem")
    asked = asked.withColumns({"_low": F.col("bounds.low"), "_high": F.col("bounds.high")})
    met = points_in_intervals(keyed.select("package", "_group", "_key").distinct(), asked, ["package", "_group"], "_key", "_low", "_high")
    met = met.where(~F.exists("bounds.not_", lambda k: k == F.col("_key")))
    return keyed.join(met, ["package", "_group", "_key"]).drop("_group", "_key", "_low", "_high", "bounds")


def in_range_matches(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components with the advisories whose range holds their version, fixed or not."""
    return _of_components(components, versions_in(components, with_bounds(advisories, limits(F.col("affected")), "affected")))


def _of_components(components: DataFrame, met: DataFrame) -> DataFrame:
    """Components with what their version met."""
    more = [c for c in met.columns if c not in components.columns]
    other = met.select(*(F.col(c).alias(f"_{c}") for c in ("package", "ecosystem", "version")), *more)
    return components.join(other, (F.col("package") == F.col("_package")) & F.col("ecosystem").eqNullSafe(F.col("_ecosystem")) & (F.col("version") == F.col("_version"))).drop("_package", "_ecosystem", "_version")


def match_advisories(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components with the advisories that affect them: the version lies in the range and doesn't hold the published fix.

    An advisory without a fix affects all of its range, one without a range all versions below
    its fix. A component without a version is never affected.
    """
    bounds = limits(F.col("affected"))
    fix = F.when(known(F.col("fixed")).isNotNull(), F.struct(version_key(known(F.col("fixed"))).alias("key"), F.lit(BEFORE).alias("side")))
    # The fix is one more upper limit; F.least passes over nulls.
    open_ = F.struct(bounds["low"].alias("low"), F.least(bounds["high"], fix).alias("high"), bounds["not_"].alias("not_"))
    return _of_components(components, versions_in(components, with_bounds(advisories, open_, "affected", "fixed")))


def _status(inside: Column, fixed: Column) -> Column:
    return F.when(inside & ~fixed, "affected").when(fixed, "fixed").otherwise("not_affected")


def advisory_states(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components with every advisory on their package (and ecosystem, where it names one) and their ``status``: affected, fixed or not_affected.

    A component without a version is not_affected. All pairs are rows of the result and are
    made in blocks, no others with them; each text of a version, range and fix is parsed once.
    """
    more = [c for c in advisories.columns if c not in components.columns]
    own = in_groups(with_parsed(components, "_key", version_key(known(F.col("version"))), "version"))
    parsed = F.struct(limits(F.col("affected")).alias("range"), version_key(known(F.col("fixed"))).alias("fix"))
    asked = with_parsed(advisories, "_asked", parsed, "affected", "fixed").select("package", F.coalesce("ecosystem", F.lit("")).alias("_group"), "_asked", *more)
    fixed = F.coalesce(F.col("_key") >= F.col("_asked.fix"), F.lit(False))
    met = pairs(own, asked, ["package", "_group"]).withColumn("status", _status(within(F.col("_key"), F.col("_asked.range")), fixed))
    return met.select(*components.columns, *more, "status")


def rematch(links: DataFrame, advisories: DataFrame) -> DataFrame:
    """Links found earlier (with ``version``, ``vuln_id``) under advisories as they are now: affected, fixed or not_affected."""
    now = links.join(advisories.select("vuln_id", F.col("affected").alias("_affected"), F.col("fixed").alias("_fixed")), "vuln_id")
    status = _status(in_range(F.col("version"), F.col("_affected")), is_fixed(F.col("version"), F.col("_fixed")))
    return now.withColumn("status", status).drop("_affected", "_fixed")


def impact(applications: DataFrame, components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each application's worst state for the advisories: affected, unaffected (it has a package that they name) or not_present."""
    hits = match_advisories(components, advisories).groupBy("app_id").agg(F.count(F.lit(1)).alias("findings"))
    named = advisories.select("package", F.col("ecosystem").alias("_eco")).distinct()
    has = components.select("app_id", "package", "ecosystem").distinct().join(named, "package").where(F.col("_eco").isNull() | (F.col("_eco") == F.col("ecosystem"))).select("app_id", F.lit(True).alias("_has")).distinct()
    per = applications.join(hits, "app_id", "left").join(has, "app_id", "left")
    return per.withColumn("state", F.when(F.col("findings") > 0, "affected").when(F.col("_has"), "unaffected").otherwise("not_present")).withColumn("findings", F.coalesce("findings", F.lit(0))).drop("_has")
