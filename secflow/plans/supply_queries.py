"""Enrichment, supply chain, collaboration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secflow.functions import versions as V
from secflow.operators import collaboration as T
from secflow.operators import enrich as E
from secflow.operators import supply_chain as S
from secflow.plans.base import ADDRESS_SQL, Book

BOOK = Book()
INTEL = [("203.0.113.20", "malicious", 95, "US", ["botnet", "c2"]), ("203.0.113.40", "suspicious", 60, None, ["scan"]), ("203.0.113.100", "anonymizer", 70, "DE", ["tor"])]
NETS = [("10.1.0.0/16", "benign", 5, 3), ("10.0.0.0/8", "suspicious", 20, 4), ("203.0.113.0/25", "malicious", 80, 1), ("203.0.113.96/27", "anonymizer", 85, 0), ("192.168.0.0/16", "benign", 0, 2)]
INTEL_SQL = "intel(value, verdict, score, country, categories) AS (VALUES ('203.0.113.20', 'malicious', 95, 'US', ['botnet', 'c2']), ('203.0.113.40', 'suspicious', 60, NULL, ['scan']), ('203.0.113.100', 'anonymizer', 70, 'DE', ['tor']))"
NUMBER = "(string_split({0}, '.')[1]::BIGINT * 16777216 + string_split({0}, '.')[2]::BIGINT * 65536 + string_split({0}, '.')[3]::BIGINT * 256 + string_split({0}, '.')[4]::BIGINT)"
NETS_SQL = f"nets(cidr, verdict, score, ordinal, low, high) AS (SELECT *, {NUMBER.format('split_part(cidr, chr(47), 1)')} AS low, {NUMBER.format('split_part(cidr, chr(47), 1)')} + (1::BIGINT << (32 - split_part(cidr, chr(47), 2)::INT)) - 1 AS high FROM (VALUES {', '.join(map(str, NETS))}) v(cidr, verdict, score, ordinal))"
ADDRS_SQL = f"addrs AS (SELECT DISTINCT source_ip AS value, {NUMBER.format('source_ip')} AS ip FROM v_events)"
#: Texts that are no address have no number.
VALID_SQL = f"addrs AS (SELECT DISTINCT source_ip AS value, CASE WHEN {ADDRESS_SQL.format('source_ip')} THEN {NUMBER.format('source_ip')} END AS ip FROM v_events)"
NETHITS_SQL = "nethits AS (SELECT value, arg_min(cidr, ordinal) AS cidr, arg_min(verdict, ordinal) AS verdict, arg_min(score, ordinal) AS score FROM addrs JOIN nets ON ip BETWEEN low AND high GROUP BY value)"


def intel(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(INTEL, "value string, verdict string, score int, country string, categories array<string>")


def nets(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(NETS, "cidr string, verdict string, score int, ordinal int")


def addresses(df: DataFrame) -> DataFrame:
    return df.select(F.col("source_ip").alias("value"))


BOOK.on("enr_indicator", "v_events", f"WITH {INTEL_SQL} SELECT value, coalesce(verdict, 'unknown') AS verdict, score FROM (SELECT DISTINCT source_ip AS value FROM v_events) LEFT JOIN intel USING (value)")(lambda df: E.match_indicators(addresses(df), intel(df)).select("value", F.coalesce("verdict", F.lit("unknown")).alias("verdict"), "score"))
BOOK.on("enr_network", "v_events", f"WITH {NETS_SQL}, {VALID_SQL}, {NETHITS_SQL} SELECT * FROM nethits")(lambda df: E.match_networks(addresses(df), nets(df)))
BOOK.on("enr_internal", "v_events", f"WITH {VALID_SQL} SELECT value, CASE WHEN ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 3232235520 AND 3232301055 THEN 'internal' ELSE 'external' END AS side FROM addrs")(
    lambda df: addresses(df).distinct().join(E.match_networks(addresses(df), df.sparkSession.createDataFrame([("10.0.0.0/8", "benign", 0, 0), ("192.168.0.0/16", "benign", 0, 1)], "cidr string, verdict string, score int, ordinal int")), "value", "left").select("value", F.when(F.col("cidr").isNotNull(), "internal").otherwise("external").alias("side"))
)

ANSWERS_SQL = f"{INTEL_SQL}, {NETS_SQL}, {ADDRS_SQL}, {NETHITS_SQL}, answers AS (SELECT value, verdict, score, country, categories, 0 AS ordinal, false AS internal FROM intel JOIN addrs USING (value) UNION ALL SELECT value, verdict, score, 'ZZ', ['network'], 1, starts_with(cidr, '192.168') FROM nethits)"
VALID_ANSWERS_SQL = ANSWERS_SQL.replace(ADDRS_SQL, VALID_SQL)
MERGED_SQL = """merged AS (SELECT value, ['unknown', 'benign', 'suspicious', 'anonymizer', 'malicious'][max(list_position(['unknown', 'benign', 'suspicious', 'anonymizer', 'malicious'], verdict))] AS verdict, max(score) AS score,
  array_to_string(list_sort(list_distinct(flatten(list(categories)))), ',') AS categories, arg_min(country, ordinal) FILTER (WHERE country IS NOT NULL) AS country FROM answers GROUP BY value)"""


def reports(df: DataFrame) -> DataFrame:
    exact = E.match_indicators(addresses(df), intel(df)).where("verdict IS NOT NULL").select("value", "verdict", "score", "country", "categories", F.lit(0).alias("ordinal"), F.lit(False).alias("internal"))
    network = E.match_networks(addresses(df), nets(df)).select("value", "verdict", "score", F.lit("ZZ").alias("country"), F.array(F.lit("network")).alias("categories"), F.lit(1).alias("ordinal"), F.col("cidr").startswith("192.168").alias("internal"))
    return E.merge_verdicts(exact.unionByName(network)).withColumn("categories", F.array_join("categories", ","))


BOOK.on("enr_merge_verdicts", "v_events", f"WITH {VALID_ANSWERS_SQL}, {MERGED_SQL} SELECT * FROM merged")(lambda df: reports(df).drop("internal"))
BOOK.on("enr_events", "v_events", f"WITH {VALID_ANSWERS_SQL}, {MERGED_SQL} SELECT event_id, verdict, categories FROM v_events LEFT JOIN merged ON v_events.source_ip = merged.value")(lambda df: df.drop("value").join(reports(df), F.col("source_ip") == F.col("value"), "left").select("event_id", "verdict", "categories"))
BOOK.on("enr_alerts", "v_events", f"WITH {ANSWERS_SQL}, {MERGED_SQL} SELECT event_id, CASE WHEN verdict IN ('malicious', 'anonymizer') THEN 'source is ' || verdict || ' (' || score || ')' END AS factor FROM v_events LEFT JOIN merged ON v_events.source_ip = merged.value WHERE event_type = 'error'")(
    lambda df: df.drop("value").where("event_type = 'error'").join(reports(df), F.col("source_ip") == F.col("value"), "left").select("event_id", F.when(F.col("verdict").isin("malicious", "anonymizer"), F.format_string("source is %s (%d)", "verdict", "score")).alias("factor"))
)
BOOK.on("enr_bulk_lookup", "v_events", f"WITH {VALID_ANSWERS_SQL}, {MERGED_SQL} SELECT v.value, coalesce(m.verdict, 'unknown') AS verdict FROM (SELECT DISTINCT source_ip AS value FROM v_events ) v LEFT JOIN merged m USING (value)")(lambda df: addresses(df).distinct().join(reports(df), "value", "left").select("value", F.coalesce("verdict", F.lit("unknown")).alias("verdict")))
BOOK.on("enr_indicator_prune", "v_events", "SELECT event_id FROM v_events WHERE coalesce(CASE WHEN k % 2 = 0 THEN t + 86400000000 * k END, t) >= 1707000000000000 - 10 * 86400000000")(lambda df: E.prune(df.withColumn("expires_at", F.when(F.col("k") % 2 == 0, F.col("t") + 86400000000 * F.col("k"))).withColumn("updated_at", F.col("t")), 1707000000000000, 10).select("event_id"))

ASSETS = [("db-prod-1", "critical"), ("db-prod-*", "high"), ("web-?", "low"), ("*", "medium")]
ACCOUNTS = [("svc-*", "service"), ("user77@*", "load_test")]
BOOK.on("enr_asset_criticality", "v_events", "SELECT event_id, CASE WHEN hostname = 'db-prod-1' THEN 10 WHEN starts_with(hostname, 'db-prod-') THEN 8 ELSE 3 END AS criticality FROM v_events")(
    lambda df: df.drop("value").join(E.first_pattern(df.select(F.col("hostname").alias("value")), E.pattern_table(df, ASSETS)), F.col("hostname") == F.col("value"), "left").select("event_id", E.level_score(F.col("level")).alias("criticality"))
)
BOOK.on("enr_account_flags", "v_events", "SELECT DISTINCT principal, CASE WHEN starts_with(principal, 'svc-') THEN 'service' ELSE 'load_test' END AS flag FROM v_events WHERE starts_with(principal, 'svc-') OR starts_with(principal, 'user77@')")(lambda df: E.first_pattern(df.select(F.col("principal").alias("value")), E.pattern_table(df, ACCOUNTS)).select(F.col("value").alias("principal"), F.col("level").alias("flag")))

# Supply chain

#: A version as one text that sorts like it: three numbers, then z for a final release or the pre-release.
DUCK_KEY = "(lpad(split_part(split_part({0}, '-', 1), '.', 1), 6, '0') || lpad(split_part(split_part({0}, '-', 1), '.', 2), 6, '0') || lpad(split_part(split_part({0}, '-', 1), '.', 3), 6, '0') || CASE WHEN contains({0}, '-') THEN split_part({0}, '-', 2) ELSE 'z' END)"
_K = {c: DUCK_KEY.format(c) for c in ("version", "low", "high", "fixed")}
_SAME = "split_part(version, '.', {0}) = split_part(low, '.', {0})".format
#: Whether a version lies in an advisory's range, by the form of the range; and whether it is open to it.
INSIDE = f"""CASE WHEN form IN (0, 1, 4) THEN true WHEN form = 2 THEN {_K['version']} >= {_K['low']} AND {_SAME(1)} WHEN form = 3 THEN {_K['version']} >= {_K['low']} AND {_SAME(1)} AND {_SAME(2)}
  WHEN form = 5 THEN {_K['version']} >= {_K['low']} AND {_K['version']} < {_K['high']} ELSE {_K['version']} >= {_K['low']} AND {_K['version']} < {_K['high']} END"""
OPEN = f"({INSIDE}) AND (coalesce(fixed, '') = '' OR {_K['version']} < {_K['fixed']})"
PAIRS = "FROM v_components c JOIN v_advisories a ON a.package = c.package AND (a.ecosystem IS NULL OR a.ecosystem = c.ecosystem)"
MATCHES = f"matches AS (SELECT c.*, a.vuln_id, a.severity, a.fixed {PAIRS} WHERE {OPEN})"


def documents(df: DataFrame, kind: str) -> DataFrame:
    """One document text per application, written from the component view."""
    purl = F.when(F.col("part_id") % 6 != 0, F.concat(F.lit("pkg:"), "ecosystem", F.lit("/org/"), "package", F.lit("@"), "version"))
    ref = F.concat(F.lit("r"), F.col("part_id").cast("string"))
    if kind == "cyclonedx":
        license = F.when(F.col("part_id") % 4 == 0, F.array(F.struct(F.struct(F.lit("MIT").alias("id"), F.lit(None).cast("string").alias("name")).alias("license"), F.lit(None).cast("string").alias("expression")))).when(F.col("part_id") % 4 == 1, F.array(F.struct(F.lit(None).cast("struct<id:string,name:string>").alias("license"), F.lit("Apache-2.0 OR MIT").alias("expression"))))
        part = F.struct(F.when(F.col("part_id") % 12 == 6, "Library").alias("type"), F.col("package").alias("name"), "version", purl.alias("purl"), ref.alias("bom-ref"), license.alias("licenses"))
        made = df.groupBy("app_id", "application").agg(F.collect_list(part).alias("components"), F.collect_list(F.when(F.col("direct"), ref)).alias("on"))
        root = F.struct(F.struct(F.col("application").alias("name"), F.lit("root").alias("bom-ref")).alias("component"))
        body = F.struct(F.lit("CycloneDX").alias("bomFormat"), root.alias("metadata"), "components", F.array(F.struct(F.lit("root").alias("ref"), F.col("on").alias("dependsOn"))).alias("dependencies"))
    else:
        refs = F.when(purl.isNotNull(), F.array(F.struct(F.lit("purl").alias("referenceType"), purl.alias("referenceLocator"))))
        purpose = F.when(F.col("part_id") % 5 == 0, "LIBRARY").when(F.col("part_id") % 5 == 1, "SOURCE")
        part = F.struct(ref.alias("SPDXID"), F.col("package").alias("name"), F.col("version").alias("versionInfo"), F.when(F.col("part_id") % 4 == 0, "NOASSERTION").otherwise("BSD-2-Clause").alias("licenseConcluded"), refs.alias("externalRefs"), purpose.alias("primaryPackagePurpose"))
        made = df.groupBy("app_id", "application").agg(F.collect_list(part).alias("p"))
        root = F.struct(F.lit("root").alias("SPDXID"), F.col("application").alias("name"), F.lit("1").alias("versionInfo"), F.lit(None).cast("string").alias("licenseConcluded"), F.lit(None).cast("array<struct<referenceType:string,referenceLocator:string>>").alias("externalRefs"), F.lit(None).cast("string").alias("primaryPackagePurpose"))
        body = F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.col("application").alias("name"), F.array(F.lit("root")).alias("documentDescribes"), F.concat(F.array(root), "p").alias("packages"))
    return made.select("app_id", F.to_json(body).alias("document"))


PURL_SQL = "CASE WHEN part_id % 6 <> 0 THEN 'pkg:' || ecosystem || '/org/' || package || '@' || version ELSE 'pkg:generic/' || package || '@' || version END"
TYPED_PURL = PURL_SQL.replace("'pkg:generic/'", "CASE WHEN part_id % 12 = 6 THEN 'pkg:library/' ELSE 'pkg:generic/' END")
BOOK.on("sbom_cyclonedx", "v_components", f"SELECT app_id, application, package AS name, version, {TYPED_PURL} AS purl, CASE part_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0 OR MIT' ELSE '' END AS licenses, direct OR NOT bool_or(direct) OVER (PARTITION BY app_id) AS direct FROM v_components")(lambda df: S.from_cyclonedx(documents(df, "cyclonedx")).withColumn("licenses", F.array_join("licenses", ", ")))
BOOK.on("sbom_spdx", "v_components", f"SELECT app_id, application, package AS name, version, {PURL_SQL} AS purl, part_id % 5 <> 1 AS direct, CASE WHEN part_id % 4 = 0 THEN '' ELSE 'BSD-2-Clause' END AS licenses FROM v_components")(lambda df: S.from_spdx(documents(df, "spdx")).withColumn("licenses", F.array_join("licenses", ", ")))
BOOK.on("src_sbom_docs", "v_components", "SELECT application, count(*) AS components FROM v_components GROUP BY application")(lambda df: S.from_cyclonedx(documents(df.where("app_id % 2 = 0"), "cyclonedx")).unionByName(S.from_spdx(documents(df.where("app_id % 2 = 1"), "spdx"))).groupBy("application").agg(F.count(F.lit(1)).alias("components")))
BOOK.on("sbom_purl", "v_components", f"SELECT part_id, CASE WHEN part_id % 6 <> 0 THEN ecosystem ELSE 'generic' END AS ecosystem, package AS name, version FROM v_components")(
    lambda df: df.select("part_id", S.purl_parts(F.when(F.col("part_id") % 6 != 0, F.concat(F.lit("pkg:"), "ecosystem", F.lit("/org/"), "package", F.lit("@"), "version", F.lit("?arch=x#src"))).otherwise(S.synthetic_purl(F.col("package"), F.col("version")))).alias("p")).select("part_id", "p.ecosystem", "p.name", "p.version")
)
BOOK.on("sbom_inventory", "v_components", "SELECT DISTINCT tenant, application, package, version FROM (SELECT *, max(revision) OVER (PARTITION BY tenant, application) AS newest FROM v_components) WHERE revision = newest")(lambda df: S.newest_inventory(df, "revision", ["tenant", "application"], ["tenant", "application", "package", "version"]).select("tenant", "application", "package", "version"))
BOOK.on("sbom_version_key", "v_components", f"SELECT part_id, CAST(dense_rank() OVER (PARTITION BY package ORDER BY {DUCK_KEY.format('version')}) AS BIGINT) AS place FROM v_components")(lambda df: df.withColumn("place", F.dense_rank().over(Window.partitionBy("package").orderBy(V.version_key(F.col("version")))).cast("long")).select("part_id", "place"))
BOOK.over("sbom_range_match", "v_components", "v_advisories", oracle=f"SELECT c.part_id, a.vuln_id {PAIRS} WHERE {INSIDE}")(lambda c, a: S.in_range_matches(c, a).select("part_id", "vuln_id"))
BOOK.over("sbom_match", "v_components", "v_advisories", oracle=f"SELECT c.part_id, a.vuln_id, CASE WHEN {OPEN} THEN 'affected' WHEN coalesce(fixed, '') <> '' AND {_K['version']} >= {_K['fixed']} THEN 'fixed' ELSE 'not_affected' END AS status {PAIRS}")(lambda c, a: S.advisory_states(c, a).select("part_id", "vuln_id", "status"))
BOOK.over("sbom_impact", "v_components", "v_advisories", oracle=f"WITH {MATCHES}, o AS (SELECT * FROM matches WHERE severity = 'critical'), h AS (SELECT DISTINCT c.app_id {PAIRS} WHERE a.severity = 'critical'), f AS (SELECT app_id, count(*) AS findings FROM o GROUP BY 1) SELECT a.app_id, CASE WHEN f.findings > 0 THEN 'affected' WHEN h.app_id IS NOT NULL THEN 'unaffected' ELSE 'not_present' END AS state, coalesce(f.findings, 0) AS findings FROM (SELECT DISTINCT app_id FROM v_components) a LEFT JOIN f USING (app_id) LEFT JOIN h USING (app_id)")(lambda c, a: S.impact(c.select("app_id").distinct(), c, a.where("severity = 'critical'")).select("app_id", "state", "findings"))


@BOOK.over("sbom_fixed", "v_components", "v_advisories", oracle=f"WITH f AS (SELECT c.part_id, c.version, a.vuln_id, a.form, a.low, a.high, CASE WHEN a.form = 2 THEN '1.0.1' ELSE a.fixed END AS now_fixed {PAIRS} WHERE {OPEN}) SELECT part_id, vuln_id, CASE WHEN coalesce(now_fixed, '') = '' OR {_K['version']} < {DUCK_KEY.format('now_fixed')} THEN 'affected' ELSE 'fixed' END AS status FROM f")
def fix_published(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Links found earlier, after some advisories published an earlier fix: their status now."""
    links = S.match_advisories(components, advisories).select("part_id", "vuln_id", "version")
    revised = advisories.withColumn("fixed", F.when(F.col("form") == 2, "1.0.1").otherwise(F.col("fixed")))
    return S.rematch(links, revised).select("part_id", "vuln_id", "status")


BOOK.over("sbom_findings", "v_components", "v_advisories", oracle=f"WITH {MATCHES} SELECT application, package, vuln_id, severity, count(*) AS parts FROM matches GROUP BY ALL")(lambda c, a: S.match_advisories(c, a).groupBy("application", "package", "vuln_id", "severity").agg(F.count(F.lit(1)).alias("parts")))
BOOK.over("sbom_applications", "v_components", "v_advisories", oracle=f"WITH {MATCHES}, f AS (SELECT application, count(*) AS findings FROM matches GROUP BY application) SELECT c.application, count(*) AS components, count(*) FILTER (WHERE direct) AS direct, coalesce(max(f.findings), 0) AS findings FROM v_components c LEFT JOIN f USING (application) GROUP BY c.application")(
    lambda c, a: c.groupBy("application").agg(F.count(F.lit(1)).alias("components"), F.count_if("direct").alias("direct")).join(S.match_advisories(c, a).groupBy("application").agg(F.count(F.lit(1)).alias("findings")), "application", "left").select("application", "components", "direct", F.coalesce("findings", F.lit(0)).alias("findings"))
)
BOOK.on("sbom_components", "v_components", "SELECT package, count(DISTINCT version) AS versions, count(DISTINCT application) AS applications FROM v_components WHERE contains(package, '-1') GROUP BY package")(lambda df: df.where(F.lower("package").contains("-1")).groupBy("package").agg(F.countDistinct("version").alias("versions"), F.countDistinct("application").alias("applications")))
BOOK.over("sbom_stats", "v_components", "v_advisories", oracle=f"WITH {MATCHES} SELECT severity, count(*) AS findings, count(DISTINCT application) AS applications FROM matches GROUP BY severity")(lambda c, a: S.match_advisories(c, a).groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("application").alias("applications")))

# Collaboration

BOOK.over("note_mentions", "v_notes", "v_users", oracle="""WITH h AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(' ' || body, '(^|[^A-Za-z0-9_.@])@([A-Za-z0-9_.+-]*[A-Za-z0-9_](@[A-Za-z0-9_.-]*[A-Za-z0-9_])?)', 2))) AS handle FROM v_notes),
  p AS (SELECT DISTINCT email FROM v_users), l AS (SELECT split_part(email, '@', 1) AS local, count(*) AS holders, min(email) AS only FROM p GROUP BY 1)
  SELECT h.id, h.handle, CASE WHEN p.email IS NOT NULL OR l.holders = 1 THEN 'resolved' WHEN l.holders > 1 THEN 'ambiguous' ELSE 'unknown' END AS state, coalesce(p.email, CASE WHEN l.holders = 1 THEN l.only END) AS email FROM h LEFT JOIN p ON h.handle = p.email LEFT JOIN l ON h.handle = l.local""")(T.mentions)
BOOK.on("note_threads", "v_notes", "SELECT n.id, n.incident_id, coalesce((SELECT string_agg(r.id::VARCHAR, ',' ORDER BY r.t, r.id) FROM v_notes r WHERE r.parent_id = n.id AND r.incident_id = n.incident_id), '') AS replies FROM v_notes n WHERE NOT EXISTS (SELECT 1 FROM v_notes p WHERE p.id = n.parent_id AND p.incident_id = n.incident_id)")(T.threads)

REASONS = "reasons AS (SELECT incident_id, author AS email, 'author' AS reason, t FROM v_notes UNION ALL SELECT incident_id, 'user' || (incident_id + t) % 150 || '@corp.example', 'mentioned', t FROM v_notes)"


def reasons(df: DataFrame) -> DataFrame:
    other = F.concat(F.lit("user"), ((F.col("incident_id") + F.col("t")) % 150).cast("string"), F.lit("@corp.example"))
    return df.select("incident_id", F.col("author").alias("email"), F.lit("author").alias("reason"), "t").union(df.select("incident_id", other, F.lit("mentioned"), "t"))


BOOK.on("note_watchers", "v_notes", f"WITH {REASONS} SELECT incident_id, email, arg_min(reason, (t, reason)) AS reason, min(t) AS since FROM reasons GROUP BY incident_id, email")(lambda df: T.watchers(reasons(df)))


@BOOK.over("notify_recipients", "v_notes", "v_users", oracle=f"WITH {REASONS}, w AS (SELECT DISTINCT incident_id, email FROM reasons), l AS (SELECT DISTINCT n.incident_id, u.email FROM (SELECT DISTINCT incident_id FROM v_notes) n JOIN v_users u ON u.team_id = n.incident_id % (SELECT max(team_id) + 1 FROM v_users) AND u.role = 'lead') SELECT incident_id, email FROM (SELECT * FROM w UNION SELECT * FROM l) WHERE email <> 'user' || incident_id % 150 || '@corp.example'")
def recipients(notes: DataFrame, users: DataFrame) -> DataFrame:
    """Watchers and the team's leads, without the actor."""
    watching = reasons(notes).select("incident_id", "email")
    count = users.agg((F.max("team_id") + 1).alias("teams"))  # one row
    teams = notes.select("incident_id").distinct().join(F.broadcast(count)).withColumn("team_id", F.col("incident_id") % F.col("teams"))
    leads = teams.join(users.where("role = 'lead'"), "team_id").select("incident_id", "email")
    actor = F.concat(F.lit("user"), (F.col("incident_id") % 150).cast("string"), F.lit("@corp.example"))
    return watching.union(leads).distinct().where(F.col("email") != actor)


BOOK.on("notify_retry_due", "v_alerts", "SELECT id FROM v_alerts WHERE status = 'closed' AND occurrences - 1 < 4 AND t + CASE occurrences - 1 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 1800 END * 1000000::BIGINT <= 1705000000000000")(
    lambda df: T.retry_due(df.select("id", F.when(F.col("status") == "closed", "failed").otherwise("sent").alias("status"), (F.col("occurrences") - 1).alias("attempts"), F.col("t").alias("last_attempt")), 1705000000000000).select("id")
)
