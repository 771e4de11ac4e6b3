"""Consolidation: findings matched by rules, aggregated by rule and by affected service."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions.scalars import distinct_in_order, in_order, port_key, risk_priority, strip
from reportmill.operators import stats
from reportmill.plans import many, prefilter
from reportmill.plans import rules as R

log = logging.getLogger("reportmill")


@dataclass
class Consolidated:
    """Lazy results: evaluation of rules and plugins (rows that matched or have a reason), entries by rule, services by rule and key, outputs by service and plugin, and the metadata row.

    places: services without their issues, which cost much less to find. issues: these, in rows of their own. judged: plugins with their results, which all others read."""

    evaluation: DataFrame
    entries: DataFrame
    services: DataFrame
    outputs: DataFrame
    metadata: DataFrame
    places: DataFrame
    issues: DataFrame
    judged: DataFrame


def _passing(readers: list[dict], name: Column, family: Column) -> Column:
    """Whether any of the rules lets a plugin through to its filters of outputs."""
    wanted = F.lit(False)
    for r in readers:
        passes, later = R.name_filters(r, name, family)
        for _, ok in later:
            passes = passes & ok
        wanted = wanted | passes
    return wanted


def _spoken_by(some: DataFrame, plugin_hosts: DataFrame, items: DataFrame | None) -> DataFrame:
    """Outputs of some plugins, by host. items: what the outputs are the first of; those of other plugins are then left out before firsts are looked for,
    and rows are dealt by plugin once for all that follows."""
    key = ["file_id", "plugin_id"]
    if items is not None:
        rows = items.select(*key, "host_ord", "ord", "plugin_output").join(some.hint("shuffle_hash"), key, "left_semi")
        first = rows.groupBy("plugin_id", "host_ord", "file_id").agg(F.min(F.struct("ord", "plugin_output")).alias("x"))
        return first.select(*key, "host_ord", "x.*").filter(F.col("plugin_output") != "")
    return plugin_hosts.filter(F.col("plugin_output") != "").join(some, key, "left_semi")


def evaluate_rules(plugins: DataFrame, plugin_hosts: DataFrame, rules: list[dict], noted: bool = False) -> DataFrame:
    """One row for each plugin and rule: rule_ord, rule_name, matched, reason. Rules do not exclude each other. noted: only rows that matched or
    have a reason.

    The outputs of a plugin count as one text, one host's after the other's. A pattern that cannot reach over a line's end is tested
    host by host, so that only one bit for each pattern is shuffled. One that asks for something, any text, and something else is tested in each
    output, and beyond that its first half must be found in an output before one that has its second half: two places are shuffled. Outputs are
    joined for other patterns alone, and only of plugins that such a rule lets through so far.

    Of rules with over ``many.MANY`` patterns, those are tried whose required literals a text holds (``evaluate_many``)."""
    if len(many.patterns_of(rules)) > many.MANY:
        return evaluate_many(plugins, plugin_hosts, rules, noted)
    return evaluations(judge(plugins, plugin_hosts, rules), rules, noted)


def judge(plugins: DataFrame, plugin_hosts: DataFrame, rules: list[dict], items: DataFrame | None = None) -> DataFrame:
    """One row for each plugin, with all its columns and ``results``, an array of rule_ord, matched, reason and what else ``evaluations`` reads. Of rules
    with over ``many.MANY`` patterns it has those that matched or have a reason. items: see ``_spoken_by``."""
    if len(many.patterns_of(rules)) > many.MANY:
        return judge_many(plugins, plugin_hosts, rules, items)
    name, family = F.coalesce(F.col("name"), F.lit("")), F.col("family")
    readers = [r for r in rules if R.reads_output(r)]
    base = plugins
    patterns = sorted({p for r in readers for p in R.output_patterns(r)})
    single = [p for p in patterns if R.within_a_line(p)]
    parted = {p: h for p in patterns if p not in single and (h := R.halves(p))}
    deep = [p for p in single if R.recursive(p)]
    key, held = ["file_id", "plugin_id"], {}
    if patterns:
        some = base.filter(_passing(readers, name, family)).select(*key)
        output = F.col("plugin_output")
        said = _spoken_by(some, plugin_hosts, items)
        if deep:
            said = said.withColumn("deep", R.python_matches(output, deep))
        found = {}
        for k, p in enumerate(patterns):
            if p in deep:
                found[f"p{k}"] = F.bool_or(F.get("deep", deep.index(p)))
            elif p in single:
                found[f"p{k}"] = F.bool_or(R.output_match(output, p))
            elif p in parted:
                first, second = parted[p]
                found[f"p{k}"] = F.bool_or(R.output_match(output, first + R.GAPS[0] + second))
                found[f"first{k}"] = F.min(F.when(R.output_match(F.concat(output, F.lit("\n")), first), F.col("ord")))
                found[f"last{k}"] = F.max(F.when(R.output_match(output, second), F.col("ord")))
        spoken = said.groupBy(*key).agg(F.lit(True).alias("spoken"), *[c.alias(n) for n, c in found.items()])
        base = base.join(spoken, key, "left")
        for k, p in enumerate(patterns):
            if p in single or p in parted:
                over = F.col(f"first{k}") < F.col(f"last{k}") if p in parted else F.lit(False)
                held[p] = F.coalesce(F.col(f"p{k}"), F.lit(False)) | F.coalesce(over, F.lit(False))
    rest = [p for p in patterns if p not in held]
    if rest:
        wide = [r for r in readers if set(R.output_patterns(r)) & set(rest)]
        some = base.filter(_passing(wide, name, family)).select(*key)
        joined = _spoken_by(some, plugin_hosts, items).groupBy(*key).agg(F.array_join(in_order(F.col("plugin_output"), F.col("ord")), "\n").alias("outputs"))
        base = base.join(joined.select(*key, R.python_matches(F.col("outputs"), rest).alias("rest")), key, "left")
        held |= {p: F.coalesce(F.get("rest", k), F.lit(False)) for k, p in enumerate(rest)}
    spoken = F.coalesce(F.col("spoken"), F.lit(False)) if patterns else F.lit(False)
    # Verdicts are columns of their own, so that each is found once however often it is read.
    base = base.withColumns({f"_verdict{k}": R.verdict(r, name, family, spoken, held) for k, r in enumerate(rules)})
    return base.select(*[F.col(c) for c in plugins.columns], F.array(*[R.result(k, r, F.col(f"_verdict{k}")) for k, r in enumerate(rules)]).alias("results"))


_EVALUATION = ["file_id", "plugin_id", "name", "plugin_ord", "rule_ord", "rule_name", "matched", "reason"]


def evaluations(judged: DataFrame, rules: list[dict], noted: bool, *also: str) -> DataFrame:
    """One row for each plugin and result; noted: that matched or has a reason. also: columns of plugins that are wanted."""
    # Without "outer", Spark finds all results once more, to see whether there are any.
    rows = judged.select("file_id", "plugin_id", "name", F.col("ord").alias("plugin_ord"), *also, F.explode_outer("results").alias("r")).select("file_id", "plugin_id", "name", "plugin_ord", *also, "r.*")
    if "rule_name" not in rows.columns:
        rows = rows.join(F.broadcast(R.rules_frame(judged.sparkSession, rules).select("rule_ord", "rule_name")), "rule_ord")  # as many rows as the configuration has rules
    return (rows.filter(F.col("matched") | F.col("reason").isNotNull()) if noted else rows).select(*_EVALUATION, *also)


def _held_by_output(said: DataFrame, patterns: list[str], parted: dict[str, tuple[str, str]]) -> DataFrame:
    """file_id, plugin_id, spoken, held: places of the patterns that some output matches, or of whose halves one output has the first and a later one the
    second. Outputs become hits before they are shuffled, and hits are combined by pattern."""
    whole = [p for p in patterns if p not in parted or parted[p]]
    asked = [p if p not in parted else parted[p][0] + R.GAPS[0] + parted[p][1] for p in whole]
    halved = [p for p in patterns if parted.get(p)]
    output = F.col("plugin_output")

    def placed(found: Column, of: list[str], part: int) -> Column:
        at = F.array(*[F.lit(patterns.index(p)) for p in of]) if of else F.array().cast("array<int>")
        return F.transform(found, lambda k: F.struct(F.get(at, k).alias("at"), F.lit(part).alias("part")))

    parts = [placed(prefilter.hits(output, asked), whole, 0)]
    if halved:
        parts += [placed(prefilter.hits(output, [parted[p][0] for p in halved], "\n"), halved, 1), placed(prefilter.hits(output, [parted[p][1] for p in halved]), halved, 2)]
    rows = said.select("file_id", "plugin_id", "ord", F.explode_outer(F.concat(*parts)).alias("hit")).select("file_id", "plugin_id", "ord", "hit.*")
    at = rows.groupBy("file_id", "plugin_id", "at").agg(F.bool_or(F.col("part") == 0).alias("one"), *[(F.min, F.max)[part - 1](F.when(F.col("part") == part, F.col("ord"))).alias(f"part{part}") for part in (1, 2)])
    held = F.coalesce(F.col("one"), F.lit(False)) | F.coalesce(F.col("part1") < F.col("part2"), F.lit(False))
    return at.groupBy("file_id", "plugin_id").agg(F.lit(True).alias("spoken"), F.collect_list(F.when(held, F.col("at"))).alias("held"))


def judge_many(plugins: DataFrame, plugin_hosts: DataFrame, rules: list[dict], items: DataFrame | None = None) -> DataFrame:
    """``judge`` for any number of rules: one pass over names and one over outputs, each with one automaton for all patterns."""
    name, key = F.coalesce(F.col("name"), F.lit("")), ["file_id", "plugin_id"]
    base = plugins
    patterns = sorted({p for r in rules for p in R.output_patterns(r)})
    spoken, held = F.lit(False), F.array().cast("array<int>")
    if patterns:
        parted = {p: R.halves(p) for p in patterns if not R.within_a_line(p)}
        said = _spoken_by(base.filter(many.may_read(name, F.col("family"), rules)).select(*key), plugin_hosts, items)
        base = base.join(_held_by_output(said, patterns, parted), key, "left")
        spoken, held = F.coalesce(F.col("spoken"), F.lit(False)), F.coalesce(F.col("held"), held)
        if rest := [p for p in patterns if p in parted and not parted[p]]:
            wide = [r for r in rules if set(R.output_patterns(r)) & set(rest)]
            some = base.filter(many.may_read(name, F.col("family"), wide)).select(*key)
            joined = _spoken_by(some, plugin_hosts, items).groupBy(*key).agg(F.array_join(in_order(F.col("plugin_output"), F.col("ord")), "\n").alias("outputs"))
            places = F.array(*[F.lit(patterns.index(p)) for p in rest])
            base = base.join(joined.select(*key, prefilter.hits(F.col("outputs"), rest).alias("rest")), key, "left")
            held = F.concat(held, F.transform(F.coalesce(F.col("rest"), F.array().cast("array<int>")), lambda k: F.get(places, k)))
    return base.select(*[F.col(c) for c in plugins.columns], many.verdicts(name, F.col("family"), spoken, held, rules, patterns).alias("results"))


def evaluate_many(plugins: DataFrame, plugin_hosts: DataFrame, rules: list[dict], noted: bool = False) -> DataFrame:
    """The rows of ``evaluate_rules`` for any number of rules."""
    found = evaluations(judge_many(plugins, plugin_hosts, rules), rules, noted)
    if noted:
        return found
    key = ["file_id", "plugin_id"]
    names = F.broadcast(R.rules_frame(plugins.sparkSession, rules).select("rule_ord", "rule_name"))  # as many rows as the configuration has rules
    every = plugins.select("file_id", "plugin_id", "name", F.col("ord").alias("plugin_ord"), F.explode(F.array(*[F.lit(k) for k in range(len(rules))])).alias("rule_ord"))
    judged = found.select("file_id", "plugin_id", "rule_ord", "matched", "reason")
    return every.join(judged, [*key, "rule_ord"], "left").withColumn("matched", F.coalesce("matched", F.lit(False))).join(names, "rule_ord").select(*_EVALUATION)


def _first_of_largest(value: Column, size: Column, ord_: Column) -> Column:
    """Of the largest, the first in order: a minimum by (-size, ord)."""
    return F.min_by(value, F.struct((-size).alias("s"), ord_.alias("o")))


def _union(column: str) -> Column:
    """Distinct lists are gathered, which tasks combine before they meet, and not one of each row."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.coalesce(F.col(column), F.array().cast("array<string>")))), lambda x: x.isNotNull() & (x != ""))))


#: What entries say of their plugins, and the column of plugins that it comes from.
FIELDS = {x: x for x in ("severity", "risk_factor", "cvss", "cvss3", "cve", "cwe", "xref", "see_also")} | {"solutions": "solution"}


def entries(matches: DataFrame, fields: list[str]) -> DataFrame:
    """matches: evaluations that matched, with what the fields come from. One row for each file and rule. Sets are sorted; solutions and plugins keep the
    order of first sight."""
    o = F.col("plugin_ord")
    made = {
        "severity": F.max("severity"), "risk_factor": _first_of_largest(F.col("risk_factor"), risk_priority(F.col("risk_factor")), o),
        **{c: F.when(F.max(f"{c}.base_score") > 0, _first_of_largest(F.col(c), F.coalesce(F.col(f"{c}.base_score"), F.lit(0.0)), o)).otherwise(
            F.struct(F.lit(0.0).alias("base_score"), F.lit(0.0).alias("temporal_score"), F.lit("").alias("vector"))) for c in ("cvss", "cvss3")},
        **{c: _union(c) for c in ("cve", "cwe", "xref", "see_also")},
        "solutions": distinct_in_order(F.nullif(strip(F.col("solution")), F.lit("")), o),
    }
    plugins = in_order(F.struct(F.col("plugin_id").alias("id"), F.col("name").alias("name")), o).alias("consolidated_plugins")
    return matches.groupBy("file_id", "rule_ord", "rule_name").agg(*[c.alias(k) for k, c in made.items() if k in fields], plugins)


def service_key(grouping: Column, ip: Column, port: Column) -> Column:
    has_ip, has_port = F.array_contains(grouping, "ip"), F.array_contains(grouping, "port")
    return F.when(has_ip & has_port, F.concat_ws(":", ip, port)).when(has_port, port).otherwise(ip)


def _affected(matches: DataFrame, plugin_hosts: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each match and host with a port: its service key, and ``at``, the place by which firsts and lasts go."""
    ports = plugin_hosts.withColumn("port_key", port_key(F.col("port"), F.col("protocol"))).filter("port_key is not null")
    rows = ports.select("file_id", "plugin_id", "host_ord", "port_key", "plugin_output", F.col("ord").alias("host_item")).join(
        matches.select("file_id", "plugin_id", "name", "plugin_ord", "rule_ord", "rule_name"), ["file_id", "plugin_id"])
    rows = rows.join(hosts.select("file_id", "host_ord", "ip", "fqdn"), ["file_id", "host_ord"]).join(rules.select("rule_ord", "grouping"), "rule_ord")
    return rows.withColumns({"service_key": service_key(F.col("grouping"), F.col("ip"), F.col("port_key")), "at": F.struct("plugin_ord", "host_item")})


_SERVICE = ["file_id", "rule_ord", "rule_name", "service_key"]


def affected_services(matches: DataFrame, plugin_hosts: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each file, rule and service key: ip, fqdn and port first seen, and issues by first sight.

    Findings without a port affect no service."""
    rows = _affected(matches, plugin_hosts, hosts, rules)
    # All rows of a plugin lie between those of its neighbours, so plugins can be reduced to their first row each before they are listed.
    plugins = rows.groupBy(*_SERVICE, "plugin_id", "name").agg(F.min_by(F.struct("ip", "fqdn", "port_key"), "at").alias("seen"), F.min("at").alias("at"))
    issue = F.struct(F.col("plugin_id").alias("id"), F.col("name").alias("name"))
    return plugins.groupBy(*_SERVICE).agg(
        F.min("at").alias("first_seen"), F.min_by("seen", "at").alias("seen"), in_order(issue, F.col("at")).alias("issues_found")
    ).select(*_SERVICE, "first_seen", "seen.ip", "seen.fqdn", F.col("seen.port_key").alias("port"), "issues_found")


def _first_places(matches: DataFrame, items: DataFrame, hosts: DataFrame, *also: str) -> DataFrame:
    """One row for each plugin that matched and host with a port, by its first item there: file_id, plugin_id, plugin_ord, rules (those it matched), ord, port_key,
    ip, fqdn and what else of items is named. Items meet the plugins first, so that they are dealt by plugin once and the others' are left out."""
    key = ["file_id", "plugin_id"]
    sets = matches.groupBy("plugin_id", "file_id").agg(F.min("plugin_ord").alias("plugin_ord"), F.array_join(F.array_sort(F.collect_list("rule_ord")), ",").alias("rules"))
    rows = items.select(*key, "host_ord", "ord", "port", "protocol", *also).join(sets.hint("shuffle_hash"), key)
    first = rows.groupBy("plugin_id", "host_ord", "file_id").agg(F.min(F.struct("ord", "port", "protocol", "plugin_ord", "rules", *also)).alias("x")).select(*key, "host_ord", "x.*")
    ports = first.withColumn("port_key", port_key(F.col("port"), F.col("protocol"))).filter("port_key is not null").drop("port", "protocol")
    return ports.join(hosts.select("file_id", "host_ord", "ip", "fqdn"), ["file_id", "host_ord"])


def _by_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of first places once for each of their rules, with its name and the service key."""
    return rows.withColumn("rule_ord", F.explode(F.split("rules", ",").cast("array<int>"))).join(rules.select("rule_ord", "rule_name", "grouping"), "rule_ord").withColumn("service_key", service_key(F.col("grouping"), F.col("ip"), F.col("port_key")))


def service_places(matches: DataFrame, items: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of :func:`affected_services` without issues.

    A key depends on the rule, the address and the port. So firsts are found for each of these and for the plugins that match the same rules, and only
    they are multiplied by rules."""
    seen = F.min(F.struct(F.struct("plugin_ord", F.col("ord").alias("host_item")).alias("at"), "fqdn")).alias("x")
    firsts = _first_places(matches, items, hosts).groupBy("rules", "ip", "port_key", "file_id").agg(seen).select("file_id", "ip", "port_key", "rules", "x.*")
    seen = _by_rule(firsts, rules).groupBy(*reversed(_SERVICE)).agg(F.min("at").alias("first_seen"), F.min_by(F.struct("ip", "fqdn", "port_key"), "at").alias("seen"))
    return seen.select(*_SERVICE, "first_seen", "seen.ip", "seen.fqdn", F.col("seen.port_key").alias("port"))


def service_issues(matches: DataFrame, items: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each file, rule, service key and plugin, with plugin_ord, by which the issues of a service are ordered: the issues of
    :func:`affected_services` where no list of them has to fit a task."""
    rows = _by_rule(_first_places(matches, items, hosts), rules)
    return rows.groupBy("plugin_id", *reversed(_SERVICE)).agg(F.min("plugin_ord").alias("plugin_ord")).select(*_SERVICE, "plugin_id", "plugin_ord")


def service_outputs(matches: DataFrame, items: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each file, rule, service key and plugin that said anything there: its last output, and the place of its first."""
    said = _by_rule(_first_places(matches, items, hosts, "plugin_output").filter(F.coalesce("plugin_output", F.lit("")) != ""), rules)
    # Of one plugin, places go by its items.
    found = said.groupBy("plugin_id", *reversed(_SERVICE)).agg(F.min(F.struct("plugin_ord", F.col("ord").alias("host_item"))).alias("first_said"), F.max(F.struct("ord", "plugin_output")).alias("last"))
    return found.select(*_SERVICE, "plugin_id", "first_said", "last.plugin_output")


def with_outputs(services: DataFrame, outputs: DataFrame) -> DataFrame:
    """Services with ``plugin_outputs``, a map from plugin to output."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_said", "plugin_id", "plugin_output"))), lambda x: F.struct(x["plugin_id"], x["plugin_output"]))
    maps = outputs.groupBy(*_SERVICE).agg(F.map_from_entries(listed).alias("plugin_outputs"))
    return services.join(maps, _SERVICE, "left").withColumn("plugin_outputs", F.coalesce("plugin_outputs", F.create_map().cast("map<string,string>")))


def consolidate(items: DataFrame, hosts: DataFrame, rules: list[dict] | None, keep: bool = False, fields: list[str] | None = None) -> Consolidated | None:
    """None where there are no valid, enabled rules; why is logged. keep: what all results read is kept on the executors. fields: of entries, those
    (of ``FIELDS``) that are wanted, all unless given; others are not read."""
    wrong = ["there are no rules"] if rules is None else R.problems(rules)
    live = [] if wrong else R.enabled(rules)
    for x in wrong or ([] if live else ["no rule is enabled"]):
        log.error("consolidation is left out: %s", x)
    if not live:
        return None
    for x in R.warnings(live):
        log.warning("%s", x)
    spark = items.sparkSession
    fields = list(FIELDS) if fields is None else fields
    read = [FIELDS[x] for x in fields]
    affected = stats.plugin_hosts(items)
    judged = judge(stats.plugins(items, ["name", "family", *read]), affected, live, items)
    if keep:
        judged.persist(StorageLevel.MEMORY_AND_DISK)
    evaluation = evaluations(judged, live, True)
    matches = evaluation.filter("matched")
    frame = F.broadcast(R.rules_frame(spark, live))  # as many rows as the configuration has rules
    matched = F.size(F.filter("results", lambda r: r["matched"])).cast("long")
    metadata = judged.select("file_id", matched.alias("n")).groupBy("file_id").agg(F.count("*").alias("original_plugins_count"), F.sum("n").alias("consolidated_count"), F.count_if(F.col("n") > 0).alias("distinct_consolidated"))
    metadata = metadata.withColumn("rules_applied", F.array(*[F.lit(r["rule_name"]) for r in live]))
    full = entries(evaluations(judged, live, True, *read).filter("matched and plugin_id is not null"), fields).join(frame.drop("rule_name"), "rule_ord")
    parts = (matches, items, hosts, frame)
    return Consolidated(evaluation, full, affected_services(matches, affected, hosts, frame), service_outputs(*parts), metadata, service_places(*parts), service_issues(*parts), judged)
