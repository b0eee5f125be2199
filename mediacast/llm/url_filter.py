"""URL filter: explicit rules, and for urls without one a tree of path templates judged by labelled purity.

Paths become templates per host: digit runs are wildcards, and so are the values of a segment that are many under their
parent, each with a small share of the distinct raw templates there, but no value that a rule names. Rows that repeat do not
matter, nor does the size of a host. Sibling templates whose share of blocked labels does not differ from their parent's beyond chance are merged and share
their counts. A template is rejected when its smoothed share of blocked labels is high. Labels are the verdicts of the rules.
A template without labels takes those of its merged siblings, if two or more of them are alike.
Raw paths are counted by template first, so everything after that grows with templates, not with urls.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.session import stage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

DEPTH = 5
MANY_VALUES = 20
SMOOTHING = 1.0
REJECTED_PURITY = 0.9
WIDTH = 1.96


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null and for urls without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def path_segments(path: Column) -> Column:
    """``DEPTH`` segments with digit runs as wildcards; what lies deeper stays one segment, missing ones are empty."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*"), "/", DEPTH)
    return F.transform(F.sequence(F.lit(0), F.lit(DEPTH - 1)), lambda i: F.coalesce(F.get(parts, i), F.lit("")))


def _named(level: int, rules: Sequence[Rule]) -> Column:
    """Whether a rule for this host names the raw segments up to this level."""
    found = F.lit(False)
    for rule in rules:
        parts = [re.sub("[0-9]+", "*", x) for x in rule.path.removeprefix("/").split("/", DEPTH - 1)]
        if level < len(parts) and parts[level]:
            fits = (F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))
            for i, part in enumerate(parts[: level + 1]):
                fits &= F.get("raw", F.lit(i)) == part
            found |= fits
    return found


def template_tree(counts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(host, raw, template, purity)`` for the raw templates ``(host, raw, urls, labelled, blocked)`` of all hosts.

    From the root on, values with at most one of ``MANY_VALUES`` parts of the raw templates below their parent become a wildcard
    if they are ``MANY_VALUES`` or more. Values that a rule names stay. Hot hosts cost nothing: every level is aggregated before
    it is joined, and written, since the next one reads it several times.
    """
    tree = counts.withColumn("template", F.array().cast("array<string>"))
    for level in range(DEPTH):
        value = F.get("raw", F.lit(level))
        rows = tree.withColumn("value", value).withColumn("named", _named(level, rules))
        values = stage(rows.groupBy("host", "template", "value").agg(F.count("*").alias("paths"), F.max("named").alias("named")), f"values-{level}")
        parents = values.groupBy("host", "template").agg(F.sum("paths").alias("all"))
        light = values.join(parents, ["host", "template"]).where(~F.col("named") & (F.col("paths") * MANY_VALUES <= F.col("all")))
        many = light.groupBy("host", "template").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= MANY_VALUES)
        wild = light.join(many, ["host", "template"]).select("host", "template", "value", F.lit("*").alias("wild"))
        tree = rows.join(wild, ["host", "template", "value"], "left").select(
            *counts.columns, F.concat("template", F.array(F.coalesce("wild", "value"))).alias("template")
        )
        tree = stage(tree, f"tree-{level}")
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # the parent of a template: its host and all segments but the last one that is not empty
    depth = F.size(F.filter("template", lambda x: x != ""))
    leaves = leaves.withColumn("parent", F.slice("template", F.lit(1), F.greatest(depth - 1, F.lit(0))))
    parents = leaves.groupBy("host", "parent").agg(F.sum("labelled").alias("of_labelled"), F.sum("blocked").alias("of_blocked"))
    share = F.try_divide("of_blocked", "of_labelled")
    apart = F.abs(F.try_divide("blocked", "labelled") - share)
    chance = WIDTH * F.sqrt(F.try_divide(share * (1 - share), F.col("labelled")))
    branches = leaves.join(parents, ["host", "parent"]).withColumn("similar", F.coalesce(apart <= chance, F.lit(False)))
    merged = (
        branches.where("similar").groupBy("host", "parent").agg(F.sum("labelled").alias("m_labelled"), F.sum("blocked").alias("m_blocked"), F.count("*").alias("m_kinds"))
    )
    # unlabelled templates take the labels of siblings only if several are alike: a single one says nothing about others
    takes = F.col("similar") | ((F.col("labelled") == 0) & F.coalesce(F.col("m_kinds") >= 2, F.lit(False)))
    judged = branches.join(merged, ["host", "parent"], "left").withColumn(
        "purity",
        (F.when(takes, F.col("m_blocked")).otherwise(F.col("blocked")) + SMOOTHING)
        / (F.when(takes, F.col("m_labelled")).otherwise(F.col("labelled")) + 2 * SMOOTHING),
    )
    return tree.select("host", "raw", "template").join(judged.select("host", "template", "purity"), ["host", "template"])


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, host, path, rule, verdict, template, purity)`` for every row.

    A null url has an empty host and path and is judged like any other. Templates without labels and without merged
    siblings have purity one half and are allowed. Repeated rows count and are judged alike; keys may be null; other columns are not read.
    """
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    named = parts.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("raw", path_segments(F.col("path")))
    counts = named.groupBy("host", "raw").agg(
        F.count("*").alias("urls"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")
    )
    tree = stage(template_tree(stage(counts, "templates"), rules), "template-tree")
    found = named.join(tree, ["host", "raw"])
    learned = F.when(F.col("purity") >= REJECTED_PURITY, "block").otherwise("allow")
    return found.select(
        key, "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"
    )
