"""All row rules in one pass over the traffic, instead of one scan per rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from httplens.functions.traffic_text import TEXTS, bind, with_texts
from httplens.plans.rules import RULES, Rule
from httplens.schema import BASE

_RULES_PER_STEP = 8

TAGGED_RULES: tuple[Rule, ...] = tuple(r for r in RULES if r.where is not None)


def _texts_of(rules: Sequence[Rule]) -> list[str]:
    return [name for name in TEXTS if any(name in rule.texts for rule in rules)]


def tag_findings(traffic: DataFrame, rules: Sequence[Rule] = TAGGED_RULES) -> DataFrame:
    """Every request with the ids of the rules it matches, in rule order. Works on streams too.

    A few rules at a time: measured twice as fast as all in one projection.
    """
    df, steps = with_texts(traffic, _texts_of(rules)), []
    for start in range(0, len(rules), _RULES_PER_STEP):
        tags = [F.when(r.where(), F.lit(r.id)) for r in rules[start:start + _RULES_PER_STEP]]
        steps.append(f"_tags{start}")
        df = bind(df, {steps[-1]: F.concat_ws(",", *tags)})
    findings = F.array_remove(F.split(F.concat_ws(",", *steps), ","), "")
    return df.select(*BASE, findings.alias("findings"))


def finding_counts(
    traffic: DataFrame, by: Sequence[str] = (), rules: Sequence[Rule] = TAGGED_RULES
) -> DataFrame:
    """How many requests match each rule, optionally per ``by`` column.

    One counter per rule is summed up before the shuffle, so what travels is one row
    per task and group, not one row per finding. The predicates sit inside the counters:
    there each gets a method of its own in the generated code, while in a projection
    they end up in one method too long for the JVM to compile.
    """
    counters: list[Column] = [F.count(F.when(rule.where(), 1)).alias(rule.id) for rule in rules]
    wide = with_texts(traffic, _texts_of(rules)).groupBy(*by).agg(*counters)
    return wide.unpivot(list(by), [rule.id for rule in rules], "rule", "hits")
