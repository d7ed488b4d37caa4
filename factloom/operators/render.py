"""Records as S-expression text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import iso_seconds, lisp_string, render_confidence


def _at(name: Column) -> Column:
    return F.concat(F.lit("@"), name)


def render_sem(s: Column, p: Column, o: Column, source: Column, confidence: Column, valid_at: Column) -> Column:
    """``o`` is already rendered."""
    return F.concat(
        F.lit("(sem "), _at(s), F.lit(" "), _at(p), F.lit(" "), o, F.lit(" :src "), _at(source), F.lit(" :c "), render_confidence(confidence), F.lit(" :v "), iso_seconds(valid_at), F.lit(")")
    )


def render_epi(event: Column, kind: Column, participants: Column, at_time: Column, observed_at: Column, source: Column, confidence: Column, location: Column) -> Column:
    people = F.array_join(F.transform(participants, _at), " ")
    return F.concat(
        F.lit("(epi "), _at(event), F.lit(" "), _at(kind), F.lit(" ("), people, F.lit(") "), _at(location), F.lit(" :at "), iso_seconds(at_time),
        F.lit(" :obs "), iso_seconds(observed_at), F.lit(" :src "), _at(source), F.lit(" :c "), render_confidence(confidence), F.lit(")"),
    )


def render_pro(rule: Column, trigger: Column, action: Column, scope: Column, source: Column, confidence: Column) -> Column:
    return F.concat(
        F.lit("(pro "), _at(rule), F.lit(" "), lisp_string(trigger), F.lit(" "), lisp_string(action), F.lit(" :scp "), _at(scope),
        F.lit(" :src "), _at(source), F.lit(" :c "), render_confidence(confidence), F.lit(")"),
    )


def render_inf(s: Column, p: Column, o: Column, parents: Column, method: Column, confidence: Column, valid_at: Column) -> Column:
    listed = F.array_join(F.transform(parents, _at), " ")
    return F.concat(
        F.lit("(inf "), _at(s), F.lit(" "), _at(p), F.lit(" "), o, F.lit(" ("), listed, F.lit(") "), _at(method), F.lit(" :c "), render_confidence(confidence), F.lit(" :v "), iso_seconds(valid_at), F.lit(")")
    )
