"""Rankers: scores of an entity for an alias, as columns.

Each takes the columns of a candidate row (qaf qat qac laf lat of the alias; qef qaef let laet of
the entity) and of the global statistics (entities sqef slet), and gives one column, so that a
ranker of one's own is any function from a DataFrame's columns to a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import INF, NAN, div, div_or, f32, ln

NIL_ID, NIL_SCORE = -1, -100.0
MU_PROBABILITY, MU_CONTEXTUAL = 20.0, 10.0
LEAST_CONTEXT = -30.0


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def probability() -> Column:
    """Log of the mixture of what queries and links say of alias and entity."""
    mu = MU_PROBABILITY
    p_e = div(_c("qef") + 1, _c("sqef") + _c("entities"))
    p_ew = div(_c("let") + 1, _c("slet") + _c("entities"))
    p_law = div(_c("laf") + 1, _c("lat") + 2)
    p_la = div(_c("qac") + 1, _c("qat") + 2)
    p_ela = F.least(F.lit(1.0), div(_c("qaef") + mu * p_e, _c("qaf") + mu))
    p_elaw = F.least(F.lit(1.0), div(_c("laet") + mu * p_ew, _c("laf") + mu))
    pr_q = div(_c("qat") + 1, _c("qat") + _c("lat") + 2)
    return ln(pr_q * (p_la * p_ela + (1 - p_la) * p_e) + (1 - pr_q) * (p_law * p_elaw + (1 - p_law) * p_ew))


def npmi(p_query: float = 0.0, p_anchor: float = 1.0) -> Column:
    """Normalized pointwise mutual information, weighted between queries and links; -1 where neither has seen the pair."""
    clicks, anchors = _c("sqef"), _c("slet")
    joint_w, joint_q = div(_c("laet"), anchors), div(_c("qaef"), clicks)
    # a joint count that isn't 0 has a logarithm; totals of 0 on bad counts give infinities
    w = div_or(F.ln(div_or(joint_w, div(_c("let"), anchors) * div(_c("lat"), anchors), INF)), -F.ln(joint_w), NAN)
    q = div_or(F.ln(div_or(joint_q, div(_c("qef"), clicks) * div(_c("qaf"), clicks), INF)), -F.ln(joint_q), NAN)
    w, q = F.lit(p_anchor) * w, F.lit(p_query) * q
    return F.when((_c("qaef") == 0) & (_c("laet") == 0), F.lit(-1.0)).when(_c("qaef") == 0, w).when(_c("laet") == 0, q).otherwise(w + q)


def contextual_prior() -> Column:
    """First phase of the contextual ranker: the mixture, in single precision."""
    mu, one = F.lit(MU_CONTEXTUAL).cast("float"), F.lit(1.0).cast("float")
    prior_q = f32(div(_c("qat") + 1, _c("qat") + _c("lat") + 2))
    prior_a = f32(one - prior_q)
    p_law, p_la = f32(div(_c("laf") + 1, _c("lat") + 2)), f32(div(_c("qac") + 1, _c("qat") + 2))
    p_e = f32(div(_c("qef") + 1, f32(_c("sqef") + _c("entities"))))
    p_ew = f32(div(_c("let") + 1, f32(_c("slet") + _c("entities"))))
    p_elaw = F.least(one, f32(div(_c("laet") + f32(mu * p_ew).cast("double"), _c("laf") + MU_CONTEXTUAL)))
    p_ela = F.least(one, f32(div(_c("qaef") + f32(mu * p_e).cast("double"), _c("qaf") + MU_CONTEXTUAL)))
    return f32(f32(prior_q * f32(f32(p_la * p_ela) + f32(f32(one - p_la) * p_e))) + f32(prior_a * f32(f32(p_law * p_elaw) + f32(f32(one - p_law) * p_ew))))


def contextual(length: Column, context: Column, prior: Column | None = None) -> Column:
    """Context log-score, not below -30, + log of the prior + a bonus for length. length: of the span, last token less first."""
    prior = contextual_prior() if prior is None else prior
    ctx = F.greatest(f32(context), F.lit(LEAST_CONTEXT).cast("float")).cast("double")
    bonus = f32(div(F.lit(1.0), 1 + F.exp(-(length.cast("double") - 1))))
    return ctx + ln(prior) + bonus.cast("double")


def importance() -> dict[str, Column]:
    """Link-importance features of joined counts: st at gt (alias totals of search, alternative search and graph), ssum, saf aaf gaf (alias frequencies), saef aaef gaef (alias and entity), entity_total."""
    st, at, gt, total = _c("search_total"), _c("alt_total"), _c("graph_total"), _c("entity_total")
    saf, aaf, gaf = _c("search_alias_freq"), _c("alt_alias_freq"), _c("graph_alias_freq")
    saef, aaef, gaef = _c("search_alias_entity_freq"), _c("alt_alias_entity_freq"), _c("graph_alias_entity_freq")
    phrase = div(st + 1, st + gt + 2)
    s_alias, a_alias, g_alias = div(_c("search_clicks") + 1, st + 2), div(aaf + 1, at + 2), div(gaf + 1, gt + 2)
    s_entity, a_entity, g_entity = div(saef + 1, saf + total), div(aaef + 1, aaf + total), div(gaef + 1, gaf + total)
    w_s, w_a = div(st + 1, st + at + gt + 3), div(at + 1, st + at + gt + 3)
    w_g = 1 - w_s - w_a
    graph = (1 - phrase) * g_alias * g_entity
    return {
        "search_prob_phrase": phrase,
        "search_prob_alias": s_alias,
        "search_prob_entity_alias": s_entity,
        "alt_search_prob_alias": a_alias,
        "alt_search_prob_entity_alias": a_entity,
        "graph_prob_phrase": 1 - phrase,
        "graph_prob_alias": g_alias,
        "graph_prob_entity_alias": g_entity,
        "search_weight": w_s,
        "alt_search_weight": w_a,
        "graph_weight": w_g,
        "link_importance_00": phrase * s_alias * s_entity + graph,
        "link_importance_01": phrase * g_alias * s_entity + graph,
        "link_importance_02": w_s * s_alias * s_entity + w_a * a_alias * a_entity + w_g * g_alias * g_entity,
    }
