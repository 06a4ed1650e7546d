"""Matching candidates with job descriptions: direct credit, bridges over the skill graph, gaps, ranks.

wants: jd, skill, demand. have: cand, skill, weight. paths: operators.paths.apsp(). Only matched and reachable
skills become rows; what a candidate misses without a path enters through the description's total demand.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import grid
from .hublabels import HubLabels
from .paths import held_or_reached, reach
from .workspace import checkpointed


#: Descriptions whose totals are sent to all tasks.
FEW = 100_000


def _demand(wants: DataFrame, p: S.ScoringParams) -> DataFrame:
    """One row for each skill, at its largest demand; 1 for each without weights."""
    d = F.max("demand") if p.use_weights else F.max(F.lit(1.0))
    return wants.groupBy("jd", "skill").agg(d.cast("double").alias("demand"))


def _have(have: DataFrame) -> DataFrame:
    return have.groupBy("cand", "skill").agg(F.max("weight").cast("double").alias("weight"))


def terms(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams) -> DataFrame:
    """jd, cand, skill, demand, weight (null if missing), dist, hops, via, matched, credit, floored, bridged.

    One row for each wanted skill that a candidate has or that can be reached from what it has.
    """
    wants, have = _demand(wants, p), _have(have)
    both = held_or_reached(have, paths, wants) if p.enable_bridging else have.withColumns({"dist": F.lit(None).cast("double"), "hops": F.lit(None).cast("int"), "via": F.lit(None)})
    x = both.join(wants, "skill")
    matched = F.col("weight").isNotNull()
    ok = S.bridgeable(F.col("dist"), F.col("hops"), p)
    own = S.proficiency_credit(F.col("weight"), p)
    floor = F.least(S.bridge_credit(F.col("dist"), p), F.lit(1.0))
    floored = matched & (own < 1.0) & ok & (floor > own)
    return x.select(
        "jd", "cand", "skill", "demand", "weight", "dist", "hops", "via", matched.alias("matched"),
        F.when(floored, floor).when(matched, own).when(ok, S.bridge_credit(F.col("dist"), p)).otherwise(0.0).alias("credit"),
        F.coalesce(floored, F.lit(False)).alias("floored"), (~matched & ok).alias("bridged"),
    )


def picked(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams, kind: str, nearest: int | None = None) -> DataFrame:
    """terms() that are of a kind, floored or bridged: jd, cand, skill, dist, via, credit; nearest: only so many of each jd and
    cand by distance, then skill, with their place."""

    def each(ways, names):
        credit, floored, bridged = ways.rated(p)
        which, cell, more = floored if kind == "floored" else bridged, ways.cell, {}
        if nearest is None:
            at, want = ways.terms(np.flatnonzero(which))
        else:
            at, want, place = ways.nearest(which, nearest)
        for a in range(0, len(at), 1 << 16):
            i, j = at[a : a + (1 << 16)], want[a : a + (1 << 16)]
            if nearest is not None:
                more = {"place": place[a : a + (1 << 16)]}
            yield pd.DataFrame({"jd": cell.jds[cell.jd[j]], "cand": names[ways.cand[i]], "skill": cell.skills[ways.skill[i]], "dist": ways.dist[i], "via": cell.sources[ways.via[i]], "credit": credit[i], **more})

    skill = dict(have.dtypes)["skill"]
    x, whole = grid.met(_demand(wants, p), _have(have), paths, each, _typed(wants, have, f"skill {skill}, dist double, via {skill}, credit double" + (", place long" if nearest is not None else "")))
    if nearest is None or whole:
        return x
    # the nearest of all are among the nearest of each block
    place = F.row_number().over(W.partitionBy("jd", "cand").orderBy("dist", "skill"))
    return x.withColumn("place", place.cast("long")).where(F.col("place") <= nearest)


def bridges(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams) -> DataFrame:
    """skill, via and n, to be added up: how often terms() bridge to a skill from another."""

    def each(ways, names):
        # counted on the paths of the cell, and given once at its end
        cell = ways.cell
        if "n" not in cell.kept:
            cell.kept["n"] = np.zeros(len(cell.dst), np.int64)
        np.add.at(cell.kept["n"], ways.path[ways.rated(p)[2]], 1)
        return iter(())

    def last(cell):
        n, first = cell.kept["n"], cell.by_skill()[1]
        for a in range(0, len(cell.sources), 1 << 12):
            count, start = cell.count[a : a + (1 << 12)], cell.start[a : a + (1 << 12)]
            row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - start, count)
            via = np.repeat(cell.sources[a : a + (1 << 12)], count)
            own = n[row] > 0
            at = cell.dst[row[own]]
            yield pd.DataFrame({"skill": cell.skills[at], "via": via[own], "n": n[row[own]] * (first[at + 1] - first[at])})

    skill = dict(have.dtypes)["skill"]
    return grid.met(_demand(wants, p), _have(have), paths, each, f"skill {skill}, via {skill}, n long", last)[0]


def _labelled_sums(wants: DataFrame, have: DataFrame, paths: HubLabels, p: S.ScoringParams, pairs: DataFrame | None) -> DataFrame:
    t = terms(wants, have, paths, p)
    if pairs is not None:
        t = t.join(pairs.select("jd", "cand"), ["jd", "cand"], "left_semi")
    return t.groupBy("jd", "cand").agg(
        F.sum(F.when(F.col("matched"), F.col("demand") * F.col("credit"))).alias("direct"),
        F.sum(F.when(F.col("bridged"), F.col("demand") * F.col("credit"))).alias("bridge"),
        F.sum(F.when(F.col("matched"), F.col("demand"))).alias("held"),
        F.sum(F.when(F.col("bridged"), F.col("demand"))).alias("bridged_demand"),
        F.count(F.when(F.col("matched"), 1)).alias("n_matched"), F.count(F.when(F.col("bridged"), 1)).alias("n_bridged"),
        F.count(F.when(F.col("floored"), 1)).alias("n_floored"),
    )


def _typed(wants: DataFrame, have: DataFrame, rest: str) -> str:
    return f"jd {dict(wants.dtypes)['jd']}, cand {dict(have.dtypes)['cand']}, {rest}"


def _summed(wants: DataFrame, have: DataFrame, paths: DataFrame | None, p: S.ScoringParams, every: bool = False) -> tuple[DataFrame, bool]:
    """The sums of terms() for every jd and cand that have any, without a row for each term; and whether there are rows for
    all other jds and cands of have too, which is so with every if there is one block."""

    def each(ways, names):
        credit, floored, bridged = ways.rated(p)
        own = ways.matched
        sums = {"direct": np.where(own, credit, 0.0), "bridge": np.where(bridged, credit, 0.0), "held": own, "bridged_demand": bridged}
        return ways.sums(names, sums, {"n_matched": own, "n_bridged": bridged, "n_floored": floored}, every and ways.cell.whole)

    schema = _typed(wants, have, "direct double, bridge double, held double, bridged_demand double, n_matched long, n_bridged long, n_floored long")
    x, whole = grid.met(_demand(wants, p), _have(have), paths if p.enable_bridging else None, each, schema)
    return x if whole else x.groupBy("jd", "cand").agg(*[F.sum(c).alias(c) for c in x.columns[2:]]), every and whole


def _sums(wants: DataFrame, have: DataFrame, paths: DataFrame | None, p: S.ScoringParams) -> DataFrame:
    return _summed(wants, have, paths, p)[0]


def overlaps(wants: DataFrame, have: DataFrame) -> DataFrame:
    """jd, cand, exact_overlap: how many wanted skills a candidate has, if any."""
    x = _sums(wants, have, None, S.ScoringParams(use_weights=False, enable_bridging=False))
    return x.where("n_matched > 0").select("jd", "cand", F.col("n_matched").alias("exact_overlap"))


def scores(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams, candidates: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """jd, cand, total, direct, bridge, penalty, total_demand, n_matched, n_bridged, n_missing, n_floored for every pair.

    candidates: cand; every one is scored, skills or not (default: those in have). pairs: jd, cand; only these are.
    """
    jds = _demand(wants, p).groupBy("jd").agg(F.sum("demand").alias("total_demand"), F.count("*").alias("n_skills"))
    if isinstance(paths, HubLabels) and p.enable_bridging:
        agg, every = _labelled_sums(wants, have, paths, p, pairs), False
    else:
        agg, every = _summed(wants, have, paths, p, every=pairs is None and candidates is None)
    if every and wants.where("jd IS NULL OR skill IS NULL").isEmpty():
        # the sums have every pair but those of candidates without a skill
        jds = checkpointed(jds)
        jds = F.broadcast(jds) if jds.count() <= FEW else jds
        bare = have.where("cand IS NULL OR skill IS NULL")
        x = agg.join(jds, "jd")
        if not bare.isEmpty():
            some = have.where("cand IS NOT NULL AND skill IS NOT NULL").select("cand").distinct()
            x = x.unionByName(bare.select("cand").distinct().join(some, "cand", "left_anti").crossJoin(jds), allowMissingColumns=True)
    else:
        cands = (candidates if candidates is not None else have).select("cand").distinct()
        pair = cands.crossJoin(jds) if pairs is None else pairs.select("jd", "cand").distinct().join(jds, "jd")
        x = pair.join(agg, ["jd", "cand"], "left")
    x = x.fillna(0.0, ["direct", "bridge", "held", "bridged_demand"]).fillna(0, ["n_matched", "n_bridged", "n_floored"])
    lost = F.greatest(F.col("total_demand") - F.col("held") - F.col("bridged_demand"), F.lit(0.0))
    x = x.withColumn("penalty", F.col("bridged_demand") * float(p.bridgeable_penalty) + lost * float(p.unreachable_penalty))
    total = F.when(F.col("total_demand") == 0, 0.0).otherwise((F.col("direct") + F.col("bridge") - F.col("penalty")) / F.col("total_demand"))
    missing = F.col("n_skills") - F.col("n_matched") - F.col("n_bridged")
    return x.select("jd", "cand", S.rounded(total, 3).alias("total"), "direct", "bridge", "penalty", "total_demand", "n_matched", "n_bridged", missing.alias("n_missing"), "n_floored")


def rank(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """rank within each jd by total, then cand; top_k None keeps all, 0 none."""
    place = F.row_number().over(W.partitionBy("jd").orderBy(F.desc("total"), "cand"))
    out = scored.withColumn("rank", place)
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def gaps(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams, candidates: DataFrame | None = None) -> DataFrame:
    """jd, cand, skill, via, distance, hops, bridgeable, demand, reason for every wanted skill that a candidate lacks."""
    wants = _demand(wants, p)
    cands = (candidates if candidates is not None else have).select("cand").distinct()
    missing = cands.crossJoin(wants).join(_have(have).select("cand", "skill"), ["cand", "skill"], "left_anti")
    near = reach(have, paths, wants)
    x = missing.join(near, ["cand", "skill"], "left")
    d, h = F.col("dist"), F.col("hops")
    return x.select("jd", "cand", "skill", "via", d.alias("distance"), "hops", S.bridgeable(d, h, p).alias("bridgeable"), "demand", S.gap_reason(d, h, p).alias("reason"))


def _reasons(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams) -> DataFrame:
    """skill, reason (null: held) and m, to be added up, of the skills that candidates hold or reach."""
    far = ("no_path", "beyond_distance", "beyond_hops", "bridgeable") if p.enable_bridging else ("bridging_disabled",) * 4
    free = replace(p, max_hops=None, enable_bridging=True)

    def each(ways, names):
        # counted for the cell, and given once at its end
        near, cell = ways.bridgeable(free), ways.cell
        kind = np.where(ways.matched, 4, np.where(np.isnan(ways.dist), 0, np.where(~near, 1, np.where(~ways.bridgeable(replace(p, enable_bridging=True)), 2, 3))))
        if "m" not in cell.kept:
            cell.kept["m"] = np.zeros(5 * len(cell.skills), np.int64)
        np.add.at(cell.kept["m"], ways.skill * 5 + kind, 1)
        return iter(())

    def last(cell):
        at = np.flatnonzero(cell.kept["m"])
        for a in range(0, len(at), 1 << 16):
            i = at[a : a + (1 << 16)]
            yield pd.DataFrame({"skill": cell.skills[i // 5], "reason": np.array([*far, None], object)[i % 5], "m": cell.kept["m"][i]})

    return grid.met(wants, have, paths, each, f"skill {dict(have.dtypes)['skill']}, reason string, m long", last)[0]


def gap_counts(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams, candidates: DataFrame | None = None) -> DataFrame:
    """jd, reason (its first word), n and demand of gaps(), without a row for each gap.

    Rows are made for held and for reached skills only; what is left of every description's total has no path.
    """
    wants = _demand(wants, p)
    cands = (candidates if candidates is not None else have).select("cand").distinct()
    own = _have(have).join(cands, "cand", "left_semi")
    # a row for each skill and reason meets the descriptions, not one for each candidate's skill
    if isinstance(paths, HubLabels):
        x = held_or_reached(own, paths, wants)
        kind = F.when(F.col("weight").isNull(), F.regexp_extract(S.gap_reason(F.col("dist"), F.col("hops"), p), "^[a-z_]+", 0))
        per = x.groupBy("skill", kind.alias("reason")).agg(F.count("*").alias("m"))
    else:
        per = _reasons(wants, own, paths, p).groupBy("skill", "reason").agg(F.sum("m").alias("m"))
    per = checkpointed(per).join(wants, "skill")  # a row for each skill and reason, read twice
    none = F.lit("no_path" if p.enable_bridging else "bridging_disabled")
    each = lambda df, by: df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("demand").alias("demand"))
    per = per.groupBy("jd", "reason").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("demand")).alias("demand"))
    reached, held = per.where("reason IS NOT NULL"), per.where("reason IS NULL").drop("reason")
    n = cands.agg(F.count("*").alias("cands"))  # one row
    total = each(wants, ("jd",)).crossJoin(F.broadcast(n)).select("jd", none.alias("reason"), (F.col("n") * F.col("cands")).alias("n"), (F.col("demand") * F.col("cands")).alias("demand"))
    less = held.unionByName(reached.drop("reason")).select("jd", none.alias("reason"), (-F.col("n")).alias("n"), (-F.col("demand")).alias("demand"))
    return total.unionByName(less).unionByName(reached).groupBy("jd", "reason").agg(F.sum("n").alias("n"), F.sum("demand").alias("demand")).where("n > 0")


def ordered_gaps(gaps: DataFrame) -> DataFrame:
    """gaps() with place within each pair: by distance, those without one last, then by skill; bridgeable ones come first."""
    w = W.partitionBy("jd", "cand").orderBy((~F.col("bridgeable")).cast("int"), F.when(F.col("bridgeable"), F.col("distance")), "skill")
    return gaps.withColumn("place", F.row_number().over(w))


def legacy(scored: DataFrame) -> DataFrame:
    """Results with the names that older callers use: score, matched and gaps (bridged ones by distance, then missing)."""
    out = scored.withColumn("score", F.col("total"))
    if "matched_skills" in scored.columns:
        none = lambda c: F.coalesce(c, F.array())
        out = out.withColumn("matched", none(F.col("matched_skills"))).withColumn("gaps", F.concat(none(F.col("bridged_skills")), none(F.col("missing_skills"))))
    return out


def results(wants: DataFrame, have: DataFrame, paths: DataFrame, p: S.ScoringParams, candidates: DataFrame | None = None) -> DataFrame:
    """scores() with sorted arrays: matched_skills, and bridged, missing and floored gaps as structs."""
    t = terms(wants, have, paths, p)
    g = gaps(wants, have, paths, p, candidates)
    gap = F.struct("skill", "via", S.wire_distance(F.col("distance")).alias("distance"), "hops", "bridgeable", "demand", "reason")
    lists = g.groupBy("jd", "cand").agg(
        F.sort_array(F.collect_list(F.when(F.col("bridgeable"), F.struct(F.col("distance").alias("by"), gap.alias("gap"))))).alias("bridged"),
        F.sort_array(F.collect_list(F.when(~F.col("bridgeable"), F.struct(F.col("skill").alias("by"), gap.alias("gap"))))).alias("missing"),
    )
    lists = lists.select("jd", "cand", F.transform("bridged", lambda x: x["gap"]).alias("bridged_skills"), F.transform("missing", lambda x: x["gap"]).alias("missing_skills"))
    held = t.where("matched").groupBy("jd", "cand").agg(F.sort_array(F.collect_list("skill")).alias("matched_skills"), F.sort_array(F.collect_list(F.when(F.col("floored"), F.col("skill")))).alias("floored_skills"))
    return scores(wants, have, paths, p, candidates).join(lists, ["jd", "cand"], "left").join(held, ["jd", "cand"], "left")


def explain(result: DataFrame) -> DataFrame:
    """results() with a text column."""
    names = lambda c: F.array_join(F.transform(c, lambda g: g["skill"].cast("string")), ", ")
    held = F.array_join(F.transform(F.coalesce("matched_skills", F.array()), lambda s: s.cast("string")), ", ")
    return result.withColumn("explanation", F.concat(
        F.format_string("total %.3f = (direct %.3f + bridge %.3f - penalty %.3f) / %.3f", "total", "direct", "bridge", "penalty", "total_demand"),
        F.lit("; matched: "), held, F.lit("; bridged: "), F.coalesce(names("bridged_skills"), F.lit("")), F.lit("; missing: "), F.coalesce(names("missing_skills"), F.lit("")),
    ))


def count_only(wants: DataFrame, have: DataFrame, k: float, candidates: DataFrame | None = None, p: S.ScoringParams | None = None, weighted: bool = False) -> DataFrame:
    """The control without a graph: direct credit plus k for each unmet skill (weighted: k times its demand), not normalised."""
    p = p or S.ScoringParams()
    one = F.col("demand") if weighted else F.lit(1.0)
    w = _demand(wants, p)
    # the sums of what is held, without a row for each holding and description
    agg = _sums(wants, have, None, replace(p, enable_bridging=False))
    agg = agg.select("jd", "cand", "direct", (F.col("held") if weighted else F.col("n_matched").cast("double")).alias("held"))
    jds = w.groupBy("jd").agg(F.sum(one).alias("all"))
    cands = (candidates if candidates is not None else have).select("cand").distinct()
    x = cands.crossJoin(jds).join(agg, ["jd", "cand"], "left").fillna(0.0, ["direct", "held"])
    return x.select("jd", "cand", F.round(F.col("direct") + F.lit(float(k)) * (F.col("all") - F.col("held")), 6).alias("total"))


def _labelled_sweep(t: DataFrame, base: S.ScoringParams, few: list) -> DataFrame:
    own = S.proficiency_credit(F.col("weight"), base)
    sums = []
    for i, p in few:
        ok, bridge = S.bridgeable(F.col("dist"), F.col("hops"), p), S.bridge_credit(F.col("dist"), p)
        held = F.when(ok & (own < 1.0), F.greatest(own, F.least(bridge, F.lit(1.0)))).otherwise(own)
        gain = F.when(F.col("matched"), F.col("demand") * held).when(ok, F.col("demand") * bridge)
        met = F.when(F.col("matched") | ok, F.col("demand"))
        sums += [F.coalesce(F.sum(gain), F.lit(0.0)).alias(f"gain{i}"), F.coalesce(F.sum(met), F.lit(0.0)).alias(f"met{i}")]
    return t.groupBy("jd", "cand").agg(*sums)


def _swept(wants: DataFrame, have: DataFrame, paths: DataFrame, base: S.ScoringParams, few: list) -> DataFrame:
    """gain and met of each setting, side by side, for every jd and cand with a term."""
    names = [f"{c}{i}" for i, _ in few for c in ("gain", "met")]

    def each(ways, cands):
        own, sums = ways.own(base), {}
        for i, p in few:
            ok = ways.bridgeable(p)
            bridge = np.where(ok, ways.bridge(p), 0.0)
            held = np.where(ok & (own < 1.0), np.maximum(own, np.minimum(bridge, 1.0)), own)
            sums |= {f"gain{i}": np.where(ways.matched, held, bridge), f"met{i}": ways.matched | ok}
        return ways.sums(cands, sums, {"terms": np.ones(len(ways.cand))})

    schema = _typed(wants, have, ", ".join(f"{c} double" for c in names) + ", terms long")
    x, whole = grid.met(_demand(wants, base), _have(have), paths, each, schema)
    return x if whole else x.groupBy("jd", "cand").agg(*[F.sum(c).alias(c) for c in names])


def sweep(wants: DataFrame, have: DataFrame, paths: DataFrame, configs: list[dict], at_once: int = 12) -> DataFrame:
    """config, jd, cand, total for many settings of cutoff, scale, cap, unreachable and hops.

    A pass sums at_once settings side by side, so that a pair is shuffled once for these and terms aren't multiplied by
    settings.
    """
    base = S.ScoringParams(bridge_cutoff=None)
    params = [S.ScoringParams(bridge_cutoff=c.get("cutoff"), max_hops=c.get("hops"), bridge_credit_scale=float(c.get("scale", 1.0)), max_bridge_credit=c.get("cap")) for c in configs]
    parts = []
    for first in range(0, len(configs), at_once):
        few = list(enumerate(params[first : first + at_once], first))
        ups = [F.struct(F.lit(i).alias("config"), F.lit(float(configs[i].get("unreachable", 0.0))).alias("up"), F.col(f"gain{i}").alias("gain"), F.col(f"met{i}").alias("met")) for i, _ in few]
        x = _swept(wants, have, paths, base, few) if not isinstance(paths, HubLabels) else _labelled_sweep(terms(wants, have, paths, base), base, few)
        parts.append(x.select("jd", "cand", F.inline(F.array(*ups))))
    jds = _demand(wants, base).groupBy("jd").agg(F.sum("demand").alias("total_demand"))
    agg = reduce(DataFrame.unionByName, parts).join(jds, "jd")
    total = (F.col("gain") - F.col("up") * (F.col("total_demand") - F.col("met"))) / F.col("total_demand")
    return agg.select("config", "jd", "cand", S.rounded(total, 3).alias("total"))
