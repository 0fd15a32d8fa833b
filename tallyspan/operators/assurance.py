"""Drift windows, event rules, classifier utility, fidelity, parity and paired-world checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import all_bands
from ..functions.keys import canonical
from ..functions.stats import rank_auc, ratio

# Causal order of event phases.
PHASES = {"latent_onset": 0, "observable_phenotype": 1, "recognition_opportunity": 2, "workup": 3, "recorded_diagnosis": 4,
          "treatment_start": 5, "treatment_response": 6, "treatment_non_response": 6}


def _per_window(df: DataFrame, pid: str, age: str, windows, aggs: list[Column]) -> DataFrame:
    return df.withColumn("window", F.explode(all_bands(F.col(age), windows))).groupBy("window", pid).agg(*aggs)


def window_metrics(members: DataFrame, points: DataFrame, visits: DataFrame, events: DataFrame, pid: str, age: str, windows: list[tuple[str, int, int]],
                   min_points: int = 1, min_visits: int = 1) -> DataFrame:
    """Coverage, event rate, visit count and mean visit gap per age window.

    Gaps between consecutive visits inside a window add up to last minus first,
    so each member needs only its count and age range there.
    """
    total = members.agg(F.count("*").alias("members"))  # one row
    grown = _per_window(points, pid, age, windows, [F.count("*").alias("n")]).groupBy("window").agg(F.count_if(F.col("n") >= min_points).alias("g"))
    seen = _per_window(visits, pid, age, windows, [F.count("*").alias("n"), (F.max(age) - F.min(age)).alias("span")]).groupBy("window").agg(
        F.count_if(F.col("n") >= min_visits).alias("v"), F.sum("n").alias("visits"), F.count_if(F.col("n") >= 2).alias("interval_support"),
        F.sum(F.when(F.col("n") >= 2, F.col("span"))).alias("days"), F.sum(F.when(F.col("n") >= 2, F.col("n") - 1)).alias("steps"))
    hit = _per_window(events, pid, age, windows, [F.count("*").alias("n")]).groupBy("window").agg(F.count("*").alias("e"))
    names = members.sparkSession.createDataFrame([(n, i) for i, (n, _, _) in enumerate(windows)], "window string, position int")
    out = names.crossJoin(F.broadcast(total))
    for part in (grown, seen, hit):
        out = out.join(F.broadcast(part), "window", "left")  # one row per window
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda c: zero(c) / F.greatest(F.col("members"), F.lit(1))
    return out.select("window", "position", "members", share("g").alias("growth_coverage"), share("v").alias("visit_coverage"), share("e").alias("event_rate"),
                      share("visits").alias("mean_visits"), zero("interval_support").alias("interval_support"), ratio(F.col("days"), F.col("steps")).alias("mean_gap"))


def window_bounds(metrics: DataFrame, bounds: dict[str, tuple[str, float | None]], floor: int) -> DataFrame:
    """Bound checks per window: ``bounds`` maps a metric to (lower | upper | diagnostic, value)."""
    rows = []
    for metric, (kind, bound) in bounds.items():
        support = "interval_support" if metric == "mean_gap" else "members"
        value = F.col(metric)
        ok = {"lower": value >= F.lit(bound), "upper": value <= F.lit(bound), "diagnostic": F.lit(True)}[kind]
        thin = (F.col("members") < floor) | (F.col(support) < floor) | value.isNull()
        rows.append(F.struct(F.lit(metric).alias("metric"), F.when(~thin, value).alias("observed"), F.lit(bound).cast("double").alias("bound"),
                             F.when(~thin, F.col(support)).alias("support"), F.when(thin, "UNEVALUABLE").when(ok, "PASS").otherwise("FAIL").alias("status")))
    return metrics.select("window", F.explode(F.array(*rows)).alias("r")).select("window", "r.*")


def window_steps(metrics: DataFrame, limits: dict[str, float], floor: int) -> DataFrame:
    """Change from the previous window against an absolute bound."""
    w = Window.partitionBy(F.lit(1)).orderBy("position")  # one row per window
    rows = [F.struct(F.lit(f"{m}_step").alias("metric"), F.col(f"s_{m}").alias("step"), F.lit(limit).alias("bound")) for m, limit in limits.items()]
    stepped = metrics.select("window", "members", F.lag("members").over(w).alias("before"), *[(F.col(m) - F.lag(m).over(w)).alias(f"s_{m}") for m in limits]).where("before is not null")
    thin = (F.col("members") < floor) | (F.col("before") < floor)
    return stepped.select("window", "members", "before", F.explode(F.array(*rows)).alias("r")).select(
        "window", "r.metric", F.when(~thin, F.col("r.step")).alias("step"), "r.bound",
        F.when(thin, "UNEVALUABLE").when(F.abs("r.step") <= F.col("r.bound"), "PASS").otherwise("FAIL").alias("status"))


def event_order(events: DataFrame, pid: str, kind: str, age: str, seq: str, phases: dict[str, int] = PHASES) -> DataFrame:
    """Whether each entity's events follow the causal order.

    Phases must strictly rise, so any repeat fails; folding to one row per
    entity and phase therefore loses nothing and bounds the window by the
    number of phases.
    """
    book = F.create_map(*[F.lit(x) for kv in phases.items() for x in kv])
    cells = events.groupBy(pid, F.try_element_at(book, F.col(kind)).alias("phase")).agg(
        F.count("*").alias("n"), F.min(seq).alias("s"), F.min(age).alias("a"))
    w = Window.partitionBy(pid).orderBy("phase")
    rising = (F.col("s") > F.lag("s").over(w)) & (F.col("a") >= F.lag("a").over(w))
    rows = cells.select(pid, "phase", "n", F.coalesce(rising, F.lit(True)).alias("ok"))
    last = max(phases.values())
    has = lambda p: F.max(F.coalesce(F.col("phase") == p, F.lit(False)))
    agg = rows.groupBy(pid).agg(
        F.min(F.col("phase").isNotNull()).alias("known"), F.min(F.col("n") == 1).alias("distinct_phases"), F.min("ok").alias("ordered"),
        has(phases["treatment_start"]).alias("treated"), has(last).alias("outcome"))
    return agg.withColumn("valid", F.col("known") & F.col("distinct_phases") & F.col("ordered") & (F.col("treated") == F.col("outcome")))


def event_timing(records: DataFrame, windows: DataFrame, pid: str, age: str) -> DataFrame:
    """Window bounds in order and every visible record inside ``[start, end)``; (pid, start, end, admin_end)."""
    span = records.groupBy(pid).agg(F.min(age).alias("lo"), F.max(age).alias("hi"))
    j = windows.join(span, pid, "left")
    bounds = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("admin_end"))
    inside = F.col("lo").isNull() | ((F.col("lo") >= F.col("start")) & (F.col("hi") < F.col("end")) & (F.col("lo") >= 0))
    return j.select(pid, F.coalesce(bounds, F.lit(False)).alias("bounds_ok"), F.coalesce(inside, F.lit(False)).alias("records_ok")).withColumn(
        "valid", F.col("bounds_ok") & F.col("records_ok"))


def cells_of(df: DataFrame, by: str) -> DataFrame:
    """Every row once overall and once in its group; callers fold their rows before."""
    return df.withColumn("cell", F.explode(F.array(F.lit("overall"), F.concat(F.lit(f"{by}="), F.col(by)))))


def decision_metrics(pred: DataFrame, label: str, decision: str, by: str) -> DataFrame:
    """Confusion counts and rates per group and, from their sums, overall; missing decisions counted."""
    y, d = F.col(label) == 1, F.col(decision)
    counts = {"members": F.count("*"), "evaluable": F.count(d), "tp": F.count_if(y & d), "tn": F.count_if(~y & ~d), "fp": F.count_if(~y & d), "fn": F.count_if(y & ~d)}
    folded = pred.groupBy(by).agg(*[c.alias(n) for n, c in counts.items()])
    agg = cells_of(folded, by).groupBy("cell").agg(*[F.sum(n).alias(n) for n in counts])
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    sens, spec = ratio(F.col("tp"), pos), ratio(F.col("tn"), neg)
    return agg.withColumns({"positives": pos, "negatives": neg, "missing": F.col("members") - F.col("evaluable"), "sensitivity": sens, "specificity": spec,
                            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "balanced_accuracy": (sens + spec) / 2})


def score_metrics(pred: DataFrame, label: str, decision: str, score: str, by: str) -> DataFrame:
    """Mid-rank AUROC and Brier mean per cell over members with a decision."""
    folded = pred.where(F.col(decision).isNotNull()).groupBy(by, F.col(label).alias("label"), F.col(score).alias("value")).agg(F.count("*").alias("n"))
    rows = cells_of(folded, by).select("cell", "label", "value", "n")
    auc = rank_auc(rows, ["cell"], "label", weight="n").select("cell", F.col("auc").alias("auroc"))
    scored = F.when(F.col("value").isNotNull() & F.col("label").isNotNull(), F.col("n"))
    brier = rows.groupBy("cell").agg(ratio(F.sum(F.pow(F.col("value") - F.col("label"), 2) * scored), F.sum(scored)).alias("brier"),
                                     F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_scores"))
    whole = F.col("missing_scores") == 0
    return brier.join(auc, "cell", "left").select("cell", "missing_scores", F.when(whole, F.col("auroc")).alias("auroc"), F.when(whole, F.col("brier")).alias("brier"))


def utility_status(decisions: DataFrame, scores: DataFrame, min_class: int, bounds: dict[str, tuple[str, float]], need_scores: bool = True) -> DataFrame:
    """Cell verdict in stated priority; counts are withheld when a class is too small."""
    j = decisions.join(scores, "cell", "left")
    thin = (F.col("positives") < min_class) | (F.col("negatives") < min_class)
    outside = reduce(Column.__or__, [F.coalesce(F.col(m) < b if kind == "lower" else F.col(m) > b, F.lit(False)) for m, (kind, b) in bounds.items()])
    no_score = F.lit(need_scores) & (F.coalesce("missing_scores", F.lit(0)) > 0)
    reason = F.when(thin, F.when(F.col("missing") > 0, "MISSING_PREDICTION").when(no_score, "MISSING_SCORE").otherwise("INSUFFICIENT_SUPPORT")).when(
        outside, "OUTSIDE_BOUND").when(F.col("missing") > 0, "MISSING_PREDICTION").when(no_score, "MISSING_SCORE").when(
        F.col("precision").isNull(), "INSUFFICIENT_SUPPORT").otherwise("WITHIN_BOUNDS")
    out = j.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason") == "WITHIN_BOUNDS", "PASS").when(F.col("reason") == "OUTSIDE_BOUND", "FAIL").otherwise("UNEVALUABLE"))
    shown = ["positives", "negatives", "tp", "tn", "fp", "fn"]
    return out.select("cell", "members", "evaluable", "missing", *[F.when(~thin, F.col(c)).alias(c) for c in shown],
                      *[F.when(~thin, F.col(m)).alias(m) for m in ("sensitivity", "specificity", "precision", "balanced_accuracy", "auroc", "brier")], "status", "reason")


def growth_fidelity(points: DataFrame, age: str, windows, tolerances: dict[str, float], floor: int) -> DataFrame:
    """Mean score per window and metric against zero."""
    tall = points.withColumn("window", F.explode(all_bands(F.col(age), windows))).select("window", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in tolerances])).alias("p")).select("window", "p.*")
    odd = F.isnan("v") | (F.abs("v") == F.lit(float("inf")))
    agg = tall.groupBy("window", "metric").agg(F.count("*").alias("denominator"), F.count("v").alias("support"), F.avg("v").alias("mean"), F.count_if(odd).alias("bad"))
    tol = F.create_map(*[F.lit(x) for kv in tolerances.items() for x in kv])[F.col("metric")]
    thin, bad = F.col("support") < floor, F.col("bad") > 0
    return agg.select("window", "metric", "support", "denominator", F.when(~thin & ~bad, F.col("mean")).alias("observed"), tol.alias("tolerance"),
                      F.when(bad, "FAIL").when(thin, "UNEVALUABLE").when(F.abs("mean") <= tol, "PASS").otherwise("FAIL").alias("status"))


def share_fidelity(entities: DataFrame, column: str, weights: DataFrame, tol: float, unknown: str = "Unknown") -> DataFrame:
    """Category shares against normalised target weights (category, weight)."""
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", unknown).otherwise(c)
    target = weights.groupBy(blank(F.col("category")).alias("category")).agg(F.sum("weight").alias("w"))
    whole = target.agg(F.sum("w").alias("__w"))
    seen = entities.groupBy(blank(F.col(column)).alias("category")).agg(F.count("*").alias("n"))
    total = seen.agg(F.sum("n").alias("__n"))
    j = target.join(seen, "category", "full").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(total))  # one row each
    share = F.coalesce("n", F.lit(0)) / F.col("__n")
    goal = F.coalesce("w", F.lit(0.0)) / F.col("__w")
    return j.select("category", F.coalesce("n", F.lit(0)).alias("support"), share.alias("observed"), goal.alias("target"), F.abs(share - goal).alias("difference"),
                    F.when(F.abs(share - goal) <= tol, "PASS").otherwise("FAIL").alias("status"))


def layer_rates(entities: DataFrame, observations: DataFrame, events: DataFrame, pid: str, kind: str, registry: list[str], floor: int, min_cohort: int) -> DataFrame:
    """Share of entities with observations, any event and each registered kind.

    No support in an adequate cohort passes as NO_EVIDENCE; thin support is
    unevaluable.
    """
    total = entities.agg(F.count("*").alias("denominator"))
    own = entities.select(pid)
    count = lambda df, name: df.select(pid).distinct().join(own, pid, "left_semi").agg(F.lit(name).alias("name"), F.count("*").alias("support"))
    kinds = events.join(own, pid, "left_semi").select(pid, kind).distinct().groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("support"))
    wanted = entities.sparkSession.createDataFrame([(k,) for k in registry], "name string")
    per = wanted.join(F.broadcast(kinds), "name", "left").fillna(0, ["support"])  # one row per registered kind
    rows = count(observations, "observed").unionByName(count(events, "event")).unionByName(per.select(F.concat(F.lit("kind."), "name").alias("name"), "support"))
    small = F.col("denominator") < min_cohort
    reason = F.when(small, "COHORT_TOO_SMALL").when(F.col("support") == 0, "NO_EVIDENCE").when(F.col("support") < floor, "INSUFFICIENT_SUPPORT").otherwise("ABOVE_MINIMUM_SUPPORT")
    return rows.crossJoin(F.broadcast(total)).withColumns({"rate": ratio(F.col("support"), F.col("denominator")), "reason": reason}).withColumn(
        "status", F.when(F.col("reason").isin("NO_EVIDENCE", "ABOVE_MINIMUM_SUPPORT"), "PASS").otherwise("UNEVALUABLE"))


def _field_parity(joined: DataFrame, pairs: list[tuple[str, Column, Column, bool]], tol: float, extra: list[Column] = ()) -> DataFrame:
    """Rows (field, compared, mismatches, max difference) from one wide aggregate."""
    aggs = []
    for i, (_, a, b, numeric) in enumerate(pairs):
        gap = F.abs(a.cast("double") - b.cast("double"))
        same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(gap <= tol if numeric else a == b)
        aggs += [F.count("*").alias(f"c{i}"), F.count_if(~same).alias(f"m{i}"), (F.max(gap) if numeric else F.lit(None).cast("double")).alias(f"d{i}")]
    return joined.agg(*aggs, *extra).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"c{i}").alias("compared"), F.col(f"m{i}").alias("mismatches"), F.coalesce(F.col(f"d{i}"), F.lit(0.0)).alias("max_difference"))
        for i, (n, *_) in enumerate(pairs)])).alias("r")).select("r.*")


def _verdict(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("mismatches") > 0, "FAIL").otherwise("PASS"))


def keyed_parity(a: DataFrame, b: DataFrame, key: str, numeric: list[str], exact: list[str], tol: float) -> DataFrame:
    """Keys on one side only, and per-field comparison of the common keys."""
    cols = [*numeric, *exact]
    side = lambda df, p: df.select(F.col(key).alias("__k"), F.lit(1).alias(f"__{p}"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = side(a, "a").join(side(b, "b"), "__k", "full")
    both = j.where("__a = 1 and __b = 1")
    fields = _field_parity(both, [(c, F.col(f"a_{c}"), F.col(f"b_{c}"), c in numeric) for c in cols], tol)
    keys = j.agg(F.lit("(keys)").alias("field"), F.count("*").alias("compared"), F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("mismatches"),
                 F.lit(0.0).alias("max_difference"))
    return _verdict(keys.unionByName(fields))


def projection_parity(source: DataFrame, derived: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Copied fields equal their (already cleaned) source; derived keys must exist in the source."""
    s = source.select(F.col(key).alias("__k"), F.lit(1).alias("__s"), *[F.col(c).alias(f"s_{c}") for c in cols])
    d = derived.select(F.col(key).alias("__k"), *[F.col(c).alias(f"d_{c}") for c in cols])
    j = d.join(s, "__k", "left")
    fields = _field_parity(j.where("__s = 1"), [(c, F.col(f"d_{c}"), F.col(f"s_{c}"), False) for c in cols], 0.0)
    lost = j.agg(F.lit("(keys)").alias("field"), F.count("*").alias("compared"), F.count_if(F.col("__s").isNull()).alias("mismatches"), F.lit(0.0).alias("max_difference"))
    return _verdict(lost.unionByName(fields))


def formula_parity(source: DataFrame, derived: DataFrame, key: str, age: str, tol: float) -> DataFrame:
    """Ages, metric units and BMI of a derived layer recomputed from its source.

    A missing unit value is accepted only when its own score explains the
    plausibility filter; without a score it is unevaluable.
    """
    s = source.select(F.col(key).alias("__k"), F.col(age).alias("__age"), F.col("weight_oz").alias("__oz"), F.col("height_in").alias("__in"))
    j = derived.withColumnRenamed(key, "__k").join(s, "__k")
    months, years = F.round(F.col("__age") / 30.4375, 2), F.round(F.col("__age") / 365.25, 3)
    ok = (F.col("__age") / 30.4375 >= 24) & (F.col("weight_kg") > 0) & (F.col("height_cm") > 0)
    bmi = F.when(ok, F.col("weight_kg") / F.pow(F.col("height_cm") / 100, 2))
    plain = _field_parity(j, [("age_in_months", F.col("age_in_months"), months, True), ("age_in_years", F.col("age_in_years"), years, True), ("bmi", F.col("bmi"), bmi, True)], tol)
    parts = [plain.withColumn("unevaluable", F.lit(0).cast("long"))]
    for field, score, raw, want, lo, hi in [
            ("weight_kg", "weight_z_score", "__oz", F.round(F.col("__oz") / 35.274, 3), -5, 5), ("height_cm", "height_z_score", "__in", F.round(F.col("__in") * 2.54, 3), -5, 3)]:
        v, z = F.col(field), F.col(score)
        out = F.coalesce(~z.between(lo, hi), F.lit(False))
        open_ = F.col(raw).isNull() | (v.isNull() & z.isNull())
        skip = F.col(raw).isNotNull() & v.isNull() & out
        wrong = F.when(v.isNull(), ~out).otherwise(out | (F.abs(v - want) > tol))
        parts.append(j.agg(
            F.lit(field).alias("field"), F.count_if(~open_ & ~skip).alias("compared"), F.count_if(~open_ & ~skip & wrong).alias("mismatches"),
            F.coalesce(F.max(F.when(~open_ & ~out, F.abs(v - want))), F.lit(0.0)).alias("max_difference"), F.count_if(open_).alias("unevaluable")))
    return _verdict(reduce(DataFrame.unionByName, parts))


def summary_parity(expected: DataFrame, derived: DataFrame, pid: str, exact: list[str], numeric: list[str], tol: float) -> DataFrame:
    """Recomputed entity summaries against a derived entity table."""
    return keyed_parity(derived.select(pid, *exact, *numeric), expected.select(pid, *exact, *numeric), pid, numeric, exact, tol)


def flag_relations(events: DataFrame, pid: str, rules: dict[str, Column], entities: DataFrame) -> DataFrame:
    """Event flags follow their rule where it can be evaluated, and ever-flags are their maxima."""
    aggs = [F.count_if(c.isNotNull()).alias(f"c:{f}") for f, c in rules.items()]
    aggs += [F.count_if(c.isNotNull() & (F.col(f) != F.coalesce(c, F.lit(False)).cast("int"))).alias(f"m:{f}") for f, c in rules.items()]
    own = events.agg(*aggs)
    ever = events.groupBy(pid).agg(*[F.max(f).alias(f"x_{f}") for f in rules])
    j = entities.join(ever, pid)
    top = j.agg(*[F.count("*").alias(f"c:ever_{f}") for f in rules], *[F.count_if(~F.col(f"ever_{f}").eqNullSafe(F.col(f"x_{f}"))).alias(f"m:ever_{f}") for f in rules])
    rows = lambda df, names: df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"`c:{n}`").alias("compared"), F.col(f"`m:{n}`").alias("mismatches")) for n in names])).alias("r")).select("r.*")
    return _verdict(rows(own, list(rules)).unionByName(rows(top, [f"ever_{f}" for f in rules])))


def _layer_digests(df: DataFrame, pid: str, layers: dict[str, list[str]], world: str) -> DataFrame:
    """Multiset digest of each layer per entity: counts and sums of row hashes."""
    aggs = []
    for name, cols in layers.items():
        text = canonical(*cols)
        kept = F.coalesce(*[F.col(c).cast("string") for c in cols[1:]]).isNotNull() if len(cols) > 1 else F.lit(True)
        piece = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
        aggs.append(F.concat_ws(":", F.count_if(kept), F.sum(F.when(kept, piece)).cast("string")).alias(f"{world}_{name}"))
    return df.groupBy(pid).agg(*aggs)


def layer_diff(a: DataFrame, b: DataFrame, pid: str, layers: dict[str, list[str]], invariant: list[str], permitted: list[str]) -> DataFrame:
    """Which layers differ per entity between two worlds, and whether the rules allow it."""
    j = _layer_digests(a, pid, layers, "a").join(_layer_digests(b, pid, layers, "b"), pid, "full")
    changed = {n: ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")) for n in layers}
    listed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in changed.items()]))
    out = j.select(pid, F.array_join(listed, ",").alias("changed"), listed.alias("__c"))
    broken = F.arrays_overlap("__c", F.array(*[F.lit(x) for x in invariant]))
    forbidden = F.size(F.array_except("__c", F.array(*[F.lit(x) for x in permitted]))) > 0
    return out.select(pid, "changed", F.when(broken, "INVARIANT_LAYER_CHANGED").when(forbidden, "FORBIDDEN_LAYER_CHANGED").when(
        F.size("__c") == 0, "UNCHANGED").otherwise("OK").alias("reason"))


def paired_assertions(a: DataFrame, b: DataFrame, index: DataFrame, pid: str, age: str, value: str, onset: str, seen_a: str, seen_b: str, direction: int = -1) -> DataFrame:
    """Paired-world assertions per entity.

    Both worlds fold to one value per entity and age before they are aligned.
    Checks: same ages; identical before onset; different somewhere; every
    change in the stated direction; earlier recognition in the second world.
    """
    fold = lambda df, n: df.where(F.col(value).isNotNull()).groupBy(pid, age).agg(F.max(value).alias(n))
    j = fold(a, "va").join(fold(b, "vb"), [pid, age], "full").join(index, pid)
    same = F.col("va").eqNullSafe(F.col("vb"))
    before = F.col(age) < F.col(onset)
    agg = j.groupBy(pid).agg(
        F.min(F.col("va").isNotNull() & F.col("vb").isNotNull()).alias("aligned"), F.count_if(before).alias("n_before"), F.min(F.when(before, same)).alias("same_before"),
        F.max(~same).alias("differs"), F.min(F.when(~same, (F.col("vb") - F.col("va")) * direction > 0)).alias("directed"),
        F.max(F.col(seen_b) < F.col(seen_a)).alias("earlier"))
    verdict = lambda ok, known: F.when(~known, "UNEVALUABLE").when(ok, "PASS").otherwise("FAIL")
    known = F.col("aligned")
    return agg.select(
        pid, verdict(F.col("same_before"), known & (F.col("n_before") > 0)).alias("pre_onset_invariant"),
        F.when(known & F.col("differs"), "PASS").otherwise("UNEVALUABLE").alias("differs"),
        verdict(F.col("directed"), known & F.col("differs")).alias("direction"), verdict(F.coalesce("earlier", F.lit(False)), F.col("earlier").isNotNull()).alias("earlier_recognition"))


def order_bundle_rules(df: DataFrame, order: str, pid: str, line: str, component: str, visit: str, order_age: str, result_age: str, start_age: str | None,
                       expected: list[tuple[int, str]], delay: int) -> DataFrame:
    """Per order: exactly the expected (line, component) pairs, one visit, one order age, results after the stated delay.

    Sets are tested by counting distinct cells, so no order's rows are gathered.
    """
    wanted = reduce(Column.__or__, [(F.col(line) == n) & (F.col(component) == c) for n, c in expected], F.lit(False))
    cells = df.groupBy(order, pid, line, component).agg(
        F.max(F.coalesce(wanted, F.lit(False))).alias("w"), F.min(visit).alias("v0"), F.max(visit).alias("v1"), F.count(visit).alias("vn"), F.count("*").alias("n"),
        F.min(order_age).alias("a0"), F.max(order_age).alias("a1"), F.min(result_age).alias("r0"), F.max(result_age).alias("r1"), F.count(result_age).alias("rn"),
        (F.min(F.col(start_age) >= F.col(order_age)) if start_age else F.lit(True)).alias("s"))
    agg = cells.groupBy(order, pid).agg(
        (F.count_if(F.col("w")) == len(expected)).alias("has_all"), F.min("w").alias("no_other"),
        ((F.min("v0") == F.max("v1")) & (F.sum("vn") == F.sum("n"))).alias("one_visit"), (F.min("a0") == F.max("a1")).alias("one_age"),
        ((F.min("r0") == F.max("r1")) & (F.min("r0") == F.min("a0") + delay) & (F.sum("rn") == F.sum("n"))).alias("delayed"), F.min("s").alias("started"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return agg.select(order, pid, (flag("has_all") & flag("no_other")).alias("pairs_ok"), flag("one_visit").alias("visit_ok"),
                      (flag("one_age") & flag("delayed") & flag("started")).alias("timing_ok"))
