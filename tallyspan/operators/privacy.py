"""Privacy controls over reference, generated and held-out entity profiles.

A profile is one row per entity with five components.  Series components are
multiset digests (counts and sums of row hashes), so no entity's history is
ever gathered.  Matching uses counts per component subset; no pairs of
entities are formed.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical, join_split
from ..functions.ordering import running_totals
from ..functions.stats import ratio, wilson_interval
from ..functions.storage import join_on

COMPONENTS = ["demographics", "timing", "utilization", "trajectory", "diagnosis"]


def _pieces(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 16)]


def _digest(count: str, sums: list[str]) -> Column:
    return F.sha2(F.concat_ws(":", F.col(count), *[F.col(s).cast("decimal(38,0)").cast("string") for s in sums]), 256)


def entity_profiles(entities: DataFrame, events: DataFrame, pid: str, demographics: list[str], sex: str, age: str, measures: list[str], label: str,
                    min_obs: int = 3) -> DataFrame:
    """Components and signatures of entities with enough observations.

    Only rows with at least one measure count as observations; utilization
    counts all events.
    """
    value = lambda m: F.coalesce(F.round(F.col(m) * 1_000_000).cast("long").cast("string"), F.lit("-"))
    seen = F.coalesce(*[F.col(m) for m in measures]).isNotNull()
    row = _pieces(F.concat_ws("|", F.col(age), *[value(m) for m in measures]))  # numbers only: neither a bar nor a dash alone can be one
    day = _pieces(F.col(age).cast("string"))
    per = events.groupBy(pid).agg(
        F.count("*").alias("visit_count"), F.count_if(seen).alias("n_obs"),
        *[F.sum(F.when(seen, c)).alias(n) for n, c in zip(["r1", "r2", "t1", "t2"], [*row, *day])])
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in demographics])
    out = entities.join(per, pid).where(F.col("n_obs") >= min_obs).select(
        pid, F.col(sex).alias("sex"), F.col(label).cast("string").alias("label"), "n_obs", F.sha2(text, 256).alias("demographics"),
        _digest("n_obs", ["t1", "t2"]).alias("timing"), F.col("visit_count").cast("string").alias("utilization"),
        _digest("n_obs", ["r1", "r2"]).alias("trajectory"), F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("diagnosis"))
    return out.withColumn("signature", F.sha2(F.concat_ws("|", *COMPONENTS), 256))


def with_cells(profiles: DataFrame) -> DataFrame:
    """Each profile once overall and once in its sex cell."""
    return profiles.withColumn("cell", F.explode(F.array(F.lit("overall"), F.concat(F.lit("sex="), F.col("sex")))))


def with_subgroups(profiles: DataFrame, metric, floor: int) -> DataFrame:
    """Apply ``metric(rows with cell)`` to all cells; cells under the floor are UNEVALUABLE.

    ``worst`` marks the failing cell with the largest rate.
    """
    out = metric(with_cells(profiles)).withColumn(
        "status", F.when(F.col("evaluated") < floor, "UNEVALUABLE").otherwise(F.col("status")))
    failing = F.when(F.col("status") == "FAIL", F.struct("rate", "evaluated", "cell"))
    return out.crossJoin(F.broadcast(out.agg(F.max(failing).alias("__w")))).withColumn(  # a handful of cells
        "worst", F.coalesce(F.col("cell") == F.col("__w.cell"), F.lit(False))).drop("__w")


def _rate(df: DataFrame, hits: str, total: str, name: str) -> DataFrame:
    lower, upper = wilson_interval(F.col(hits), F.col(total))
    return df.withColumns({name: F.round(ratio(F.col(hits), F.col(total)), 6), "ci_lower": lower, "ci_upper": upper})


def identifiers(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct non-empty values over all key columns."""
    parts = [df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("id")) for df, cols in tables]
    return reduce(DataFrame.unionByName, parts).where("id <> ''").distinct()


def identifier_overlap(reference: DataFrame, generated: DataFrame) -> DataFrame:
    """Share of generated identifiers that occur in the reference."""
    hit = generated.join(reference.withColumn("__hit", F.lit(1)), "id", "left")
    out = _rate(hit.agg(F.count("*").alias("identifiers"), F.count("__hit").alias("overlap")), "overlap", "identifiers", "overlap_rate")
    return out.withColumn("status", F.when(F.col("identifiers") == 0, "UNEVALUABLE").when(F.col("overlap") > 0, "FAIL").otherwise("PASS"))


def _reproduced(queries: DataFrame, known: DataFrame, groups: list[str]) -> DataFrame:
    # Copies fold to one row per signature before the join.
    counts = queries.groupBy(*groups, "trajectory").agg(F.count("*").alias("n"))
    seen = known.select("trajectory").distinct().withColumn("__hit", F.lit(1))
    return counts.join(seen, "trajectory", "left").groupBy(*groups).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), F.coalesce(F.sum(F.when(F.col("__hit") == 1, F.col("n"))), F.lit(0)).alias("reproduced"))


def exact_reproduction(reference: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated trajectories that equal a reference trajectory."""
    out = _rate(_reproduced(generated, reference, []), "reproduced", "evaluated", "rate")
    return out.withColumn("status", F.when(F.col("evaluated") == 0, "UNEVALUABLE").when(F.col("reproduced") > 0, "FAIL").otherwise("PASS"))


def reproduction_by_cell(queries: DataFrame, reference: DataFrame) -> DataFrame:
    out = _rate(_reproduced(queries, reference, ["cell"]), "reproduced", "evaluated", "rate")
    return out.withColumn("status", F.when(F.col("reproduced") > 0, "FAIL").otherwise("PASS"))


def composition(generated: DataFrame, prior: list[DataFrame], limit: float = 0.0) -> DataFrame:
    """Generated trajectories already published in an earlier release."""
    seen = reduce(DataFrame.unionByName, [p.select("trajectory") for p in prior])
    out = _rate(_reproduced(generated, seen, []), "reproduced", "evaluated", "rate")
    return out.withColumn("prior_releases", F.lit(len(prior))).withColumn("status", F.when(F.col("rate") > limit, "FAIL").otherwise("PASS"))


def _subsets(components: list[str]) -> list[tuple[str, ...]]:
    return [s for k in range(len(components), 0, -1) for s in combinations(components, k)]


def _subset_keys(components: list[str]) -> Column:
    """Array of (level, key) over all component subsets; a key is 16 bytes."""
    return F.array(*[F.struct(F.lit(len(s)).alias("level"), F.unhex(F.md5(canonical(F.lit("+".join(s)), *s))).alias("key")) for s in _subsets(components)])


def subset_counts(reference: DataFrame, components: list[str], counts: dict[str, Column]) -> DataFrame:
    """Reference counts per component subset; equal profiles fold together first."""
    folded = reference.groupBy(*components).agg(*[c.alias(n) for n, c in counts.items()])
    return folded.select(F.explode(_subset_keys(components)).alias("s"), *counts).select("s.key", *counts).groupBy("key").agg(
        *[F.sum(n).alias(n) for n in counts])


def nearest_counts(queries: DataFrame, reference: DataFrame, components: list[str], counts: dict[str, Column]) -> DataFrame:
    """For each distinct query profile: highest matched level and the counts of candidates there.

    A candidate at the highest level matches exactly one subset of that size,
    so the candidate count is the sum over subsets; candidates themselves are
    never listed.  A profile is known by 16 bytes while its subsets travel.
    """
    kinds = queries.select(*components).distinct().withColumn("__kind", F.unhex(F.md5(canonical(*components))))
    keys = kinds.select("__kind", F.explode(_subset_keys(components)).alias("s")).select("__kind", "s.*")
    # A component of few values gives a few keys that hold most of the profiles.
    found = join_split(keys, subset_counts(reference, components, counts), "key").groupBy("__kind", "level").agg(*[F.sum(n).alias(n) for n in counts])
    best = found.groupBy("__kind").agg(F.max(F.struct("level", *counts)).alias("b")).select("__kind", "b.*")
    return kinds.join(best, "__kind", "left").withColumn("level", F.coalesce("level", F.lit(0))).drop("__kind")


def nearest_outcomes(queries: DataFrame, reference: DataFrame, components: list[str] = COMPONENTS) -> DataFrame:
    """Exact, unique and tied nearest counts per cell."""
    total = reference.agg(F.count("*").alias("__total"))  # one row
    near = nearest_counts(queries, reference, components, {"n": F.count("*")}).crossJoin(F.broadcast(total))
    near = near.select(*components, "level", F.coalesce("n", "__total").alias("n"))
    sizes = queries.groupBy("cell", *components).agg(F.count("*").alias("q"))
    j = sizes.join(near, components)
    weigh = lambda c: F.coalesce(F.sum(F.when(c, F.col("q"))), F.lit(0))
    return j.groupBy("cell").agg(F.sum("q").alias("evaluated"), weigh(F.col("level") == len(components)).alias("exact"), weigh(F.col("n") == 1).alias("unique_nearest"), weigh(F.col("n") != 1).alias("tied"))


def nearest_component(reference: DataFrame, generated: DataFrame, heldout: DataFrame, floor: int, zero_limit: float, unique_limit: float) -> DataFrame:
    """Nearest-component screen per cell against the held-out baseline."""
    rates = lambda df, s: nearest_outcomes(with_cells(df), reference).select(
        "cell", F.col("evaluated").alias(f"{s}evaluated"), F.col("exact").alias(f"{s}exact"), F.round(F.col("exact") / F.col("evaluated"), 6).alias(f"{s}zero_rate"),
        F.round(F.col("unique_nearest") / F.col("evaluated"), 6).alias(f"{s}unique_rate"), F.round(F.col("tied") / F.col("evaluated"), 6).alias(f"{s}tied_rate"))
    j = rates(generated, "").join(rates(heldout, "heldout_"), "cell", "left")
    lower, upper = wilson_interval(F.col("exact"), F.col("evaluated"))
    failed = (F.col("zero_rate") > zero_limit) | (F.col("unique_rate") > unique_limit)
    thin = (F.col("evaluated") < floor) | (F.coalesce("heldout_evaluated", F.lit(0)) < floor)
    return j.select(
        "cell", "evaluated", "zero_rate", "unique_rate", "tied_rate", "heldout_evaluated", "heldout_zero_rate", "heldout_unique_rate", lower.alias("ci_lower"), upper.alias("ci_upper"),
        F.when(thin, "UNEVALUABLE").when(failed, "FAIL").otherwise("PASS").alias("status"))


def indexed(profiles: DataFrame, pid: str) -> DataFrame:
    """Dense position by entity id, from running totals over id ranges."""
    return running_totals(profiles.withColumn("__one", F.lit(1).cast("long")), [], [pid], {"position": "__one"}).drop("__one")


def _permuted(reference: DataFrame, pid: str, components: list[str]) -> DataFrame:
    """Break the association between components by shifting each a different number of places."""
    rows = indexed(reference.select(pid, *components), pid)
    total = rows.agg(F.count("*").alias("__n"))  # one row
    cells = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("v")) for i, c in enumerate(components)])
    spread = rows.crossJoin(F.broadcast(total)).select("position", "__n", F.explode(cells).alias("c")).select(
        F.pmod(F.col("position") - F.col("c.which") - 1, F.col("__n")).alias("slot"), "c.*")
    return spread.groupBy("slot").agg(*[F.max(F.when(F.col("which") == i, F.col("v"))).alias(c) for i, c in enumerate(components)])


def _key_counts(df: DataFrame, selections: list[tuple[str, ...]], groups: list[str] = ()) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("selection"), F.md5(canonical(*s)).alias("key")) for i, s in enumerate(selections)])
    return df.select(*groups, F.explode(keys).alias("k")).select(*groups, "k.*").groupBy(*groups, "selection", "key").agg(F.count("*").alias("n"))


def linkage(reference: DataFrame, generated: DataFrame, heldout: DataFrame | None, pid: str, knowledge: list[str] = COMPONENTS) -> DataFrame:
    """Largest linkage advantage per cell over single components and the full set.

    Advantage = unique-candidate rate beyond the larger of the shifted
    reference and the held-out baseline.
    """
    selections = [(c,) for c in knowledge] + ([tuple(knowledge)] if len(knowledge) > 1 else [])
    unique = lambda df, n: _key_counts(df, selections).where("n = 1").select("selection", "key", F.lit(1).alias(n))

    def rates(queries: DataFrame, against: list[tuple[str, DataFrame]], prefix: str) -> DataFrame:
        q = _key_counts(with_cells(queries), selections, ["cell"])
        for n, ref in against:
            q = q.join(unique(ref, n), ["selection", "key"], "left")
        return q.groupBy("cell", "selection").agg(F.sum("n").alias(f"{prefix}evaluated"), *[
            F.round(F.coalesce(F.sum(F.when(F.col(n) == 1, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias(f"{prefix}{n}") for n, _ in against])

    shifted = _permuted(reference, pid, knowledge)
    out = rates(generated, [("unique_rate", reference), ("permutation_rate", shifted)], "")
    if heldout is not None:
        out = join_on(out, rates(heldout, [("unique_rate", reference)], "heldout_"), ["cell", "selection"], "left")
    else:
        out = out.withColumns({"heldout_evaluated": F.lit(None).cast("long"), "heldout_unique_rate": F.lit(None).cast("double")})
    base = F.greatest("permutation_rate", F.coalesce("heldout_unique_rate", F.lit(0.0)))
    out = out.withColumn("advantage", F.round(F.greatest(F.lit(0.0), F.col("unique_rate") - base), 6))
    order = F.struct(F.col("advantage"), F.col("unique_rate"), -F.col("permutation_rate"), -F.coalesce("heldout_unique_rate", F.lit(0.0)), -F.col("selection"))
    names = F.array(*[F.lit("+".join(s)) for s in selections])
    kept = ["evaluated", "unique_rate", "permutation_rate", "heldout_unique_rate", "advantage"]
    return out.groupBy("cell").agg(F.max_by(F.struct(F.get(names, F.col("selection")).alias("selection"), *kept), order).alias("b")).select("cell", "b.*")


def membership_inference(reference: DataFrame, packages: DataFrame, members: DataFrame, limit: float) -> DataFrame:
    """Per shadow run: how much better matching signatures finds members than non-members.

    ``packages`` and ``members``: (run, trajectory).  Reference profiles fold to
    counts per signature, then meet each run's signatures by equi-join.
    """
    known = reference.groupBy("trajectory").agg(F.count("*").alias("n"))
    total = known.agg(F.sum("n").alias("__total"))  # one row
    tag = lambda df, c: df.select("run", "trajectory", F.lit(1).alias(c)).distinct()
    marks = tag(packages, "score").join(tag(members, "member"), ["run", "trajectory"], "full")
    hit = marks.join(known, "trajectory").groupBy("run").agg(
        F.sum(F.when(F.col("member") == 1, F.col("n")).otherwise(0)).alias("positives"),
        F.sum(F.when(F.col("score") == 1, F.col("n")).otherwise(0)).alias("matches"),
        F.sum(F.when((F.col("score") == 1) & (F.col("member") == 1), F.col("n")).otherwise(0)).alias("true_positives"))
    out = hit.crossJoin(F.broadcast(total)).withColumns({
        "negatives": F.col("__total") - F.col("positives"), "false_positives": F.col("matches") - F.col("true_positives"), "evaluated": F.col("__total")})
    tpr, fpr = ratio(F.col("true_positives"), F.col("positives")), ratio(F.col("false_positives"), F.col("negatives"))
    tl, tu = wilson_interval(F.col("true_positives"), F.col("positives"))
    fl, fu = wilson_interval(F.col("false_positives"), F.col("negatives"))
    advantage = F.round(F.greatest(F.lit(0.0), tpr - fpr), 6)
    return out.select(
        "run", "evaluated", "positives", "negatives", "true_positives", "false_positives", F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"), advantage.alias("advantage"),
        F.round(F.greatest(F.lit(0.0), tl - fu), 6).alias("advantage_lower"), F.round(F.greatest(F.lit(0.0), tu - fl), 6).alias("advantage_upper"),
        F.when(advantage > limit, "FAIL").otherwise("PASS").alias("status"))


def attribute_disclosure(reference: DataFrame, generated: DataFrame, heldout: DataFrame, pid: str, limit: float, knowledge: list[str] = COMPONENTS) -> DataFrame:
    """Majority vote of the nearest training half against majority baselines.

    Positions alternate between training and evaluation; a generated profile is
    scored when its trajectory occurs once in the reference and once in the
    generated data and belongs to the evaluation half.
    """
    attack = [c for c in knowledge if c != "diagnosis"]
    placed = indexed(reference, pid)
    training, evaluation = placed.where("position % 2 = 0"), placed.where("position % 2 = 1")
    once = lambda df: df.groupBy("trajectory").agg(F.count("*").alias("c")).where("c = 1").select("trajectory")
    targets = generated.join(once(generated), "trajectory", "left_semi").join(once(reference), "trajectory", "left_semi").join(
        evaluation.select("trajectory", F.col("label").alias("target")), "trajectory")
    votes = {"v0": F.count_if(F.col("label") == "0"), "v1": F.count_if(F.col("label") == "1")}
    near = nearest_counts(targets, training, attack, votes)
    tally = lambda df, p: df.agg(F.count_if(F.col("label") == "0").alias(f"{p}0"), F.count_if(F.col("label") == "1").alias(f"{p}1"))  # one row
    joined = targets.join(near, attack).crossJoin(F.broadcast(tally(training, "t"))).crossJoin(F.broadcast(tally(heldout, "h")))
    # Ties go to the larger label.
    guess = lambda a, b: F.when(b >= a, "1").otherwise("0")
    own = guess(F.coalesce("v0", "t0"), F.coalesce("v1", "t1"))
    right = lambda g: F.count_if(g == F.col("target"))
    agg = joined.agg(F.count("*").alias("evaluated"), right(own).alias("attack_hits"), right(guess(F.col("t0"), F.col("t1"))).alias("r"), right(guess(F.col("h0"), F.col("h1"))).alias("h"))
    out = _rate(agg, "attack_hits", "evaluated", "attack_accuracy").withColumns({
        "reference_baseline": F.round(ratio(F.col("r"), F.col("evaluated")), 6), "heldout_baseline": F.round(ratio(F.col("h"), F.col("evaluated")), 6)})
    advantage = F.round(F.greatest(F.lit(0.0), F.col("attack_accuracy") - F.greatest("reference_baseline", "heldout_baseline")), 6)
    return out.drop("r", "h").withColumn("advantage", advantage).withColumn(
        "status", F.when(F.col("evaluated") == 0, "UNEVALUABLE").when(F.col("advantage") > limit, "FAIL").otherwise("PASS"))


def control_harness(reference: DataFrame, control: DataFrame, pid: str, name: str, expect_detected: bool, limit: float) -> DataFrame:
    """Known package through reproduction and linkage: a positive control must be detected, a negative must not."""
    rep = _rate(_reproduced(control, reference, []), "reproduced", "evaluated", "reproduction_rate").select("evaluated", "reproduced", "reproduction_rate")
    link = linkage(reference, control, None, pid).where("cell = 'overall'").select("unique_rate", "permutation_rate")
    advantage = F.round(F.greatest(F.lit(0.0), F.col("unique_rate") - F.col("permutation_rate"), F.col("reproduction_rate")), 6)
    detected = F.col("advantage") > limit
    return rep.crossJoin(link).withColumn("advantage", advantage).select(  # one row each
        F.lit(name).alias("control"), "*", F.when(detected == F.lit(expect_detected), "PASS").otherwise("FAIL").alias("status"))


def audit_decision(controls: DataFrame, required: list[str]) -> DataFrame:
    """Overall verdict over control rows (control, status)."""
    failed = F.count_if(F.col("status") == "FAIL")
    open_ = F.count_if(F.col("control").isin(*required) & (F.col("status") == "UNEVALUABLE"))
    present = F.count_if(F.col("control").isin(*required))
    return controls.agg(F.count("*").alias("controls"), failed.alias("failed"), (open_ + F.lit(len(required)) - present).alias("required_open")).withColumn(
        "decision", F.when(F.col("failed") > 0, "FAIL").when(F.col("required_open") > 0, "UNEVALUABLE").otherwise("PASS"))
