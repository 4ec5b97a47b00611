"""Statistics over evaluation results: exact McNemar, paired bootstrap, matched operating points, d-prime, item response,
gates, entity scores, allocation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import touching


def leak_vector(responses: DataFrame) -> DataFrame:
    """(doc, system, leaked) of responses(item, system, outcome); an item is "<doc>#<number>", split at the last #."""
    doc = F.regexp_extract("item", r"^([\s\S]*)#[^#]*$", 1)
    sound = F.assert_true(F.col("outcome").isNotNull(), F.lit("blank outcome"))
    return responses.where(sound.isNull()).groupBy(doc.alias("doc"), "system").agg(F.bool_or(F.col("outcome") == 0).alias("leaked"))


def mcnemar(vectors: DataFrame, a: str, b: str) -> DataFrame:
    """One row: documents that only a or only b leaks, and the exact two-sided p."""
    one = vectors.where(F.col("system").isin(a, b)).groupBy("doc").agg(F.bool_or(F.when(F.col("system") == a, F.col("leaked"))).alias("a"), F.bool_or(F.when(F.col("system") == b, F.col("leaked"))).alias("b"))
    counts = one.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    n, low = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # Terms fall by a ratio from the largest one down; those beyond 8 standard deviations below it add nothing to a double.
    first = F.exp(log_gamma(n + 1) - log_gamma(low + 1) - log_gamma(n - low + 1) - n * F.lit(math.log(2)))
    steps = F.least(low, F.ceil(8 * F.sqrt(n.cast("double"))) + 100).cast("int")
    start = F.struct(first.alias("term"), first.alias("sum"))
    add = lambda s, k: F.struct((s["term"] * (low - k + 1) / (n - low + k)).alias("term"), (s["sum"] + s["term"] * (low - k + 1) / (n - low + k)).alias("sum"))
    tail = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, add, lambda s: s["sum"])
    return counts.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def log_gamma(x: Column) -> Column:
    """Stirling's series for x >= 1, moved up by ten, where it is exact to a double's digits but the last few."""
    y = x.cast("double") + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y) + 1 / (1188 * y * y * y * y * y * y * y * y * y)
    moved = reduce(lambda a, b: a * b, (x.cast("double") + k for k in range(10)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(moved)


#: Groups of documents, by hash, that a bootstrap resamples together.
BUCKETS = 1_024


def poisson_sql(u: str) -> str:
    """A Poisson number of mean 1 for u evenly drawn from [0, 1), up to 8."""
    total, term, steps = 0.0, math.exp(-1), []
    for k in range(8):
        total += term
        term /= k + 1
        steps.append(f"CASE WHEN {u} >= {total!r}D THEN 1 ELSE 0 END")
    return " + ".join(steps).replace("D THEN", " THEN")


def bootstrap(vectors: DataFrame, reference: str, draws: int = 1_000, seed: int = 0) -> DataFrame:
    """Difference of each system's leak rate to the reference, with the 95 % interval of paired resamples.

    Documents are dealt into BUCKETS groups by hash, and a group's weight in a draw is Poisson of mean 1 by hash of (seed,
    draw, group): only sums by group are multiplied by draws, whatever the number of documents.
    """
    wide = vectors.where(F.col("system") == reference).select("doc", F.col("leaked").cast("int").alias("r"))
    pairs = vectors.where(F.col("system") != reference).join(wide, "doc").select("doc", "system", (F.col("leaked").cast("int") - F.col("r")).alias("d"))
    of = lambda text: F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    groups = pairs.groupBy("system", (of(F.col("doc")) % BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), F.sum("d").alias("d"))
    key = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("bucket").cast("string"))
    weighed = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", of(key) / 4294967296.0).withColumn("w", F.expr(poisson_sql("u")))
    drawn = weighed.groupBy("system", "draw").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum(F.col("w") * F.col("n"))).alias("diff"))
    ends = drawn.groupBy("system").agg(F.sort_array(F.collect_list("diff")).alias("x")).select("system", F.element_at("x", int(0.025 * draws) + 1).alias("low"), F.element_at("x", int(0.975 * draws)).alias("high"))
    mean = groups.groupBy("system").agg((F.sum("d") / F.sum("n")).alias("diff"))
    verdict = F.when(F.col("high") < 0, "better").when(F.col("low") > 0, "worse").otherwise("even")
    return mean.join(ends, "system").withColumn("verdict", verdict)


def matched_points(sweep: DataFrame, caps: list[float]) -> DataFrame:
    """Of each system and over-redaction cap, the sweep row with least leaking documents, ties to the highest threshold."""
    within = sweep.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).where("over_redaction <= cap")
    best = Window.partitionBy("system", "cap").orderBy("leak_docs", F.desc("threshold"))
    return within.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


# A published rational approximation of the normal quantile, with a relative error below 1.2e-9.
CENTRE = ([-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239], [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0])
TAILS = ([-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783], [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0])
TAIL_FROM = 0.02425


def probit_sql(p: str) -> str:
    """The normal quantile of p as SQL text of any dialect; null outside (0, 1)."""

    def poly(coefficients: list[float], x: str) -> str:
        out = f"({coefficients[0]!r})"
        for c in coefficients[1:]:
            out = f"({out} * {x} + ({c!r}))"
        return out

    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    square = f"({q} * {q})"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {TAIL_FROM} THEN {poly(TAILS[0], low)} / {poly(TAILS[1], low)} WHEN {p} > {1 - TAIL_FROM} THEN -{poly(TAILS[0], high)} / {poly(TAILS[1], high)} ELSE {poly(CENTRE[0], square)} * {q} / {poly(CENTRE[1], square)} END"


def d_prime_points(rows: DataFrame, near: float = 0.35) -> DataFrame:
    """Of each system in rows(system, threshold, d_prime), the greatest d' (at the lowest threshold that has it) and the one at the threshold nearest to `near`."""
    best, close = F.struct(F.negative("d_prime"), "threshold"), F.struct(F.abs(F.col("threshold") - near), F.col("threshold"))
    both = F.struct("d_prime", "threshold")
    return rows.groupBy("system").agg(F.min_by(both, best).alias("b"), F.min_by(both, close).alias("c")).select("system", F.col("b.d_prime").alias("best"), F.col("b.threshold").alias("best_at"), F.col("c.d_prime").alias("near"), F.col("c.threshold").alias("near_at"))


def d_prime(sweep: DataFrame) -> DataFrame:
    """d' and criterion of sweep rows(hits, hit_n, false_alarms, fa_n), log-linear."""
    rate = lambda x, n: (F.col(x) + 0.5) / (F.col(n) + 1)
    rows = sweep.withColumn("ph", rate("hits", "hit_n")).withColumn("pf", rate("false_alarms", "fa_n"))
    rows = rows.withColumn("zh", F.expr(probit_sql("ph"))).withColumn("zf", F.expr(probit_sql("pf"))).drop("ph", "pf")
    edge = (F.col("hits") == 0) | (F.col("hits") == F.col("hit_n")) | (F.col("false_alarms") == 0) | (F.col("false_alarms") == F.col("fa_n"))
    return rows.withColumn("d_prime", F.col("zh") - F.col("zf")).withColumn("criterion", -(F.col("zh") + F.col("zf")) / 2).withColumn("boundary", edge).drop("zh", "zf")


def fit_2pl(patterns: np.ndarray, counts: np.ndarray, rounds: int = 80, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two-parameter item response by joint MAP over response patterns (nan: none): a, b by pattern; theta, its error.

    N(0, 1) priors on log a, b and theta; damped Newton steps alternate between patterns and systems.
    """
    seen = ~np.isnan(patterns)
    y = np.where(seen, patterns, 0.0)
    la, b = np.zeros(len(y)), np.zeros(len(y))
    theta = np.zeros(y.shape[1])

    def p_of(la, b, theta):
        return 1 / (1 + np.exp(-np.clip(np.exp(la)[:, None] * (theta[None, :] - b[:, None]), -30, 30)))

    def fit_of(la, b, theta):
        p = np.clip(p_of(la, b, theta), 1e-12, 1 - 1e-12)
        return seen * (y * np.log(p) + (1 - y) * np.log(1 - p))

    for _ in range(rounds):
        p, a = p_of(la, b, theta), np.exp(la)[:, None]
        gap, info = theta[None, :] - b[:, None], seen * p * (1 - p)
        g_la, g_b = (seen * (y - p) * a * gap).sum(1) - la, -(seen * (y - p) * a).sum(1) - b
        h_aa, h_bb, h_ab = (info * (a * gap) ** 2).sum(1) + 1, (info * a**2).sum(1) + 1, -(info * a**2 * gap).sum(1)
        det = np.maximum(h_aa * h_bb - h_ab**2, 1e-9)
        step_a, step_b = np.clip((h_bb * g_la - h_ab * g_b) / det, -1, 1), np.clip((h_aa * g_b - h_ab * g_la) / det, -1, 1)
        before, scale = fit_of(la, b, theta).sum(1) - (la**2 + b**2) / 2, np.ones(len(y))
        for _ in range(5):
            worse = fit_of(la + scale * step_a, b + scale * step_b, theta).sum(1) - ((la + scale * step_a) ** 2 + (b + scale * step_b) ** 2) / 2 < before
            scale = np.where(worse, scale / 2, scale)
        la, b = la + scale * step_a, b + scale * step_b
        p, a = p_of(la, b, theta), np.exp(la)[:, None]
        w = counts[:, None] * seen
        gradient, info = (w * (y - p) * a).sum(0) - theta, (w * p * (1 - p) * a**2).sum(0) + 1
        step = np.clip(gradient / info, -1, 1)
        theta = theta + step
        if max(np.abs(scale * step_a).max(initial=0), np.abs(scale * step_b).max(initial=0), np.abs(step).max(initial=0)) < tol:
            break
    a = np.exp(la)[:, None]
    p = p_of(la, b, theta)
    return np.exp(la), b, theta, 1 / np.sqrt((counts[:, None] * seen * p * (1 - p) * a**2).sum(0) + 1)


#: Response patterns that are fitted on the driver and sent to every task.
PATTERNS = 100_000


def item_response(responses: DataFrame, systems: list[str], touched: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items with a, b, p; systems with theta, se): equal patterns share parameters, so only distinct ones are fitted.

    There are at most 3 ** len(systems) patterns, whatever the number of items; more than PATTERNS of them are refused.
    """
    hit = (F.col("outcome") >= 1) if touched else (F.col("outcome") == 2)
    wide = responses.withColumn("y", hit.cast("int")).groupBy("item").pivot("system", systems).agg(F.first("y"))
    pattern = F.concat_ws(",", *[F.coalesce(F.col(f"`{s}`").cast("string"), F.lit("-")) for s in systems])
    items = wide.select("item", pattern.alias("pattern"))
    rows = items.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} response patterns")
    informative = [r for r in rows if "0" in r["pattern"] and "1" in r["pattern"]]
    table = np.array([[np.nan if x == "-" else float(x) for x in r["pattern"].split(",")] for r in informative]).reshape(-1, len(systems))
    a, b, theta, se = fit_2pl(table, np.array([r["n"] for r in informative], dtype=float))
    spark = responses.sparkSession
    fitted = spark.createDataFrame([(r["pattern"], float(x), float(y), float(np.nanmean(t))) for r, x, y, t in zip(informative, a, b, table, strict=True)], "pattern string, a double, b double, p double")
    return items.join(F.broadcast(fitted), "pattern").drop("pattern"), spark.createDataFrame([(s, float(t), float(e)) for s, t, e in zip(systems, theta, se, strict=True)], "system string, theta double, se double")


def empirical(responses: DataFrame, touched: bool = True) -> DataFrame:
    """(system, p, informative): share of items a system gets right, and how many of its items tell systems apart at all."""
    hit = ((F.col("outcome") >= 1) if touched else (F.col("outcome") == 2)).cast("int")
    x = responses.where("outcome IS NOT NULL").select("item", "system", hit.alias("y"))
    spread = x.groupBy("item").agg((F.min("y") < F.max("y")).alias("tells"))
    return x.join(spread, "item").groupBy("system").agg(F.avg("y").alias("p"), F.count_if("tells").alias("informative"))


def tag_difficulty(items: DataFrame, tags: DataFrame) -> DataFrame:
    """Mean and population spread of b, mean p, and items of little discrimination, by tag."""
    return items.join(tags, "item").groupBy("tag").agg(F.count("*").alias("n"), F.avg("b").alias("mean_b"), F.stddev_pop("b").alias("sd_b"), F.avg("p").alias("mean_p"), F.count_if(F.col("a") < 0.5).alias("flat"))


def tag_agreement(rows: DataFrame) -> DataFrame:
    """Precision, recall and agreement of a computed flag against a stated one, by tag."""
    got, want = F.col("computed"), F.col("stated")
    counts = rows.groupBy("tag").agg(F.count_if(got & want).alias("tp"), F.count_if(got & ~want).alias("fp"), F.count_if(~got & want).alias("fn"), F.count_if(~got & ~want).alias("tn"))
    return counts.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("agreement", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def gates(scores: DataFrame, baseline_leak: float = 0.0) -> DataFrame:
    """Release gates of scores(set, system, leak_rate, over_redaction, int8_recall, fp32_recall): value, limit, pass."""
    gate = lambda name, value, limit, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("gate"), value.alias("actual"), F.lit(limit).alias("limit"), (value <= limit + 1e-12).alias("pass")))
    all_ = F.array(gate("over_redaction", F.col("over_redaction"), 0.01), gate("leak_rate", F.col("leak_rate"), baseline_leak + 0.005, F.col("set").startswith("clin")), gate("int8_recall", F.abs(F.col("int8_recall") - F.col("fp32_recall")), 0.005))
    return scores.select("set", "system", F.explode(F.filter(all_, lambda g: g.isNotNull())).alias("g")).select("set", "system", "g.gate", "g.actual", "g.limit", "g.pass")


def touch_recall(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: gold entities (doc_id, start, end), those that a predicted one overlaps, and their share."""
    g = gold.select("doc_id", "start", "end").distinct()
    hit = touching(g, predicted.select("doc_id", "start", "end").distinct())
    rows = g.select(F.lit(1).alias("gold"), F.lit(0).alias("touched")).union(hit.select(F.lit(0), F.lit(1)))
    return rows.agg(F.coalesce(F.sum("gold"), F.lit(0)).alias("gold"), F.coalesce(F.sum("touched"), F.lit(0)).alias("touched")).withColumn("recall", F.try_divide("touched", "gold"))


def entity_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: exact precision, recall and F1 of entities identified by keys."""
    g, p = gold.select(*keys, F.lit(1).alias("__g")).distinct(), predicted.select(*keys, F.lit(1).alias("__p")).distinct()
    both = g.join(p.hint("merge"), keys, "full")
    counts = both.agg(F.count("__g").alias("gold"), F.count("__p").alias("predicted"), F.count(F.col("__g") + F.col("__p")).alias("right"))
    pr, rc = F.try_divide("right", "predicted"), F.try_divide("right", "gold")
    return counts.select("gold", "predicted", "right", pr.alias("precision"), rc.alias("recall"), F.try_divide(2 * pr * rc, pr + rc).alias("f1"))


def token_scores(tokens: DataFrame) -> DataFrame:
    """One row: token recall, precision and F2 of tokens(gold boolean, predicted boolean)."""
    c = tokens.agg(F.count_if(F.col("gold") & F.col("predicted")).alias("tp"), F.count_if("gold").alias("g"), F.count_if("predicted").alias("p"))
    r, p = F.try_divide("tp", "g"), F.try_divide("tp", "p")
    return c.select(r.alias("recall"), p.alias("precision"), F.try_divide(5 * p * r, 4 * p + r).alias("f2"))


def largest_remainder(shares: DataFrame, total: int, key: str = "name", share: str = "share") -> DataFrame:
    """Whole numbers that add up to total in proportion to shares: floors, then one more to the largest fractions."""
    exact = shares.crossJoin(shares.agg(F.sum(share).alias("__all"))).withColumn("__x", F.col(share) * total / F.col("__all")).withColumn("__f", F.floor("__x"))
    left = F.lit(total) - F.sum("__f").over(Window.partitionBy())
    turn = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__x") - F.col("__f"), 9)), key))
    return exact.withColumn("__left", left).withColumn("__n", turn).select(key, (F.col("__f") + (F.col("__n") <= F.col("__left")).cast("int")).cast("bigint").alias("n"))


def merged_responses(a: DataFrame, b: DataFrame) -> DataFrame:
    """item with the systems of both wide response tables; items must be the same, and shared systems must agree."""
    shared = [c for c in a.columns if c in b.columns and c != "item"]
    x = a.alias("a").join(b.alias("b"), F.col("a.item") == F.col("b.item"), "full")
    sound = F.assert_true(F.col("a.item").isNotNull() & F.col("b.item").isNotNull(), F.lit("item sets differ"))
    for c in shared:
        sound = F.coalesce(sound, F.assert_true(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"{c} differs")))
    return x.where(sound.isNull()).select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in a.columns])
