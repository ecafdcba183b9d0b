"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each whole text gets counts (words, characters in words, symbols, repeated lines, words in repeated 8-word windows;
beside these punctuation, capital letters and distinct words). Plain rules fail the obvious cases; of the others, a
vector of transformed statistics is compared with a robust centre and scatter of its language and source. A row whose
squared Mahalanobis distance exceeds the chi-square quantile of `level` is rejected.

The statistics are means over the words of a text, so those of short texts spread more: the scatter of a text of n
words is taken as S * (1 + SPREAD / n), and S is what is estimated.

MCD: of all subsets that hold the share `support` of a group's rows, the one whose covariance has the least determinant
gives centre and scatter. Concentration steps (the support nearest by the last estimate gives the next one) run from
several starts, the start with the least determinant goes on until its determinant no longer falls, and a last step
weighs in all rows within the 97.5 % quantile. Both estimates are corrected for the part of a normal distribution that
they leave out. A step is one aggregation over all rows: counts and moments by group and distance bin. The bins up to
the one that completes the support form the subset (of that last bin only the missing share), so nothing is sorted or
gathered, whatever a group's size.

Estimates are made for every group of language and source, every language, and all rows. A group's centre and scatter
are drawn towards its language's, and that one's towards all rows', as if `prior` rows stood for them; the scatter of
all rows is drawn towards a wide one by P + 1 rows. So groups of any size, single rows too, are tested by one rule.

Statistics are integers in units of 1/UNIT, and moments are sums of integers (in doubles, exact to 2^53), so they do
not depend on partitioning.

Defined results: a null text has no words and fails the base rules; null languages and sources form groups of their
own; `distance` is null where the base rules failed; repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST, cut_lineage, mapped, quoted, row_of, small, stored

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_punct", "n_capitals", "n_distinct"]
WINDOW = 8
#: Transformed statistics and their unit.
FEATURES, UNIT = ["word_length", "punctuation", "capitals", "diversity"], 4096
#: Words at which the scatter of a text is twice S, and the unit of the weights n / (n + SPREAD).
SPREAD, WEIGHT = 100, 64
#: Values of a statistic in one bin of the starting histograms.
STEP = 8
#: Standard deviation of every statistic as long as there are no rows: it stands for P + 1 rows of all, as many as a
#: scatter takes to be determined.
WIDE = 0.1
#: Share of the rows in a subset, starts of a group, and steps before the search ends in any case.
SUPPORT, STARTS, MOST_STEPS = 0.6, 3, 12
#: Change of the logarithm of a determinant, in any group, below which the search ends.
CONVERGED = 0.01


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """How many words lie in n-word windows that occur more than once."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    if len(np.unique(mixed)) == m:  # equal windows have equal hashes, so none repeats
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    width = 1
    while width < n:  # exact: pairs of equal-width runs are numbered anew
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def _bytes_where(test) -> np.ndarray:
    return np.array([i for i in range(256) if test(i)])


_SYMBOL, _BLANK, _CAPITAL = (_bytes_where(s.__contains__) for s in (SYMBOLS, BLANKS, bytes(range(65, 91))))
_FOLLOWING = _bytes_where(lambda b: 0x80 <= b < 0xC0)
_PUNCTUATION = _bytes_where(lambda b: 33 <= b < 127 and not chr(b).isalnum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts in the order of COUNTS and MORE. Punctuation and capitals are those of ASCII."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    of = lambda which: int(seen[which].sum())
    return (
        len(words),
        len(raw) - of(_FOLLOWING) - of(_BLANK),
        of(_SYMBOL),
        len(lines) - len(set(lines)),
        repeated_words(words),
        of(_PUNCTUATION),
        of(_CAPITAL),
        len(set(words)),
    )


def with_counts(df: DataFrame, keep: list[str], text: str = "text", field: int | None = None) -> DataFrame:
    """keep and the counts (COUNTS and MORE) of every whole text; field: of this field, by place, of structs."""

    def made(texts: list) -> list:
        found = np.array([counts(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS) + len(MORE))
        return list(found.T)

    return mapped(df, keep, text, {c: T.LongType() for c in (*COUNTS, *MORE)}, made, 512, field)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
X = [f"x{i}" for i in range(P)]


def with_features(df: DataFrame) -> DataFrame:
    """df with the transformed statistics in integer units and the weight of a text. Logarithms and square roots even
    out the spread of ratios and rates; diversity is the logarithm of the distinct words to the base of all words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    stats = [
        F.log(chars / n),
        F.sqrt(F.col("n_punct") / chars),
        F.sqrt(F.col("n_capitals") / chars),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) / F.log(n + 1),
    ]
    units = {x: F.round(s * UNIT).cast("bigint") for x, s in zip(X, stats)}
    return df.withColumns(units | {"w": F.greatest(F.lit(1), F.round(WEIGHT * n / (n + SPREAD))).cast("bigint")})


# -- estimates ------------------------------------------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """Of k degrees of freedom, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = math.exp(a * math.log(z) - z - math.lgamma(a + 1))
    n = a
    while term > 1e-17 * total:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total)


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return high


def _kept_variance(share: float) -> float:
    """The variance, as a part of the whole one, of a normal distribution within the ellipsoid that holds a share of it."""
    return chi2_cdf(chi2_quantile(share, P), P + 2) / share


def _whitening(cov: np.ndarray) -> np.ndarray:
    """Lower triangles L, for stacked scatters, with d = |L (x - mu)|^2. The histograms' resolution is added to
    variances, so that data without any spread have an inverse."""
    return np.linalg.inv(np.linalg.cholesky(cov + np.eye(P) * (STEP / UNIT) ** 2))


def distance(x: list[Column], w: Column, mu: Column, lower: Column) -> Column:
    """Squared Mahalanobis distance of a row, from its statistics and weight and its group's estimate; scalar
    expressions only, so that it is compiled."""
    d = [c / UNIT - F.get(mu, i) for i, c in enumerate(x)]
    at = {ij: k for k, ij in enumerate(_LOWER)}
    parts = [sum((F.get(lower, at[i, j]) * d[j] for j in range(1, i + 1)), F.get(lower, at[i, 0]) * d[0]) for i in range(P)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0]) * w / WEIGHT


#: Levels of estimates: all rows, a language, a language and source.
LEVELS = ([], ["lang"], ["lang", "source"])
_KEY = ["level", "lang", "source"]
_PARAMS = "level int, lang string, source string, start int, n bigint, logdet double, mu array<double>, cov array<double>, lower array<double>"


def _params(g: pd.DataFrame, start, mu: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Estimates of the groups in g from stacked centres and scatters."""
    out = g[[*_KEY]].copy()
    out["start"], out["n"] = start, g["n"].to_numpy()
    out["logdet"] = np.linalg.slogdet(cov + np.eye(P) * (STEP / UNIT) ** 2)[1]
    lower = _whitening(cov)
    out["mu"], out["cov"] = list(mu), list(cov.reshape(-1, P * P))
    out["lower"] = list(np.stack([lower[:, i, j] for i, j in _LOWER], axis=1))
    return out


def _matrices(g: pd.DataFrame, prefix: str) -> np.ndarray:
    out = np.zeros((len(g), P, P))
    for i, j in _PAIRS:
        out[:, i, j] = out[:, j, i] = g[f"{prefix}{i}{j}"]
    return out


def _of_level(rows: DataFrame, level: int) -> DataFrame:
    """rows with the key of their group on a level; names that a level doesn't use are null."""
    name = lambda c: (F.col(c) if c in LEVELS[level] else F.lit(None)).cast("string").alias(c)
    return rows.select(F.lit(level).alias("level"), name("lang"), name("source"), "w", *X)


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many summary rows, in no more partitions than these need. What lies in one is grouped further
    without a shuffle, so that steps over few groups don't wait for hundreds of empty tasks."""
    return df.coalesce(math.ceil(max(rows, 1) / BROADCAST))


def _joined_parts(rows: DataFrame) -> DataFrame:
    """rows in fewer partitions, as they are numbers only: up to 16 to one, but enough for all cores."""
    parts = rows.rdd.getNumPartitions()
    return rows.coalesce(max(4 * rows.sparkSession.sparkContext.defaultParallelism, parts // 16, 1))


def _meet(rows: DataFrame, params: DataFrame, sizes: list[int]) -> DataFrame:
    """Every row with each estimate of each of its groups, in one pass over the rows. The estimates of a group are
    packed into one row; these are broadcast where the counted groups of a level are few."""
    out = rows
    for level, names in enumerate(LEVELS):
        key = [F.col(c).alias(f"p_{c}") for c in names]
        packed = _packed(params.filter(F.col("level") == level), STARTS * sizes[level]).groupBy(*key).agg(F.collect_list(F.struct("level", F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "start", "mu", "lower")).alias(f"e{level}"))
        if not names:
            out = out.crossJoin(F.broadcast(packed))  # one row
            continue
        on = F.lit(True)
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
        out = out.join(small(packed, sizes[level]), on).drop(*(f"p_{c}" for c in names))
    each = out.select("w", *X, F.explode(F.concat(*(f"e{level}" for level in range(len(LEVELS))))).alias("e"))
    return each.select("e.level", F.col("e.g_lang").alias("lang"), F.col("e.g_source").alias("source"), "e.start", "w", *X, "e.mu", "e.lower")


#: Bins of log1p(distance), and how many of them a group has at about most.
BINS, MOST_BINS = 16, 256


def _step(rows: DataFrame, params: DataFrame, sizes: list[int], origin: np.ndarray, final: bool = False) -> DataFrame:
    """One concentration step from params; or the last one, over all rows within the quantile."""
    bin_of = F.floor(BINS * F.log1p(distance([F.col(x) for x in X], F.col("w"), F.col("mu"), F.col("lower")))).cast("int")
    at = [(F.col(x) - int(o)).cast("double") for x, o in zip(X, origin)]
    moments = {"m": F.count("*").cast("double"), "w": F.sum("w").cast("double")}
    moments |= {f"s{i}": F.sum(F.col("w") * at[i]) for i in range(P)} | {f"q{i}{j}": F.sum(F.col("w") * at[i] * at[j]) for i, j in _PAIRS}
    binned = _meet(rows, params, sizes).withColumn("bin", bin_of).groupBy(*_KEY, "start", "bin").agg(*(c.alias(k) for k, c in moments.items()))
    binned = _packed(binned, STARTS * sum(sizes) * MOST_BINS)
    group = W.partitionBy(*_KEY, "start")
    if final:
        edge, factor = BINS * math.log1p(chi2_quantile(0.975, P)), _kept_variance(0.975)
        # Where no row lies near the centre, as in groups of one or two rows, the nearest ones stand.
        share = F.when(F.col("bin") == F.min("bin").over(group), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(edge) - F.col("bin"))))
    else:
        factor = _kept_variance(SUPPORT)
        before = F.sum("m").over(group.orderBy("bin")) - F.col("m")
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (SUPPORT * F.sum("m").over(group) - before) / F.col("m")))
    summed = binned.withColumn("share", share).groupBy(*_KEY, "start").agg(F.sum("m").cast("bigint").alias("n"), *(F.sum(F.col("share") * F.col(k)).alias(k) for k in moments))

    def step(batches):
        for g in batches:
            s = g[[f"s{i}" for i in range(P)]].to_numpy()
            m, w = g["m"].to_numpy(), g["w"].to_numpy()
            mean = s / w[:, None]
            cov = (_matrices(g, "q") - mean[:, :, None] * s[:, None, :]) / (m * WEIGHT * UNIT**2 * factor)[:, None, None]
            yield _params(g, g["start"].to_numpy(), (origin + mean) / UNIT, cov)

    return cut_lineage(_packed(summed, STARTS * sum(sizes)).mapInPandas(step, _PARAMS))


def _started(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """Starts of all groups, and how many groups each level has: medians with (0) independent spreads by quartiles, (1) the correlations of tanh-bounded
    statistics and (2) those of directions from the median (spatial signs)."""
    bins = None
    for level in range(len(LEVELS)):
        each = _of_level(rows, level).select(*_KEY, F.posexplode(F.array(*[F.floor(F.col(x) / STEP) for x in X])).alias("k", "value"))
        own = each.groupBy(*_KEY, "k", "value").count()
        bins = own if bins is None else bins.unionByName(own)
    one = W.partitionBy(*_KEY, "k")
    upto = bins.withColumn("upto", F.sum("count").over(one.orderBy("value"))).withColumn("n", F.sum("count").over(one))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("value"))).alias(f"q{int(100 * q)}")
    quartiles = upto.groupBy(*_KEY, "k").agg(F.max("n").alias("n"), *(quartile(q) for q in (0.25, 0.5, 0.75)))
    of = lambda c, i: F.max(F.when(F.col("k") == i, c))
    mu = F.array(*[of(F.col("q50") * (STEP / UNIT), i) for i in range(P)]).alias("mu")
    sd = F.array(*[of((F.col("q75") - F.col("q25")) * (STEP / UNIT / 1.349), i) for i in range(P)]).alias("spread")
    found = cut_lineage(quartiles.groupBy(*_KEY).agg(F.max("n").alias("n"), mu, sd))
    # Correlations of bounded deviations, one more aggregation; their products lie within 1, in units of 2^-20.
    z = [(F.col(x) / UNIT - F.get("mu", i)) / (F.get("spread", i) + STEP / UNIT) for i, x in enumerate(X)]
    norm = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0])) + 1e-9
    unit = lambda v: F.sum(F.round(v * (1 << 20)).cast("bigint")).cast("double")
    bounded = [[F.tanh(c) for c in z], [c / norm for c in z]]
    sums = [unit(b[i] * b[j]).alias(f"b{k}_{i}{j}") for k, b in enumerate(bounded) for i, j in _PAIRS]
    sizes = group_sizes(found)
    met = _meet(rows, found.withColumn("start", F.lit(0)).withColumn("lower", F.col("spread")), sizes).withColumnRenamed("lower", "spread")
    both = met.groupBy(*_KEY).agg(F.first("mu").alias("mu"), F.first("spread").alias("spread"), F.count("*").alias("n"), *sums)

    def starts(batches):
        for g in batches:
            mu, sd = (np.stack(g[c].to_list()) if len(g) else np.zeros((0, P)) for c in ("mu", "spread"))
            scale = sd[:, :, None] * sd[:, None, :]
            yield _params(g, 0, mu, scale * np.eye(P))
            for k in range(STARTS - 1):
                c = _matrices(g, f"b{k}_")
                d = np.sqrt(np.maximum(np.einsum("nii->ni", c), 1.0))
                correlation = c / (d[:, :, None] * d[:, None, :])
                np.einsum("nii->ni", correlation)[:] = 1.0
                yield _params(g, k + 1, mu, scale * (0.999 * correlation + 0.001 * np.eye(P)))

    return cut_lineage(_packed(both, sum(sizes)).mapInPandas(starts, _PARAMS)), sizes


def group_sizes(params: DataFrame) -> list[int]:
    """How many groups each level has."""
    n = {r.level: r.n for r in params.groupBy("level").agg(F.count("*").alias("n")).collect()}
    return [n.get(level, 0) for level in range(len(LEVELS))]


def robust_estimates(rows: DataFrame) -> DataFrame:
    """level, lang, source, start, n, logdet, mu, cov, lower by MCD over rows of lang, source, w and the statistics,
    for groups of any size on all levels. n counts a group's rows."""
    rows = _joined_parts(rows.select("lang", "source", "w", *X))
    found, sizes = _started(rows)
    top = found.filter("level = 0").select("mu").first()
    if top is None:
        return found
    origin, every = np.round(np.array(top.mu) * UNIT), sum(sizes)
    for _ in range(2):
        found = _step(rows, found, sizes, origin)
    best = F.min_by(F.struct("start", "n", "logdet", "mu", "cov", "lower"), F.struct("logdet", "start")).alias("b")
    found = cut_lineage(_packed(found, STARTS * every).groupBy(*_KEY).agg(best).select(*_KEY, "b.*"))
    for _ in range(MOST_STEPS):
        now = _step(rows, found, sizes, origin)
        same = [now[c].eqNullSafe(found[c]) for c in _KEY]
        fell = _packed(found, every).join(_packed(now, every), same[0] & same[1] & same[2]).select(F.max(F.abs(found["logdet"] - now["logdet"]))).first()[0]
        found = now
        if fell is None or fell < CONVERGED:
            break
    return _step(rows, found, sizes, origin, final=True)


def estimates(rows: DataFrame, prior: int = 100) -> DataFrame:
    """lang, source, n, mu, lower of every group of language and source, drawn towards its language's and those
    towards all rows' estimate by `prior` rows."""
    found = robust_estimates(rows)
    level = lambda k: found.filter(F.col("level") == k).select(*[F.col(c).alias(f"{c}{k}") for c in ("lang", "source", "n", "mu", "cov")])
    by_language, every = level(1), level(0)
    joined = level(2).join(by_language, F.col("lang2").eqNullSafe(F.col("lang1"))).crossJoin(F.broadcast(every))  # one row

    def drawn(batches):
        for g in batches:
            stack = lambda c: np.stack(g[c].to_list()).reshape(len(g), *((P, P) if c[:3] == "cov" else (P,)))  # noqa: B023, E731
            if not len(g):
                continue
            mu, a = stack("mu0"), (g["n0"] / (g["n0"] + P + 1)).to_numpy()[:, None, None]
            cov = a * stack("cov0") + (1 - a) * np.eye(P) * WIDE**2
            for k in (1, 2):
                a = (g[f"n{k}"] / (g[f"n{k}"] + prior)).to_numpy()
                mu = a[:, None] * stack(f"mu{k}") + (1 - a)[:, None] * mu
                cov = a[:, None, None] * stack(f"cov{k}") + (1 - a)[:, None, None] * cov
            lower = _whitening(cov)
            out = g[["lang2", "source2", "n2"]].set_axis(["lang", "source", "n"], axis=1)
            out["mu"], out["lower"] = list(mu), list(np.stack([lower[:, i, j] for i, j in _LOWER], axis=1))
            yield out

    return joined.mapInPandas(drawn, "lang string, source string, n bigint, mu array<double>, lower array<double>")


def _tested(rows: DataFrame, good: DataFrame) -> DataFrame:
    """rows with the distance from the estimate of their group, which comes from the rows in good."""
    found = cut_lineage(estimates(good))
    p = small(found.select(F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), "mu", "lower"), found.count())
    met = rows.join(p, F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("source").eqNullSafe(F.col("p_source")), "left")
    return met.withColumn("distance", distance([F.col(x) for x in X], F.col("w"), F.col("mu"), F.col("lower")))


def verdicts(df: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source", level: float = 1e-6) -> DataFrame:
    """keep, the five counts, base_failed, distance and kept. level: the share of a normal distribution that the
    quantile leaves outside."""
    own = [f"k{i}" for i in range(len(keep))]
    named = df.select(*[F.col(quoted(k)).alias(o) for k, o in zip(keep, own)], F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(source)).cast("string").alias("source"), F.col(quoted(text)).alias("t"))
    rows = cut_lineage(with_features(with_counts(named, [*own, "lang", "source"], "t").withColumn("base_failed", base_failed())).drop(*MORE))
    out = _tested(rows, rows.filter(~F.col("base_failed")))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - level, P))
    return out.select(*[F.col(o).alias(k) for k, o in zip(keep, own)], *COUNTS, "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), F.coalesce(kept, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", level: float = 1e-6) -> DataFrame:
    """The documents that pass, with their own columns only. Texts are counted once: what passes the base rules is
    stored with its statistics, and only these are read for the estimates."""
    whole = docs.select(row_of(docs).alias("__row"), F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(source)).cast("string").alias("source"))
    rows = with_features(with_counts(whole, ["__row", "lang", "source"], "__row", docs.columns.index(text)).filter(~base_failed()))
    rows = stored(rows.select("__row", "lang", "source", "w", *X))
    return _tested(rows, rows).filter(F.col("distance") <= chi2_quantile(1 - level, P)).select("__row.*")
