"""Quality rules as robust multivariate outliers, in DataFrame functions only.

Each text gives five statistics, transformed to be roughly normal: the logarithm of its words, the
logarithm of their mean length, and the arcsine roots of the shares of symbols, repeated lines and
repeated words. For the documents of a language and source, the minimum covariance determinant
looks for the three quarters of them whose covariance is smallest: from a start by coordinate
medians and quartiles, concentration steps take the rows nearest to the centre and estimate centre
and covariance anew. A document is rejected if its squared Mahalanobis distance from that estimate
is beyond what one normal document in ten thousand reaches.

Everything per group is a partially aggregated sum, a histogram of bounded size, or one row, so a
group may hold any share of the documents. Groups below ``MIN_ROWS`` documents are pooled by
language, then altogether.

Defined results: null and empty texts, and texts without words, fail the base rule; documents that
fail it take no part in the estimates and have no distance; a pool that stays below ``MIN_ROWS``
rejects nothing; null languages and sources are values of their own; repeated rows and null ids are
judged like any other row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.llm.common import settle, small_join, whole_text
from ticketlake.llm.order_minhash import _left, _right, words_of

MIN_ROWS = 200
#: The share of a group that the determinant is minimised over.
SUBSET = 0.75
#: Covariance of the nearest three quarters of a 5-variate normal, to that of all: 0.75 / P(X7 <= q)
#: with X5's quantile q = 6.626 of 0.75 (X: chi-squared).
CONSISTENCY = 1.41
STEPS = 3
#: Chi-squared quantile of 5 degrees of freedom at 1 - 1e-4.
CUTOFF = 25.74
#: Standard deviations below which a statistic's spread within a group isn't taken at its word:
#: shares that are zero nearly everywhere would else make any other value an outlier. Their squares
#: are added to the variances.
FLOORS = (0.3, 0.08, 0.06, 0.2, 0.15)
DIMENSIONS = len(FLOORS)
_X = [f"x{k}" for k in range(DIMENSIONS)]


def _any() -> Column:
    """What the rows of a group are spread by where they meet a row about their group."""
    return F.struct(*_X)


def with_statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that matter and each text's statistics.

    Words in repeated three-word windows are found by one sort: window hashes carry their positions
    in the low bits, so equal windows become neighbours, and neighbours are compared word by word.
    """
    text = whole_text()
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    size = F.col("n_words").cast("int")
    base = (
        docs.select(
            F.col("doc_id").cast("long"),
            F.coalesce(F.col("lang"), F.lit("")).alias("language"),
            F.coalesce(F.col("source"), F.lit("")).alias("source"),
            text.alias("_text"),
        )
        .withColumns({"_w": words_of(F.col("_text")), "_lines": lines})
        .withColumns(
            {
                "n_words": F.size("_w").cast("long"),
                "word_chars": F.length(F.array_join("_w", "")).cast("long"),
                "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            }
        )
        .drop("_text", "_lines")
        .withColumn("_b", F.length(F.bin("n_words")))
    )
    bits = F.col("_b")

    def word(i) -> Column:
        return F.coalesce(F.get("_w", i), F.lit(""))

    windows = F.when(size < 3, F.array().cast("array<bigint>")).otherwise(
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), size - 3),
                lambda i: _left(F.xxhash64(word(i), word(i + 1), word(i + 2)), bits) + i,
            )
        )
    )
    mask = _left(F.lit(1).cast("long"), bits) - 1

    def place(x) -> Column:
        return x.bitwiseAND(mask).cast("int")

    def same(x, y) -> Column:
        p, q = place(x), place(y)
        equal = _right(x, bits) == _right(y, bits)
        for j in range(3):
            equal = equal & (word(p + j) == word(q + j))
        return F.coalesce(equal, F.lit(False))

    repeated = F.filter(
        "_s", lambda x, i: same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1))
    )
    # Neighbouring windows share words; each counts the words that the next one doesn't.
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    counted = (
        base.withColumn("_s", windows)
        .withColumn("_p", F.sort_array(F.transform(repeated, place)))
        .withColumn("n_repeat_words", covered)
        .drop("_w", "_b", "_s", "_p")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _share(part: str, whole: str) -> Column:
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))


def with_vector(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics ``x0`` .. ``x4``."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    vector = (
        F.log1p(F.col("n_words")),
        F.log(F.greatest(F.col("word_chars") / words, F.lit(0.5))),
        _share("n_symbols", "word_chars"),
        _share("n_dup_lines", "n_lines"),
        _share("n_repeat_words", "n_words"),
    )
    return df.withColumns(dict(zip(_X, vector, strict=True)))


def with_group(df: DataFrame) -> DataFrame:
    """Adds ``grp``: language and source, or the pool of their small groups; null for a small pool."""
    judged = df.filter(~F.col("base_failed"))
    groups = judged.groupBy("language", "source").count()
    left = F.sum(F.when(F.col("count") < MIN_ROWS, F.col("count")))
    by_language = left.over(Window.partitionBy("language"))
    named = (
        groups.withColumn("_language_rows", by_language)
        .withColumn("_own", F.col("count") >= MIN_ROWS)
        .withColumn("_pooled", ~F.col("_own") & (F.col("_language_rows") >= MIN_ROWS))
    )
    apart = F.sum(F.when(~F.col("_own") & ~F.col("_pooled"), F.col("count")))
    rest = named.agg(F.coalesce(apart, F.lit(0))).scalar()
    label = (
        F.when(F.col("_own"), F.to_json(F.array("language", "source")))
        .when(F.col("_pooled"), F.to_json(F.array("language")))
        .when(rest >= MIN_ROWS, F.lit("[]"))
    )
    labels = named.select("language", "source", label.alias("grp"))
    return small_join(df, labels, ["language", "source"], _any(), "left")


def _quantile_bins(rows: DataFrame, keys: list[str], bin_name: str, shares: dict[str, float]) -> DataFrame:
    """Bins at which the counts of a histogram reach the given shares, by key."""
    counts = rows.groupBy(*keys, bin_name).count()
    along = Window.partitionBy(*keys).orderBy(bin_name)
    whole = Window.partitionBy(*keys)
    summed = counts.withColumn("_upto", F.sum("count").over(along)).withColumn("_all", F.sum("count").over(whole))
    reached = [
        F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col(bin_name))).alias(name)
        for name, share in shares.items()
    ]
    return summed.groupBy(*keys).agg(*reached)


def _start(rows: DataFrame) -> DataFrame:
    """Centre and diagonal factor of each group by medians and quartiles, from fine histograms."""
    width = 0.01
    each = rows.select("grp", F.posexplode(F.array(*[F.floor(F.col(x) / width) for x in _X])).alias("k", "bin"))
    quartiles = _quantile_bins(each, ["grp", "k"], "bin", {"low": 0.25, "middle": 0.5, "high": 0.75})
    by_k = [F.col("k") == k for k in range(DIMENSIONS)]
    centre = [F.max(F.when(at, (F.col("middle") + 0.5) * width)).alias(f"m{k}") for k, at in enumerate(by_k)]
    spread = [
        F.greatest(F.max(F.when(at, (F.col("high") - F.col("low")) * width / 1.349)), F.lit(FLOORS[k])).alias(f"l{k}_{k}")
        for k, at in enumerate(by_k)
    ]
    zeros = [F.lit(0.0).alias(f"l{i}_{j}") for i in range(DIMENSIONS) for j in range(i)]
    return quartiles.groupBy("grp").agg(*centre, *spread).select("*", *zeros)


def _cholesky(moments: DataFrame) -> DataFrame:
    """Centre ``m*`` and lower Cholesky factor ``l*_*`` of each group's moments."""
    centred = moments.select("grp", *[(F.col(f"s{k}") / F.col("n")).alias(f"m{k}") for k in range(DIMENSIONS)], "n", *[
        f"s{i}_{j}" for i in range(DIMENSIONS) for j in range(i + 1)
    ])
    out = centred
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            covariance = (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
            if i == j:
                covariance = F.greatest(covariance, F.lit(0.0)) + F.lit(FLOORS[i] ** 2)
            before = [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)]
            rest = reduce(lambda a, b: a - b, before, covariance)
            entry = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}")
            out = out.withColumn(f"l{i}_{j}", entry)
    return out.select("grp", *[f"m{k}" for k in range(DIMENSIONS)], *[f"l{i}_{j}" for i in range(DIMENSIONS) for j in range(i + 1)])


def _with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    out = small_join(rows, estimate, ["grp"], _any(), "left")
    for i in range(DIMENSIONS):
        rest = reduce(
            lambda a, b: a - b,
            [F.col(f"l{i}_{j}") * F.col(f"_z{j}") for j in range(i)],
            F.col(f"x{i}") - F.col(f"m{i}"),
        )
        out = out.withColumn(f"_z{i}", rest / F.col(f"l{i}_{i}"))
    squared = reduce(lambda a, b: a + b, [F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(DIMENSIONS)])
    return out.withColumn("d2", squared).select(*rows.columns, "d2")


def estimate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre and Cholesky factor by group: the start and ``steps`` concentration steps."""
    found = settle(_start(rows), small=True)
    products = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
    for _ in range(steps):
        near = _with_distance(rows, found).withColumn(
            "bin", F.floor(F.log(F.greatest("d2", F.lit(1e-9))) / 0.02)
        )
        limits = _quantile_bins(near, ["grp"], "bin", {"limit": SUBSET})
        nearest = small_join(near, limits, ["grp"], _any()).filter("bin <= limit")
        moments = nearest.groupBy("grp").agg(
            F.count("*").alias("n"),
            *[F.sum(x).alias(f"s{k}") for k, x in enumerate(_X)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in products],
        )
        found = settle(_cholesky(moments), small=True)
    return found


def judge_documents(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance)`` of every row."""
    measured = settle(with_vector(with_statistics(docs)))
    grouped = with_group(measured)
    rows = grouped.filter(~F.col("base_failed") & F.col("grp").isNotNull()).select("grp", *_X)
    found = estimate(rows, steps)
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return _with_distance(grouped, found).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))).alias("kept"),
        distance.alias("distance"),
    )
