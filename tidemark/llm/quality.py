"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Everything here is DataFrame functions. Statistics of a text are computed inside its row; only those few numbers are
shuffled, and only as partial sums of each group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import SPACE, words, written

#: Smallest scale (as a standard deviation) that a feature is given in any group, so that a feature which is nearly constant
#: over most of a group (no repeats, few capitals) does not make every other value an outlier.
FLOOR = {"f_length": 0.5, "f_word": 0.08, "f_marks": 0.05, "f_upper": 0.03, "f_repeats": 0.1}
FEATURES = list(FLOOR)
#: Words of ordinary prose (5.5 characters and 0.25 marks each, 3 % capitals) that every text is taken to have besides its own.
PRIOR = 20
#: Smallest group that is given estimates of its own; smaller ones take those of their language, then of all rows.
LEAST = 40
#: Most groups (of about 200 bytes each) whose estimates are broadcast.
GROUPS = 50_000
#: Distances are counted in bins of 1/BINS of a power of two, to find a group's h-th smallest exactly in counts.
BINS = 32


def text_stats(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text counts as none of each."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    out = docs.withColumn("_words", words(text))
    out = out.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hash")
    at = lambda i: F.get(F.col("_hash"), i)
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4))))
    out = out.withColumn("_windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    # Windows with their places, in order of their hash: one that equals a neighbour is repeated.
    ordered = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("_ordered", F.when(repeated, ordered))
    same = lambda i, j: F.get(F.col("_ordered"), i)["h"].eqNullSafe(F.get(F.col("_ordered"), j)["h"])
    places = F.array_sort(F.transform(F.filter("_ordered", lambda x, i: ((i > 0) & same(i, i - 1)) | same(i, i + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, start, lambda s, i: F.struct((s["n"] + i + 5 - F.greatest(i, s["end"])).alias("n"), (i + 5).alias("end")), lambda s: s["n"])
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_marks": F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_words", "_hash", "_windows", "_ordered", "_lines")


def transformed(stats: DataFrame) -> DataFrame:
    """The vector the method judges: log length, log mean word length, damped shares of marks and repeats, capitals.

    Every text is taken to have PRIOR words of ordinary prose besides its own, so that a short one is not judged by chance.
    """
    mean = lambda a, b, usual, k: (F.col(a) + usual * k) / (F.col(b) + k)
    return stats.withColumns(
        {
            "f_length": F.log1p(F.col("n_words").cast("double")),
            "f_word": F.log(mean("word_chars", "n_words", 5.5, PRIOR)),
            "f_marks": F.sqrt(mean("n_marks", "n_words", 0.25, PRIOR)),
            "f_upper": mean("n_upper", "word_chars", 0.03, 5.5 * PRIOR),
            "f_repeats": F.sqrt(F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))),
        }
    )


def _estimates(rows: DataFrame, group: list[str]) -> DataFrame:
    """Mean vector and floored covariance of each group, as columns m_i and c_i_j (i >= j)."""
    k = len(FEATURES)
    means = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)]
    covs = [F.coalesce(F.covar_pop(FEATURES[i], FEATURES[j]), F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(k) for j in range(i + 1)]
    made = rows.groupBy(*group).agg(F.count("*").alias("n"), *means, *covs)
    return made.withColumns({f"c_{i}_{i}": F.col(f"c_{i}_{i}") + F.lit(FLOOR[f] ** 2) for i, f in enumerate(FEATURES)})


def _triangle(made: DataFrame) -> DataFrame:
    """Adds l_i_j, the Cholesky factor of the covariance: positive definite, as the floor is on its diagonal."""
    for j in range(len(FEATURES)):
        square = reduce(lambda a, b: a + b, [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
        made = made.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - square, F.lit(1e-9))))
        below = {}
        for i in range(j + 1, len(FEATURES)):
            dot = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            below[f"l_{i}_{j}"] = (F.col(f"c_{i}_{j}") - dot) / F.col(f"l_{j}_{j}")
        made = made.withColumns(below) if below else made
    return made


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i, f in enumerate(FEATURES):
        dot = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)], F.lit(0.0))
        rows = rows.withColumn(f"z_{i}", (F.col(f) - F.col(f"m_{i}") - dot) / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(FEATURES))]))


def _cut(rows: DataFrame, group: list[str], share: float) -> DataFrame:
    """Each group's bin of d2 below which at least `share` of its rows lie, counted exactly, and that bin's upper edge."""
    bin_ = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS)
    # A few hundred bins a group, finished before they are dealt by group: else the partial counts of all tasks would be.
    counts = written(rows.groupBy(*group, bin_.alias("bin")).agg(F.count("*").alias("k")), "bins")
    w = W.partitionBy(*group).orderBy("bin")
    total = F.sum("k").over(W.partitionBy(*group))
    counts = counts.withColumn("upto", F.sum("k").over(w)).withColumn("total", total).where(F.col("upto") >= share * F.col("total"))
    return counts.groupBy(*group).agg(F.pow(F.lit(2.0), (F.min("bin") + 1) / BINS).alias("cut"))


def _by_group(rows: DataFrame, made: DataFrame, group: list[str]) -> DataFrame:
    """Rows with their group's row of a written table: broadcast if it has at most GROUPS rows, which are counted, else joined by key."""
    return rows.join(F.broadcast(made) if made.limit(GROUPS + 1).count() <= GROUPS else made, group)


def _spread(rows: DataFrame, group: list[str]) -> DataFrame:
    """Each group's medians as means, and its squared median deviations, floored, as a diagonal covariance: outliers hardly move them."""
    middle = lambda c: F.percentile_approx(c, 0.5, 4_000)
    medians = written(rows.groupBy(*group).agg(*(middle(f).alias(f"m_{i}") for i, f in enumerate(FEATURES))), "medians")
    off = [middle(F.abs(F.col(f) - F.col(f"m_{i}"))).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    spread = _by_group(rows, medians, group).groupBy(*group).agg(F.count("*").alias("n"), *off)
    k = range(len(FEATURES))
    covs = [(F.pow(1.4826 * F.col(f"s_{i}"), 2) + FLOOR[FEATURES[i]] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in k for j in range(i + 1)]
    return spread.join(medians, group).select(*group, "n", *(f"m_{i}" for i in k), *covs)


def robust_distance(rows: DataFrame, group: list[str], share: float = 0.75, steps: int = 3) -> DataFrame:
    """Adds d2: the squared Mahalanobis distance by minimum-covariance-determinant estimates of the row's group.

    Two starts: the group's mean and covariance, and its medians with their deviations, which a cluster of outliers does not hide
    from. Concentration steps from each: keep the `share` of the group's rows with the least distances and estimate again
    (the determinant never grows), `steps` times; the start that ends with the lesser determinant counts. Distances are
    rescaled so that the groups' cut agrees with the chi-square law. Group columns must not be null. Rows are never gathered by
    group: each step joins the groups' small table of estimates, so rows of a hot group stay where they are.
    """
    own = [*group, "_start"]
    both = rows.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = both
    for step in range(steps + 1):
        if step:
            made = _estimates(kept, own)
        else:
            made = _estimates(rows, group).withColumn("_start", F.lit(0)).unionByName(_spread(rows, group).withColumn("_start", F.lit(1)))
        made = written(_triangle(made), "estimates")
        far = _distance(_by_group(both, made.drop("n"), own))
        cuts = written(_cut(far, own, share), "cuts")
        if step < steps:
            kept = _by_group(far, cuts, own).where(F.col("d2") <= F.col("cut")).select(*both.columns)
    size = reduce(lambda a, b: a + b, [F.log(F.col(f"l_{i}_{i}")) for i in range(len(FEATURES))])
    best = made.withColumn("_size", size).groupBy(*group).agg(F.min(F.struct("_size", "_start"))["_start"].alias("_start"))
    final = written(made.join(best, own).join(cuts, own).drop("_start", "n"), "final")
    scale = F.lit(CHI2_75) / F.greatest("cut", F.lit(CHI2_75))
    return _distance(_by_group(rows, final, group)).withColumn("d2", F.col("d2") * scale).select(*rows.columns, "d2")


#: 0.75 quantile of the chi-square law with five degrees of freedom.
CHI2_75 = 6.6257
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: float = 30.0) -> DataFrame:
    """Base counts and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2, text_hash.

    A row fails the base rules with fewer than 10 words, or with over a fifth of its words in 5-word windows that its text repeats.
    The rest are judged against estimates of their (lang, source), or of their lang where that pair has fewer than LEAST
    rows that pass the base rules, or of all rows where the lang has fewer too; each is estimated from every row that passes at its
    level, small pairs and large. A squared distance over `limit`, far beyond what the chi-square law gives ordinary rows, rejects. Null lang or source (or no such column) is a group of its own; null text is empty and fails;
    repeated rows are judged alike; an empty table gives an empty result. Texts are read once and whole.
    """
    cols = {c.lower() for c in docs.columns}
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c in cols else F.lit("\0")
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), part("lang").alias("_lang"), part("source").alias("_source"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    slim = slim.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    stats = transformed(text_stats(slim)).drop("text").withColumn("base_failed", failed)
    stats = written(stats, "stats")
    passed = stats.where(~F.col("base_failed"))
    sizes = written(passed.groupBy("_lang", "_source").agg(F.count("*").alias("n")), "sizes")
    langs = written(sizes.groupBy("_lang").agg(F.sum("n").alias("by_lang"), F.min("n").alias("smallest")), "langs")
    pair, lang, every = F.concat_ws("\1", F.lit("pair"), "_lang", "_source"), F.concat_ws("\1", F.lit("lang"), "_lang"), F.lit("all")
    own = F.when(F.col("n") >= LEAST, pair).when(F.col("by_lang") >= LEAST, lang).otherwise(every)
    # A row counts for each level that some row reads, and is judged by the first that is large enough.
    counts_for = [F.when(F.col("n") >= LEAST, pair), F.when((F.col("by_lang") >= LEAST) & (F.col("smallest") < LEAST), lang)]
    counts_for += [every] if langs.where(F.col("by_lang") < LEAST).take(1) else []
    levels = _by_group(sizes, langs, ["_lang"]).select("_lang", "_source", own.alias("_own"), F.array_compact(F.array(*counts_for)).alias("_groups"))
    groups = written(levels, "groups")
    rows = written(_by_group(passed, groups, ["_lang", "_source"]).withColumn("_group", F.explode("_groups")).drop("_groups"), "features")
    judged = robust_distance(rows, ["_group"]).where("_group = _own").withColumn("kept", F.col("d2") <= limit).drop("_group", "_own")
    failing = stats.where("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return judged.unionByName(failing).select("doc_id", *COUNTS, "base_failed", "kept", "d2", "text_hash")
