"""Operator 9, quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Each document becomes a vector of transformed statistics. For every (lang, source), and for all documents together, the
minimum covariance determinant estimate is found from several starts: from each, keep the half of the documents with the
smallest distances, estimate mean and covariance from it, and repeat until the determinant falls no more, however many steps
that takes; the start that ends with the least determinant gives the estimate. All groups and starts go through a step
together. The starts are fixed, so results are too: the medians with the floors as deviations, the medians with the median
absolute deviations, and the means and covariances of the documents on either side of the median length, and of those with the
fewer repeats. A document is rejected when its Mahalanobis distance under the estimate of its group is beyond ``cutoff``.

The vectors of all documents are summed once into cells of CELL a side, with their numbers, sums and products; the steps run on
cells, each as far away as its mean, so their cost follows the number of cells, not of documents. A cell is kept or left whole,
and so are bins of equal distances. What this is and is not: variances have the squares of FLOOR added, as most texts have no
symbols and no repeats; the estimate is that of the half, without a consistency factor and without reweighting, so distances
are larger than chi-square would have them, and the cutoff is set for that.

Edge cases: a null or empty text has no words and fails the base rule; null lang or source are groups of their own;
repeated rows are judged alike; an empty table gives an empty result; further columns are ignored; groups of fewer than
``min_group`` usable documents borrow the estimate of all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, dropped, small_side, written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
FEATURES = ("len_words", "word_len", "symbol_rate", "line_rate", "repeat_rate")
#: Least standard deviations: most texts have no symbols and no repeats, so the estimate of a half is flat there; the base rule already bounds repeats.
FLOOR = (0.5, 0.08, 0.25, 0.4, 0.6)
#: Square of the distance beyond which a document is rejected: far in the tail of chi-square with 5 degrees of freedom (1e-8).
CUTOFF = 46.0
N_STARTS = 5
#: What a fall of the logarithm of a determinant must be beyond the noise of sums.
NOISE = 1e-9
MIN_GROUP = 50
#: Sides of a cell of vectors.
CELL = (0.1, 0.02, 0.1, 0.1, 0.1)
#: So many estimates, with some hundred bins each, go to a task.
TASK_ESTIMATES = 50
#: Distances are binned by this step of their logarithm; the sums of a bin go together.
BIN = 0.02


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every ``_text``, beside the columns ``keep``."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    words = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words"))
    n = F.size("_words")
    gram = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    grams = words.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), gram)).otherwise(F.array().cast("array<long>")).alias("_grams"),
    )
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    placed = grams.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("_sorted"),
    )
    beside = lambda x, k: F.coalesce(F.get("_sorted", k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["g"] == x["g"], F.lit(False))
    starts = placed.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", beside), lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    out = starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistic_vector() -> list[Column]:
    """The transformed statistics, in the order of FEATURES."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / n),
        F.log1p(100.0 * F.col("n_symbols") / chars),
        F.log1p(100.0 * F.col("n_dup_lines") / n),
        F.log1p(100.0 * F.col("n_repeat_words") / n),
    ]


def _covariances(sums: DataFrame, by: list[str]) -> DataFrame:
    """Means and the lower triangle of the covariance of each group, with the floors of the variances added; sums: by, k, t0.."""
    d = range(len(FEATURES))
    pairs = [(i, j) for i in d for j in range(i + 1)]
    cov = [f"t{at} / k - (t{i} / k) * (t{j} / k)" for at, (i, j) in enumerate(pairs, len(FEATURES))]
    lower = [(f"greatest({c}, 0D) + {FLOOR[i] ** 2!r}D" if i == j else c) + f" AS c{i}{j}" for c, (i, j) in zip(cov, pairs, strict=True)]
    return sums.selectExpr(*by, *[f"t{i} / k AS m{i}" for i in d], *lower)


def _factored(moments: DataFrame, by: list[str]) -> DataFrame:
    """The Cholesky factor of every group's covariance, a column for each entry, and the logarithm of its determinant."""
    d, lower = range(len(FEATURES)), []
    for i in d:
        for j in range(i + 1):
            rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            lower.append(f"sqrt(greatest({rest}, {FLOOR[i] ** 2 / 4!r}D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return moments.selectExpr(*by, *[f"m{i}" for i in d], *lower, " + ".join(f"2 * ln(l{i}{i})" for i in d) + " AS logdet")


def _distances(rows: DataFrame) -> DataFrame:
    """rows with ``distance``, the squared Mahalanobis distance of x under m and l, by forward substitution.

    Each z is a column that the next ones name: written out, the expression doubles with every statistic.
    """
    d = range(len(FEATURES))
    solved = [f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} AS z{i}" for i in d]
    return rows.selectExpr("*", *solved, " + ".join(f"z{i} * z{i}" for i in d) + " AS distance").drop(*[f"z{i}" for i in d])


def _joined(rows: DataFrame, estimates: DataFrame, by: list[str], small: bool, how: str = "left") -> DataFrame:
    """rows with the estimates of their group; null keys match null keys. ``small`` tells that the estimates were found to be few."""
    renamed = estimates.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in estimates.columns if c not in by])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    return rows.join(F.broadcast(renamed) if small else renamed, on, how).drop(*[f"_{k}" for k in by])


def _held(estimates: DataFrame, name: str, tasks: int) -> DataFrame:
    """The estimates, computed once: if they were found to be few, by so many tasks into rows of the driver's, else as a written table."""
    return estimates.sparkSession.createDataFrame(estimates.coalesce(tasks).toArrow(), estimates.schema) if tasks else written(estimates, name)


def _products() -> list[str]:
    d = range(len(FEATURES))
    return [f"x{i}" for i in d] + [f"x{i} * x{j}" for i in d for j in range(i + 1)]


def cells_of(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, g0.., k, t0..): how many vectors each cell of a group holds, and the sums of their values and products."""
    corner = [F.floor(F.col(f"x{i}") / CELL[i]).cast("int").alias(f"g{i}") for i in range(len(FEATURES))]
    return vectors.groupBy(*by, *corner).agg(F.count(F.lit(1)).alias("k"), *[F.expr(f"sum({x}) AS {t}") for t, x in zip(_sums(), _products(), strict=True)])


def _sums() -> list[str]:
    return [f"t{k}" for k in range(len(_products()))]


def _added() -> list[Column]:
    return [F.expr(f"sum({t}) AS {t}") for t in ("k", *_sums())]


def _concentrated(cells: DataFrame, now: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """One concentration step of every start: the estimate from the half of its group with the smallest distances.

    Sums are kept for each bin of the distance; the half ends with the bin that completes it. A group has a few thousand bins
    at most, so the bins of few estimates need few tasks, however many partitions a shuffle has.
    """
    keys = [*by, "_start"]
    rows = _distances(_joined(cells, now.drop("logdet"), by, bool(tasks), "inner"))
    binned = rows.groupBy(*keys, F.floor(F.log(F.col("distance") + 1e-9) / BIN).cast("int").alias("_bin")).agg(*_added())
    binned = binned.coalesce(tasks) if tasks else binned
    so_far, whole = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    near = binned.withColumns({"_before": F.coalesce(F.sum("k").over(so_far), F.lit(0)), "_all": F.sum("k").over(whole)}).filter(2 * F.col("_before") < F.col("_all"))
    return _factored(_covariances(near.groupBy(*keys).agg(*_added()), keys), keys)


def _starts(cells: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """(by, _start, m, l): the estimates that the steps begin with; medians are those of the cells' middles."""
    d = range(len(FEATURES))
    at = lambda i: (F.col(f"g{i}") + 0.5) * CELL[i]
    middle = _held(cells.groupBy(*by).agg(*[F.percentile(at(i), 0.5, F.col("k")).alias(f"m{i}") for i in d]), "medians", tasks)
    off = _joined(cells, middle, by, bool(tasks))
    spread = off.groupBy(*by).agg(*[F.percentile(F.round(F.abs(at(i) - F.col(f"m{i}")), 4), 0.5, F.col("k")).alias(f"s{i}") for i in d])
    lower = lambda of: [(of(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in d for j in range(i + 1)]
    means = [f"m{i}" for i in d]
    plain = middle.select(*by, F.lit(0).alias("_start"), *means, *lower(lambda i: F.lit(FLOOR[i])))
    wide = _joined(middle, spread, by, False).select(*by, F.lit(1).alias("_start"), *means, *lower(lambda i: F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + FLOOR[i] ** 2)))
    sides = F.array(F.when(F.col("x0") <= F.col("m0"), 2).otherwise(3), F.when(F.col("x4") <= F.col("m4"), 4))
    sided = off.select(*by, F.explode(sides).alias("_start"), "k", *_sums()).filter("_start is not null")
    keys = [*by, "_start"]
    out = plain.unionByName(wide).unionByName(_factored(_covariances(sided.groupBy(*keys).agg(*_added()), keys), keys).drop("logdet")).withColumn("logdet", F.lit(float("inf")))
    out = _held(out, "mcd", tasks)
    if not tasks:
        dropped(middle)
    return out


def mcd_estimates(cells: DataFrame, by: list[str]) -> DataFrame:
    """The minimum covariance determinant estimate of each group of cells: mean and Cholesky factor.

    A start rests when two steps no longer lower its determinant, with the estimate before them. Few estimates, those that a
    broadcast may hold, stay with the driver between steps: a table each would cost several jobs more; many go by two steps to
    a table. The tasks of a step on few estimates follow their number: the driver keeps an account of every task.
    """
    keys = [*by, "_start"]
    n = cells.select(*by).distinct().count() * N_STARTS
    tasks = n // TASK_ESTIMATES + 1 if n <= BROADCAST_ROWS // 4 else 0  # 25 doubles a row; 0: many
    cells = cells.withColumns({f"x{i}": F.col(f"t{i}") / F.col("k") for i in range(len(FEATURES))})
    now = _starts(cells, by, tasks)
    used, settled, names = [now], None, now.columns
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    while True:
        before = now.select(*[F.col(c).alias(f"_{c}") for c in names])
        once = _concentrated(cells, now, by, tasks)
        twice = _concentrated(cells, _held(once, "mcd", tasks) if tasks else once, by, tasks)
        new = _held(twice.join(F.broadcast(before) if tasks else before, on), "mcd", tasks)
        used.append(new)
        falls = F.col("_logdet") - F.col("logdet") > NOISE
        rested = new.filter(~falls).select(*[F.col(f"_{c}").alias(c) for c in names] if len(used) > 2 else names)
        settled = rested if settled is None else settled.unionByName(rested)
        now = new.filter(falls).select(*names)
        if now.isEmpty():
            break
    first = F.row_number().over(Window.partitionBy(*by).orderBy("logdet", "_start"))
    least = _held(settled.withColumn("_n", first).filter("_n = 1").drop("_n", "_start", "logdet"), "mcd-least", tasks)
    if not tasks:
        dropped(*used)
    return least


def quality_verdicts(docs: DataFrame, *keep: str, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Base statistics, the squared robust distance and the verdict of every row, beside the columns ``keep``.

    docs: text, lang, source. The vectors are written once; the estimates are made from those that pass the base rule.
    ``keep`` travels as one struct, so that its names can't clash with those used here.
    """
    by = ["_lang", "_source"]
    row = F.struct(*[F.col(k) for k in keep]).alias("_row")
    own = docs.select(row, F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    stats = base_statistics(own, "_row", *by)
    stats = written(stats.select("*", *[x.alias(f"x{i}") for i, x in enumerate(statistic_vector())]), "quality")
    vectors = stats.filter(~F.col("base_failed")).select(*by, *[f"x{i}" for i in range(len(FEATURES))])
    cells = written(cells_of(vectors, by), "cells")
    corner = [f"g{i}" for i in range(len(FEATURES))]
    sizes = cells.groupBy(*by).agg(F.sum("k").alias("n_group")).filter(F.col("n_group") >= min_group).drop("n_group")
    own = _joined(cells, small_side(sizes), by, False, "inner").withColumn("_whole", F.lit(False))
    # every row counts for all documents together, and for its group if that is large enough
    none = [F.lit(None).cast(vectors.schema[k].dataType).alias(k) for k in by]
    everything = cells.groupBy(*corner).agg(*_added()).select(*none, *corner, "k", *_sums(), F.lit(True).alias("_whole"))
    judged_by = written(own.unionByName(everything), "cells")
    found = mcd_estimates(judged_by, ["_whole", *by])
    dropped(cells, judged_by)
    names = [c for c in found.columns if c not in ("_whole", *by)]
    everywhere = found.filter("_whole").first() or dict.fromkeys(names)
    both = _joined(stats, small_side(found.filter("not _whole").drop("_whole"), row_bytes=256), by, False).withColumns({c: F.coalesce(F.col(c), F.lit(everywhere[c]).cast("double")) for c in names})
    judged = _distances(both)
    return judged.select(
        "_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "distance",
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules accept, with their columns."""
    whole = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_doc"))
    return quality_verdicts(whole, "_doc").filter("kept").select("_doc.*")
