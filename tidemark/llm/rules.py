"""Quality rules: base rules, then robust multivariate outliers (DataFrame functions only).

Each text gives a vector of transformed statistics. Per language and source a
minimum-covariance-determinant estimate is made: from each of four starts (the
coordinatewise median and quartiles, and the moments of all rows) concentration
steps (mean and covariance of the 75 % of rows with the smallest Mahalanobis
distance) run until the determinant settles, and of the four results the one
with the least determinant is taken. Rows farther than
``cutoff`` (squared distance; 20.5 is the 0.999 quantile of chi-square with five
degrees of freedom) from their group's estimate are rejected. Centre and
covariance of a group of n usable rows are drawn towards those of all rows
together, as if ``prior`` of those stood among its own: one rule for any size.

Order statistics come from counts in fixed fine bins, so that a group with a
third of all rows needs no single task. The square of a floor is added to each
variance, so that a statistic that never varies in a group rejects nobody by a
hair; by itself it still rejects at 4.5 floors from the mean: over 2 % symbols
or 30 % repeated lines or words where the group has none.

Null and empty texts have no words: all counts 0, base_failed, not kept.
Repeated rows are judged alike. Other columns stay out of the result. An empty
table gives no rows. Null languages and sources are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, words_col

STATS = ("s_words", "s_length", "s_symbols", "s_lines", "s_repeats")
#: Least standard deviation of each statistic.
FLOORS = (0.35, 0.10, 0.03, 0.12, 0.12)
#: Scale of the covariance of the nearest 75 % of 5-variate normal rows: 0.75 / P(chi2 with 7 df <= 6.626).
CONSISTENCY = 1.41
_P = len(STATS)
_POS = 26
_POS_MASK = (1 << _POS) - 1


def base_stats(docs: DataFrame, most_places: int = _POS_MASK) -> DataFrame:
    """doc_id, lang, source and the contract's counts for every row; texts of more than most_places words sort their windows as strings."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = text
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        blanks = F.replace(blanks, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select("doc_id", "lang", "source", words_col(F.col("text")).alias("w"), F.length(blanks).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    # 3-word windows as sorted (hash, position); equal neighbours are compared word by word
    gram = lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)), _POS), _POS).bitwiseOR(i.cast("long"))
    b = a.select(
        "doc_id", "lang", "source", "w", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.when(F.size("w") >= 3, F.transform(F.slice("w", 1, F.size("w") - 2), gram)).otherwise(F.array().cast("array<long>"))).alias("g"),
    )
    at = lambda v: v.bitwiseAND(_POS_MASK).cast("int")

    def same(u: Column, v: Column) -> Column:
        same_word = [F.get("w", at(u) + k) == F.get("w", at(v) + k) for k in range(3)]
        return (F.shiftright(u, _POS) == F.shiftright(v, _POS)) & same_word[0] & same_word[1] & same_word[2]

    # a clash of different windows can part equal ones, and places beyond the mask do not fit: such texts sort the windows themselves
    clash = F.exists(F.transform("g", lambda v, j: F.coalesce((F.shiftright(F.get("g", j - 1), _POS) == F.shiftright(v, _POS)) & ~same(F.get("g", j - 1), v), F.lit(False))), lambda x: x)
    twice = F.transform(F.filter("g", lambda v, j: F.coalesce(same(F.get("g", j - 1), v), F.lit(False)) | F.coalesce(same(v, F.get("g", j + 1)), F.lit(False))), at)
    window = lambda x, i: F.struct(F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)).alias("text"), i.alias("at"))
    c = b.select("doc_id", "lang", "source", "w", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", F.when(~(clash | (F.col("n_words") > most_places)), twice).alias("p"))
    windows = F.when(F.col("p").isNull(), F.sort_array(F.transform(F.slice("w", 1, F.size("w") - 2), window)))
    c = c.select("doc_id", "lang", "source", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "p", windows.alias("x"))
    equal = lambda v, j: F.coalesce(F.get("x", j)["text"] == v["text"], F.lit(False))
    exact = F.transform(F.filter("x", lambda v, j: equal(v, j - 1) | equal(v, j + 1)), lambda v: v["at"])
    c = c.withColumn("p", F.sort_array(F.coalesce("p", exact)))
    covered = F.aggregate(F.transform("p", lambda v, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), v - F.get("p", j - 1)))), F.lit(0), lambda s, x: s + x)
    d = c.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics: logarithms of sizes, square roots of shares."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.withColumns({
        "s_words": F.log(n + 1.0),
        "s_length": F.log(chars / n),
        "s_symbols": F.sqrt(F.col("n_symbols") / chars),
        "s_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "s_repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


def _bin_quantile(rows: DataFrame, by: list[str], value: Column, share: float, step: float) -> DataFrame:
    """by, q: the middle of the first bin of width step up to which a share of the rows lies."""
    counts = rows.groupBy(*by, F.floor(value / step).alias("_bin")).agg(F.count("*").alias("_n"))
    packed = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_bin", "_n"))).alias("_bins"), F.sum("_n").alias("_all"))
    first = F.aggregate(
        "_bins",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
        lambda s, x: F.struct((s["seen"] + x["_n"]).alias("seen"), F.when(s["bin"].isNotNull(), s["bin"]).when(s["seen"] + x["_n"] >= F.lit(share) * F.col("_all"), x["_bin"]).alias("bin")),
    )
    return packed.select(*by, ((first["bin"] + 0.5) * step).alias("q"))


def _estimates(rows: DataFrame) -> DataFrame:
    """grp, mean m0.. and the Cholesky factor l00.. of the covariance, the square of its floor added to each variance."""
    moments = [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)]
    moments += [F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in range(_P) for j in range(i + 1)]
    out = rows.groupBy("grp").agg(*moments)
    for i in range(_P):
        for j in range(i + 1):
            cov = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)
            rest = cov
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    volume = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, _P)), F.log(F.col("l00")))
    return out.select("grp", *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i in range(_P) for j in range(i + 1)], volume.alias("volume"))


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    z: list[Column] = []
    for i, s in enumerate(STATS):
        v = F.col(s) - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


#: Up to so many groups (21 doubles each) their table is broadcast; beyond it both sides are shuffled.
MOST_BROADCAST = 5000


def attach(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their group (grp). groups is a written table, so its size is known."""
    return rows.join(F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups.hint("merge"), "grp", how)


def _starts(stats: DataFrame) -> DataFrame:
    """(grp, start, m.., l..): the quartiles of each coordinate with the floors as spread, and the mean and covariance of all rows."""
    long = stats.select("grp", F.posexplode(F.array(*STATS)).alias("dim", "x"))
    diagonal = {f"l{i}{j}": F.lit(FLOORS[i] if i == j else 0.0) for i in range(_P) for j in range(i + 1)}
    out = _estimates(stats).withColumn("start", F.lit(0)).drop("volume")
    for k, share in enumerate((0.5, 0.25, 0.75), 1):
        at = _bin_quantile(long, ["grp", "dim"], F.col("x"), share, 0.01).groupBy("grp").agg(*[F.max(F.when(F.col("dim") == i, F.col("q"))).alias(f"m{i}") for i in range(_P)])
        out = out.unionByName(at.withColumns(diagonal).withColumn("start", F.lit(k)))
    return out


def robust_groups(stats: DataFrame, most_steps: int = 12, share: float = 0.75, settled: float = 0.01) -> DataFrame:
    """Minimum-covariance-determinant estimates (grp, m.., l.., volume) of the groups of rows (grp, statistics).

    From each start concentration steps run until the logarithm of the determinant's root (``volume``) falls by less than
    ``settled`` in every group, ``most_steps`` times at most; a start keeps its least determinant, a group the least of its starts.
    """
    names = [c for c in _estimates(stats).columns if c != "grp"]
    now, best = keep(_starts(stats), "mcd"), None
    for _ in range(most_steps):
        # a row takes part once for each start that still moves
        near = attach(stats, now).withColumn("d", F.log(_distance() + 1e-6)).withColumn("grp", F.struct("grp", "start"))
        edge = keep(_bin_quantile(near, ["grp"], F.col("d"), share, 0.05), "mcd-edge")
        inside = attach(near, edge).where("d <= q + 0.025").select("grp", *STATS)
        found = keep(_estimates(inside).select("grp.*", *names), "mcd")
        if best is None:
            now = best = found
            continue
        before = best.select("grp", "start", F.col("volume").alias("before"))
        moved = found.join(before.hint("merge"), ["grp", "start"]).where(F.col("volume") < F.col("before"))
        kept = best.join(moved.select("grp", "start").hint("merge"), ["grp", "start"], "left_anti").unionByName(moved.select(*best.columns))
        best = keep(kept, "mcd-best")
        now = keep(moved.where(F.col("before") - F.col("volume") >= settled).select(*best.columns), "mcd")
        if now.isEmpty():
            break
    least = best.groupBy("grp").agg(F.min_by(F.struct("start", *names), F.struct("volume", "start")).alias("e"))
    return least.select("grp", "e.*").drop("start")


def drawn_together(groups: DataFrame, prior: float) -> DataFrame:
    """groups (grp, rows, m.., l..) with centre and covariance drawn towards those of group *, which stays as it is: one rule for every size.

    They are the moments of a mixture of the group's rows and ``prior`` rows of the whole, the distance of their centres included.
    """
    whole = groups.where("grp = '*'").first()  # one row of 21 numbers
    if whole is None:
        return groups
    own = F.when(F.col("grp") == "*", 1.0).otherwise(F.col("rows") / (F.col("rows") + prior))
    apart = lambda i: F.col(f"m{i}") - float(whole[f"m{i}"])
    cov = lambda at, i, j: sum((at(i, k) * at(j, k) for k in range(1, j + 1)), at(i, 0) * at(j, 0))
    out = groups.withColumns({f"m{i}": own * F.col(f"m{i}") + (1 - own) * float(whole[f"m{i}"]) for i in range(_P)} | {
        f"c{i}{j}": own * cov(lambda a, k: F.col(f"l{a}{k}"), i, j) + (1 - own) * float(cov(lambda a, k: whole[f"l{a}{k}"], i, j)) + own * (1 - own) * apart(i) * apart(j) for i in range(_P) for j in range(i + 1)
    })
    for i in range(_P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.drop(*[f"c{i}{j}" for i in range(_P) for j in range(i + 1)])


def judge(docs: DataFrame, cutoff: float = 20.5, prior: float = 25.0, steps: int = 12) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the squared distance of every row."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    stats = keep(vectors(base_stats(docs)).withColumn("own", F.concat(name("lang"), F.lit("\n"), name("source"))), "stats")
    usable = stats.where("not base_failed")
    rows = usable.select(F.explode(F.array(F.col("own"), F.lit("*"))).alias("grp"), *STATS)
    groups = keep(robust_groups(rows, steps).join(rows.groupBy("grp").agg(F.count("*").alias("rows")).hint("merge"), "grp"), "groups")
    # a group without usable rows has nothing to judge
    groups = keep(drawn_together(groups, prior), "groups-drawn")
    far = attach(stats.withColumn("grp", F.col("own")), groups, "left").withColumn("distance", _distance())
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "distance")
