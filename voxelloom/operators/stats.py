"""Order statistics, histograms and thresholds per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.session import cut


def value_counts(vox: DataFrame, keys=("ds",), col="v") -> DataFrame:
    """Rows per distinct value; equal values combine before the shuffle.

    Stored, because every statistic below reads the counts several times and the
    volume must be read just once.
    """
    return cut(vox.groupBy(*keys, F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n")))


def _binned(counts: DataFrame, keys, nbins: int):
    """Value counts with a bin number that grows with the value, and the ranges."""
    span = counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    pos = (F.col("v") - F.col("lo")) * float(nbins) / (F.col("hi") - F.col("lo"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(pos), F.lit(nbins - 1).cast("bigint")))
    return counts.join(span, list(keys)).withColumn("bin", F.coalesce(b, F.lit(0).cast("bigint"))), span


def quantiles(vox: DataFrame, probs, keys=("ds",), col="v", nbins: int = 4096) -> DataFrame:
    """Exact quantiles q0, q1, ... per key, interpolated between order statistics.

    Values are counted, counts are binned, and only the bins that hold a wanted
    rank are looked at value by value; no dataset is ever sorted as a whole.
    """
    keys = list(keys)
    binned, span = _binned(value_counts(vox, keys, col), keys, nbins)
    per_bin = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bin = per_bin.withColumn("upto", F.sum("m").over(w)).withColumn("before", F.col("upto") - F.col("m"))
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), fn(F.lit(float(p)) * (F.col("total") - 1)).alias("rank"))
            for i, p in enumerate(probs) for side, fn in ((0, F.floor), (1, F.ceil))
        ]
    )
    wanted = span.select(*keys, F.explode(ranks).alias("r")).select(*keys, "r.*")
    hit = per_bin.join(wanted, keys).where("rank >= before and rank < upto").select(*keys, "bin", "before", "i", "side", "rank")
    inside = binned.join(hit.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi")
    w = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.select(*keys, "bin", "v", "n", F.sum("n").over(w).alias("cum"))
    found = hit.join(inside, [*keys, "bin"]).where("rank >= before + cum - n and rank < before + cum")
    pick = found.groupBy(*keys).agg(
        *[F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("v"))).alias(f"_{i}_{side}")
          for i in range(len(probs)) for side in (0, 1)]
    ).join(span.select(*keys, "total"), keys)
    out = []
    for i, p in enumerate(probs):
        r = F.lit(float(p)) * (F.col("total") - 1)
        frac = r - F.floor(r)
        out.append((F.col(f"_{i}_0") + (F.col(f"_{i}_1") - F.col(f"_{i}_0")) * frac).alias(f"q{i}"))
    return pick.select(*keys, *out)


def otsu(vox: DataFrame, keys=("ds",), col="v", nbins: int = 256) -> DataFrame:
    """Bin range per key that splits its histogram best (between-class variance).

    Output: keys, lo, hi, otsu_bin; foreground are the values in higher bins.
    """
    keys = list(keys)
    binned, _ = _binned(value_counts(vox, keys, col), keys, nbins)
    h = binned.groupBy(*keys, "lo", "hi", "total", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    h = h.withColumns(
        {"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("bin")).over(upto),
         "s": F.sum(F.col("n") * F.col("bin")).over(whole)}
    )
    d = lambda c: F.col(c).cast("double")
    gap = d("s0") * d("total") - d("s") * d("w0")
    h = h.withColumn("var", F.when(F.col("w0") < F.col("total"), gap * gap / (d("w0") * (d("total") - d("w0")))).otherwise(0.0))
    best = F.max_by("bin", F.struct("var", (-F.col("bin")).alias("b")))
    return h.groupBy(*keys, "lo", "hi").agg(best.alias("otsu_bin"))


def above_otsu(vox: DataFrame, keys=("ds",), col="v", nbins: int = 256) -> DataFrame:
    t = otsu(vox, keys, col, nbins)
    pos = (F.col(col) - F.col("lo")) * float(nbins) / (F.col("hi") - F.col("lo"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(pos), F.lit(nbins - 1).cast("bigint"))).otherwise(0)
    m = F.when(b > F.col("otsu_bin"), 1).otherwise(0)
    return vox.join(t, list(keys)).select(*vox.columns, m.alias("m"))


def above_quantile(vox: DataFrame, prob: float, keys=("ds",), col="v") -> DataFrame:
    """Foreground mask: 1 where the value exceeds the dataset's quantile."""
    q = quantiles(vox, [prob], keys, col)
    return vox.join(q, list(keys)).withColumn("m", F.when(F.col(col) > F.col("q0"), 1).otherwise(0)).drop("q0")


def winsorize(vox: DataFrame, low: float, high: float, keys=("ds",), col="v") -> DataFrame:
    """Clip the lowest and highest fractions to the values at those ranks."""
    q = quantiles(vox, [low, 1.0 - high], keys, col)
    clipped = F.least(F.greatest(F.col(col).cast("double"), F.col("q0")), F.col("q1"))
    return vox.join(q, list(keys)).withColumn(col, clipped).drop("q0", "q1")


SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def pair_sums(a: str, b: str):
    """Count and moment sums of two aligned arrays, folded in the JVM."""
    zero = F.lit(0.0)
    plain, squared = (lambda s, x: s + x), (lambda s, x: s + x * x)
    parts = (
        F.size(a).cast("double"), F.aggregate(a, zero, plain), F.aggregate(b, zero, plain), F.aggregate(a, zero, squared),
        F.aggregate(b, zero, squared), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, plain),
    )
    return F.struct(*[p.alias(n) for n, p in zip(SUMS, parts)])


def corr_of_sums():
    """Pearson correlation from columns n, sa, sb, saa, sbb, sab; NULL when flat."""
    n, sa, sb, saa, sbb, sab = [F.col(c).cast("double") for c in SUMS]
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    return F.when((va > 0) & (vb > 0), (n * sab - sa * sb) / (F.sqrt(va) * F.sqrt(vb)))


def corr_blocks(fix: DataFrame, mov: DataFrame, keys=("ds",), col="v") -> DataFrame:
    """Correlation of two aligned block tables, one row per block; joins block rows."""
    on = [*keys, "blk_z", "blk_y", "blk_x"]
    both = fix.select(*on, F.col(col).alias("a")).join(mov.select(*on, F.col(col).alias("b")), on)
    sums = both.select(*on, pair_sums("a", "b").alias("s")).select(*on, "s.*")
    return sums.withColumn("r", corr_of_sums())


def corr_global(fix: DataFrame, mov: DataFrame, keys=("ds",), col="v") -> DataFrame:
    sums = corr_blocks(fix, mov, keys, col).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])
    return sums.withColumn("r", corr_of_sums())


def corr_spaced(fix_vox: DataFrame, mov_vox: DataFrame, fix_spacing, mov_spacing, bsize, keys=("ds",)) -> DataFrame:
    """Per-block correlation of volumes with different spacing: each fixed voxel is
    compared with the moving voxel nearest to its physical position."""
    from voxelloom.operators import select as S

    f = S.to_index(S.to_physical(fix_vox, fix_spacing), mov_spacing)
    m = mov_vox.select(*keys, *[F.col(a).alias(f"i{a}") for a in "zyx"], F.col("v").alias("mv"))
    block = [F.floor(F.col(a) / int(b)).cast("bigint").alias(f"blk_{a}") for a, b in zip("zyx", bsize)]
    a, b = F.col("v").cast("double"), F.col("mv").cast("double")
    sums = f.join(m, [*keys, "iz", "iy", "ix"]).groupBy(*keys, *block).agg(
        F.count("*").cast("double").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"),
        F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"),
    )
    return sums.withColumn("r", corr_of_sums())


def winsorize_blocks(blocks: DataFrame, limits: DataFrame, keys=("ds",), col="v") -> DataFrame:
    """Clip block values to columns q0, q1 of `limits` (one small row per key)."""
    df = blocks.join(limits, list(keys))
    return df.withColumn(col, F.transform(col, lambda v: F.least(F.greatest(v, F.col("q0")), F.col("q1")))).drop("q0", "q1")


def standardize(blocks: DataFrame, keys=("ds",), col="v") -> DataFrame:
    """Block values with mean 0 and deviation 1 per key (flat volumes become 0)."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    fold = F.aggregate(col, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    part = blocks.select(*keys, F.size(col).alias("n"), fold.alias("f"))
    m = part.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("f.s").alias("_s"), F.sum("f.q").alias("_q"))
    mean = F.col("_s") / F.col("_n")
    m = m.select(*keys, mean.alias("_mean"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("_sd"))
    scaled = F.transform(col, lambda v: F.when(F.col("_sd") > 0, (v - F.col("_mean")) / F.col("_sd")).otherwise(0.0))
    return blocks.join(m, list(keys)).withColumn(col, scaled).drop("_mean", "_sd")
