"""Dataflow on run manifests: one row per sample, tile or block job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_group(df: DataFrame, keys, order: str, name: str = "rn", bits: int = 16) -> DataFrame:
    """1-based rank of an integer column within its group, whatever the group's size.

    Rows are counted per slice of 2**bits order values, slices get running offsets,
    and only rows of one slice are ever sorted together.  `order` is unique per group.
    """
    keys = list(keys)
    df = df.withColumn("_slice", F.shiftright(F.col(order), bits))
    counts = df.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_super", F.shiftright("_slice", bits))
    tops = counts.groupBy(*keys, "_super").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_top", F.coalesce(F.sum("_m").over(before), F.lit(0).cast("bigint"))).drop("_m")
    inner = Window.partitionBy(*keys, "_super").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0).cast("bigint")))
        .join(tops, [*keys, "_super"])
        .select(*keys, "_slice", (F.col("_before") + F.col("_top")).alias("_before"))
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(order)
    ranked = df.withColumn("_r", F.row_number().over(in_slice))
    return (
        ranked.join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_r")).cast("bigint"))
        .drop("_slice", "_before", "_r")
    )


def map_rows(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.select(*[e.alias(n) for n, e in exprs.items()])


def flat_map(df: DataFrame, items: Column, name: str) -> DataFrame:
    """0..n rows per row; an empty or missing list gives none."""
    return df.withColumn(name, F.explode(items))


def assert_unique(df: DataFrame, key: str) -> None:
    """Fail when a key occurs twice (keys of a join must be unique per side)."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"duplicate {key} in manifest")


def join_by_key(left: DataFrame, *others: DataFrame, key: str = "meta_id", check: bool = False) -> DataFrame:
    """Inner join of manifests; unmatched rows drop out.  Chains share one partitioning."""
    for side in (left, *others) if check else ():
        assert_unique(side, key)
    for other in others:
        left = left.join(other, key)
    return left


def multi_map(df: DataFrame, **outputs) -> dict[str, DataFrame]:
    """Several row-aligned outputs of one input; each lists its columns."""
    return {name: df.select(*cols) for name, cols in outputs.items()}


def group_tuple(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Members of each key in order: key, rn (from 1), value; a row a member, so no row grows with the hottest key."""
    return rank_in_group(df, [key], order).select(key, "rn", value)


def group_parts(df: DataFrame, key: str, order: str, value: str, part_size: int) -> DataFrame:
    """The members as lists in numbered parts of `part_size`; the parts together hold every member."""
    ranked = rank_in_group(df, [key], order)
    part = F.expr(f"(rn - 1) div {int(part_size)}")
    return ranked.groupBy(key, part.alias("part")).agg(
        F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda e: e[value]).alias(value)
    )


def group_fixed(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Groups of exactly `size` members in arrival order; a short rest is not emitted."""
    ranked = rank_in_group(df, [key], order)
    grp = F.expr(f"(rn - 1) div {int(size)}")
    out = ranked.groupBy(key, grp.alias("grp")).agg(
        F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda e: e[value]).alias(value),
    )
    return out.where(F.col("n") == int(size))


def quorum(df: DataFrame, key: str, arrived: Column, required: Column) -> DataFrame:
    """Keys for which enough members arrived; required <= 0 or > total means all."""
    g = df.groupBy(key).agg(
        F.count("*").alias("total"), F.sum(arrived.cast("int")).cast("bigint").alias("arrived"),
        F.max(required).cast("bigint").alias("required"),
    )
    need = F.when((F.col("required") <= 0) | (F.col("required") > F.col("total")), F.col("total"))
    g = g.withColumn("required", need.otherwise(F.col("required")))
    return g.where("arrived >= required")


def concat(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def first_value(source: DataFrame, order: str, value: str) -> Column:
    """The first row's value as a scalar usable with every row (scalar subquery)."""
    return source.agg(F.min_by(value, order)).scalar()


def with_params(df: DataFrame, **params) -> DataFrame:
    """Scalar arguments beside a channel become literals."""
    return df.withColumns({k: F.lit(v) for k, v in params.items()})


def path_set(*cols) -> Column:
    """Distinct, sorted, non-empty paths out of optional columns or lists."""
    flat = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in cols]))
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(flat), lambda p: p != "")))


def common_parent(df: DataFrame, key: str, path: str) -> DataFrame:
    """Longest common leading path of each key's paths.

    Segment arrays sort lexicographically, and what the smallest and the largest
    share all between them share too, so each key needs just a min and a max.
    """
    parts = F.split(path, "/")
    g = df.groupBy(key).agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    same = F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    n = F.when(F.forall(same, lambda s: s), F.size(same)).otherwise(F.array_position(same, False).cast("int") - 1)
    return g.select(key, F.array_join(F.slice("lo", F.lit(1), n), "/").alias("common_parent"))


def expand(df: DataFrame, n: Column, name: str = "ordinal") -> DataFrame:
    """n numbered copies of each row (none for n < 1)."""
    seq = F.when(n >= 1, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")))
    return df.withColumn(name, F.explode(seq))


def take_fields(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Fields start..stop (inclusive, 0-based) of a tuple."""
    return df.select(*df.columns[start:stop + 1])


def branch(df: DataFrame, flag: Column, when_true, when_false) -> DataFrame:
    """Rows with the flag take one path, all others (also NULL) the second."""
    f = F.coalesce(flag, F.lit(False))
    return when_true(df.where(f)).unionByName(when_false(df.where(~f)))


#: Fixed value: a valid tool version.
VERSION = r"^\d.*|^[a-f0-9]{40}$"


def check_versions(df: DataFrame, col: str = "manifest") -> DataFrame:
    """Validity of version manifests map<process, map<tool, version>>.

    Fixed rules: exactly one process, at least one tool, each version a number or a
    40-digit hash, and no left-over of the heredoc that wrote it.
    """
    tools = F.map_values(F.map_values(col)[0])
    names = F.concat(F.map_keys(col), F.map_keys(F.map_values(col)[0]), tools)
    return df.withColumns(
        {
            "one_process": F.size(F.map_keys(col)) == 1,
            "has_tools": F.size(tools) >= 1,
            "versions_ok": F.forall(tools, lambda v: v.rlike(VERSION)),
            "clean": ~F.exists(names, lambda v: F.contains(v, F.lit("END_VERSIONS"))),
        }
    ).withColumn("ok", F.col("one_process") & F.col("has_tools") & F.col("versions_ok") & F.col("clean"))
