"""Queries: manifest dataflow and functions on paths, names, parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import paths as L
from voxelloom.operators import manifest as M
from voxelloom.plans import fixtures as X
from voxelloom.plans.fixtures import sql

QUERIES, ORACLES = {}, {}


def _first_result(spark, sf):
    return X.results(spark, sf).groupBy("meta_id").agg(F.min_by("path", "seq").alias("first_path"))


def _result_count(spark, sf):
    return X.results(spark, sf).groupBy("meta_id").agg(F.count("*").alias("n_results"))


QUERIES["mf_map"] = lambda s, d: M.map_rows(
    X.manifest(s, d), meta_id=F.col("meta_id"), image=F.concat_ws("/", "fix", L.default("fix_subpath", F.lit("s0"))),
    masked=F.col("fix_mask").isNotNull() & F.col("use_mask"),
)
ORACLES["mf_map"] = sql(
    "SELECT meta_id, concat(fix, '/', coalesce(nullif(fix_subpath, ''), 's0')) AS image,"
    " fix_mask IS NOT NULL AND use_mask AS masked FROM fx_manifest"
)
QUERIES["mf_flatmap"] = lambda s, d: M.flat_map(
    X.manifest(s, d).select("meta_id", "n_extra"),
    F.transform(
        F.when(F.col("n_extra") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("n_extra")))
        .otherwise(F.array().cast("array<bigint>")),
        lambda i: F.concat(F.lit("extra-"), i),
    ), "extra",
)
ORACLES["mf_flatmap"] = sql(
    "SELECT meta_id, n_extra, concat('extra-', i) AS extra FROM fx_manifest, range(1, 4) r(i) WHERE i <= n_extra"
)
QUERIES["mf_join"] = lambda s, d: M.join_by_key(X.manifest(s, d), _first_result(s, d)).select("meta_id", "fix", "first_path")
ORACLES["mf_join"] = sql(
    "SELECT meta_id, fix, first_path FROM fx_manifest JOIN"
    " (SELECT meta_id, arg_min(path, seq) AS first_path FROM fx_results GROUP BY 1) USING (meta_id)"
)
QUERIES["mf_join3"] = lambda s, d: M.join_by_key(X.manifest(s, d), _first_result(s, d), _result_count(s, d)).select(
    "meta_id", "fix", "first_path", "n_results")
ORACLES["mf_join3"] = sql(
    "SELECT meta_id, fix, first_path, n_results FROM fx_manifest JOIN (SELECT meta_id, arg_min(path, seq) AS"
    " first_path FROM fx_results GROUP BY 1) USING (meta_id) JOIN (SELECT meta_id, count(*) AS n_results"
    " FROM fx_results GROUP BY 1) USING (meta_id)"
)


def mf_multimap(spark, sf):
    out = M.multi_map(
        X.manifest(spark, sf),
        data=["meta_id", F.lit("data").alias("output"), F.col("fix").alias("value")],
        cluster=["meta_id", F.lit("cluster").alias("output"), F.col("n_extra").cast("string").alias("value")],
    )
    return M.concat(out["data"], out["cluster"])


QUERIES["mf_multimap"] = mf_multimap
ORACLES["mf_multimap"] = sql(
    "SELECT meta_id, 'data' AS output, fix AS value FROM fx_manifest UNION ALL"
    " SELECT meta_id, 'cluster', CAST(n_extra AS VARCHAR) FROM fx_manifest"
)
QUERIES["mf_filter"] = lambda s, d: X.manifest(s, d).where(F.col("use_mask") & (L.default("fix_subpath").isNotNull()))
ORACLES["mf_filter"] = sql("SELECT * FROM fx_manifest WHERE use_mask AND fix_subpath <> ''")
QUERIES["mf_group"] = lambda s, d: M.group_tuple(X.results(s, d), "meta_id", "seq", "path")
ORACLES["mf_group"] = sql("SELECT meta_id, row_number() OVER (PARTITION BY meta_id ORDER BY seq) AS rn, path FROM fx_results")
QUERIES["mf_group_size"] = lambda s, d: M.group_fixed(X.results(s, d), "meta_id", "seq", "path", 4).withColumn(
    "path", L.join_list("path"))
ORACLES["mf_group_size"] = sql(
    "SELECT meta_id, CAST((rn - 1) // 4 AS BIGINT) AS grp, count(*) AS n, string_agg(path, ',' ORDER BY rn) AS path"
    " FROM (SELECT *, row_number() OVER (PARTITION BY meta_id ORDER BY seq) AS rn FROM fx_results) GROUP BY 1, 2"
    " HAVING count(*) = 4"
)
QUERIES["mf_quorum"] = lambda s, d: M.quorum(
    X.results(s, d), "meta_id", F.col("path").contains("/F/") | F.col("path").contains("/O/"),
    F.length("meta_id") * 3 - 9,
)
ORACLES["mf_quorum"] = sql(
    "SELECT meta_id, total, arrived, required FROM (SELECT meta_id, total, arrived, CASE WHEN req <= 0 OR req > total"
    " THEN total ELSE req END AS required FROM (SELECT meta_id, count(*) AS total, count(*) FILTER (path LIKE '%/F/%'"
    " OR path LIKE '%/O/%') AS arrived, length(meta_id) * 3 - 9 AS req FROM fx_results GROUP BY meta_id))"
    " WHERE arrived >= required"
)
QUERIES["mf_concat"] = lambda s, d: M.concat(
    X.manifest(s, d).select("meta_id", F.col("fix").alias("path")), X.results(s, d).select("meta_id", "path"))
ORACLES["mf_concat"] = sql(
    "SELECT meta_id, fix AS path FROM fx_manifest UNION ALL SELECT meta_id, path FROM fx_results"
)


def mf_value(spark, sf):
    m = X.manifest(spark, sf)
    return m.select("meta_id", M.first_value(X.results(spark, sf), "seq", "path").alias("shared_path"))


QUERIES["mf_value"] = mf_value
ORACLES["mf_value"] = sql(
    "SELECT meta_id, (SELECT arg_min(path, seq) FROM fx_results) AS shared_path FROM fx_manifest"
)
QUERIES["mf_params"] = lambda s, d: M.with_params(X.manifest(s, d).select("meta_id"), cpus=3, mem_gb=15.5, config="cfg.yml")
ORACLES["mf_params"] = sql("SELECT meta_id, 3 AS cpus, 15.5e0 AS mem_gb, 'cfg.yml' AS config FROM fx_manifest")
QUERIES["mf_path_set"] = lambda s, d: X.manifest(s, d).select(
    "meta_id",
    F.array_join(M.path_set(F.array("fix", "fix_subpath"), F.array("fix_mask"), F.array(L.parent("fix"), "fix")), "|").alias("paths"),
)
ORACLES["mf_path_set"] = sql(
    "SELECT meta_id, array_to_string(list_sort(list_distinct(list_filter([fix, fix_subpath, fix_mask,"
    " regexp_replace(fix, '/[^/]*$', '')], lambda p: p IS NOT NULL AND p <> ''))), '|') AS paths FROM fx_manifest"
)
QUERIES["mf_common_parent"] = lambda s, d: M.common_parent(X.results(s, d), "meta_id", "path")
ORACLES["mf_common_parent"] = sql(
    "SELECT meta_id, CASE WHEN n_paths = 1 THEN any_path WHEN n_status = 1 THEN concat('/out/', st) ELSE '/out' END"
    " AS common_parent FROM (SELECT meta_id, count(DISTINCT path) AS n_paths, min(path) AS any_path,"
    " count(DISTINCT split_part(path, '/', 3)) AS n_status, min(split_part(path, '/', 3)) AS st"
    " FROM fx_results GROUP BY meta_id)"
)
QUERIES["mf_expand"] = lambda s, d: M.expand(X.manifest(s, d).select("meta_id", "n_extra"), F.col("n_extra"))
ORACLES["mf_expand"] = sql(
    "SELECT meta_id, n_extra, CAST(i AS BIGINT) AS ordinal FROM fx_manifest, range(1, 4) r(i) WHERE i <= n_extra"
)
QUERIES["mf_slice"] = lambda s, d: M.take_fields(X.manifest(s, d), 0, 2)
ORACLES["mf_slice"] = sql("SELECT meta_id, fix, fix_subpath FROM fx_manifest")


def mf_literal(spark, sf):
    segments = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2), ("AUTOMOBILE", 3)], "segment string, rank int")
    m = X.manifest(spark, sf).withColumn("segment", F.split("fix", "/")[2])
    return m.join(segments, "segment").select("meta_id", "segment", "rank")


QUERIES["mf_literal"] = mf_literal
ORACLES["mf_literal"] = sql(
    "SELECT meta_id, segment, rank FROM (SELECT meta_id, split_part(fix, '/', 3) AS segment FROM fx_manifest) JOIN"
    " (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('AUTOMOBILE', 3)) v(segment, rank) USING (segment)"
)
QUERIES["mf_branch"] = lambda s, d: M.branch(
    X.manifest(s, d), F.col("use_mask") & F.col("fix_mask").isNotNull(),
    lambda df: df.select("meta_id", F.concat("fix", F.lit("+"), "fix_mask").alias("job")),
    lambda df: df.select("meta_id", F.col("fix").alias("job")),
)
ORACLES["mf_branch"] = sql(
    "SELECT meta_id, CASE WHEN use_mask AND fix_mask IS NOT NULL THEN concat(fix, '+', fix_mask) ELSE fix END AS job"
    " FROM fx_manifest"
)


def versions_check(spark, sf):
    v = X.versions(spark, sf)
    return M.check_versions(
        v.select("row_id", F.create_map("process", F.create_map("tool", "version")).alias("manifest"))
    ).drop("manifest")


QUERIES["versions_check"] = versions_check
ORACLES["versions_check"] = sql(
    "SELECT row_id, true AS one_process, true AS has_tools, good AS versions_ok, NOT residue AS clean,"
    " good AND NOT residue AS ok FROM (SELECT row_id, regexp_matches(version, '^[0-9].*|^[a-f0-9]{40}$') AS good,"
    " contains(concat(process, tool, version), 'END_VERSIONS') AS residue FROM fx_versions)"
)

# --- functions -------------------------------------------------------------

QUERIES["fn_join"] = lambda s, d: X.manifest(s, d).select("meta_id", L.join_list(F.array("fix", "fix_subpath", "fix_mask")).alias("s"))
ORACLES["fn_join"] = sql("SELECT meta_id, concat_ws(',', fix, fix_subpath, fix_mask) AS s FROM fx_manifest")
QUERIES["fn_default"] = lambda s, d: X.manifest(s, d).select("meta_id", L.default("fix_subpath", "fix_mask", "fix").alias("s"))
ORACLES["fn_default"] = sql("SELECT meta_id, coalesce(nullif(fix_subpath, ''), fix_mask, fix) AS s FROM fx_manifest")
_R = "SELECT meta_id, seq, {} AS s FROM fx_results"
for name, expr, oracle in [
    ("fn_basename", lambda: L.base_name("path"), "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')"),
    ("fn_replace", lambda: L.replace_dots("path"), "replace(path, '.', '_')"),
    ("fn_last_segment", lambda: L.last_segment("path"), "regexp_extract(path, '[^/]*$')"),
    ("fn_parent", lambda: L.parent("path"), "regexp_replace(path, '/[^/]*$', '')"),
    ("fn_contains", lambda: L.contains("path", "/F/"), "contains(path, '/F/')"),
    ("fn_regex_extract", lambda: L.after("path", "/out/O/"), "regexp_extract(path, '/out/O/(\\S*)', 1)"),
    ("fn_tokenize", lambda: F.concat_ws("-", L.token("path", ".", 1), L.token("path", ".", -1), L.token("path", "/", 3)),
     "concat_ws('-', lower(split_part(path, '.', 1)), lower(split_part(path, '.', -1)), lower(split_part(path, '/', 3)))"),
]:
    QUERIES[name] = lambda s, d, e=expr: X.results(s, d).select("meta_id", "seq", e().alias("s"))
    ORACLES[name] = sql(_R.format(oracle))
QUERIES["fn_split_ext"] = lambda s, d: X.manifest(s, d).select(
    "meta_id", L.stem("fix_mask").alias("mask_stem"), L.extension("fix_mask").alias("mask_ext"),
    L.stem("fix_subpath").alias("sub_stem"), L.extension("fix_subpath").alias("sub_ext"))
ORACLES["fn_split_ext"] = sql(
    "SELECT meta_id, regexp_replace(fix_mask, '\\.[^.]*$', '') AS mask_stem, regexp_extract(fix_mask, '\\.([^.]*)$', 1)"
    " AS mask_ext, fix_subpath AS sub_stem, '' AS sub_ext FROM fx_manifest"
)
QUERIES["fn_vector"] = lambda s, d: X.points(s, d).select(
    "point_id", L.vector(F.concat_ws(",", F.col("x").cast("string"), F.lit(".5"), F.col("z").cast("string"))).alias("a")
).select("point_id", F.col("a")[0].alias("a0"), F.col("a")[1].alias("a1"), F.reverse("a")[0].alias("zyx0"))
ORACLES["fn_vector"] = sql("SELECT point_id, x AS a0, 0.5e0 AS a1, z AS zyx0 FROM fx_points")


def _config_maps(spark, sf):
    base = F.create_map(*[F.lit(v) for v in ("iterations", "100", "rate", "0.25", "spacing", "2.0")])
    over = F.create_map(F.lit("iterations"), (F.col("n_extra") * 25).cast("string"), F.lit("mask"), L.default("fix_mask", F.lit("none")))
    return X.manifest(spark, sf).select("meta_id", L.merge_maps(base, over).alias("cfg"))


_CFG = "SELECT meta_id, n_extra * 25 AS it, coalesce(fix_mask, 'none') AS mask FROM fx_manifest"
QUERIES["fn_map_merge"] = lambda s, d: _config_maps(s, d).select(
    "meta_id", F.col("cfg")["iterations"].alias("iterations"), F.col("cfg")["mask"].alias("mask"), F.col("cfg")["rate"].alias("rate"),
    F.size("cfg").alias("n"))
ORACLES["fn_map_merge"] = sql(
    "SELECT meta_id, CAST(it AS VARCHAR) AS iterations, mask, '0.25' AS rate, 4 AS n FROM cfg", cfg=_CFG)
QUERIES["fn_map_render"] = lambda s, d: _config_maps(s, d).select("meta_id", L.render_map("cfg", ";").alias("s"))
ORACLES["fn_map_render"] = sql(
    "SELECT meta_id, concat('iterations=', it, ';mask=', mask, ';rate=0.25;spacing=2.0') AS s FROM cfg", cfg=_CFG)


def config_merge(spark, sf):
    """Per-sample parameter maps: top-level defaults < phase section < sample overrides."""
    top = F.create_map(*[F.lit(v) for v in ("alignment_spacing", "2.0", "iterations", "100", "rate", "0.25")])
    phase = F.create_map(*[F.lit(v) for v in ("alignment_spacing", "1.0", "iterations", "25")])
    own = F.when(F.col("use_mask"), F.create_map(F.lit("iterations"), F.col("n_extra").cast("string")))
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    return X.manifest(spark, sf).select("meta_id", L.render_map(L.merge_maps(L.merge_maps(top, phase), own), ";").alias("params"))


QUERIES["config_merge"] = config_merge
ORACLES["config_merge"] = sql(
    "SELECT meta_id, concat('alignment_spacing=1.0;iterations=', CASE WHEN use_mask THEN n_extra ELSE 25 END,"
    " ';rate=0.25') AS params FROM fx_manifest"
)
