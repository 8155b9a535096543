"""The graph's tables derived from the star schema, as DataFrames and as SQL for a second engine.

Commands, configuration objects and features come from parts and customers, business objects from regions, nations and
suppliers, telemetry from events, test runs and reviews from conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows, dealt out to more tasks than run at once: a table of few bytes is read by few tasks, however long its rows take."""
    return rows.repartition(max(16, 4 * rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64(key))


def _nf(key: str) -> Column:
    return F.concat(F.lit("NF"), (F.col(key) % 3).cast("string"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, nf, local, version): one row for each part."""
    p = read(spark, sf_dir, "part")
    version = F.concat_ws(".", F.lit("20"), F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string"))
    return p.select(F.col("p_partkey").alias("src"), _nf("p_partkey").alias("nf"), F.upper("p_name").alias("local"), version.alias("version"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (id, version); the last source wins."""
    own = parts(spark, sf_dir).groupBy("nf", "local", "version").agg(F.max("src").alias("src"))
    return own.withColumn("id", F.concat("nf", F.lit("@MMLCommand@"), "local"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")

    def shaped(df, type_, layer, scope, nf, version, domain, scenario, name, mtime):
        return df.select(
            "id", version.alias("version"), F.lit(type_).alias("type"), F.lit(layer).alias("layer"), F.lit(scope).alias("scope"), nf.alias("nf"), domain.alias("domain"), scenario.alias("scenario"), name.alias("name"), mtime.cast("double").alias("mtime")
        )

    cmd = commands(spark, sf_dir)
    token = F.split_part("local", F.lit(" "), F.lit(2))
    cfg = cmd.groupBy("nf", token.alias("token"), "version").agg(F.max("src").alias("src")).withColumn("id", F.concat("nf", F.lit("@ConfigObject@"), "token"))
    cust = read(spark, sf_dir, "customer").select(
        _nf("c_custkey").alias("nf"), F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("local"), F.concat(F.lit("20."), (F.col("c_custkey") % 7).cast("string"), F.lit(".0")).alias("version"), "c_custkey"
    )
    feat = cust.groupBy("nf", "local", "version").agg(F.max("c_custkey").alias("src")).withColumn("id", F.concat("nf", F.lit("@Feature@"), "local"))
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    nation = nation.join(region, nation.n_regionkey == region.r_regionkey)
    supplier = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    business = [
        (region.withColumn("id", F.concat(F.lit("BusinessDomain@"), "r_name")), "BusinessDomain", null, "r_name", "r_regionkey"),
        (nation.withColumn("id", F.concat(F.lit("NetworkScenario@"), "n_name")), "NetworkScenario", F.col("n_name"), "n_name", "n_nationkey"),
        (supplier.withColumn("id", F.concat(F.lit("ConfigurationSolution@"), "s_name")), "ConfigurationSolution", F.col("n_name"), "s_name", "s_suppkey"),
    ]
    found = shaped(cmd, "MMLCommand", "Command", "nf", F.col("nf"), F.col("version"), null, null, F.col("local"), F.col("src"))
    found = found.unionByName(shaped(cfg, "ConfigObject", "ConfigObject", "nf", F.col("nf"), F.col("version"), null, null, F.col("token"), F.col("src")))
    found = found.unionByName(shaped(feat, "Feature", "Feature", "nf", F.col("nf"), F.col("version"), null, null, F.col("local"), F.col("src")))
    for df, type_, scenario, name, key in business:
        found = found.unionByName(shaped(df, type_, "Business", "cross", null, null, F.col("r_name"), scenario, F.col(name), F.col(key)))
    path = F.when(F.col("scope") == "nf", F.concat_ws("/", "layer", "nf", "version", "id")).otherwise(F.concat_ws("/", "layer", "domain", "scenario", "id"))
    return found.withColumns({"name_zh": F.concat(F.lit("增加"), "name"), "source_path": F.concat(path, F.lit(".md"))})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd, p = commands(spark, sf_dir), parts(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))
    token = F.split_part("local", F.lit(" "), F.lit(2))
    cfg = cmd.select(F.col("id").alias("from_id"), F.col("version").alias("from_version"), F.lit("操作配置对象").alias("relation"), F.concat("nf", F.lit("@ConfigObject@"), token).alias("to_id"))
    other = p.select(F.col("src").alias("_src"), F.concat("nf", F.lit("@MMLCommand@"), "local").alias("_to"))
    asked = cmd.crossJoin(F.broadcast(n)).withColumn("_src", (F.col("src") * 7 + 1) % F.col("n"))  # one row
    target = F.when(F.col("src") % 50 == 0, F.concat("nf", F.lit("@MMLCommand@NOPE"))).otherwise(F.col("_to"))
    see = asked.join(other, "_src").select(F.col("id").alias("from_id"), F.col("version").alias("from_version"), F.lit("参见").alias("relation"), target.alias("to_id"))
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    null = F.lit(None).cast("string")
    down = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("BusinessDomain@"), "r_name").alias("from_id"), null.alias("from_version"), F.lit("下游场景").alias("relation"), F.concat(F.lit("NetworkScenario@"), "n_name").alias("to_id")
    )
    solve = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.concat(F.lit("NetworkScenario@"), "n_name").alias("from_id"), null.alias("from_version"), F.lit("下游方案").alias("relation"), F.concat(F.lit("ConfigurationSolution@"), "s_name").alias("to_id")
    )
    return cfg.unionByName(see).distinct().unionByName(down).unionByName(solve)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.when(kind.isin("view", "click", "purchase"), "object").otherwise("request").alias("level"),
        F.when(F.col("user_id") % 5 == 0, "web").otherwise("skill").alias("caller"),
        F.when(kind == "view", "/md").when(kind == "click", "/domains").when(kind == "purchase", "/fs/upload").otherwise("/api/v1/objects").alias("endpoint"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("obj_id"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("event_id") % 4).cast("string"))).alias("obj_type"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("EMP"), (F.col("user_id") % 11).cast("string"))).alias("operator"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each supplier; the runs below use the first 25."""
    n = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), F.lpad(n.cast("string"), 9, "0")).alias("id"), F.concat(F.lit("d"), (n % 5).cast("string")).alias("domain"), F.concat(F.lit("s"), (n % 7).cast("string")).alias("scenario"), F.concat(F.lit("Case "), n.cast("string")).alias("name")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select(F.concat(F.lit("r"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("c"), F.lpad((F.col("conv_id") % 25).cast("string"), 9, "0")).alias("case_id"), F.lpad((F.col("conv_id") * 37 % 1000).cast("string"), 4, "0").alias("run_at"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n"))
    verdict = F.when(F.col("n") % 4 == 0, "通过").when(F.col("n") % 4 == 1, "不通过").when(F.col("n") % 4 == 2, " ").otherwise("部分通过")
    run = F.concat(F.lit("r"), F.lpad(F.col("conv_id").cast("string"), 9, "0"))
    return c.select(F.concat(run, F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), run.alias("run_id"), verdict.alias("verdict"))


#: The same tables in SQL, as common table expressions.
SQL = """
p AS (SELECT p_partkey AS src, 'NF' || (p_partkey % 3)::VARCHAR AS nf, upper(p_name) AS local, '20.' || p_size::VARCHAR || '.' || (p_partkey % 12)::VARCHAR AS version FROM part),
cmd AS (SELECT nf, local, version, max(src) AS src, nf || '@MMLCommand@' || local AS id FROM p GROUP BY nf, local, version),
cfg AS (SELECT nf, split_part(local, ' ', 2) AS token, version, max(src) AS src FROM cmd GROUP BY ALL),
feat AS (SELECT 'NF' || (c_custkey % 3)::VARCHAR AS nf, c_mktsegment || ' ' || (c_custkey % 50)::VARCHAR AS local, '20.' || (c_custkey % 7)::VARCHAR || '.0' AS version, max(c_custkey) AS src FROM customer GROUP BY ALL),
nat AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
sup AS (SELECT * FROM supplier JOIN nat ON s_nationkey = n_nationkey),
raw_objects AS (
  SELECT id, version, 'MMLCommand' AS type, 'Command' AS layer, 'nf' AS scope, nf, NULL::VARCHAR AS domain, NULL::VARCHAR AS scenario, local AS name, src::DOUBLE AS mtime FROM cmd
  UNION ALL SELECT nf || '@ConfigObject@' || token, version, 'ConfigObject', 'ConfigObject', 'nf', nf, NULL, NULL, token, src FROM cfg
  UNION ALL SELECT nf || '@Feature@' || local, version, 'Feature', 'Feature', 'nf', nf, NULL, NULL, local, src FROM feat
  UNION ALL SELECT 'BusinessDomain@' || r_name, NULL, 'BusinessDomain', 'Business', 'cross', NULL, r_name, NULL, r_name, r_regionkey FROM region
  UNION ALL SELECT 'NetworkScenario@' || n_name, NULL, 'NetworkScenario', 'Business', 'cross', NULL, r_name, n_name, n_name, n_nationkey FROM nat
  UNION ALL SELECT 'ConfigurationSolution@' || s_name, NULL, 'ConfigurationSolution', 'Business', 'cross', NULL, r_name, n_name, s_name, s_suppkey FROM sup),
objects AS (SELECT *, '增加' || name AS name_zh, (CASE WHEN scope = 'nf' THEN concat_ws('/', layer, nf, version, id) ELSE concat_ws('/', layer, domain, scenario, id) END) || '.md' AS source_path,
            list_transform(string_split(version, '.'), lambda x: x::BIGINT) AS vk,
            CASE type WHEN 'MMLCommand' THEN '命令层' WHEN 'ConfigObject' THEN '命令层' WHEN 'Feature' THEN '特性层' ELSE '业务层' END AS ui_layer FROM raw_objects),
latest AS (SELECT id, arg_max(version, vk) AS version FROM objects GROUP BY id),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vk DESC NULLS LAST) AS rn FROM objects) WHERE rn = 1),
vers AS (SELECT id, coalesce(list_sort(list(DISTINCT version) FILTER (WHERE version IS NOT NULL)), []) AS versions, coalesce(string_agg(DISTINCT version, ',' ORDER BY version), '') AS vtext FROM objects GROUP BY id),
edges AS (
  SELECT id AS from_id, version AS from_version, '操作配置对象' AS relation, nf || '@ConfigObject@' || split_part(local, ' ', 2) AS to_id FROM cmd
  UNION SELECT c.id, c.version, '参见', CASE WHEN c.src % 50 = 0 THEN c.nf || '@MMLCommand@NOPE' ELSE q.nf || '@MMLCommand@' || q.local END
        FROM cmd c JOIN p q ON q.src = (c.src * 7 + 1) % (SELECT count(*) FROM part)
  UNION ALL SELECT 'BusinessDomain@' || r_name, NULL, '下游场景', 'NetworkScenario@' || n_name FROM nat
  UNION ALL SELECT 'NetworkScenario@' || n_name, NULL, '下游方案', 'ConfigurationSolution@' || s_name FROM sup),
telemetry AS (
  SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'object' ELSE 'request' END AS level,
         CASE WHEN user_id % 5 = 0 THEN 'web' ELSE 'skill' END AS caller,
         CASE event_type WHEN 'view' THEN '/md' WHEN 'click' THEN '/domains' WHEN 'purchase' THEN '/fs/upload' ELSE '/api/v1/objects' END AS endpoint,
         regexp_extract(props, '([0-9]+)', 1) AS obj_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'T' || (event_id % 4)::VARCHAR END AS obj_type,
         'u' || user_id::VARCHAR AS user, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'EMP' || (user_id % 11)::VARCHAR END AS operator FROM events),
used AS (SELECT * FROM telemetry WHERE level = 'object' AND caller = 'skill' AND endpoint IN ('/md', '/domains')),
cases AS (SELECT 'c' || lpad(i::VARCHAR, 9, '0') AS id, 'd' || (i % 5)::VARCHAR AS domain, 's' || (i % 7)::VARCHAR AS scenario, 'Case ' || i::VARCHAR AS name FROM (SELECT s_suppkey AS i FROM supplier)),
runs AS (SELECT DISTINCT 'r' || lpad(conv_id::VARCHAR, 9, '0') AS id, 'c' || lpad((conv_id % 25)::VARCHAR, 9, '0') AS case_id, lpad((conv_id * 37 % 1000)::VARCHAR, 4, '0') AS run_at FROM conversations),
reviews AS (SELECT 'r' || lpad(conv_id::VARCHAR, 9, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS id, 'r' || lpad(conv_id::VARCHAR, 9, '0') AS run_id,
            CASE max(length(text)) % 4 WHEN 0 THEN '通过' WHEN 1 THEN '不通过' WHEN 2 THEN '未判定' ELSE '部分通过' END AS verdict
            FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
lv AS (SELECT run_id, count(*) AS n_reviews, arg_max(verdict, id) AS latest_verdict FROM reviews GROUP BY run_id)
"""
