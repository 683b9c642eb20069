"""Query-plan documents: nodes, red flags, structural hashes, flips and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import explain_safe, statement_verb
from fleetlens.sources.landing import landed

# The children of a plan node, and the keys that make its skeleton.
CHILDREN = ("table", "nested_loop", "query_specifications", "ordering_operation", "grouping_operation", "duplicates_removal", "windowing")
CANONICAL = (
    "select_id table_name access_type key key_length ref used_key_parts used_columns attached_condition using_index using_index_for_group_by "
    "using_filesort using_temporary_table index_condition rows_produced_per_join_is_estimated"
).split()


KEY = ("server_id", "digest", "ts")


def _key(df: DataFrame) -> list[str]:
    """What tells plans apart: server (where the table has one), digest and time."""
    return [c for c in KEY if c in df.columns]


def plan_nodes(plans: DataFrame) -> DataFrame:
    """(server_id, digest, ts, path, kind, node): every node of each plan, from query_block or else the document down.

    A path part of a list is its zero-padded place; below a table nothing is entered. Text that is no JSON object has no
    nodes. One round a level, each landed, as deep as the deepest plan; a document is parsed once."""
    names, keys = ", ".join(f"'{c}'" for c in CHILDREN), ", ".join(_key(plans))
    spark = plans.sparkSession
    # documents are large against the rows of the table they may come from, so a table's few partitions are dealt out first
    dealt = plans.select(*_key(plans), "plan_json").repartition(3 * spark.sparkContext.defaultParallelism, *_key(plans))
    levels = [landed(spark.sql(
        f"""SELECT {keys}, 'query_block' AS path, 'query_block' AS kind, coalesce(try_variant_get(doc, '$.query_block', 'variant'), doc) AS node
            FROM (SELECT {keys}, try_parse_json(plan_json) AS doc FROM {{plans}}) WHERE doc IS NOT NULL AND startswith(schema_of_variant(doc), 'OBJECT')""",
        plans=dealt,
    ), "plan-level")]
    while True:
        below = landed(spark.sql(
            f"""SELECT {keys}, concat(n.path, '/', coalesce(e.key, lpad(CAST(e.pos AS STRING), 4, '0'))) AS path, coalesce(e.key, 'item') AS kind, e.value AS node
                FROM {{level}} AS n, LATERAL variant_explode(n.node) AS e WHERE n.kind <> 'table' AND (e.key IS NULL OR e.key IN ({names}))""",
            level=levels[-1],
        ), "plan-level")
        if not below.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        levels.append(below)


def plan_red_flags(plans: DataFrame, full_scan_rows: int = 1000, ratio: int = 100) -> DataFrame:
    number = lambda k: F.coalesce(F.try_variant_get("node", f"$.{k}", "bigint"), F.lit(0))
    true = lambda k: F.coalesce(F.try_variant_get("node", f"$.{k}", "boolean"), F.lit(False))
    rows = plan_nodes(plans).withColumns({"examined": number("rows_examined_per_scan"), "produced": number("rows_produced_per_join"), "table_name": F.try_variant_get("node", "$.table_name", "string"), "access": F.try_variant_get("node", "$.access_type", "string")})
    table = F.col("kind") == "table"
    flags = F.array_compact(F.array(
        F.when(table & (F.col("access") == "ALL") & (F.col("examined") >= full_scan_rows), "FULL_SCAN"), F.when(table & (F.col("produced") > 0) & (F.col("examined") >= F.col("produced") * ratio), "BIG_SCAN_RATIO"),
        F.when(true("using_filesort"), "FILESORT"), F.when(true("using_temporary_table"), "TEMP_TABLE"),
    ))
    return rows.select(*_key(plans), "path", "table_name", "examined", "produced", F.explode(flags).alias("flag"))


def condition_columns(plans: DataFrame) -> DataFrame:
    """The columns that a table's attached condition names, each once: chains of backquoted names outside of string
    literals; a chain that names another table is left out."""
    nodes = plan_nodes(plans).filter("kind = 'table'").select(*_key(plans), "path", F.try_variant_get("node", "$.table_name", "string").alias("table_name"), F.try_variant_get("node", "$.attached_condition", "string").alias("condition"))
    plain = F.regexp_replace("condition", r"'(?:[^'\\]|\\.|'')*'", "''")
    chains = nodes.select(*_key(plans), "path", "table_name", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"((?:`[^`]+`\s*\.\s*)*`[^`]+`)"), 1))).alias("chain"))
    names = F.regexp_extract_all("chain", F.lit("`([^`]+)`"), 1)
    own = (F.size(names) == 1) | (F.try_element_at(names, F.lit(-2)) == F.col("table_name"))
    return chains.filter(own).select(*_key(plans), "path", "table_name", F.element_at(names, -1).alias("column_name")).distinct()


def unindexed_conditions(plans: DataFrame, indexes: DataFrame) -> DataFrame:
    """Condition columns that no index starts with. ``indexes`` (table_name, column_name, seq_in_index, and server_id where
    the plans have it)."""
    on = [*(["server_id"] if "server_id" in indexes.columns and "server_id" in plans.columns else []), "table_name", "column_name"]
    return condition_columns(plans).join(indexes.filter("seq_in_index = 1").select(*on), on, "left_anti").withColumn("flag", F.lit("UNINDEXED_CONDITION")).select(*_key(plans), "path", "table_name", "column_name", "flag")


def plan_hash(plans: DataFrame) -> DataFrame:
    """SHA-256 of a plan's skeleton: its nodes and their canonical keys, without costs and row estimates."""
    keys = F.array_compact(F.array(*(F.when(F.try_variant_get("node", f"$.{k}", "variant").isNotNull(), F.concat(F.lit(k + "="), F.to_json(F.try_variant_get("node", f"$.{k}", "variant")))) for k in sorted(CANONICAL))))
    text = F.concat(F.col("path"), F.lit("{"), F.array_join(F.when(F.col("kind") == "item", F.array().cast("array<string>")).otherwise(keys), ";"), F.lit("}"))
    rows = plan_nodes(plans).select(*_key(plans), F.struct("path", text.alias("text")).alias("x"))
    return rows.groupBy(*_key(plans)).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n"), 256).alias("plan_hash"))


def plan_flips(hashes: DataFrame) -> DataFrame:
    """Where a digest's plan hash on one server differs from the one before."""
    keys = _key(hashes)
    before = F.lag("plan_hash").over(Window.partitionBy(*keys[:-1]).orderBy("ts"))
    return hashes.withColumn("prior_hash", before).filter("prior_hash is not null and prior_hash <> plan_hash").select(*keys, "prior_hash", F.col("plan_hash").alias("new_hash"))


def recent_example(history: DataFrame) -> DataFrame:
    """The latest non-empty text of each digest."""
    return history.filter("coalesce(sql_text, '') <> ''").groupBy("server_id", "digest").agg(F.max_by(F.struct("sql_text", "schema_name"), F.struct("timer_end", "sql_text")).alias("e")).select("server_id", "digest", "e.*")


def explain_candidates(digests: DataFrame, history: DataFrame) -> DataFrame:
    rows = digests.select("server_id", "digest").distinct().join(recent_example(history), ["server_id", "digest"], "left")
    reason = F.when(F.col("sql_text").isNull(), "no example").when(~explain_safe(F.col("sql_text")), F.concat(F.lit("unsafe verb: "), statement_verb(F.col("sql_text"))))
    return rows.withColumn("skip_reason", reason)
