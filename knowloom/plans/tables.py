"""The sample tables read as tables of the knowledge model.

Every view is a projection of a whole table, so the work of each query grows with its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions.layout import spread


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    # --- texts -------------------------------------------------------------------------------
    def documents(self) -> DataFrame:
        return spread(self.raw("documents")).select(
            F.col("doc_id").alias("version_id"), F.col("source").alias("source_id"), F.col("lang").alias("owner_id"), "text"
        )

    def questions(self) -> DataFrame:
        """Every owner (language) asks for every benchmark passage in its own documents."""
        owners = self.raw("documents").agg(F.collect_set("lang")).scalar()
        asked = self.raw("benchmark").select("item_id", F.explode(owners).alias("owner_id"), F.col("text").alias("question"))
        return asked.select(F.concat_ws("-", "owner_id", F.col("item_id").cast("string")).alias("query_id"), "owner_id", "question")

    # --- change capture ----------------------------------------------------------------------
    def pages(self) -> DataFrame:
        """Page urls as external ids; the host is the source."""
        return self.raw("pages").select(
            F.col("page_id").alias("version_id"), F.col("url").alias("external_id"),
            F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source_id"),
            F.lit("text/html").alias("mime_type"), F.sha2("html", 256).alias("content_hash"), "html",
        )

    def turns(self) -> DataFrame:
        """A conversation is an object, each turn an observed version of it."""
        return self.raw("conversations").select(
            F.col("conv_id").alias("object_id"), F.col("turn").alias("observed_at"), F.col("turn").alias("version_id"),
            F.lit("v1").alias("pipeline_version"), F.sha2("text", 256).alias("content_hash"), "role",
        )

    def observations(self) -> DataFrame:
        """Events as observations of a user's state."""
        return self.raw("events").select(
            F.col("user_id").alias("object_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("version_id"),
            F.lit("v1").alias("pipeline_version"), F.col("event_type").alias("content_hash"), "value", "props",
        )

    def runs(self) -> DataFrame:
        """Orders as sync runs of a customer."""
        status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source_id"), status.alias("status"),
            F.col("o_orderdate").alias("completed_at"), F.col("o_orderpriority").alias("mode"),
        )

    def sources(self) -> DataFrame:
        """Customers as sources; the nation owns them."""
        return self.raw("customer").select(
            F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("owner_id"), (F.col("c_acctbal") > 0).alias("enabled"),
            F.to_json(F.struct(F.col("c_mktsegment").alias("project"))).alias("configuration"),
        )

    def versions(self) -> DataFrame:
        """Orders as document versions of a customer's source; status columns come from order fields."""
        o = self.raw("orders")
        st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
        return o.select(
            F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("source_id"),
            F.concat(F.lit("file-"), F.col("o_orderkey").cast("string"),
                     F.when(pr == "1-URGENT", ".md").when(pr == "2-HIGH", ".pdf").otherwise(".json")).alias("external_id"),
            F.col("o_orderdate").alias("observed_at"),
            F.when(st == "P", "pending").when(st == "F", "failed").otherwise("completed").alias("extraction_status"),
            F.when(pr == "1-URGENT", "completed").when(pr == "2-HIGH", "skipped").otherwise("pending").alias("knowledge_status"),
            F.when(pr == "5-LOW", "pending").otherwise("completed").alias("triage_status"),
            F.when(st == "F", F.concat(F.lit("error in "), pr)).alias("extraction_error"),
            F.when(pr == "5-LOW", "{}").otherwise(
                F.concat(F.lit('{"relevance":'), (F.floor("o_totalprice") / 1000000).cast("string"), F.lit("}"))
            ).alias("triage_metadata"),
            F.when(pr == "1-URGENT", '{"embedding_model_mismatch":true}').otherwise("{}").alias("maintenance_flags"),
        )

    def version_chunks(self) -> DataFrame:
        """Line items as chunks of an order's version."""
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("chunk_id"),
            F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("chunk_index"),
            F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("created_at"),
            F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("text"),
            F.when(F.col("l_returnflag") == "R", "old-model").otherwise("current-model").alias("embedding_model"),
        )

    # --- proposals and decisions -------------------------------------------------------------
    def proposals(self) -> DataFrame:
        """Orders as proposals of a customer."""
        st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
        kind = (
            F.when(pr == "1-URGENT", "entity").when(pr == "2-HIGH", "claim").when(pr == "3-MEDIUM", "relationship")
            .when(pr == "4-NOT SPECIFIED", "entity_resolution").otherwise("task")
        )
        confidence = F.least(F.floor(F.col("o_totalprice") / 50) / 10000, F.lit(1.0))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("owner_id"), kind.alias("proposal_type"),
            F.when(st == "O", "pending").when(st == "F", "approved").otherwise("deferred").alias("status"),
            confidence.alias("confidence"),
            F.when(confidence < 0.6, "high").when(confidence >= 0.85, "low").otherwise("medium").alias("risk_level"),
            (F.col("o_custkey") < F.col("o_orderkey")).alias("requires_review"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.concat(F.lit('{"name":"'), pr, F.lit('","priority":"'), pr, F.lit('"}')).alias("payload"),
            F.lit(None).cast("string").alias("original_payload"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        )

    def evidence(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("proposal_id"), F.col("l_linenumber").alias("anchor_start"),
            F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("version_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("evidence_id"),
        )

    def decisions(self) -> DataFrame:
        """Line items as decisions on their order's proposal."""
        action = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "reject").otherwise("edit_and_approve")
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("decision_id"),
            F.col("l_orderkey").alias("proposal_id"), action.alias("action"),
            F.concat(F.lit('{"part":'), F.col("l_partkey").cast("string"), F.lit("}")).alias("edited_payload"),
            F.col("l_shipdate").alias("created_at"),
        )

    # --- canonical knowledge -----------------------------------------------------------------
    def claims(self) -> DataFrame:
        """Line items as claims about an order: return flag is the predicate, ship mode the value."""
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"),
            F.lit(1).alias("owner_id"), F.col("l_orderkey").alias("subject_entity_id"),
            F.col("l_returnflag").alias("predicate"), F.col("l_linestatus").alias("object_value"),
            F.when(F.col("l_discount") > 0.09, "superseded").otherwise("active").alias("status"),
            F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_partkey").alias("source_proposal_id"),
            F.col("l_shipdate").alias("created_at"),
        )

    def part_claims(self) -> DataFrame:
        """Claims about a part across all orders: few topics, many claims each."""
        return self.claims().withColumn("subject_entity_id", F.lit(None).cast("bigint"))

    def entities(self) -> DataFrame:
        """Parts as entities; the brand owns them."""
        return spread(self.raw("part")).select(
            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_brand").alias("owner_id"),
            F.lower("p_type").alias("entity_type"), F.col("p_name").alias("canonical_name"),
            F.array(F.concat_ws(" ", F.lower("p_type"), F.col("p_name"))).alias("aliases"),
            F.lit(None).cast("string").alias("description"), F.lit("active").alias("status"),
            F.lit(None).cast("string").alias("source_proposal_id"),
            F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        )

    # --- graph -------------------------------------------------------------------------------
    def nodes(self) -> DataFrame:
        def of(table: str, prefix: str, key: str, label: str, kind: str) -> DataFrame:
            return self.raw(table).select(
                F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"),
                F.col(label).cast("string").alias("label"),
            )

        return (
            of("region", "r", "r_regionkey", "r_name", "entity").unionByName(of("nation", "n", "n_nationkey", "n_name", "entity"))
            .unionByName(of("supplier", "s", "s_suppkey", "s_name", "entity"))
            .unionByName(of("customer", "c", "c_custkey", "c_name", "entity"))
            .unionByName(of("orders", "o", "o_orderkey", "o_orderstatus", "claim"))
        )

    def edges(self) -> DataFrame:
        def of(table: str, sp: str, s: str, dp: str, d: str, kind: str) -> DataFrame:
            src = F.concat(F.lit(sp), F.col(s).cast("string"))
            dst = F.concat(F.lit(dp), F.col(d).cast("string"))
            return self.raw(table).select(
                F.concat_ws(">", src, dst).alias("edge_id"), src.alias("src"), dst.alias("dst"),
                F.lit(kind).alias("edge_type"), F.lit(1).alias("owner_id"),
            )

        return (
            of("nation", "n", "n_nationkey", "r", "n_regionkey", "IN_REGION")
            .unionByName(of("supplier", "s", "s_suppkey", "n", "s_nationkey", "IN_NATION"))
            .unionByName(of("customer", "c", "c_custkey", "n", "c_nationkey", "IN_NATION"))
            .unionByName(of("orders", "c", "o_custkey", "o", "o_orderkey", "HAS_CLAIM"))
        )

    # --- operations --------------------------------------------------------------------------
    def outbox(self) -> DataFrame:
        """Events as outbox rows: purchases and signups carry a complete payload, errors a broken one."""
        kind, uid = F.col("event_type"), F.col("user_id").cast("string")
        entity = F.to_json(F.struct(
            uid.alias("entity_id"), F.lit("1").alias("owner_id"), F.lit("person").alias("entity_type"),
            F.concat(F.lit("user "), uid).alias("canonical_name")))
        claim = F.to_json(F.struct(
            F.col("event_id").cast("string").alias("claim_id"), F.lit("1").alias("owner_id"),
            uid.alias("subject_entity_id"), F.lit("bought").alias("predicate"),
            F.col("value").cast("string").alias("object_value")))
        relation = F.to_json(F.struct(
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("relationship_id"), F.lit("1").alias("owner_id"),
            uid.alias("source_entity_id"), F.get_json_object("props", "$.k").alias("target_entity_id"),
            F.lit("works-with").alias("relationship_type")))
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            F.when(kind == "signup", "entity.materialized").when(kind == "purchase", "claim.materialized")
            .when(kind == "view", "relationship.materialized").when(kind == "error", "claim.materialized")
            .otherwise("entity.alias_added").alias("event_type"),
            F.when(kind == "signup", entity).when(kind == "purchase", claim).when(kind == "view", relation)
            .otherwise(F.col("props")).alias("payload"),
            F.when(F.col("value") > 100, "processed").otherwise("pending").alias("status"),
            F.lit(0).alias("retry_count"), F.col("ts").alias("created_at"),
        )


def joined(c: Column | str, sep: str = "|") -> Column:
    """Array as text, for flat comparable outputs."""
    return F.array_join(c, sep, "")
