"""Audit of packages from a listing of their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t


#: Positions of one block of running sums.
BLOCK = 4096


def running_size(members: DataFrame) -> DataFrame:
    """members plus running, the expanded bytes up to and with each member: totals of earlier blocks of pos, and the sum inside the block."""
    rows = members.withColumn("block", F.floor(F.col("pos") / BLOCK))
    totals = rows.groupBy(F.col("package").alias("of"), F.col("block").alias("nth")).agg(F.sum("file_size").alias("total"))
    earlier = F.sum("total").over(Window.partitionBy("of").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("file_size").over(Window.partitionBy("package", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("inside", inside).join(totals.select("of", "nth", earlier.alias("earlier")), F.col("package").eqNullSafe(F.col("of")) & F.col("block").eqNullSafe(F.col("nth")))
    running = F.coalesce(F.col("earlier") + F.col("inside"), "inside", "earlier")
    return joined.select(*members.columns, running.alias("running"))


def excessive(ratio: Column | float) -> Column:
    """Whether a member expands by more than the ratio; data from no bytes always does."""
    return (F.col("file_size") > 0) & ((F.col("compress_size") == 0) | (F.col("file_size") / F.col("compress_size") > ratio))


def audit(members: DataFrame, max_members: int = t.MAX_MEMBERS, max_member: int = t.MAX_MEMBER_BYTES, max_total: int = t.MAX_TOTAL_BYTES, max_ratio: float = t.MAX_RATIO) -> DataFrame:
    """package, members, failure: the first rule that a package breaks, null for a sound one.

    In order: too many members; member by member encryption, size, running
    size, ratio; checks sums; required parts; a page; XML in the order of names.
    """
    rows = running_size(members)
    step = (
        F.when(F.col("flag_bits").bitwiseAND(1) != 0, F.struct(F.lit(1).alias("sub"), F.lit("encrypted").alias("rule")))
        .when(F.col("file_size") > max_member, F.struct(F.lit(2).alias("sub"), F.lit("member_size").alias("rule")))
        .when(F.col("running") > max_total, F.struct(F.lit(3).alias("sub"), F.lit("total_size").alias("rule")))
        .when(excessive(max_ratio), F.struct(F.lit(4).alias("sub"), F.lit("ratio").alias("rule")))
    )
    is_page = F.col("name").startswith("visio/pages/page") & F.col("name").endswith(".xml")
    is_xml = F.col("name").endswith(".xml") | F.col("name").endswith(".rels")
    required = F.array(*map(F.lit, sorted(t.REQUIRED_PARTS)))
    out = rows.withColumn("step", step).groupBy("package").agg(
        F.count("*").alias("members"),
        F.min_by("step.rule", F.when(F.col("step").isNotNull(), F.struct("pos", "step.sub"))).alias("step_rule"),
        F.min_by("name", F.when(~F.col("crc_ok"), F.col("pos"))).alias("corrupt"),
        F.array_except(required, F.collect_set(F.when(F.col("name").isin(*t.REQUIRED_PARTS), F.col("name")))).alias("missing"),
        F.bool_or(is_page).alias("has_page"),
        F.min(F.when(is_xml & ~F.col("xml_ok"), F.col("name"))).alias("malformed"),
    )
    failure = (
        F.when(F.col("members") > max_members, "members")
        .when(F.col("step_rule").isNotNull(), F.col("step_rule"))
        .when(F.col("corrupt").isNotNull(), F.concat(F.lit("corrupt: "), F.col("corrupt")))
        .when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", ")))
        .when(~F.col("has_page"), "no_page")
        .when(F.col("malformed").isNotNull(), F.concat(F.lit("malformed: "), F.col("malformed")))
    )
    return out.select("package", "members", failure.alias("failure"))
