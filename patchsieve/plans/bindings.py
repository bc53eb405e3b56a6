"""The driver tables seen as changes, files and repositories, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ = ["line", "part", "supp"]

FILES_SQL = """files AS (
  SELECT l_orderkey AS cid, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
         CAST(l_quantity AS BIGINT) AS added, CAST(round(l_tax * 100) AS BIGINT) AS deleted,
         CAST(round(l_discount * 100) AS BIGINT) AS hunks,
         CAST(l_quantity AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) AS total,
         l_returnflag = 'R' AS positive, l_discount = 0 AS excluded, l_extendedprice AS price
  FROM lineitem)"""

REPO_FILES_SQL = FILES_SQL + """, repo_files AS (
  SELECT files.*, c_nationkey AS repo, o_orderdate AS ts, o_orderpriority AS priority
  FROM files JOIN orders ON cid = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

# scores of the flagship ranking
RANKED_SQL = FILES_SQL + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY excluded, CASE WHEN NOT excluded THEN total END DESC, line, part, supp) - 1 AS position,
         count(*) FILTER (NOT excluded) OVER (PARTITION BY cid) AS n_ranked FROM files),
ranked AS (
  SELECT *, CASE WHEN excluded THEN 0.0 ELSE 1.0 - position / greatest(n_ranked - 1, 1)::DOUBLE END AS score
  FROM numbered)"""


def files(t, also: dict[str, Column] | None = None) -> DataFrame:
    """The lines as files, with the columns named in ``also`` beside."""
    c = F.col
    return t.lineitem.select(
        c("l_orderkey").alias("cid"), c("l_linenumber").alias("line"),
        c("l_partkey").alias("part"), c("l_suppkey").alias("supp"),
        c("l_quantity").cast("long").alias("added"),
        F.round(c("l_tax") * 100).cast("long").alias("deleted"),
        F.round(c("l_discount") * 100).cast("long").alias("hunks"),
        (c("l_quantity").cast("long") + F.round(c("l_tax") * 100).cast("long")).alias("total"),
        (c("l_returnflag") == "R").alias("positive"),
        (c("l_discount") == 0).alias("excluded"),
        c("l_extendedprice").alias("price"),
        *[column.alias(name) for name, column in (also or {}).items()],
    )


def repo_files(t, also: dict[str, Column] | None = None) -> DataFrame:
    """Files with the repository (customer nation) and the time of their change."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = t.customer.select("c_custkey", "c_nationkey")
    changes = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("cid"), F.col("c_nationkey").alias("repo"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("priority"),
    )
    base = files(t, also)
    return base.join(changes, "cid").select(*base.columns, "repo", "ts", "priority")
