"""Queries of the ontology's hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.ids import term_id
from termweave.operators import hierarchy as H
from termweave.session import table


def ontology_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the table ontology."""
    parents = F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda x: term_id(x))
    return H.parent_edges(table(spark, folder, "ontology"), term_id(F.col("id")), parents)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with every term reached from it."""
    return H.closure(ontology_graph(spark, folder)[1]).select(F.col("src").alias("id"), F.col("dst").alias("ancestor_id"))


def p4_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Depth, path, roots and loop mark of every term."""
    rows = H.hierarchy(*ontology_graph(spark, folder)).withColumnRenamed("node", "id")
    return rows.withColumn("path", F.array_join("path", ">")).withColumn("roots", F.array_join("roots", ","))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every link of every path: a term, a parent and a root that the parent is or leads to."""
    nodes, edges = ontology_graph(spark, folder)
    links = H.path_links(nodes, edges)
    return links.select(F.col("src").alias("id"), F.col("dst").alias("parent_id"), F.col("root").alias("root_id"))


GRAPH = """
rows_ AS (SELECT upper(trim(id, ' ')) AS id, parents FROM ontology WHERE trim(id, ' ') <> ''),
nodes_ AS (SELECT DISTINCT id FROM rows_),
edges_ AS (SELECT DISTINCT e.id, e.parent FROM (SELECT id, upper(trim(unnest(parents), ' ')) AS parent FROM rows_) e JOIN nodes_ n ON n.id = e.parent),
reach_ AS (SELECT id, parent AS ancestor_id FROM edges_ UNION SELECT r.id, e.parent FROM reach_ r JOIN edges_ e ON e.id = r.ancestor_id)
"""
ORACLE = {
    "p4_found": f"WITH RECURSIVE {GRAPH} SELECT id, ancestor_id FROM reach_",
    "p4_hierarchy": f"""WITH RECURSIVE {GRAPH},
roots_ AS (SELECT id FROM nodes_ WHERE id NOT IN (SELECT id FROM edges_)),
down_ AS (SELECT id, 0 AS depth FROM roots_ UNION SELECT e.id, d.depth + 1 FROM down_ d JOIN edges_ e ON e.parent = d.id WHERE d.depth < 200),
depths_ AS (SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM down_ GROUP BY id),
first_ AS (SELECT e.id, min(e.parent) AS parent FROM edges_ e JOIN depths_ c ON c.id = e.id JOIN depths_ p ON p.id = e.parent AND p.depth = c.depth - 1 GROUP BY e.id),
paths_ AS (SELECT id, id AS path FROM roots_ UNION ALL SELECT f.id, p.path || '>' || f.id FROM paths_ p JOIN first_ f ON f.parent = p.id)
SELECT n.id, d.depth, p.path,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT r.ancestor_id AS x FROM reach_ r JOIN roots_ t ON t.id = r.ancestor_id WHERE r.id = n.id UNION SELECT t.id FROM roots_ t WHERE t.id = n.id)), '') AS roots,
 (SELECT count(*) FROM reach_ r WHERE r.id = n.id) AS n_ancestors,
 (SELECT count(*) FROM reach_ r WHERE r.ancestor_id = n.id) AS n_descendants,
 EXISTS (SELECT 1 FROM reach_ r WHERE r.id = n.id AND r.ancestor_id = n.id) AS on_loop
FROM nodes_ n LEFT JOIN depths_ d ON d.id = n.id LEFT JOIN paths_ p ON p.id = n.id""",
    "p4_links": f"""WITH RECURSIVE {GRAPH},
roots_ AS (SELECT id FROM nodes_ WHERE id NOT IN (SELECT id FROM edges_)),
led_ AS (SELECT id, ancestor_id AS root_id FROM reach_ WHERE ancestor_id IN (SELECT id FROM roots_) UNION SELECT id, id FROM roots_)
SELECT e.id, e.parent AS parent_id, l.root_id FROM edges_ e JOIN led_ l ON l.id = e.parent""",
}
QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_links": p4_links}
