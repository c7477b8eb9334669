"""The tables of the knowledge base, and how they are made when there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sink

VECTOR = "array<float>"
COORDINATES = "struct<ymin:int,xmin:int,ymax:int,xmax:int>"
METADATA = f"struct<coordinates:{COORDINATES},trust_zone:string,labels_on_diagram:array<string>,source:string>"
# Names and types of the columns.
TABLES = {
    "security_requirements": f"id string, job_id string, category string, title string, actionable_rule string, parent_id string, embedding {VECTOR}, created_at timestamp",
    "tsd_documents": "id string, title string",
    "document_nodes": f"id string, document_id string, text_content string, layer int, parent_id string, embedding {VECTOR}",
    "architecture_entities": f"id string, document_id string, name string, entity_type string, description string, embedding {VECTOR}, spatial_metadata {METADATA}",
    "architecture_edges": "id string, source_id string, target_id string, relation_type string, description string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def bootstrap(spark: SparkSession, root: str) -> list[str]:
    """Make the tables below ``root`` that are not there yet; their names."""
    made = [n for n in TABLES if not sink.versions(spark, f"{root}/{n}")]
    for n in made:
        sink.commit(empty(spark, n), f"{root}/{n}")
    return made


def stamped(d: DataFrame) -> DataFrame:
    """With the time of the job as created_at."""
    return d.withColumn("created_at", F.current_timestamp())
