"""Cloud inventories: Kubernetes manifests and posture findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import k8s_public

SERVICE = "file_path string, kind string, namespace string, name string, service_type string, has_ingress boolean"


def kubernetes(files: DataFrame) -> DataFrame:
    """Services and ingresses of YAML files with several documents; documents that do not parse are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            rows = []
            for path, text in zip(b["file_path"], b["text"]):
                for part in (text or "").split("\n---"):
                    try:
                        doc = yaml.safe_load(part)
                    except yaml.YAMLError:
                        continue
                    if not isinstance(doc, dict) or doc.get("kind") not in ("Service", "Ingress"):
                        continue
                    meta, spec = doc.get("metadata") or {}, doc.get("spec") or {}
                    if not meta.get("name"):
                        continue
                    ingress = doc["kind"] == "Ingress" and bool(spec.get("rules"))
                    rows.append((path, doc["kind"], meta.get("namespace") or "default", meta["name"], spec.get("type"), ingress))
            yield pd.DataFrame(rows, columns=["file_path", "kind", "namespace", "name", "service_type", "has_ingress"])

    found = files.select("file_path", "text").mapInPandas(run, SERVICE)
    return found.withColumn("public", k8s_public("service_type", "has_ingress"))


def cspm(documents: DataFrame) -> DataFrame:
    """Posture findings of JSON arrays (json); those without a resource_id are left out."""
    kind = "array<struct<resource_id:string,resource_name:string,internet_facing:boolean,severity:string,tags:map<string,string>>>"
    rows = documents.select(F.explode(F.from_json("json", kind)).alias("r")).select("r.*").where("resource_id is not null")
    return rows.select(
        "resource_id", F.coalesce("resource_name", "resource_id").alias("name"), F.coalesce("internet_facing", F.lit(False)).alias("public"), "severity", "tags"
    )
