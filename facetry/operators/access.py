"""Access decisions by role, modality and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded


def decide(requests: DataFrame, grants: DataFrame, acl: DataFrame) -> DataFrame:
    """requests (client, role, modality, entity_id, permission, ...) with ``allowed`` and ``reason``: their audit log.

    A permission comes from the role everywhere (a grant without modality), from the role for the modality, or from the
    entity's own list. grants: (role, modality, permission), broadcast while small; acl: (entity_id, client, permission).
    """
    every = grants.where("modality is null").select("role", "permission").distinct().withColumn("by_role", F.lit(True))
    some = grants.where("modality is not null").distinct().withColumn("by_modality", F.lit(True))
    own = acl.select("entity_id", "client", "permission").distinct().withColumn("by_entity", F.lit(True))
    x = requests.join(bounded(every), ["role", "permission"], "left").join(bounded(some), ["role", "modality", "permission"], "left").join(own, ["entity_id", "client", "permission"], "left")
    reason = F.when(F.col("by_role"), "global").when(F.col("by_modality"), "modality").when(F.col("by_entity"), "entity").otherwise("denied")
    return x.withColumn("reason", reason).withColumn("allowed", reason != "denied").drop("by_role", "by_modality", "by_entity")
