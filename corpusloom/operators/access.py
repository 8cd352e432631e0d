"""Who may read which collection: grants joined to principals, before anything is ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles in rising order, and the role each action needs.
ROLES = ("viewer", "editor", "owner")
NEEDS = {"read": "viewer", "write": "editor", "manage": "owner"}


def role_rank(role: Column) -> Column:
    """1, 2, 3 for the roles; 0 for none."""
    rank = F.lit(0)
    for k, name in enumerate(ROLES, 1):
        rank = F.when(role == name, k).otherwise(rank)
    return rank


def group_names(claims: Column) -> Column:
    """Sorted distinct groups; of a path that starts with a slash the last part."""
    last = lambda g: F.when(g.startswith("/"), F.element_at(F.split(g, "/"), -1)).otherwise(g)
    return F.array_sort(F.array_distinct(F.transform(claims, last)))


def readable(principals: DataFrame, grants: DataFrame, collections: DataFrame) -> DataFrame:
    """sub, collection_id, role: the highest role of each principal in each collection it may read.

    principals: sub, groups, is_admin. A principal becomes rows of (type, id), so that grants meet
    them by equality and not by an OR. An admin owns every collection."""
    own = principals.select("sub", F.lit("user").alias("principal_type"), F.col("sub").alias("principal_id"))
    groups = principals.select("sub", F.lit("group").alias("principal_type"), F.explode("groups").alias("principal_id"))
    granted = own.unionByName(groups).join(grants, ["principal_type", "principal_id"]).select("sub", "collection_id", "role")
    admins = principals.where("is_admin").select("sub").join(collections.select("collection_id"), F.lit(True)).select("sub", "collection_id", F.lit("owner").alias("role"))
    return granted.unionByName(admins).groupBy("sub", "collection_id").agg(F.max_by("role", role_rank(F.col("role"))).alias("role"))


def can(role: Column, action: Column) -> Column:
    needed = F.lit(99)
    for name, least in NEEDS.items():
        needed = F.when(action == name, ROLES.index(least) + 1).otherwise(needed)
    return role_rank(role) >= needed


def outcome(role: Column, action: Column) -> Column:
    """404 without a role, 403 with too low a one, else 200."""
    return F.when(role.isNull(), 404).when(~can(role, action), 403).otherwise(200)


def last_grants(grants: DataFrame, place: str = "place") -> DataFrame:
    """Of the grants to one principal on one collection the last by `place`."""
    last = Window.partitionBy("collection_id", "principal_type", "principal_id").orderBy(F.desc(place))
    return grants.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def owners_left(grants: DataFrame) -> DataFrame:
    """collection_id, has_owner: whether the grants (collection_id, role) of each collection leave it an owner, as those that anyone
    but an admin sets must."""
    return grants.groupBy("collection_id").agg(F.bool_or(F.col("role") == "owner").alias("has_owner"))


def narrowed(allowed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The allowed collections that were asked for; never more than the allowed ones."""
    return allowed.join(wanted, ["sub", "collection_id"], "left_semi")
