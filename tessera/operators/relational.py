"""Membership, role and property queries over any tables of that shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Inner join of two tables by a bridge table; Spark picks the side to broadcast by its size."""
    return left.join(bridge, left_on).join(right, right_on)


def holders(users: DataFrame, members: DataFrame, grants: DataFrame, user_key: str, group_key: str) -> DataFrame:
    """Users that hold a grant through any group, each once: a semi-join, so no pair of membership and grant is
    made and nothing needs to be made distinct."""
    return users.join(members.join(grants, group_key, "left_semi"), user_key, "left_semi")


def member_counts(groups: DataFrame, members: DataFrame, key: str, member: str, name: str = "members") -> DataFrame:
    """Every group with its number of members, 0 for none; members are counted before they are joined."""
    counted = members.groupBy(key).agg(F.count(member).alias(name))
    return groups.join(counted, key, "left").fillna(0, [name])


def groups_of_member(groups: DataFrame, members: DataFrame, key: str, member: str, who: Column, name: str = "members") -> DataFrame:
    """The groups that a member is in, with the number of all their members."""
    return member_counts(groups.join(members.where(who), key, "left_semi"), members.join(members.where(who).select(key).distinct(), key, "left_semi"), key, member, name)


def effective(users: DataFrame, user_key: str, *ways: DataFrame) -> DataFrame:
    """Users that any of the ways (each with the user's key) leads to: a semi-join with their union."""
    keys = ways[0].select(user_key)
    for way in ways[1:]:
        keys = keys.union(way.select(user_key))
    return users.join(keys, user_key, "left_semi")


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row: whether any row meets the condition."""
    return df.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def folded_properties(owners: DataFrame, properties: DataFrame, key: str, name: str, value: str, out: str = "properties") -> DataFrame:
    """Every owner with its properties as a map in name order, an empty one for none. Of a name's several values the
    smallest is taken."""
    one = properties.groupBy(key, name).agg(F.min(value).alias("_v"))
    folded = one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("_v"))))).alias(out))
    kind = folded.schema[out].dataType
    return owners.join(folded, key, "left").withColumn(out, F.coalesce(F.col(out), F.create_map().cast(kind)))


def next_order(df: DataFrame, scope: Sequence[str], order: str) -> DataFrame:
    """The next free order number of each scope: one beyond the largest, 0 for none."""
    return df.groupBy(*scope).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_order"))


def policy(entries: DataFrame, identities: DataFrame, classes: DataFrame, sids: DataFrame) -> DataFrame:
    """Roles by domain, component and action from access entries: granting entries of roles, masks decoded with what
    they imply. entries: object_id, sid_id, mask, granting; identities: object_id, class_id, component; classes:
    class_id, domain; sids: sid_id, sid, principal. As each bit implies what it does whatever else is set, a role's masks
    are put together before they are decoded."""
    from tessera.functions import access

    rows = entries.where("granting").join(identities, "object_id").join(classes, "class_id").join(sids.where("not principal"), "sid_id")
    masks = rows.groupBy("domain", "component", "sid").agg(F.bit_or("mask").alias("mask"))
    acts = masks.select("domain", "component", F.explode(access.actions(F.col("mask"))).alias("action"), access.role_name(F.col("sid")).alias("role"))
    return acts.groupBy("domain", "component", "action").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def overlay(base: DataFrame, later: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two policies as one: the later one's values win where they aren't null."""
    b = later.withColumnsRenamed({v: f"_{v}" for v in values})
    joined = base.join(b, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"_{v}"), F.col(v)).alias(v) for v in values])


def with_fallback(policy_rows: DataFrame, action: str = "write", other: str = "read") -> DataFrame:
    """The policy, and for each domain and component without roles for ``action`` those of ``other`` in their place."""
    own = policy_rows.where((F.col("action") == action) & (F.size("roles") > 0)).select("domain", F.coalesce("component", F.lit("")).alias("_c")).distinct()
    read = policy_rows.where(F.col("action") == other).withColumn("_c", F.coalesce("component", F.lit("")))
    taken = read.join(own, ["domain", "_c"], "left_anti").withColumn("action", F.lit(action)).select(*policy_rows.columns)
    return policy_rows.where((F.col("action") != action) | (F.size("roles") > 0)).unionByName(taken)


def allowed(policy_rows: DataFrame, roles: DataFrame) -> DataFrame:
    """user, domain, component, action: what users may do; ``*`` for the role ADMIN, which may do all.
    roles: user, role."""
    rows = policy_rows.withColumn("role", F.explode("roles")).drop("roles")
    by_role = rows.join(roles.where("role <> 'ADMIN'"), "role").select("user", "domain", "component", "action")
    admins = roles.where("role = 'ADMIN'").select("user", F.lit("*").alias("domain"), F.lit(None).cast("string").alias("component"), F.lit("*").alias("action"))
    return by_role.union(admins).distinct()
