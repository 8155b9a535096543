"""Users and what they may do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("is_admin", "can_frontend", "can_skill", "can_upload", "can_assets", "can_test")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def may(permission: Column) -> Column:
    """Whether a user (the flag columns) has a permission.

    An administrator has all. Uploading and testing also need the frontend, the frontend includes what skills may read.
    """
    front = _flag("can_frontend")
    return (
        F.when(_flag("is_admin"), True)
        .when(permission == "frontend", front)
        .when(permission == "skill", front | _flag("can_skill"))
        .when(permission == "upload", front & _flag("can_upload"))
        .when(permission == "assets", _flag("can_assets"))
        .when(permission == "test", front & _flag("can_test"))
        .otherwise(False)
    )


def permission_matrix(users: DataFrame, permissions: tuple[str, ...] = ("admin", "frontend", "skill", "upload", "assets", "test")) -> DataFrame:
    """(user, permission, allowed) for all users."""
    return users.withColumn("permission", F.explode(F.array(*(F.lit(p) for p in permissions)))).select("user", "permission", may(F.col("permission")).alias("allowed"))


# Path prefixes and the permissions they need; whole paths that skills read.
PREFIXES = (
    ("/api/v1/users", "admin"),
    ("/api/v1/fs", "assets"),
    ("/api/v1/docs", "assets"),
    ("/api/v1/import", "upload"),
    ("/api/v1/export", "upload"),
    ("/api/v1/tests", "test"),
)
WHOLE_PATHS = (("/api/v1/domains", "skill"), ("/api/v1/md", "skill"))


def required_permission(path: Column) -> Column:
    """The permission that a request path needs; null for public ones: the login and all that is not below ``/api/``."""
    found = F.when(~path.startswith("/api/") | (path == "/api/v1/users/login"), F.lit(None).cast("string"))
    for prefix, permission in PREFIXES:
        found = found.when(path.startswith(prefix), permission)
    for whole, permission in WHOLE_PATHS:
        found = found.when(path == whole, permission)
    return found.otherwise("frontend")


def user_rows(users: DataFrame) -> DataFrame:
    """Users with all flags as booleans; a missing assets flag is the administrator's."""
    flags = {f: _flag(f) for f in FLAGS if f in users.columns}
    if "can_assets" in users.columns:
        flags["can_assets"] = F.coalesce(F.col("can_assets").cast("boolean"), _flag("is_admin"))
    return users.withColumns(flags)


def by_key(users: DataFrame, key: str) -> DataFrame:
    return users.where(F.col("key") == key)


def authenticate(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (path, key) with user, permission, status (``public``, ``unknown key``, ``forbidden`` or ``ok``) and caller.

    The caller follows from what the user may do, not from what the request says.
    """
    known = users.select("key", F.col("username").alias("user"), *(_flag(f).alias(f) for f in FLAGS if f in users.columns))
    joined = requests.withColumn("permission", required_permission(F.col("path"))).join(known, "key", "left")
    status = F.when(F.col("permission").isNull(), "public").when(F.col("user").isNull(), "unknown key").when(may(F.col("permission")), "ok").otherwise("forbidden")
    caller = F.when(F.col("user").isNull(), None).when(_flag("can_frontend"), "web").otherwise("skill")
    return joined.select(*requests.columns, "permission", "user", status.alias("status"), caller.alias("caller"))


def put_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users with those of ``new``, which replace users of their names; a missing column keeps what was known, else is false."""
    columns = [c for c in users.columns if c != "username"]
    both = users.alias("o").join(new.alias("n"), "username", "full_outer")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return both.select("username", *((F.coalesce(value(c), F.lit(False)) if c in FLAGS else value(c)).alias(c) for c in columns))


def drop_users(users: DataFrame, names: DataFrame) -> DataFrame:
    return users.join(names.select("username").distinct(), "username", "left_anti")


def migrate_users(users: DataFrame) -> DataFrame:
    """Users of an older table: missing flags are added as false, and administrators get the assets flag."""
    for flag in FLAGS:
        users = users.withColumn(flag, _flag(flag) if flag in users.columns else F.lit(False))
    return users.withColumn("can_assets", F.col("can_assets") | F.col("is_admin"))
