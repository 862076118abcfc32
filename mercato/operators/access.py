"""Identity and access as table jobs.

The reference answers "may actor X see merchant Y?" one request at a time with
an EXISTS query.  Here the same rule is a join: role rows are reduced to one
row per actor (admin flag, tenant where the actor holds the merchant role), and
requests are joined to that on ``actor_id`` (a high-cardinality key, so no hot
partition even when one tenant holds most requests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.cols import first_reason
from mercato.functions.names import first_name, full_name, last_name

# Role types created for every merchant, and the role text pattern.
DEFAULT_ROLE_TYPES = ("merchant", "employee", "customer")
ROLE_DESCRIPTION_SUFFIX = " role"


def actor_roles_flat(actors: DataFrame, actor_roles: DataFrame) -> DataFrame:
    """A1: one row per actor with its role (NULL when it has none).

    Roles count only in the actor's own tenant (the reference joins roles on the
    actor's merchant).
    """
    a = actors.select(F.col("id").alias("actor_id"), "merchant_id")
    r = actor_roles.select("actor_id", "merchant_id", "role_type")
    return a.join(r, ["actor_id", "merchant_id"], "left")


def role_flags(actors: DataFrame, actor_roles: DataFrame) -> DataFrame:
    """Per actor: ``is_admin`` (admin anywhere) and ``merchant_role_of`` (tenant with merchant role)."""
    flat = actor_roles_flat(actors, actor_roles)
    return flat.groupBy("actor_id").agg(
        F.max(F.coalesce(F.col("role_type") == "admin", F.lit(False))).alias("is_admin"),
        F.max(F.when(F.col("role_type") == "merchant", F.col("merchant_id"))).alias("merchant_role_of"),
        F.max(F.when(F.col("role_type") == "customer", F.col("merchant_id"))).alias("customer_role_of"),
        F.first("merchant_id").alias("actor_merchant_id"),
    )


def can_view(requests: DataFrame, flags: DataFrame, actor_col: str = "actor_id", merchant_col: str = "merchant_id") -> DataFrame:
    """A2: add ``can_view`` / ``can_manage`` to (actor, target merchant) requests.

    Admin in any tenant, or merchant role in the target tenant.  Viewing and
    managing use the same rule in the reference.
    """
    f = flags.select(F.col("actor_id").alias("_actor"), "is_admin", "merchant_role_of")
    j = requests.join(f, requests[actor_col] == f["_actor"], "left")
    allowed = F.coalesce(F.col("is_admin"), F.lit(False)) | F.coalesce(F.col("merchant_role_of") == F.col(merchant_col), F.lit(False))
    return j.withColumn("can_view", allowed).withColumn("can_manage", allowed).drop("_actor", "is_admin", "merchant_role_of")


def actor_profiles(actors: DataFrame) -> DataFrame:
    """Actor rows with ``full_name`` = trim(first || ' ' || last)."""
    return actors.select(
        "merchant_id", F.col("id").alias("uid"), "email",
        full_name("first_name", "last_name").alias("full_name"), "is_active",
    )


def employees(actors: DataFrame, actor_roles: DataFrame, role_type: str = "employee") -> DataFrame:
    """Actors holding ``role_type`` in their tenant.

    A semi join replaces the reference's DISTINCT over a three-way join: the
    actor id is unique, so no de-duplication shuffle is needed.
    """
    roles = actor_roles.filter(F.col("role_type") == role_type).select(F.col("actor_id").alias("id"), "merchant_id")
    return actor_profiles(actors.join(roles, ["id", "merchant_id"], "left_semi"))


def split_full_name(df: DataFrame, name_col: str = "full_name") -> DataFrame:
    """A4: first word and the remaining words (whitespace collapsed)."""
    return df.withColumn("first_name", first_name(name_col)).withColumn("last_name", last_name(name_col))


def bootstrap_candidates(merchants: DataFrame, actors: DataFrame) -> DataFrame:
    """A5: merchants that have no actor yet."""
    return merchants.join(actors.select("merchant_id").withColumnRenamed("merchant_id", "id"), "id", "left_anti")


def ensure_default_roles(merchants: DataFrame, existing_roles: DataFrame) -> DataFrame:
    """(merchant, role_type) rows still missing among the default role types.

    The three role types are generated per merchant with ``explode`` (no join to
    a constant table), then existing roles are removed with an anti join.
    """
    wanted = merchants.select(
        F.col("id").alias("merchant_id"), F.explode(F.array(*[F.lit(t) for t in DEFAULT_ROLE_TYPES])).alias("role_type")
    )
    have = existing_roles.select("merchant_id", "role_type")
    missing = wanted.join(have, ["merchant_id", "role_type"], "left_anti")
    return missing.withColumn("description", F.concat(F.col("role_type"), F.lit(ROLE_DESCRIPTION_SUFFIX)))


def classify_sessions(attempts: DataFrame, sessions: DataFrame, actors: DataFrame, as_of) -> DataFrame:
    """State of each refresh attempt, first failing check wins.

    ``attempts`` has (attempt_id, session_id, email, refresh_token).  Checks in
    the reference's order: not_found, blocked, actor_mismatch, token_mismatch,
    expired; otherwise ok.  The session's actor e-mail comes from a left join
    (guest sessions have none, i.e. '').
    """
    s = sessions.alias("s").join(
        actors.select(F.col("id").alias("_aid"), F.col("merchant_id").alias("_amid"), F.col("email").alias("actor_email")),
        (F.col("s.actor_id") == F.col("_aid")) & (F.col("s.merchant_id") == F.col("_amid")),
        "left",
    ).select(
        F.col("s.id").alias("session_id"), F.col("is_blocked"), F.col("refresh_token").alias("session_token"),
        F.col("expires_at"), F.coalesce("actor_email", F.lit("")).alias("actor_email"),
    )
    j = attempts.join(s, "session_id", "left")
    state = F.coalesce(
        first_reason(
            (F.col("session_token").isNull(), "not_found"),
            (F.col("is_blocked"), "blocked"),
            (F.col("actor_email") != F.col("email"), "actor_mismatch"),
            (F.col("session_token") != F.col("refresh_token"), "token_mismatch"),
            (F.lit(as_of).cast("timestamp") > F.col("expires_at"), "expired"),
        ),
        F.lit("ok"),
    )
    return j.select("attempt_id", "session_id", state.alias("state"))


def visible_orders(requests: DataFrame, orders: DataFrame, flags: DataFrame) -> DataFrame:
    """May ``viewer_id`` see ``order_id``?

    Admins see any order; others only find orders of their own tenant, and then
    need the merchant role there or to be the order's actor.
    """
    f = flags.select(F.col("actor_id").alias("viewer_id"), "is_admin", "merchant_role_of", "actor_merchant_id")
    o = orders.select(F.col("id").alias("order_id"), F.col("merchant_id").alias("order_merchant_id"),
                      F.col("actor_id").alias("order_actor_id"))
    j = requests.select("viewer_id", "order_id").join(f, "viewer_id", "left").join(o, "order_id", "left")
    admin = F.coalesce(F.col("is_admin"), F.lit(False))
    reason = first_reason(
        (F.col("actor_merchant_id").isNull(), "viewer_not_found"),
        (F.col("order_merchant_id").isNull(), "not_found"),
        (~admin & (F.col("order_merchant_id") != F.col("actor_merchant_id")), "not_found"),
        (~admin & ~F.coalesce(F.col("merchant_role_of") == F.col("order_merchant_id"), F.lit(False))
         & ~F.coalesce(F.col("order_actor_id") == F.col("viewer_id"), F.lit(False)), "forbidden"),
    )
    return j.select("viewer_id", "order_id", reason.isNull().alias("visible"), reason.alias("reason"))


# Roles an actor may be created with.
ACTOR_ROLES = ("merchant", "employee", "customer")


def validate_actor_batch(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(merchant_id, full_name, email, password, role) rows get a ``reason`` or NULL.

    required name and e-mail, e-mail format, role in the set (trimmed, lower
    case), password required unless the role is customer, (merchant, email)
    unique within the batch and against ``existing`` actors.
    """
    from mercato.operators.quality import EMAIL_PATTERN

    role = F.lower(F.trim(F.col("role")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    dup_in_batch = batch.groupBy("merchant_id", "email").agg(F.count(F.lit(1)).alias("_n"))
    j = batch.join(dup_in_batch, ["merchant_id", "email"], "left")
    if existing is not None:
        ex = existing.select("merchant_id", "email").distinct().withColumn("_exists", F.lit(True))
        j = j.join(ex, ["merchant_id", "email"], "left")
    else:
        j = j.withColumn("_exists", F.lit(None).cast("boolean"))
    reason = first_reason(
        (blank("full_name") | blank("email"), "required"),
        (~F.col("email").rlike(EMAIL_PATTERN), "invalid_email"),
        (~F.coalesce(role.isin(*ACTOR_ROLES), F.lit(False)), "invalid_role"),
        ((role != "customer") & blank("password"), "password_required"),
        (F.coalesce(F.col("_exists"), F.lit(False)) | (F.col("_n") > 1), "duplicate_email"),
    )
    return j.withColumn("reason", reason).drop("_n", "_exists")
