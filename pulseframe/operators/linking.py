"""Identity bridges: participant <-> app user <-> store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.semantics import null_if_text_null, to_num


def not_deleted(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows whose soft-delete columns are NULL after mapping text markers
    ('NULL', 'None', '') to NULL."""
    cond = F.lit(True)
    for c in cols:
        if c in df.columns:
            cond = cond & null_if_text_null(c).isNull()
    return df.where(cond)


def active_flag(c: str):
    """``is_active`` is false for 0, false, nan, none (any case/format)."""
    s = F.lower(F.trim(F.col(c).cast("string")))
    return ~F.coalesce(s.isin("0", "0.0", "false", "nan", "none", ""), F.lit(True))


def store_names(stores: DataFrame) -> DataFrame:
    """(store_id, store_name) with the default name 'Store <id>' for blank names."""
    name = F.nullif(F.trim(F.col("name")), F.lit(""))
    return stores.select(F.col("id").alias("store_id"),
                         F.coalesce(name, F.concat(F.lit("Store "), F.col("id").cast("string"))).alias("store_name"))


def link_participant_store(participants: DataFrame, app_users: DataFrame, store_employees: DataFrame,
                           stores: DataFrame, drop_archived: bool = False,
                           drop_closed_stores: bool = False) -> DataFrame:
    """participant -> user (public_id = qe_participant_id) -> employment -> store.

    Deleted employments are dropped, archived ones and deleted or inactive
    stores only on request. NULL keys never match, and a participant employed by several stores keeps the
    smallest store id. The choice is a ``min`` aggregate (map-side combined),
    so a participant with a huge number of employment rows is reduced before
    the shuffle.
    """
    st = stores
    if drop_closed_stores:
        st = not_deleted(st, "deleted_at")
        if "is_active" in st.columns:
            st = st.where(active_flag("is_active"))
    names = store_names(st)
    emp = not_deleted(store_employees, "deleted_at", *(["archived_at"] if drop_archived else [])).select("user_id", "store_id").where(
        F.col("user_id").isNotNull() & F.col("store_id").isNotNull())
    emp = emp.join(names.select("store_id"), "store_id", "left_semi")
    p = participants.select(F.col("id").alias("participant_id"), "public_id").where(F.col("public_id").isNotNull())
    u = app_users.select("user_id", "qe_participant_id").where(F.col("qe_participant_id").isNotNull())
    bridge = p.join(u, p.public_id == u.qe_participant_id).select("participant_id", "user_id")
    per_p = bridge.join(emp, "user_id").groupBy("participant_id").agg(F.min("store_id").alias("store_id"))
    return per_p.join(names, "store_id").select("participant_id", "store_id", "store_name")


def link_participant_user(participants: DataFrame, app_users: DataFrame) -> DataFrame:
    """(participant_id, user_id): first (smallest) user per participant."""
    p = participants.select(F.col("id").alias("participant_id"), "public_id").where(F.col("public_id").isNotNull())
    u = app_users.select("user_id", "qe_participant_id").where(F.col("qe_participant_id").isNotNull()
                                                                & F.col("user_id").isNotNull())
    return (p.join(u, p.public_id == u.qe_participant_id)
             .groupBy("participant_id").agg(F.min("user_id").alias("user_id")))


def direct_store_links(participants: DataFrame, stores: DataFrame) -> DataFrame:
    """participant -> store from the participant's own store_id column."""
    names = store_names(stores)
    return (participants.select(F.col("id").alias("participant_id"), "store_id")
            .where(F.col("store_id").isNotNull())
            .join(names, "store_id").select("participant_id", "store_id", "store_name"))


def link_active_store(links: DataFrame | None, store_employees: DataFrame, stores: DataFrame) -> DataFrame:
    """One store per user: the smallest store id of the participant->store
    links when there are any; otherwise from employments that are neither
    deleted nor archived and point to an existing store."""
    if links is not None:
        return (links.select("user_id", "store_id").where(F.col("user_id").isNotNull() & F.col("store_id").isNotNull())
                .groupBy("user_id").agg(F.min("store_id").alias("store_id")))
    emp = not_deleted(store_employees, "deleted_at", "archived_at").select("user_id", "store_id").where(
        F.col("user_id").isNotNull() & F.col("store_id").isNotNull())
    emp = emp.join(stores.select(F.col("id").alias("store_id")), "store_id", "left_semi")
    return emp.groupBy("user_id").agg(F.min("store_id").alias("store_id"))


def link_store_routes(participants: DataFrame, app_users: DataFrame, store_employees: DataFrame) -> DataFrame:
    """participant -> store through three routes, in priority order:
    1. participants.user_id, 2. participants.public_id -> app user,
    3. participants.pmo_id -> app user id. NULLs are dropped and the first
    route (then the smallest store id) wins per participant."""
    emp = (store_employees.select("user_id", "store_id")
           .where(F.col("user_id").isNotNull() & F.col("store_id").isNotNull()).distinct())
    routes = []
    if "user_id" in participants.columns:
        r1 = participants.select(F.col("id").alias("participant_id"), "user_id").where(
            F.col("participant_id").isNotNull() & F.col("user_id").isNotNull())
        routes.append(r1.join(emp, "user_id").select("participant_id", "store_id", F.lit(1).alias("route")))
    if "public_id" in participants.columns and "qe_participant_id" in app_users.columns:
        p = participants.select(F.col("id").alias("participant_id"), "public_id").where(F.col("public_id").isNotNull())
        u = app_users.select("qe_participant_id", "user_id").where(F.col("user_id").isNotNull())
        r2 = p.join(u, p.public_id == u.qe_participant_id).select("participant_id", "user_id")
        routes.append(r2.join(emp, "user_id").select("participant_id", "store_id", F.lit(2).alias("route")))
    if "pmo_id" in participants.columns and "id" in app_users.columns:
        p = participants.select(F.col("id").alias("participant_id"), "pmo_id").where(F.col("pmo_id").isNotNull())
        u = app_users.select(F.col("id").alias("_app_id"), "user_id").where(F.col("user_id").isNotNull())
        r3 = p.join(u, p.pmo_id == u._app_id).select("participant_id", "user_id")
        routes.append(r3.join(emp, "user_id").select("participant_id", "store_id", F.lit(3).alias("route")))
    allr = routes[0]
    for r in routes[1:]:
        allr = allr.unionByName(r)
    best = allr.groupBy("participant_id").agg(F.min(F.struct("route", "store_id")).alias("_b"))
    return best.select("participant_id", F.col("_b.store_id").alias("store_id"), F.col("_b.route").alias("route"))


def store_fallback(participants: DataFrame, store_employees: DataFrame) -> DataFrame:
    """Participant store: its own store_id when any participant has one
    (table-wide, as the original decides), else the employment store of its
    user (smallest store id per user)."""
    link = (store_employees.select("user_id", "store_id").where(F.col("user_id").isNotNull()
                                                                 & F.col("store_id").isNotNull())
            .groupBy("user_id").agg(F.min("store_id").alias("_emp_store")))
    has_any = participants.agg((F.count("store_id") > 0).alias("_any_store"))
    p = participants.select(F.col("id").alias("participant_id"), F.coalesce("user_id", "id").alias("user_id"), "store_id")
    return (p.join(link, "user_id", "left").crossJoin(F.broadcast(has_any))  # one row
             .select("participant_id", "user_id",
                     F.when(F.col("_any_store"), F.col("store_id")).otherwise(F.col("_emp_store")).alias("store_id")))


# Address columns that enrichment adds (fixed values).
ADDRESS_COLUMNS = ("lat", "long", "city", "country", "postal_code")


def live_user_addresses(addresses: DataFrame, order: str = "id", newest: bool = True) -> DataFrame:
    """(app_user_id, address columns): the newest (largest ``order``) address
    of each user, or the oldest, of those that are not deleted and belong to a
    user. One ``max_by`` aggregate, combined map-side."""
    cols = [c for c in (*ADDRESS_COLUMNS, "first_name", "last_name") if c in addresses.columns]
    live = not_deleted(addresses, "deleted_at")
    if "model_type" in addresses.columns:
        live = live.where(F.col("model_type") == "user")
    live = live.select(to_num("model_id").cast("long").alias("app_user_id"), F.col(order).alias("_o"), *cols)
    pick = F.max_by if newest else F.min_by
    best = live.where(F.col("app_user_id").isNotNull()).groupBy("app_user_id").agg(pick(F.struct(*cols), "_o").alias("_a"))
    return best.select("app_user_id", "_a.*")


def enrich_address(rows: DataFrame, addresses: DataFrame, bridge: DataFrame | None = None, order: str = "id") -> DataFrame:
    """Rows LEFT the newest live address of their app user.

    The app user is ``user_id`` when that finds an address for any row (one
    decision for the whole table); else an ``app_user_id`` column with any
    value; else the user that ``bridge`` (public_id, app_user_id) names for
    the row's ``public_id`` (the smallest if several). Adds ``app_user_id``
    and the address columns, with ``_addr`` behind names the rows already
    have; NULL where nothing is found."""
    best = live_user_addresses(addresses, order).select("app_user_id", *[c for c in ADDRESS_COLUMNS if c in addresses.columns])
    own = F.col("app_user_id") if "app_user_id" in rows.columns else F.lit(None).cast("long")
    direct = to_num("user_id").cast("long") if "user_id" in rows.columns else F.lit(None).cast("long")
    x = rows.withColumns({"_direct": direct, "_own": own.cast("long")}).drop("app_user_id")
    hits = x.select("_direct").join(best.select(F.col("app_user_id").alias("_direct")), "_direct", "left_semi")
    rule = hits.agg((F.count(F.lit(1)) > 0).alias("_any_direct")).crossJoin(
        x.agg((F.count("_own") > 0).alias("_any_own")))  # one row
    if bridge is not None and "public_id" in rows.columns:
        b = (bridge.where(F.col("app_user_id").isNotNull()).groupBy(F.col("public_id").cast("string").alias("_public"))
             .agg(F.min("app_user_id").cast("long").alias("_bridged")))
        x = x.withColumn("_public", F.col("public_id").cast("string")).join(b, "_public", "left").drop("_public")
    else:
        x = x.withColumn("_bridged", F.lit(None).cast("long"))
    x = x.crossJoin(F.broadcast(rule))  # one row
    user = F.when(F.col("_any_direct"), F.col("_direct")).when(F.col("_any_own"), F.col("_own")).otherwise(F.col("_bridged"))
    x = x.withColumn("app_user_id", user).drop("_direct", "_own", "_bridged", "_any_direct", "_any_own")
    names = {c: f"{c}_addr" if c in rows.columns else c for c in best.columns if c != "app_user_id"}
    return x.join(best.withColumnsRenamed(names), "app_user_id", "left").select(
        *[c for c in rows.columns if c != "app_user_id"], "app_user_id", *names.values())


def geo_points(rows: DataFrame, keep: tuple[str, ...] = ("participant_id", "postal_code"), lat: str = "lat",
               lon: str = "long") -> DataFrame:
    """Rows whose coordinates are both numbers, as (kept columns, lat, lon)."""
    return (rows.select(*[c for c in keep if c in rows.columns], to_num(lat).alias("lat"), to_num(lon).alias("lon"))
            .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))


def funnel_bridge(participants: DataFrame, app_users: DataFrame, users: DataFrame, addresses: DataFrame,
                  order: str = "id") -> DataFrame:
    """(participant_id, user_id, has_name): each participant's app user (the
    smallest) and whether the user's name or the first or last name of the
    user's first live address holds more than blanks."""
    user = link_participant_user(participants, app_users)
    named = users.select(F.col("id").alias("user_id"), F.col("name").alias("_user_name"))
    addr = live_user_addresses(addresses, order, newest=False).select(
        F.col("app_user_id").alias("user_id"), F.col("first_name").alias("_first"), F.col("last_name").alias("_last"))
    filled = F.lit(False)
    for c in ("_user_name", "_first", "_last"):
        filled = filled | F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))
    p = participants.select(F.col("id").alias("participant_id")).where(F.col("participant_id").isNotNull()).distinct()
    return (p.join(user, "participant_id", "left").join(named, "user_id", "left").join(addr, "user_id", "left")
            .select("participant_id", "user_id", filled.alias("has_name")))


def newest_participant_per_user(participants: DataFrame) -> DataFrame:
    """user_id -> the participant with the largest id."""
    return (participants.where(F.col("user_id").isNotNull()).groupBy("user_id")
            .agg(F.max("id").alias("participant_id")))


def join_orders_products(orders: DataFrame, products: DataFrame, participants: DataFrame) -> DataFrame:
    """Orders LEFT products on the id compared as text, LEFT the newest
    participant of the ordering user."""
    prod = products.select(F.col("id").cast("string").alias("_pid"), F.col("name").alias("product_name"),
                           F.col("price").alias("product_price"))
    o = orders.withColumn("_pid", F.col("product_id").cast("string"))
    pmap = newest_participant_per_user(participants).withColumnRenamed("participant_id", "mapped_participant_id")
    return o.join(prod, "_pid", "left").join(pmap, "user_id", "left").drop("_pid")


def merge_latest_over(base: DataFrame, latest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """LEFT join ``latest`` on ``key``; a non-null latest value replaces the
    base value for every overlapping column."""
    lt = latest.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns if c in latest.columns])
    j = base.join(lt, key, "left")
    for c in columns:
        if c in latest.columns and c in base.columns:
            j = j.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
        elif c in latest.columns:
            j = j.withColumnRenamed(f"_new_{c}", c)
    return j


def store_display_names(store_rows: DataFrame, stores: DataFrame, partners: DataFrame) -> DataFrame:
    """Rows keyed by store_id LEFT stores LEFT partners; display name =
    partner name, else store name, else 'Store #<id>'."""
    s = stores.select(F.col("id").alias("store_id"), F.col("name").alias("_store_name"),
                      F.col("partner_id").alias("_partner_id"))
    p = partners.select(F.col("id").alias("_partner_id"), F.col("name").alias("_partner_name"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return (store_rows.join(s, "store_id", "left").join(p, "_partner_id", "left")
            .withColumn("display_name", F.coalesce(blank("_partner_name"), blank("_store_name"),
                                                   F.concat(F.lit("Store #"), F.col("store_id").cast("string"))))
            .drop("_store_name", "_partner_id", "_partner_name"))


def flag_in_set(df: DataFrame, key: str, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """Adds boolean ``flag``: ``key`` occurs in ``ids`` (left join on the
    distinct ids, no driver-side id list)."""
    s = ids.select(F.col(id_col).alias("_fid")).where(F.col("_fid").isNotNull()).distinct()
    return (df.join(s, df[key] == s["_fid"], "left").withColumn(flag, F.col("_fid").isNotNull()).drop("_fid"))


def overlap_counts(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Pairwise intersection sizes of named id sets (plus each set's size).

    All sets are tagged and unioned, reduced to one row per id holding the
    sorted tag list, and then every pair of tags of that id is counted: work
    is linear in the ids times the (small, fixed) number of sets."""
    tagged = None
    for name, df in sets.items():
        t = df.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct().withColumn("_set", F.lit(name))
        tagged = t if tagged is None else tagged.unionByName(t)
    per_id = tagged.groupBy("_k").agg(F.array_sort(F.collect_list("_set")).alias("_sets"))
    pairs = per_id.select(F.explode(F.flatten(F.transform(
        "_sets", lambda a: F.transform(F.filter("_sets", lambda b: b >= a),
                                       lambda b: F.struct(a.alias("set_a"), b.alias("set_b")))))).alias("p"))
    return pairs.groupBy("p.set_a", "p.set_b").agg(F.count(F.lit(1)).alias("n_overlap"))
