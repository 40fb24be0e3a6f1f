"""Domain-shaped views over the driver's tables.

The engine's operators take DataFrames plus column names, so they run on any
source. For the oracle checks and the bench they are fed from the TPC-H-like
parquet tables through the bindings below. Each binding exists twice: as a
DataFrame builder and as SQL text (a CTE body) that an independent SQL engine
can run on the same parquet files. The two must stay equivalent.

Binding (domain role -> table):
  participant        customer (c_custkey); gender = key parity (1 = man),
                     age = 18 + floor(|c_acctbal| / 200), postal code = last
                     four digits of c_name, segment = c_mktsegment
  store / partner    nation / region
  completion         orders (questionnaire = o_orderpriority)
  score history      lineitem JOIN orders: slug = l_returnflag,
                     value = l_quantity, at = o_orderdate
  store employment   lineitem JOIN orders JOIN supplier: a participant is
                     employed by the nations of the suppliers it bought from;
                     returned lines ('R') are deleted links
  app user bridge    distinct events.user_id (equal to c_custkey)
  interactions       events (view / purchase / ...), product = $.k of props
"""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def paths(self, *names: str) -> list[str]:
        return [f"{self.sf_dir}/{n}.parquet" for n in names]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)


# --------------------------------------------------------------------------
# DataFrame bindings
# --------------------------------------------------------------------------

class Domain:
    """Domain views built from the driver's tables (all lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)
        self.spark = spark

    @property
    def participants(self) -> DataFrame:
        c = self.t.customer
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("user_id"),
            F.col("c_custkey").alias("public_id"),
            F.col("c_nationkey").cast("long").alias("store_id"),
            (F.col("c_custkey") % 2).cast("string").alias("gender_raw"),
            (F.lit(18) + F.floor(F.abs(F.col("c_acctbal")) / 200)).cast("double").alias("age"),
            F.substring(F.col("c_name"), -4, 4).alias("postal_code"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
        )

    @property
    def stores(self) -> DataFrame:
        return self.t.nation.select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").cast("long").alias("partner_id"),
        )

    @property
    def partners(self) -> DataFrame:
        return self.t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    @property
    def completions(self) -> DataFrame:
        return self.t.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("participant_id"),
            F.col("o_orderpriority").alias("questionnaire_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("total"),
            F.col("o_orderdate").alias("created_at"),
        )

    @property
    def history(self) -> DataFrame:
        """The score history table (written once per source version)."""
        from pulseframe.plans.materialize import materialized
        return materialized(self.spark, "score_history", self.t.paths("lineitem", "orders"), self.history_plan)

    def history_plan(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            F.col("o_custkey").alias("participant_id"),
            F.col("l_returnflag").alias("slug"),
            F.col("l_linestatus").alias("line_status"),
            F.col("o_orderkey").alias("completion_id"),
            F.col("o_orderpriority").alias("questionnaire_id"),
            F.col("l_quantity").alias("score_value"),
            F.col("o_orderdate").alias("completion_created_at"),
        )

    @property
    def store_employees(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        s = self.t.supplier.select("s_suppkey", "s_nationkey")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                  .join(s, li.l_suppkey == s.s_suppkey)
                  .select(F.col("o_custkey").alias("user_id"),
                          F.col("s_nationkey").cast("long").alias("store_id"),
                          F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deleted_at")))

    @property
    def app_users(self) -> DataFrame:
        """Bridge rows (user_id, qe_participant_id) from the event log."""
        return (self.t.events.select("user_id").distinct()
                .select(F.col("user_id"), F.col("user_id").alias("qe_participant_id")))

    @property
    def interactions(self) -> DataFrame:
        return self.t.events.select(
            F.col("event_id").alias("id"),
            F.col("user_id"),
            F.col("event_type").alias("type"),
            F.get_json_object("props", "$.k").alias("item_ref"),
            F.col("value"),
            F.col("ts").alias("created_at"),
        )


# --------------------------------------------------------------------------
# SQL bindings (CTE bodies); same meaning as the builders above.
# --------------------------------------------------------------------------

SQL = {
    "participants": """SELECT c_custkey AS id, c_custkey AS user_id, c_custkey AS public_id,
        CAST(c_nationkey AS BIGINT) AS store_id, CAST(c_custkey % 2 AS VARCHAR) AS gender_raw,
        CAST(18 + floor(abs(c_acctbal) / 200) AS DOUBLE) AS age,
        right(c_name, 4) AS postal_code, c_mktsegment AS segment, c_acctbal AS balance
        FROM customer""",
    "stores": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS partner_id
        FROM nation""",
    "partners": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "completions": """SELECT o_orderkey AS id, o_custkey AS participant_id, o_orderpriority AS questionnaire_id,
        o_orderstatus AS status, o_totalprice AS total, o_orderdate AS created_at FROM orders""",
    "history": """SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS participant_id, l_returnflag AS slug,
        l_linestatus AS line_status, o_orderkey AS completion_id, o_orderpriority AS questionnaire_id,
        l_quantity AS score_value, o_orderdate AS completion_created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "store_employees": """SELECT o_custkey AS user_id, CAST(s_nationkey AS BIGINT) AS store_id,
        CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS deleted_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "app_users": "SELECT DISTINCT user_id, user_id AS qe_participant_id FROM events",
    "interactions": """SELECT event_id AS id, user_id, event_type AS type,
        json_extract_string(props, '$.k') AS item_ref, value, ts AS created_at FROM events""",
}


def with_views(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named SQL bindings (plus extra CTEs)."""
    parts = [f"d_{n} AS ({SQL[n]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"


# Score slugs of the history binding -> wide columns (l_returnflag values).
BINDING_SLUG_COLUMNS = {"A": "rec_med_bmi", "N": "rec_heartrisk", "R": "rec_ls_stress_sum"}
BINDING_SCORE_COLUMNS = list(BINDING_SLUG_COLUMNS.values())


def wide_plan(d: Domain) -> DataFrame:
    """The consolidated per-user table built from the bindings (full plan)."""
    from pulseframe.plans.consolidate import consolidate_scores
    return consolidate_scores(d.participants, d.history, d.completions, None, BINDING_SLUG_COLUMNS,
                              lifestyle_components=BINDING_SCORE_COLUMNS)


def wide(d: Domain) -> DataFrame:
    """The consolidated per-user table (``users_met_scores``), written once
    per source version and read by the analyses, as the original stores it."""
    from pulseframe.plans.materialize import materialized
    return materialized(d.spark, "users_met_scores", d.t.paths("customer", "lineitem", "orders"),
                        lambda: wide_plan(d))


def _num(x: str) -> str:
    return f"TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)"


SQL["latest"] = """SELECT participant_id, slug, score_value, completion_created_at, id FROM (
    SELECT *, row_number() OVER (PARTITION BY participant_id, slug
        ORDER BY (completion_created_at IS NOT NULL) DESC, completion_created_at DESC, id DESC, score_value DESC) AS rn
    FROM d_history WHERE slug IS NOT NULL) WHERE rn = 1"""

SQL["wide"] = f"""WITH piv AS (
      SELECT participant_id,
             max(CASE WHEN slug = 'A' THEN score_value END) AS rec_med_bmi,
             max(CASE WHEN slug = 'N' THEN score_value END) AS rec_heartrisk,
             max(CASE WHEN slug = 'R' THEN score_value END) AS rec_ls_stress_sum
      FROM d_latest GROUP BY participant_id),
    lastc AS (SELECT participant_id, max(created_at) AS latest_completion_at FROM d_completions
              WHERE participant_id IS NOT NULL GROUP BY participant_id),
    j AS (
      SELECT p.id AS participant_id, coalesce(p.user_id, p.id) AS user_id, p.store_id, p.postal_code, p.segment,
             p.balance, p.age AS rec_age_current, p.gender_raw,
             piv.rec_med_bmi, piv.rec_heartrisk, piv.rec_ls_stress_sum, lastc.latest_completion_at
      FROM d_participants p LEFT JOIN piv ON piv.participant_id = p.id
      LEFT JOIN lastc ON lastc.participant_id = p.id)
    SELECT participant_id, user_id, store_id, postal_code, segment, balance, rec_age_current,
           rec_med_bmi, rec_heartrisk, rec_ls_stress_sum, latest_completion_at,
           CAST(CASE WHEN upper(trim(gender_raw)) LIKE 'M%' THEN 1
                WHEN upper(trim(gender_raw)) LIKE 'V%' OR upper(trim(gender_raw)) LIKE 'F%' THEN 0
                WHEN {_num('gender_raw')} = 1 THEN 1 WHEN {_num('gender_raw')} = 0 THEN 0 END AS INTEGER) AS rec_user_gender,
           CAST(CASE WHEN rec_heartrisk >= 20 THEN 2 WHEN rec_heartrisk >= 10 THEN 1 ELSE 0 END AS INTEGER) AS rec_heartrisk_cat,
           CAST(CASE WHEN rec_med_bmi >= 30 THEN 2 WHEN rec_med_bmi >= 25 THEN 1 WHEN rec_med_bmi >= 18.5 THEN 0
                WHEN rec_med_bmi < 18.5 THEN -1 ELSE 0 END AS INTEGER) AS rec_med_bmi_cat,
           CAST(CASE WHEN rec_ls_stress_sum >= 40 THEN 2 WHEN rec_ls_stress_sum >= 20 THEN 1 ELSE 0 END AS INTEGER)
                AS rec_ls_stress_cat,
           CAST(CASE WHEN rec_age_current >= 55 THEN 2 WHEN rec_age_current >= 40 THEN 1 ELSE 0 END AS INTEGER)
                AS rec_med_age_cat,
           CAST(NULL AS INTEGER) AS rec_ls_sleep_cat,
           CASE WHEN (rec_med_bmi IS NOT NULL)::INT + (rec_heartrisk IS NOT NULL)::INT + (rec_ls_stress_sum IS NOT NULL)::INT > 0
                THEN (coalesce(rec_med_bmi, 0) + coalesce(rec_heartrisk, 0) + coalesce(rec_ls_stress_sum, 0))
                     / ((rec_med_bmi IS NOT NULL)::INT + (rec_heartrisk IS NOT NULL)::INT + (rec_ls_stress_sum IS NOT NULL)::INT)
           END AS rec_ls_lifestyle_score
    FROM j"""

# Views that depend on other views, in definition order.
_DEPENDS = {"latest": ["history"], "wide": ["participants", "completions", "history", "latest"]}


def views(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Like ``with_views`` but pulls in the views each named view depends on."""
    order: list[str] = []

    def add(n):
        for dep in _DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return with_views(*order, extra=extra)


# --------------------------------------------------------------------------
# Behaviour bindings: questionnaires, item scores, purchases, views, products
# --------------------------------------------------------------------------

def questionnaires(d: Domain) -> DataFrame:
    return (d.t.orders.select(F.col("o_orderpriority").alias("id")).distinct()
            .withColumn("name", F.col("id")))


def item_scores(d: Domain) -> DataFrame:
    """completion_scores: one row per answered item (line) of a completion."""
    return d.t.lineitem.select(F.col("l_orderkey").alias("completion_id"),
                               F.concat(F.lit("rec_item_"), F.col("l_linenumber").cast("string")).alias("slug"),
                               F.col("l_quantity").alias("value"))


def purchases(d: Domain) -> DataFrame:
    """Purchase events; low-value ones are cancelled."""
    e = d.t.events.where(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("participant_id"), F.col("user_id"),
                    F.get_json_object("props", "$.k").cast("long").alias("product_id"),
                    F.when(F.col("value") < 5, "cancelled").otherwise("completed").alias("status"),
                    F.col("ts").alias("created_at"), F.col("value").alias("amount"))


def article_views(d: Domain) -> DataFrame:
    e = d.t.events.where(F.col("event_type") == "view")
    return e.select(F.col("event_id").alias("id"), F.col("user_id"), F.col("user_id").alias("participant_id"),
                    F.lit("view").alias("type"),
                    F.get_json_object("props", "$.k").cast("long").alias("interactable_id"),
                    F.col("ts").alias("created_at"))


def products(d: Domain) -> DataFrame:
    return d.t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                           F.col("p_retailprice").alias("price"))


def titles(d: Domain) -> DataFrame:
    return d.t.part.select(F.col("p_partkey").alias("content_id"), F.col("p_name").alias("title"))


SQL.update({
    "questionnaires": "SELECT DISTINCT o_orderpriority AS id, o_orderpriority AS name FROM orders",
    "item_scores": """SELECT l_orderkey AS completion_id, 'rec_item_' || CAST(l_linenumber AS VARCHAR) AS slug,
        l_quantity AS value
        FROM lineitem""",
    "purchases": """SELECT event_id AS id, user_id AS participant_id, user_id,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
        CASE WHEN value < 5 THEN 'cancelled' ELSE 'completed' END AS status, ts AS created_at, value AS amount
        FROM events WHERE event_type = 'purchase'""",
    "article_views": """SELECT event_id AS id, user_id, user_id AS participant_id, 'view' AS type,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS interactable_id, ts AS created_at
        FROM events WHERE event_type = 'view'""",
    "products": "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part",
    "titles": "SELECT p_partkey AS content_id, p_name AS title FROM part",
})


# --------------------------------------------------------------------------
# Addresses and user accounts (two address rows per customer, the later one
# deleted for customers in debt; every seventh belongs to a store)
# --------------------------------------------------------------------------

SQL.update({
    "addresses": """SELECT c_custkey * 2 + k AS id, c_custkey AS model_id,
        CASE WHEN c_custkey % 7 = 0 THEN 'store' ELSE 'user' END AS model_type,
        CASE WHEN k = 1 AND c_acctbal < 0 THEN '2020-01-01' END AS deleted_at,
        CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE CAST(n_nationkey + k AS VARCHAR) END AS lat,
        CAST(n_regionkey AS VARCHAR) AS long, n_name AS city, r_name AS country, right(c_name, 4) AS postal_code,
        CASE WHEN k = 0 AND c_custkey % 3 = 0 THEN c_name ELSE ' ' END AS first_name, CAST(NULL AS VARCHAR) AS last_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
             (SELECT 0 AS k UNION ALL SELECT 1 AS k)""",
    "accounts": "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE '' END AS name FROM customer",
})


def addresses(d: Domain) -> DataFrame:
    n, g = d.t.nation, d.t.region
    x = (d.t.customer.join(n, F.col("c_nationkey") == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"])
         .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))))
    key = F.col("c_custkey")
    return x.select((key * 2 + F.col("k")).alias("id"), key.alias("model_id"),
                    F.when(key % 7 == 0, "store").otherwise("user").alias("model_type"),
                    F.when((F.col("k") == 1) & (F.col("c_acctbal") < 0), "2020-01-01").alias("deleted_at"),
                    F.when(key % 5 == 0, "unknown").otherwise((F.col("n_nationkey") + F.col("k")).cast("string")).alias("lat"),
                    F.col("n_regionkey").cast("string").alias("long"), F.col("n_name").alias("city"),
                    F.col("r_name").alias("country"), F.substring("c_name", -4, 4).alias("postal_code"),
                    F.when((F.col("k") == 0) & (key % 3 == 0), F.col("c_name")).otherwise(" ").alias("first_name"),
                    F.lit(None).cast("string").alias("last_name"))


def accounts(d: Domain) -> DataFrame:
    return d.t.customer.select(F.col("c_custkey").alias("id"),
                               F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise("").alias("name"))
