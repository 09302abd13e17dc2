"""Synthetic access logs, drawn by hash: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.operators.sets import sample_rows, standardize

AGENTS = ("Mozilla/5.0 (Windows NT) Chrome/120", "Mozilla/5.0 (Macintosh) Safari/605", "Mozilla/5.0 (X11; Linux) Firefox/119")
RESOURCES = ("bucket", "database", "console", "queue", "keystore")
REGIONS = ("eu-north", "eu-south", "us-east", "ap-east")
ALL_DAYS = 30


@dataclass(frozen=True)
class Generator:
    """Who acts, and how; `end` is the last day that events may start on."""

    n_users: int = 100
    n_roles: int = 5
    n_actions: int = 10
    seed: int = 42
    end: str = "2024-06-30"

    def _u(self, tag: str, *keys: Column) -> Column:
        """Uniform in [0, 1) for a tag and keys."""
        return F.pmod(F.xxhash64(*keys, F.lit(f"{self.seed}/{tag}")), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def _int(self, low: int, high: int, tag: str, *keys: Column) -> Column:
        """Whole number from low to high, both included."""
        return (F.floor(self._u(tag, *keys) * (high - low + 1)) + low).cast("int")

    def _choice(self, options: tuple[str, ...], tag: str, *keys: Column) -> Column:
        return F.get(F.array(*[F.lit(o) for o in options]), self._int(0, len(options) - 1, tag, *keys))

    def permissions(self, spark: SparkSession) -> DataFrame:
        """(role, action): 3 to 8 actions for each role."""
        roles = spark.range(self.n_roles).select(F.concat(F.lit("role_"), F.col("id").cast("string")).alias("role"))
        pairs = roles.select("role", F.explode(F.sequence(F.lit(0), F.lit(self.n_actions - 1))).alias("a")).withColumn("u", self._u("permit", F.col("role"), F.col("a")))
        ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("role").orderBy("u", "a")))
        return ranked.where(F.col("nth") <= F.least(F.lit(self.n_actions), self._int(3, 8, "permits", F.col("role")))).select("role", F.concat(F.lit("action_"), F.col("a").cast("string")).alias("action"))

    def role_of(self, user: Column) -> Column:
        return F.concat(F.lit("role_"), self._int(0, self.n_roles - 1, "role", user).cast("string"))

    def sessions(self, spark: SparkSession, n: int, anomalous: bool, tag: str = "") -> DataFrame:
        """n sessions with one row per action."""
        kind = f"{tag}{anomalous}"
        s = spark.range(n).select(F.col("id").alias("nth"))
        key = F.col("nth")
        user = F.concat(F.lit("user_"), self._int(1, self.n_users, kind + "user", key).cast("string"))
        lengths, minutes, hours = ((30, 100), (300, 600), (0, 23)) if anomalous else ((5, 20), (30, 180), (9, 17))
        s = s.select(
            "nth", user.alias("user_id"), self._int(*lengths, kind + "length", key).alias("n"), self._int(*minutes, kind + "minutes", key).alias("minutes"),
            (F.to_timestamp(F.lit(self.end)) - F.make_dt_interval(self._int(0, ALL_DAYS, kind + "day", key), -self._int(*hours, kind + "hour", key), -self._int(0, 59, kind + "minute", key))).alias("session_start"),
        )
        s = s.withColumns({
            "role": self.role_of(F.col("user_id")), "session_end": F.col("session_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes")),
            "session_id": F.substring(F.sha2(F.concat_ws("/", F.lit(f"{self.seed}{kind}"), key.cast("string")), 256), 1, 32),
        })
        permitted = self.permissions(spark).groupBy("role").agg(F.sort_array(F.collect_list("action")).alias("permitted"))
        every = F.array(*[F.lit(f"action_{i}") for i in range(self.n_actions)])
        e = s.join(F.broadcast(permitted), "role").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
        keys = (key, F.col("i"))
        pick = lambda options, name: F.get(options, F.floor(self._u(kind + name, *keys) * F.size(options)).cast("int"))
        others = F.array_except(every, F.col("permitted"))
        stray = F.lit(anomalous) & (self._u(kind + "stray", *keys) < 0.3) & (F.size(others) > 0)
        net = "203.0" if anomalous else "192.168"
        address = F.concat(F.lit(net + "."), self._int(1, 254, kind + "ip3", *keys).cast("string"), F.lit("."), self._int(1, 254, kind + "ip4", *keys).cast("string"))
        drawn = F.when((F.col("i") == 1) | (self._u(kind + "newip", *keys) < (0.8 if anomalous else 0.1)), address)
        sticky = F.last("drawn", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        failed = F.lit(anomalous) & (self._u(kind + "status", *keys) < 0.3)
        minute = F.floor(F.col("minutes") * (F.col("i") - 1) / F.col("n")).cast("int")
        return e.withColumn("drawn", drawn).select(
            (F.col("session_start") + F.make_dt_interval(F.lit(0), F.lit(0), minute)).alias("timestamp"), "user_id", F.when(stray, pick(others, "other")).otherwise(pick(F.col("permitted"), "action")).alias("action"),
            self._choice(RESOURCES, kind + "resource", *keys).alias("resource"), sticky.alias("ip_address"), self._choice(REGIONS, kind + "region", key).alias("region"),
            F.when(failed, "failure").otherwise("success").alias("status"), "session_id", "session_start", "session_end", self._choice(AGENTS, kind + "agent", key).alias("user_agent"),
            "role", F.lit(anomalous).alias("is_anomaly"), F.xxhash64("session_id", "i").alias("row_id"),
        )

    def _exactly(self, df: DataFrame, n: int) -> DataFrame:
        return df.orderBy("session_id", "timestamp", "row_id").limit(n)

    def normal_log(self, spark: SparkSession, n: int) -> DataFrame:
        """Exactly n rows of normal sessions; the last session may be cut."""
        return self._exactly(self.sessions(spark, n // 5 + 1, False), n)

    def inject_anomalies(self, df: DataFrame, ratio: float) -> DataFrame:
        """int(rows * ratio) rows changed in one of five ways and labelled."""
        k = int(df.count() * ratio)
        chosen = sample_rows(df, k, self.seed).select(F.col("row_id").alias("__hit"))
        kind = self._int(0, 4, "inject", F.col("row_id"))
        hit = F.col("__hit").isNotNull()
        at = lambda n: hit & (kind == n)
        night = F.date_trunc("day", "timestamp") + F.make_dt_interval(F.lit(0), self._int(0, 4, "night", F.col("row_id")))
        out = df.join(chosen, F.col("row_id") == F.col("__hit"), "left")
        return out.withColumns({
            "timestamp": F.when(at(0), night).otherwise(F.col("timestamp")), "role": F.when(at(1), F.lit("role_unknown")).otherwise(F.col("role")),
            "ip_address": F.when(at(2), F.concat(F.lit("203.0."), self._int(1, 254, "badip", F.col("row_id")).cast("string"), F.lit(".7"))).otherwise(F.col("ip_address")),
            "action": F.when(at(3), F.lit("action_forbidden")).otherwise(F.col("action")), "session_id": F.when(at(4), F.sha2(F.col("row_id").cast("string"), 256)).otherwise(F.col("session_id")),
            "is_anomaly": hit | F.col("is_anomaly"),
        }).drop("__hit")

    def dataset(self, spark: SparkSession, n: int = 10_000, ratio: float = 0.1, session_ratio: bool = False) -> DataFrame:
        """Exactly n labelled rows, by time. ratio is the share of anomalous rows, or of sessions if session_ratio."""
        odd = int(n * ratio)
        if session_ratio:
            both = self.normal_log(spark, n - odd).unionByName(self.sessions(spark, odd, True))
            rows = sample_rows(both, n, self.seed)
        else:
            rows = self.normal_log(spark, n - odd).unionByName(self._exactly(self.sessions(spark, odd // 30 + 1, True), odd))
        return rows.orderBy("timestamp", "row_id")

    def fixture(self, spark: SparkSession, n: int = 99) -> DataFrame:
        """n normal rows and one anomalous session, by time."""
        return self.normal_log(spark, n).unionByName(self.sessions(spark, 1, True, "fixture")).orderBy("timestamp", "row_id")

    def privileged(self, spark: SparkSession, n: int, ratio: float = 0.1, accounts: int = 10) -> DataFrame:
        """Privileged access: 50 users, 20 servers, 5 vaults; anomalous rows in one of five ways."""
        k = F.col("row_id")
        odd = self._u("podd", k) < ratio
        kind = F.when(odd, self._int(0, 4, "pkind", k)).otherwise(-1)
        # A normal draw from two uniforms.
        normal = F.sqrt(-2 * F.log(self._u("n1", k) + 1e-12)) * F.cos(2 * 3.141592653589793 * self._u("n2", k))
        seconds = F.greatest(F.lit(10.0), 300 + 100 * normal)
        e = spark.range(n).withColumnRenamed("id", "row_id")
        e = e.select(
            "row_id", (F.to_timestamp(F.lit(self.end)) - F.make_dt_interval(self._int(0, ALL_DAYS, "pday", k), F.when(kind == 0, F.lit(0)).otherwise(-self._int(8, 18, "phour", k)), -self._int(0, 59, "pmin", k))).alias("timestamp"),
            F.concat(F.lit("user_"), self._int(1, 50, "puser", k).cast("string")).alias("user_id"), self._choice(("login", "logout", "retrieve", "rotate", "connect", "run"), "pact", k).alias("action"),
            F.concat(F.lit("server_"), self._int(1, 20, "psrv", k).cast("string")).alias("resource"),
            F.when(kind == 1, F.concat(F.lit("203.0.113."), self._int(1, 254, "pbad", k).cast("string"))).otherwise(F.concat(F.lit("10.0.0."), self._int(1, 70, "pip", k).cast("string"))).alias("ip_address"),
            F.lit(None).cast("string").alias("region"), F.when(self._u("pfail", k) < 0.1, "failure").otherwise("success").alias("status"),
            F.substring(F.sha2(F.concat(F.lit(f"{self.seed}p"), k.cast("string")), 256), 1, 32).alias("session_id"), F.lit(None).cast("string").alias("user_agent"),
            F.concat(F.lit("acct_"), self._int(1, accounts, "pacct", k).cast("string")).alias("privileged_account_used"), F.concat(F.lit("vault_"), self._int(1, 5, "pvault", k).cast("string")).alias("vault_name"),
            F.when(kind == 2, seconds * 10).otherwise(seconds).alias("session_duration_seconds"), F.lit(True).alias("is_privileged_session"), (kind == 3).alias("policy_violation"),
            F.when(kind != 4, F.lit("maintenance")).alias("reason_for_access"), F.when(kind != 4, F.concat(F.lit("T"), k.cast("string"))).alias("ticket_id"), odd.alias("is_anomaly"),
        )
        return e.withColumns({"session_start": F.col("timestamp"), "session_end": F.col("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("session_duration_seconds").cast("decimal(18,6)"))})


def read_synthetic(spark: SparkSession, path: str | None = None, n: int = 10_000, **generator) -> DataFrame:
    """The dataset as a reader gives it: canonical columns, no labels."""
    return standardize(Generator(**generator).dataset(spark, n))
