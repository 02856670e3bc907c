"""Operational metrics as rows (name, category, scope, value, timestamp, labels)."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, category string, scope string, value double, timestamp timestamp, labels map<string,string>"
RAW = "name string, category string, scope string, value double, timestamp string, user string, locale_name string, locale_num string, locale_hostname string, labels map<string,string>"


class Category(Enum):
    ALL = "ALL"
    NUM_REQUESTS = "NUM_REQUESTS"
    RESPONSE_TIME = "RESPONSE_TIME"
    AVG_RESPONSE_TIME = "AVG_RESPONSE_TIME"
    TOTAL_RESPONSE_TIME = "TOTAL_RESPONSE_TIME"
    TOTAL_MEMORY_USED = "TOTAL_MEMORY_USED"
    SYSTEM = "SYSTEM"
    SERVER = "SERVER"
    SERVER_INFO = "SERVER_INFO"
    NUM_ERRORS = "NUM_ERRORS"


class Scope(Enum):
    GLOBAL = "GLOBAL"
    LOCALE = "LOCALE"
    USER = "USER"


def decode(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON samples as metric rows; the labels say user or locale by scope.  Text that is no sample gives no row."""
    m = df.select(F.from_json(F.col(column).cast("string"), RAW).alias("m")).where("m.name is not null and m.value is not null")
    pair = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), F.coalesce(F.col(v), F.lit("")))])
    own = (
        F.when(F.col("m.scope") == Scope.USER.value, pair(("user", "m.user")))
        .when(F.col("m.scope") == Scope.LOCALE.value, pair(("locale_name", "m.locale_name"), ("locale_num", "m.locale_num"), ("locale_hostname", "m.locale_hostname")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    given = F.coalesce("m.labels", F.create_map().cast("map<string,string>"))
    labels = F.map_concat(F.map_filter(given, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    return m.select("m.name", "m.category", "m.scope", "m.value", F.try_to_timestamp("m.timestamp").alias("timestamp"), labels.alias("labels"))


def key(labels: Column) -> Column:
    """Labels as text, in order of name."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def last_values(metrics: DataFrame) -> DataFrame:
    """name, labels, value, timestamp: the latest sample of each series; of equally late ones the greatest.  Works on a stream too (complete or update mode)."""
    last = F.max(F.struct("timestamp", "value")).alias("m")
    return metrics.groupBy("name", key(F.col("labels")).alias("labels")).agg(last).select("name", "labels", F.col("m.value").alias("value"), F.col("m.timestamp").alias("timestamp"))


def request_series(requests: DataFrame) -> DataFrame:
    """Requests (user, command, seconds, memory, error) as the series of counts, times, memory and errors, overall, by command, by user, by both and by kind of error."""
    def rows(name: str, category: Category, value: Column, *by: str, where: str | None = None) -> DataFrame:
        part = requests.where(where) if where else requests
        labels = F.create_map(*[x for c in by for x in (F.lit(c), F.col(c).cast("string"))]) if by else F.create_map().cast("map<string,string>")
        out = part.groupBy(*by).agg(value.cast("double").alias("value"))
        scope = Scope.USER if "user" in by else Scope.GLOBAL
        return out.select(F.lit(name).alias("name"), F.lit(category.value).alias("category"), F.lit(scope.value).alias("scope"), "value", labels.alias("labels"))

    n = F.count("*")
    parts = [
        rows("total_number_of_requests", Category.NUM_REQUESTS, n),
        rows("number_of_requests_per_command", Category.NUM_REQUESTS, n, "command"),
        rows("per_user_total_number_of_requests", Category.NUM_REQUESTS, n, "user"),
        rows("per_user_number_of_requests_per_command", Category.NUM_REQUESTS, n, "command", "user"),
        rows("response_times_per_command", Category.RESPONSE_TIME, F.max_by("seconds", "id"), "command"),
        rows("avg_response_times_per_command", Category.AVG_RESPONSE_TIME, F.avg("seconds"), "command"),
        rows("total_response_times_per_command", Category.TOTAL_RESPONSE_TIME, F.sum("seconds"), "command"),
        rows("total_memory_used_per_command", Category.TOTAL_MEMORY_USED, F.sum("memory"), "command"),
        rows("total_number_of_errors", Category.NUM_ERRORS, n, where="error is not null"),
        rows("number_of_errors_per_error_type", Category.NUM_ERRORS, n, "error", where="error is not null"),
        rows("number_of_errors_per_command", Category.NUM_ERRORS, n, "command", where="error is not null"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster_metrics(spark: SparkSession) -> DataFrame:
    """One row per executor and series: memory, memory used, its part, cores; and the server's version, host and number of executors."""
    context = spark.sparkContext
    status = context._jsc.sc().getExecutorMemoryStatus()
    rows, at = [], status.iterator()
    cores = int(context.defaultParallelism)
    while at.hasNext():
        entry = at.next()
        name, total, free = entry._1(), float(entry._2()._1()), float(entry._2()._2())
        labels = {"locale_name": name, "locale_num": str(len(rows) // 4), "locale_hostname": name.rpartition(":")[0]}
        for series, value in (("memory_per_locale", total), ("memory_used_per_locale", total - free), ("pct_memory_used_per_locale", 100 * (total - free) / total if total else 0.0), ("processing_units_per_locale", cores / max(1, status.size()))):
            rows.append((series, Category.SYSTEM.value, Scope.LOCALE.value, value, labels))
    info = {"host": context.getConf().get("spark.driver.host", ""), "version": spark.version, "number_of_locales": str(status.size())}
    rows.append(("server_information", Category.SERVER_INFO.value, Scope.GLOBAL.value, 1.0, info))
    return spark.createDataFrame(rows, "name string, category string, scope string, value double, labels map<string,string>").withColumn("timestamp", F.current_timestamp())


def server_totals(metrics: DataFrame) -> DataFrame:
    """Cores and memory summed over executors."""
    total = lambda s: F.sum(F.when(F.col("name") == s, F.col("value")))
    return metrics.agg(total("processing_units_per_locale").alias("processing_units"), total("memory_per_locale").alias("memory"))


class Recorder:
    """Keeps the requests of a session: who ran which command, how long it took, and how it failed.

    It is a context for each request, and listens to streaming queries, whose
    batches count as requests of the command ``stream:<name>``.
    """

    def __init__(self, spark: SparkSession, user: str = ""):
        self.spark, self.user = spark, user
        self.rows: list[tuple] = []

    def request(self, command: str, user: str | None = None):
        from contextlib import contextmanager
        from time import perf_counter

        @contextmanager
        def timed():
            began, error = perf_counter(), None
            try:
                yield
            except Exception as e:
                error = type(e).__name__
                raise
            finally:
                self.add(command, perf_counter() - began, error, user)

        return timed()

    def add(self, command: str, seconds: float, error: str | None = None, user: str | None = None) -> None:
        self.rows.append((len(self.rows), user or self.user, command, float(seconds), 0.0, error))

    def listener(self):
        """A StreamingQueryListener that records batches; the caller adds it to ``spark.streams``."""
        from pyspark.sql.streaming import StreamingQueryListener

        recorder = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                recorder.add(f"stream:{event.progress.name or event.progress.id}", event.progress.batchDuration / 1000)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                if event.exception:
                    recorder.add("stream", 0.0, "StreamingQueryException")

        return Listener()

    def requests(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "id long, user string, command string, seconds double, memory double, error string")

    def metrics(self) -> DataFrame:
        """All series of the requests and of the cluster."""
        own = request_series(self.requests()).withColumn("timestamp", F.current_timestamp())
        columns = ["name", "category", "scope", "value", "timestamp", "labels"]
        return own.select(columns).unionByName(cluster_metrics(self.spark).select(columns))


def run_loop(fetch: Callable[[], DataFrame], emit: Callable[[DataFrame], None], every: float = 5.0, rounds: int | None = None, connected: Callable[[], bool] = lambda: True, reconnect: Callable[[], None] = lambda: None) -> int:
    """Polls: each ``every`` seconds the samples that ``fetch`` gives go to ``emit``; how often they did.

    When the source is not connected, ``reconnect`` is called once a round;
    a round that stays without connection gives nothing.  It ends after
    ``rounds``, or never.
    """
    done = n = 0
    while rounds is None or n < rounds:
        n += 1
        if not connected():
            reconnect()
        if connected():
            emit(fetch())
            done += 1
        else:
            warnings.warn("no connection, no metrics", stacklevel=2)
        if rounds is None or n < rounds:
            time.sleep(every)
    return done
