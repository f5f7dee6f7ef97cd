"""The given tables in the shapes the operators take (see FIXTURES.md), for Spark.

Shapes that the workflow itself keeps as files (weekly log, user table, action pairs, session
table) are staged once per Spark application and data folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators import activity, directory, sessions
from sessionlens.operators.skew import sifted
from sessionlens.session import prepare, stage
from sessionlens.sources import logs as log_files

_CACHE: dict[tuple[str, str], "Shapes"] = {}


def shapes(spark: SparkSession, sf_dir: str) -> "Shapes":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Shapes(prepare(spark), sf_dir)
    prepare(spark)
    return _CACHE[key]


# page_id % 20 → host put into the page's address, so that every web category occurs
HOSTS = {
    0: "www.dropbox.com", 1: "wikileaks.org", 2: "www.facebook.com", 3: "www.job-hunt.org",
    4: "free.keylogger.net", 5: "www.aol.com", 6: "news.bbc.co.uk", 7: "indeed.com", 8: "actionalert.com",
}
EXTENSIONS = ["zip", "rar", "7z", "jpg", "png", "bmp", "doc", "docx", "pdf", "txt", "cfg", "rtf", "exe", "sh", "dat"]


#: Length of an incident. Incidents begin on different days, so that every part of a time split holds some.
INCIDENT_DAYS = 8


def incident_start(fifth: Column) -> Column:
    """The day a user's incident begins: 2, 7, 12, 17 or 22 January."""
    return F.lit("2024-01-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((fifth % 5 * 5).cast("int"))


def user_id(c: Column) -> Column:
    return F.concat(F.lit("U"), F.lpad(c.cast("string"), 7, "0"))


class Shapes:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # --- events as logs ---------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        kind = F.col("event_type")
        log = (
            F.when(kind.isin("signup", "error"), "logon")
            .when(kind.isin("click", "purchase"), "device")
            .when(F.col("event_id") % 3 == 0, "http")
            .when(F.col("event_id") % 3 == 1, "email")
            .otherwise("file")
        )
        name = (
            F.when(kind == "signup", "Logon").when(kind == "error", "Logoff")
            .when(kind == "click", "Connect").when(kind == "purchase", "Disconnect")
        )
        k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
        return self.table("events").select(
            "event_id",
            F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
            F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
            user_id(F.col("user_id")).alias("user"),
            F.concat(F.lit("PC-"), (k % 3).cast("string")).alias("pc"),
            log.alias("log"), name.alias("activity"), "value", k.alias("k"), F.length("props").alias("n"),
        )

    @cached_property
    def web(self) -> DataFrame:
        url = F.col("url")
        for number, host in HOSTS.items():
            other = F.regexp_replace("url", "//[^/]+/", f"//{host}/")
            url = F.when(F.col("page_id") % 20 == number, other).otherwise(url)
        text = F.regexp_replace("html", "[\\r\\n]+", " ")
        return self.table("pages").select("page_id", url.alias("url"), text.alias("content"))

    @cached_property
    def files(self) -> DataFrame:
        exts = F.array(*[F.lit(e) for e in EXTENSIONS])
        ext = F.get(exts, (F.col("p_partkey") % 15).cast("int"))
        drive = F.when(F.col("p_partkey") % 5 == 0, "D").when(F.col("p_partkey") % 2 == 0, "C").otherwise("R")
        return self.table("part").select(
            "p_partkey",
            F.concat(drive, F.lit(":\\"), "p_brand", F.lit("\\"), "p_name", F.lit("."), ext).alias("filename"),
            F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("content"),
        )

    @cached_property
    def mails(self) -> DataFrame:
        return self._mails(self.table("lineitem"))

    def sent(self, keys: DataFrame) -> DataFrame:
        """The mails that ``keys``, a stored table of order keys, names. Lines of other orders are neither grouped nor
        sorted, and most of them aren't shuffled."""
        lines = sifted(self.table("lineitem"), F.xxhash64("l_orderkey"), keys.select(F.xxhash64("_key").alias("key")))
        return self._mails(lines.where("_maybe")).join(keys, F.col("o_orderkey") == F.col("_key"), "left_semi")

    def _mails(self, lines: DataFrame) -> DataFrame:
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        host = F.when(F.col("s_nationkey") < 12, "@dtaa.com").otherwise("@ext.org")
        line = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "l_orderkey", "l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), host).alias("a"))

        def listed(part: int) -> Column:
            mine = F.collect_list(F.when(F.col("l_linenumber") % 3 == part, F.struct("l_linenumber", "a")))
            text = F.array_join(F.transform(F.array_sort(mine), lambda x: x["a"]), ";")
            return F.when(text != "", text)

        lists = line.groupBy("l_orderkey").agg(
            listed(0).alias("to"), listed(1).alias("cc"), listed(2).alias("bcc"), F.count(F.lit(1)).alias("n"))
        body = F.when(F.col("o_orderkey") % 10 != 0, F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
        return self.table("orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            "o_orderkey", "to", "cc", "bcc",
            F.concat(user_id(F.col("o_custkey")), F.lit("@dtaa.com")).alias("from"),
            F.floor("o_totalprice").cast("string").alias("size"),
            (F.coalesce("n", F.lit(0)) % 4).cast("string").alias("#att"), body.alias("content"))

    def logs(self) -> dict[str, DataFrame]:
        """The five logs with the columns of their files, times as text."""
        base = self.events.withColumn("date", F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))

        def keyed(log: str, items: DataFrame) -> DataFrame:
            size = items.agg(F.count(F.lit(1)).alias("n")).scalar()
            return base.where(F.col("log") == log).withColumn("_key", F.col("event_id") % size)

        def attach(log: str, items: DataFrame, key: str) -> DataFrame:
            mine = mailed if log == "email" else keyed(log, items)
            names = log_files.LOG_COLUMNS[log]
            return mine.join(items, F.col("_key") == F.col(key)).select(*[F.col(f"`{c}`") for c in names])

        # an order is one mail, so orders are counted
        mailed = keyed("email", self.table("orders"))
        keys = stage(mailed.select("_key").distinct(), "mail-keys")
        plain = {x: base.where(F.col("log") == x).select(*log_files.LOG_COLUMNS[x]) for x in ("logon", "device")}
        return {
            **plain,
            "http": attach("http", self.web, "page_id"),
            "email": attach("email", self.sent(keys), "o_orderkey"),
            "file": attach("file", self.files, "p_partkey"),
        }

    def sunday(self) -> Column:
        http = self.events.where(F.col("log") == "http")
        return log_files.first_sunday(http.select(F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("date")))

    def unified_weeks(self) -> DataFrame:
        return log_files.with_week(log_files.unify(self.logs()), self.sunday())

    @cached_property
    def weeks(self) -> DataFrame:
        return stage(self.unified_weeks(), "weeks", ["week"])

    # --- people -----------------------------------------------------------------------------

    def snapshots(self) -> DataFrame:
        """Customers present in each month they ordered in."""
        months = self.table("orders").select(
            "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
        key = F.col("c_custkey")
        people = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        role = F.when(F.col("c_mktsegment") == "MACHINERY", "ITAdmin").otherwise(F.col("c_mktsegment"))
        team = F.concat(F.lit("T"), ((key + F.substring("month", 6, 2).cast("int")) % 10).cast("string"))
        boss = F.concat(F.lit("Customer#"), F.lpad(F.floor(key / 10).cast("string"), 9, "0"))
        return months.join(people, F.col("o_custkey") == key).select(
            "month", F.col("c_name").alias("uname"), user_id(key).alias("user"),
            F.concat(F.lower("c_name"), F.lit("@dtaa.com")).alias("email"), role.alias("role"),
            F.col("r_name").alias("b_unit"), F.concat(F.lit("F"), (F.col("c_nationkey") % 7).cast("string")).alias("f_unit"),
            F.col("n_name").alias("dept"), team.alias("team"), boss.alias("sup_name"))

    def traits(self) -> DataFrame:
        key = F.col("c_custkey")
        score = {"O": 10 + key % 40, "C": 10 + (key * 7) % 41, "E": 10 + (key * 11) % 39,
                 "A": 10 + (key * 13) % 37, "N": 10 + (key * 17) % 43}
        return self.table("customer").where(key % 9 != 0).select(
            user_id(key).alias("user"), *[c.cast("double").alias(n) for n, c in score.items()])

    def answers(self) -> DataFrame:
        """Insider index: every fifth user, some of another data set."""
        fifth = F.floor(F.col("user_id") / 5)
        users = self.table("events").select("user_id").distinct().where(F.col("user_id") % 5 == 0)
        return users.select(
            F.when(fifth % 4 == 3, "5.2").otherwise("4.2").alias("dataset"),
            (1 + fifth % 3).cast("string").alias("scenario"),
            F.concat(user_id(F.col("user_id")), F.lit(".csv")).alias("details"), user_id(F.col("user_id")).alias("user"),
            F.date_format(incident_start(fifth), "MM/dd/yyyy HH:mm:ss").alias("start"),
            F.date_format(incident_start(fifth) + F.expr(f"make_dt_interval({INCIDENT_DAYS})"), "MM/dd/yyyy HH:mm:ss").alias("end"))

    def details(self) -> DataFrame:
        """Lines of the action list files; some listed files do not exist."""
        fifth = F.floor(F.col("user_id") / 5)
        stamp = F.date_trunc("second", "ts").cast("timestamp_ntz")
        rows = self.table("events").where(
            (F.col("user_id") % 5 == 0) & (F.col("event_id") % 17 == 0) & (fifth % 7 != 6)
            & stamp.between(incident_start(fifth), incident_start(fifth) + F.expr(f"make_dt_interval({INCIDENT_DAYS})")))
        user = user_id(F.col("user_id"))
        action = F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
        line = F.concat(F.lit("logon,\""), action, F.lit("\","), F.date_format(stamp, "MM/dd/yyyy HH:mm:ss"),
                        F.lit(",\""), user, F.lit("\",PC"))
        return rows.select((1 + fifth % 3).cast("string").alias("scenario"),
                           F.concat(user, F.lit(".csv")).alias("details"), line.alias("value"))

    @cached_property
    def people(self) -> DataFrame:
        """Directory with supervisors: the base of every user column, so kept as a table, as are the snapshots, which are read
        several times."""
        snapshots = stage(self.snapshots(), "snapshots")
        return stage(directory.resolve_supervisor(directory.directory(snapshots, self.traits())), "people")

    def pair_rows(self) -> DataFrame:
        from sessionlens.sources.people import parse_answer_details

        return directory.malicious_pairs(directory.insider_index(self.answers()), parse_answer_details(self.details()))

    @cached_property
    def users(self) -> DataFrame:
        return stage(directory.user_table(self.people, self.weeks, self.answers()), "users")

    @cached_property
    def pairs(self) -> DataFrame:
        return stage(self.pair_rows(), "pairs")

    # --- rows and sessions --------------------------------------------------------------------

    @cached_property
    def _rows(self) -> DataFrame:
        return activity.row_features(self.weeks)

    def rows(self) -> DataFrame:
        return self._rows

    def known_rows(self) -> DataFrame:
        """Rows with their user and label columns and session numbers."""
        numbered = sessions.with_sessions(self.rows())
        return activity.with_malicious_flag(activity.with_user(numbered, self.users), self.pairs)

    def session_table(self) -> DataFrame:
        return sessions.session_table(self.rows(), self.users, self.pairs)

    @cached_property
    def sessions(self) -> DataFrame:
        return stage(self.session_table(), "sessions")

    # --- vectors ------------------------------------------------------------------------------

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")

    def probabilities(self) -> DataFrame:
        """id, true class y, four class probabilities p0..p3, expert p of three e0..e2, gate q."""
        x = [F.get("embedding", F.lit(i)).cast("double") * 8 for i in range(8)]

        def soft(values: list[Column], prefix: str) -> list[Column]:
            total = sum((F.exp(v) for v in values[1:]), F.exp(values[0]))
            return [(F.exp(v) / total).alias(f"{prefix}{i}") for i, v in enumerate(values)]

        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), (F.col("label") % 4).cast("int").alias("y"),
            *soft(x[0:4], "p"), *soft(x[4:7], "e"), (1 / (1 + F.exp(-x[7]))).alias("q"))

    def importance(self) -> DataFrame:
        lag = (F.col("l_linenumber") % 5).cast("string")
        return self.table("lineitem").select(
            F.concat("l_returnflag", "l_linestatus", F.lit("_"), (F.col("l_partkey") % 30).cast("string"),
                     F.lit("_t-"), lag).alias("feature"),
            (F.col("l_suppkey") % 4).cast("int").alias("cls"), F.col("l_quantity").alias("value"))
