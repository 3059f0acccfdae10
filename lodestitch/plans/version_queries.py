"""Queries of new table versions, observed counts and lines replaced in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.operators import versions as V
from lodestitch.sources import files as X
from lodestitch.sources import lines as L
from lodestitch.sources import tables as T
from lodestitch.sources.shared import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(
    """WITH p AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) + (SELECT max(c_custkey) FROM customer) AS new FROM customer WHERE c_nationkey = 3),
    n AS (SELECT o_orderkey AS id, p.new AS parent, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(o_orderkey) FROM orders) AS new FROM orders JOIN p ON p.id = o_custkey)
    SELECT 'base' AS kind, new AS id, id AS copied_from, NULL::BIGINT AS parent_id FROM p UNION ALL SELECT 'term', new, id, parent FROM n"""
)
def copied_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as term bases, their orders as terms: copies with new ids and links."""
    parents = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tenant_id"))
    children = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"))
    new, own = V.copied(parents, children, F.col("tenant_id") == 3, fresh={"tenant_id": F.lit(None).cast("int")})
    shown = new.select(F.lit("base").alias("kind"), "id", "copied_from", F.lit(None).cast("long").alias("parent_id"))
    return shown.unionByName(own.select(F.lit("term").alias("kind"), "id", "copied_from", "parent_id"))


@query(
    """SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS number FROM events"""
)
def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless numbers in the order of time over any number of tasks."""
    return V.with_numbers(T.table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type", "number")


@query(
    """WITH c AS (SELECT * FROM events WHERE event_type IN ('purchase', 'error', 'signup')), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT u AS id, coalesce(l.event_type, 'none') AS status, coalesce(l.value, 0.0) AS value FROM range(0, 200) r(u) LEFT JOIN l ON l.user_id = u WHERE coalesce(l.event_type, 'none') <> 'error'
    UNION ALL SELECT user_id, event_type, value FROM l WHERE user_id >= 200 AND event_type <> 'error'"""
)
def upserted_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after all events that change them: latest version by key, errors delete."""
    current = spark.range(200).select("id", F.lit("none").alias("status"), F.lit(0.0).alias("value"))
    events = T.table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error", "signup"))
    changes = events.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "value", "event_id", (F.col("event_type") == "error").alias("gone"))
    return V.upserted(current, changes, ["id"], "event_id", "gone")


@query(
    """SELECT c_custkey AS customer_id, coalesce(o.lang, 'zh') AS lang, coalesce(o.ids, NULL) AS ids, o.lang IS NULL AS made FROM customer LEFT JOIN
    (SELECT o_custkey, min(o_orderpriority) AS lang, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0) AS ids FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1) o ON o_custkey = c_custkey"""
)
def customer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings row for every customer, made where there is none; id lists without blanks."""
    orders = T.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.when(x % 2 == 0, x.cast("string")).otherwise(" "))
    rows = orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.min("o_orderpriority").alias("lang"), V.cleaned_ids(ids).alias("ids"), F.lit(False).alias("made"))
    owners = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return V.with_defaults(rows, owners, ["customer_id"], {"lang": F.lit("zh"), "made": F.lit(True)})


@query(
    """SELECT id, created_at, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM
    (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40)"""
)
def page_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of jobs and the number of all of them, from one job."""
    jobs = T.jobs(spark, sf_dir).where("status = 'done'").select("id", "created_at")
    rows, total = V.page_with_total(jobs, [F.desc("created_at"), F.desc("id")], 3, 20)
    return spark.createDataFrame(rows, jobs.schema).withColumn("total", F.lit(total).cast("long"))


@query(
    """SELECT conv_id, turn, text || '!' AS target, (SELECT count(*) FROM conversations) AS sources, (SELECT count(*) FROM conversations) AS results FROM conversations"""
)
def checked_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are written only if each source has one, counted on the way."""
    sources = T.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    results = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("!")).alias("target"))
    path = shared_path(spark, "checked")
    counts = V.written_checked(sources, results, ["conv_id", "turn"], path)
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumns({k: F.lit(counts[k]).cast("long") for k in ("sources", "results")})


@query(
    """WITH l AS (SELECT file, doc_id, i, CASE WHEN (row_number() OVER (PARTITION BY file ORDER BY doc_id, i) - 1) % 5 = 3 THEN '[' || line || ']' ELSE line END AS line FROM
      (SELECT coalesce(source, '') || '-' || doc_id % 4 AS file, doc_id, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))))
    SELECT file, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY doc_id, i) || chr(10)) AS digest FROM l GROUP BY file"""
)
def replaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line of some files replaced by chunks, the rest as it was byte for byte."""
    path, out = shared_path(spark, "text"), shared_path(spark, "replaced")
    docs = T.table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id") % 4).alias("file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "value"))
    docs.repartition("file").sortWithinPartitions("file", "doc_id", "i").select("file", "value").write.partitionBy("file").text(path)
    lines = L.numbered_lines(spark, path)
    patches = lines.where("line % 5 = 3").select("path", "line", F.concat(F.lit("["), "text", F.lit("]")).alias("text"))
    L.write_files(L.replaced_lines(lines, patches, 100), out, lambda p: F.regexp_extract(p, "file=([^/]*)/", 1))
    parts = X.read_bytes(spark, out, "part-*").select(F.regexp_extract("path", "file=([^/]*)/", 1).alias("file"), F.regexp_extract("path", "[^/]*$", 0).alias("part"), F.col("content").cast("string").alias("text"))
    whole = parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.select("file", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("lines"), F.sha2("text", 256).alias("digest"))
