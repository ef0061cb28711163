"""Chat tables that the queries run on, derived from the given ``conversations`` table.

The given conversations hold no repeats and no push-backs, so messages are rewritten by rule, and each conversation is
repeated ``REPLICAS`` times with attributes (user, time, model ...) that follow from hashes of its id.  Rules are
written once as SQL expressions; ``{h:x:n}`` is the hash of x modulo n in the dialect at hand.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlytics.sources.files import shared_folder

REPLICAS = 40

#: Repeated texts are named by dictionaries.  Beyond Parquet's 1 MB, a column's remaining texts would be written out once per repetition, so
#: that files grew faster than the input; rows per group bound what a dictionary has to hold.
LAYOUT = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20), "parquet.block.row.count.limit": "40000"}

_written: dict[tuple, str] = {}


def written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session and folder of given tables, in the folder that the cluster shares; made again
    should it be gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _written.get(key)
    if path is not None:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            path = None
    if path is None:
        path = shared_folder(spark, f"chat-{name}")
        make().write.options(**LAYOUT).parquet(path)
        _written[key] = path
    return spark.read.parquet(path)


def dialect(text: str, spark: bool) -> str:
    form = r"(conv(substr(md5(\1), 1, 8), 16, 10)::bigint % \2)" if spark else r"(('0x' || substr(md5(\1), 1, 8))::BIGINT % \2)"
    text = re.sub(r"\{h:(.*?):(\d+)\}", form, text)
    return text.replace("{day}", "cast(date_add(DATE '2024-03-04', cast({d} as int)) as date)" if spark else "(DATE '2024-03-04' + ({d})::INTEGER)")


# The message text after the rewriting rules; pu is the last earlier user text, seen whether there is one.
CONTENT = """CASE
 WHEN role = 'user' AND seen AND (cid * 31 + turn * 7 + k) % 5 = 0 THEN concat(pu, ' please')
 WHEN role = 'user' AND seen AND (cid * 31 + turn * 7 + k) % 5 = 1 AND (v2 = 0 OR {h:concat('x', conv_id):4} = 0) THEN concat(
   CASE (cid + turn + k) % 6 WHEN 0 THEN 'No, that is wrong. ' WHEN 1 THEN 'not what I asked. ' WHEN 2 THEN 'I meant something else: '
     WHEN 3 THEN '不对，' WHEN 4 THEN 'нет, ' ELSE 'try again ' END, text)
 WHEN role = 'user' AND NOT seen AND (cid + k) % 23 = 0 THEN ''
 WHEN role = 'assistant' AND (cid * 13 + turn + k) % 11 = 0 THEN 'I''m sorry, but I can''t help with that.'
 WHEN role = 'assistant' AND (cid * 13 + turn + k) % 11 IN (1, 2) THEN 'Sure, here you go.'
 ELSE text END"""

RESPONDER = "CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN CASE idx % 3 WHEN 0 THEN 'planner' WHEN 1 THEN 'researcher' ELSE 'writer' END END"

DAY = "({h:concat('d', conv_id):126} + CASE WHEN {h:concat('d', conv_id):126} >= 63 THEN 7 ELSE 0 END)"

#: Attributes in the order in which later ones use earlier ones.
ATTRIBUTES = [
    ("usr", "concat('u', {h:concat('u', conv_id):397})"),
    ("d", DAY),
    ("hours", "{h:concat('hh', conv_id):24}"),
    ("model", """CASE WHEN d < 63 THEN CASE WHEN {h:concat('m', conv_id):100} < 55 + {h:concat('e', usr):40} THEN 'gpt-3.5-turbo-0613' ELSE 'gpt-4-0125-preview' END
       WHEN {h:concat('m', conv_id):100} < 30 + {h:concat('e', usr):40} THEN 'gpt-4o-2024-05-13' WHEN {h:concat('m', conv_id):100} < 85 THEN 'gpt-4o-mini-2024-07-18' ELSE 'o1-mini-2024-09-12' END"""),
    ("nation", "CASE WHEN {h:concat('n', usr):100} >= 7 THEN {h:concat('c', usr):25} END"),
    ("language", """CASE WHEN {h:concat('l', usr):100} < 50 THEN 'English' WHEN {h:concat('l', usr):100} < 64 THEN 'Chinese' WHEN {h:concat('l', usr):100} < 74 THEN 'Russian'
       WHEN {h:concat('l', usr):100} < 81 THEN 'Spanish' WHEN {h:concat('l', usr):100} < 86 THEN 'French' WHEN {h:concat('l', usr):100} < 90 THEN 'German' WHEN {h:concat('l', usr):100} < 93 THEN 'Portuguese'
       WHEN {h:concat('l', usr):100} < 95 THEN 'Italian' WHEN {h:concat('l', usr):100} < 97 THEN 'Turkish' WHEN {h:concat('l', usr):100} < 98 THEN 'Japanese' WHEN {h:concat('l', usr):100} < 99 THEN 'Korean' END"""),
    ("version", "CASE WHEN d < 98 THEN 'v1' ELSE 'v2' END"),
    ("redacted", "({h:concat('r', conv_id):10} = 0)"),
    ("prompt_tokens", "CASE WHEN NOT (d < 70 OR {h:concat('t', conv_id):10} > 2) THEN 50 + {h:concat('p', conv_id):400} END"),
    ("completion_tokens", "CASE WHEN prompt_tokens IS NOT NULL THEN 20 + {h:concat('q', conv_id):800} END"),
    ("label", "CASE {h:concat('i', conv_id):10} WHEN 0 THEN 'other' WHEN 1 THEN 'translation' WHEN 2 THEN 'creative_roleplay' WHEN 3 THEN 'coding' WHEN 4 THEN 'coding' WHEN 5 THEN 'writing_and_business' WHEN 6 THEN 'image_prompting' ELSE 'questions' END"),
    ("shard", "concat('shard-', conv_id % 4)"),
]

# Fixture eras: two periods with several models side by side.
ERAS = [("A", "2024-03-04", "2024-05-05"), ("B", "2024-05-13", "2024-07-14")]
MIN_CELL = 20


def nested(spark: SparkSession, sf_dir: str, replicas: int = REPLICAS) -> DataFrame:
    """conv_id, messages: array of (idx from 1, role, content, responder).

    Windows and the only exchange run on the given conversations; their repetitions follow within the row, next to each other, so that what
    is written of them compresses to little more than the given texts.
    """
    from pyspark.sql import Window

    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role").isin("user", "assistant"))
    line = Window.partitionBy("cid").orderBy("turn")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # repeated rows are the work, not those given
    rows = given.select(F.col("conv_id").alias("cid"), "turn", "role", "text").repartition(parts, "cid")
    rows = rows.select(
        "cid", "turn", "role", "text", F.row_number().over(line).alias("idx"),
        F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before).alias("pu"),
        F.coalesce(F.max(F.col("role") == "user").over(before), F.lit(False)).alias("seen"),
    )
    rows = rows.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct(*MESSAGE))).alias("m"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicas - 1).cast("long"))))
    rows = rows.withColumn("conv_id", F.col("cid") * 1000 + F.col("k"))
    rows = rows.withColumn("v2", F.expr(dialect(f"CASE WHEN {DAY} < 98 THEN 0 ELSE 1 END", True)))
    content, responder = (of_message(dialect(rule, True)) for rule in (CONTENT, RESPONDER))
    return rows.select("conv_id", F.expr(f"transform(m, x -> struct(x.idx AS idx, x.role AS role, {content} AS content, {responder} AS responder))").alias("messages"))


MESSAGE = ["idx", "turn", "role", "text", "pu", "seen"]


def of_message(rule: str) -> str:
    """A rule on the columns of a message as one on the fields of ``x``; quoted texts stay."""
    parts = re.split(r"('(?:[^']|'')*')", rule)
    return "".join(p if i % 2 else re.sub(rf"\b({'|'.join(MESSAGE)})\b", r"x.\1", p) for i, p in enumerate(parts))


def messages(rows: DataFrame) -> DataFrame:
    """conv_id, idx (from 1), role, content, responder: a row per message of ``nested`` rows."""
    return rows.select("conv_id", F.inline("messages"))


def with_attributes(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the attributes, ``ts``, ``date``, ``country`` and ``pseudo_user`` to rows that have a conv_id."""
    from turnlytics.functions.rules import pseudo_user

    for name, rule in ATTRIBUTES:
        rows = rows.withColumn(name, F.expr(dialect(rule, True)))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("country"))
    rows = rows.join(F.broadcast(nations), "nation", "left")  # 25 rows
    rows = rows.withColumn("date", F.expr("date_add(DATE '2024-03-04', cast(d as int))")).withColumn("ts", F.expr("cast(cast(date as timestamp) + make_interval(0, 0, 0, 0, cast(hours as int)) as timestamp_ntz)"))
    return rows.withColumn("pseudo_user", pseudo_user(F.col("usr"), F.lit("browser"), F.col("language")))


def sql_messages() -> str:
    return dialect(
        f"""given AS (
 SELECT conv_id AS cid, turn, role, text, row_number() OVER w AS idx,
  last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pu,
  coalesce(max(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen
 FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), repeated AS (
 SELECT *, cid * 1000 + k AS conv_id FROM given, (SELECT unnest(range({REPLICAS})) AS k)
), dated AS (SELECT *, CASE WHEN {DAY} < 98 THEN 0 ELSE 1 END AS v2 FROM repeated),
messages AS MATERIALIZED (SELECT conv_id, idx, role, {CONTENT} AS content, {RESPONDER} AS responder FROM dated)""",
        False,
    )


def sql_attributes() -> str:
    """attributes: a row per conversation with its attributes."""
    steps, last = [], "(SELECT DISTINCT conv_id FROM messages)"
    for i, (name, rule) in enumerate(ATTRIBUTES):
        last = f"(SELECT *, {dialect(rule, False)} AS {name} FROM {last})"
        steps.append(i)
    return f"""attributes AS MATERIALIZED (
 SELECT a.*, n.n_name AS country, DATE '2024-03-04' + d::INTEGER AS date, (DATE '2024-03-04' + d::INTEGER)::TIMESTAMP + to_hours(hours::INTEGER) AS ts,
  substr(sha256(concat(usr, '|browser|', coalesce(language, ''))), 1, 16) AS pseudo_user
 FROM {last} a LEFT JOIN nation n ON a.nation = n.n_nationkey
)"""
