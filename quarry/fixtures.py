"""The views that the queries read: tables as they are, and retrieval-shaped views derived from them.

Every view exists twice with the same rows, as a DataFrame and as DuckDB SQL, so that a query and its oracle can
both be written on top of it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.sources.corpus import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Words of a chunk, and from one start to the next, of the `chunks` view (256 and 32 tokens at 1.3 a word).
CHUNK_WORDS, CHUNK_STEP = 196, 172


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in ("documents", "pages") else table

    @cached_property
    def corpus(self) -> DataFrame:
        return self.documents.select(
            "doc_id",
            F.concat(F.lit("shard_"), F.lpad(F.substring("source", 4, 99), 5, "0"), F.lit("_"), F.col("doc_id").cast("string")).alias("docid"),
            F.col("text").alias("contents"),
            "lang",
            "source",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        from quarry.functions.text import chunk_fixed

        c = self.corpus.select("doc_id", "docid", F.posexplode(chunk_fixed(F.col("contents"), CHUNK_WORDS, CHUNK_STEP)).alias("k", "contents"))
        return c.select("doc_id", "docid", (F.col("k") + 1).cast("int").alias("page"), F.concat("docid", F.lit("_p"), (F.col("k") + 1).cast("string")).alias("id"), "contents")

    @cached_property
    def qrels(self) -> DataFrame:
        g = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 3).when(F.col("quality") == 1, 2).when(F.col("toxic") == 0, 1).otherwise(0)
        return self.labels.join(self.corpus, "doc_id").select(F.col("lang").alias("topic_id"), F.col("docid").alias("chunk_id"), g.alias("grade"))

    @cached_property
    def runs(self) -> DataFrame:
        key = [F.col("lang").alias("topic_id"), F.concat_ws("::", "lang", "source").alias("qkey"), F.col("docid").alias("chunk_id")]
        a = self.corpus.select(F.lit("len").alias("config"), *key, F.length("contents").cast("double").alias("score"))
        b = self.corpus.select(F.lit("id").alias("config"), *key, (-F.col("doc_id")).cast("double").alias("score"))
        rank = F.row_number().over(W.partitionBy("config", "qkey").orderBy(F.desc("score"), "chunk_id"))
        return a.unionByName(b).select("config", "topic_id", "qkey", "chunk_id", rank.alias("rnk"), "score")

    @cached_property
    def steps(self) -> DataFrame:
        i = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
        return self.conversations.select("conv_id", "turn", i.alias("step_idx"), "role", "text")

    @cached_property
    def log(self) -> DataFrame:
        """Judgment log: failures are independent of the key, which leaves out the event type."""
        return self.events.select(
            "event_id",
            "ts",
            F.concat_ws("::", F.lit("v1"), (F.col("user_id") % 20).cast("string"), F.col("user_id").cast("string")).alias("jkey"),
            (F.col("user_id") % 20).cast("int").alias("topic_id"),
            F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.floor("value").cast("long") % 4).alias("grade"),
            (F.col("event_type") == "error").alias("failed"),
            "event_type",
            "value",
        )

    @cached_property
    def rubric(self) -> DataFrame:
        """Criteria of a topic (brand): signed weights, axes, and a grade 0 to 2 from each of two engines."""
        w = (F.col("p_size") % 5 + 1).cast("long")
        return self.part.select(
            F.col("p_brand").alias("qid"),
            F.col("p_partkey").alias("cid"),
            F.split("p_type", " ")[0].alias("axis"),
            F.when(F.col("p_partkey") % 7 == 0, -w).otherwise(w).alias("weight"),
            (F.col("p_partkey") % 3).cast("long").alias("grade_a"),
            (F.col("p_size") % 3).cast("long").alias("grade_b"),
        )


#: The same in DuckDB.
SQL_VIEWS = {
    "corpus": "SELECT doc_id, concat('shard_', lpad(substr(source, 4), 5, '0'), '_', CAST(doc_id AS VARCHAR)) AS docid, text AS contents, lang, source FROM documents",
    "chunks": rf"""SELECT doc_id, docid, k AS page, docid || '_p' || k AS id,
        regexp_replace(array_to_string(w[(k - 1) * {CHUNK_STEP} + 1 : (k - 1) * {CHUNK_STEP} + {CHUNK_WORDS}], ''), '\s+$', '') AS contents
        FROM (SELECT doc_id, docid, w, CAST(unnest(range(1, 2 + CAST(ceil(greatest(len(w) - {CHUNK_WORDS}, 0) / {CHUNK_STEP}.0) AS BIGINT))) AS INT) AS k
              FROM (SELECT doc_id, docid, regexp_extract_all(contents, '\S+\s*') AS w FROM corpus) WHERE len(w) > 0)""",
    "qrels": """SELECT c.lang AS topic_id, c.docid AS chunk_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 3 WHEN l.quality = 1 THEN 2
        WHEN l.toxic = 0 THEN 1 ELSE 0 END AS grade FROM labels l JOIN corpus c ON c.doc_id = l.doc_id""",
    "runs": """SELECT config, topic_id, qkey, chunk_id, row_number() OVER (PARTITION BY config, qkey ORDER BY score DESC, chunk_id) AS rnk, score
        FROM (SELECT 'len' AS config, lang AS topic_id, concat(lang, '::', source) AS qkey, docid AS chunk_id, CAST(length(contents) AS DOUBLE) AS score FROM corpus
              UNION ALL SELECT 'id', lang, concat(lang, '::', source), docid, CAST(-doc_id AS DOUBLE) FROM corpus)""",
    "steps": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx, role, text FROM conversations",
    "log": """SELECT event_id, ts, concat('v1::', CAST(user_id % 20 AS VARCHAR), '::', CAST(user_id AS VARCHAR)) AS jkey, CAST(user_id % 20 AS INT) AS topic_id,
        CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 4 END AS grade, event_type = 'error' AS failed, event_type, value FROM events""",
    "rubric": """SELECT p_brand AS qid, p_partkey AS cid, split_part(p_type, ' ', 1) AS axis,
        CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE 1 END * CAST(p_size % 5 + 1 AS BIGINT) AS weight,
        CAST(p_partkey % 3 AS BIGINT) AS grade_a, CAST(p_size % 3 AS BIGINT) AS grade_b FROM part""",
}


def with_views(sql: str) -> str:
    """sql with the definitions of the views that it names, in order of need."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(body.replace(name, "") if name == "corpus" else body)
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in need)
    body = sql.lstrip()
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
