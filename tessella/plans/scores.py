"""Queries on consensus, scores, weights and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import scoring, weights
from tessella.plans.corpus import pairs
from tessella.plans.registry import query, table
from tessella.session import scratch
from tessella.streaming.checkpoint import run_log


@query()
def chrf_bleu_scores(spark, sf_dir):
    """A turn against the next."""
    return scoring.row_scores(pairs(spark, sf_dir), "source", "target").select("conv_id", "turn", "bleu", "chrf", "geometric_mean")


@query()
def corpus_scores(spark, sf_dir):
    """M10"""
    return scoring.corpus_scores(pairs(spark, sf_dir), "source", "target")


_SETS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query(f"""
WITH p AS (SELECT * FROM (SELECT conv_id, turn, coalesce(text, '') AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL),
s AS (SELECT conv_id, turn, {_SETS.format('a')} AS x, {_SETS.format('b')} AS y FROM p)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 100.0 ELSE 100.0 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END AS jaccard FROM s""")
def jaccard_pairs(spark, sf_dir):
    """M2"""
    return pairs(spark, sf_dir).select("conv_id", "turn", scoring.token_jaccard(F.col("source"), F.col("target")).alias("jaccard"))


def _pool(spark, sf_dir):
    """Turns as the candidates of their conversation."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT conv_id, count(*) AS support, min_by(text, turn) AS text, min(turn) AS turn FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))")
def candidate_support(spark, sf_dir):
    """M1"""
    return scoring.dedupe_candidates(_pool(spark, sf_dir), "conv_id", "text", "turn")


@query(f"""
WITH c AS (SELECT conv_id, min(turn) AS turn, min_by(text, turn) AS text, count(*) AS support FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY support DESC, turn) AS r, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::DOUBLE AS n, {_SETS.format('text')} AS s FROM c),
m AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY conv_id) AS med FROM k WHERE r <= 32),
p AS (SELECT a.conv_id, a.turn, avg(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 100.0 ELSE 100.0 * len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE END) AS mean FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY ALL),
f AS (SELECT m.conv_id, m.turn, m.text, m.support, coalesce(mean, 0) + 0.1 * 100 * exp(-0.5 * pow((n - med) / greatest(0.4 * med, 5.0), 2)) AS score FROM m LEFT JOIN p USING (conv_id, turn))
SELECT conv_id, turn, text, support, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, turn) AS k FROM f) WHERE k = 1""")
def mbr_pick(spark, sf_dir):
    """M5 to M8 by word sets and length alone."""
    out = scoring.mbr(_pool(spark, sf_dir), "conv_id", "text", "turn", w_chrf=0, w_bleu=0, w_jaccard=1)
    return out.withColumn("score", F.round("score", 6))


@query()
def mbr_full(spark, sf_dir):
    """M8 with all scores."""
    return scoring.mbr(_pool(spark, sf_dir), "conv_id", "text", "turn")


@query()
def diverse_candidates(spark, sf_dir):
    """M9"""
    pool = _pool(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("t"))
    return pool.select("conv_id", scoring.diverse_subset(F.array_distinct("t"), 3).alias("subset"))


@query()
def rouge(spark, sf_dir):
    """M12"""
    return pairs(spark, sf_dir).select("conv_id", "turn", scoring.rouge2(F.col("source"), F.col("target"))["f1"].alias("f1"))


_VECTORS = "WITH v AS (SELECT label AS model, idx, avg(value) AS value FROM (SELECT label, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY ALL)"


def _vectors(spark, sf_dir):
    """One mean vector for each label, as a model's weights."""
    v = weights.vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return v.groupBy("model", F.col("idx").cast("long").alias("idx")).agg(F.avg(F.col("value").cast("double")).alias("value"))


@query(_VECTORS + """, r AS (SELECT model, idx, round(value, 12) AS value FROM v),
k AS (SELECT *, CASE WHEN rank() OVER (PARTITION BY model ORDER BY abs(value) DESC) <= floor(count(*) OVER (PARTITION BY model) * 0.5) THEN value ELSE 0 END AS t FROM r),
s AS (SELECT idx, sign(round(sum(t), 10)) AS s FROM k GROUP BY idx)
SELECT idx, round(coalesce(avg(t) FILTER (sign(t) = s AND t <> 0), 0), 6) AS value FROM k JOIN s USING (idx) GROUP BY idx""")
def ties_merge(spark, sf_dir):
    """X1"""
    v = _vectors(spark, sf_dir).withColumn("value", F.round("value", 12))
    return weights.ties_merge(v, 0.5).withColumn("value", F.round("value", 6))


@query(_VECTORS + "SELECT idx, round(sum(value) * 0.4, 6) AS value FROM v GROUP BY idx")
def task_vectors(spark, sf_dir):
    """X2"""
    return weights.task_sum(_vectors(spark, sf_dir), 0.4).withColumn("value", F.round("value", 6))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def checkpoint_resume_stream(spark, sf_dir):
    """K5, S8, J22 as a stream: events through a file stream into a log, started twice, each row once."""
    sink, state = scratch(spark, "event-log"), scratch(spark, "event-state")
    schema = table(spark, sf_dir, "events").schema
    for _ in range(2):
        run_log(spark, f"{sf_dir}/events.parquet*", schema, sink, state).awaitTermination()
    log = spark.read.schema(schema).parquet(sink)
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_by_key(spark, sf_dir):
    """The last row of each key."""
    from tessella.sources.readers import last_by_key as last

    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("o"))
    return last(e, "user_id", "o").select("user_id", "event_type", "value")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def latest_stream(spark, sf_dir):
    """S8 as a stream: events, dealt into files, one file a batch, the last row of each user kept as state. The stream is stopped after the first
    files and goes on from its checkpoint when the others have come."""
    from tessella.streaming.checkpoint import keep_latest, latest

    source, sink, state = (scratch(spark, f"latest-{x}") for x in ("source", "sink", "state"))
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "event_type", "value")
    late = F.pmod(F.xxhash64("o"), F.lit(3)) == 0
    for part in (~late, late):
        events.filter(part).repartition(2, "o").write.mode("append").parquet(source)
        keep_latest(spark, source, events.schema, sink, state, "user_id", "o", files=1).awaitTermination()
    return latest(spark, sink, "user_id").select("user_id", "event_type", "value", F.col("o.ts").alias("ts"))
