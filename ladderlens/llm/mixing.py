"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents fall into cells of source, language and topic. The cells' token weights are raked: scaled to
the targets of one dimension after the other until all margins hold. A document's calibrated
probability is its cell's raked share over its actual one, scaled so that the most wanted cell is kept
whole; a hash of its id draws it. The expected tokens of the sample then have the target margins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.llm.common import documents, staged

DIMENSIONS = ("source", "lang", "topic")
#: Sweeps over the dimensions. Where cells are missing that the targets need, margins come closer ever more slowly, or not
#: at all; the residual tells how far they came.
SWEEPS = 8
#: Targets of the query: each value's share is its share of tokens to this power, made to sum to 1.
TEMPER = 0.7
#: The first mark that a text holds decides its topic.
TOPICS = ((" | ", "table"), ("!!", "shout"), ("@", "contact"))
OTHER_TOPIC = "prose"
WORD = r"[^\x20\x09-\x0D]+"
#: Cells that may be broadcast; more of them are joined by shuffling.
BROADCAST_CELLS = 100_000
SEED = "mix"
DIGITS = 9


def topic(text: Column) -> Column:
    found = F.lit(OTHER_TOPIC)
    for mark, name in reversed(TOPICS):
        found = F.when(F.contains(text, F.lit(mark)), name).otherwise(found)
    return found


def with_cells(docs: DataFrame) -> DataFrame:
    """(row, source, lang, topic, tokens): the documents' columns in one struct, whatever their names, with
    their cells and sizes in words. Nulls count as empty strings."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic(text).alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """Target shares (value, target) of a dimension from its own share of tokens."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("n")).withColumn("n", F.pow(F.col("n").cast("double"), F.lit(power)))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("all")))).select(dimension, (F.col("n") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (dimensions, tokens) with ``weight``: shares whose margins meet the targets (value, target), and
    ``residual``, how far the furthest margin still is from its target.

    ``sweeps`` sweeps over the dimensions, each written to the shared folder so that plans stay short. Values
    without a target keep no weight; cells without tokens keep none either.
    """
    total = cells.agg(F.sum("tokens").alias("all"))
    now = cells.crossJoin(F.broadcast(total)).withColumn("weight", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0))).drop("all")
    for dimension, target in targets.items():
        now = now.join(target.withColumnRenamed("target", f"target_{dimension}"), dimension, "left")
    now = staged(now, "cells")
    for _ in range(sweeps):
        for dimension in targets:
            margin = F.sum("weight").over(Window.partitionBy(dimension))
            share = F.coalesce(F.col(f"target_{dimension}"), F.lit(0.0))
            now = now.withColumn("weight", F.when(margin > 0, F.col("weight") * share / margin).otherwise(0.0))
        now = staged(now, "cells")
    off = margins(now, targets).agg(F.max(F.abs(F.col("share") - F.col("target"))).alias("off"))
    return now.crossJoin(F.broadcast(off.select(F.coalesce("off", F.lit(0.0)).alias("residual"))))


def margins(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, share, target) after raking: how far each margin is from its target."""
    found = None
    for dimension, target in targets.items():
        own = raked.groupBy(dimension).agg(F.sum("weight").alias("share")).join(target, dimension, "full").select(F.lit(dimension).alias("dimension"), F.col(dimension).alias("value"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("target", F.lit(0.0)).alias("target"))
        found = own if found is None else found.union(own)
    return found


def probabilities(raked: DataFrame) -> DataFrame:
    """(dimensions, weight, residual, probability): the raked share over the actual one, the largest being kept whole."""
    total = raked.agg(F.sum("tokens").alias("all"))
    ratio = raked.crossJoin(F.broadcast(total)).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") * F.col("all") / F.col("tokens")).otherwise(0.0))
    most = ratio.agg(F.max("ratio").alias("most"))
    chance = F.when(F.col("most") > 0, F.col("ratio") / F.col("most")).otherwise(0.0)
    return ratio.crossJoin(F.broadcast(most)).select(*DIMENSIONS, F.round("weight", DIGITS).alias("weight"), F.round("residual", DIGITS).alias("residual"), F.round(chance, DIGITS).alias("probability"))


def draw(key: Column) -> Column:
    """A number from 0 to 1 from the hash of a key; null draws as the empty string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample(docs: DataFrame, targets=tempered, sweeps: int = SWEEPS) -> DataFrame:
    """The drawn documents: (row, source, lang, topic, tokens, weight, residual, probability).

    ``targets`` gives (value, target) from the cells and a dimension's name. What is shuffled is one
    row per cell and task; the texts stay where they are unless there are more than BROADCAST_CELLS cells.
    Rows of one doc_id are drawn together, repeated ones included; those without one are drawn as one. Texts of
    no words are in a cell like any other. An empty table gives an empty one.
    """
    celled = with_cells(docs)
    cells = staged(celled.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    chances = staged(probabilities(rake(cells, {x: targets(cells, x) for x in DIMENSIONS}, sweeps)), "chances")
    if chances.count() <= BROADCAST_CELLS:
        chances = F.broadcast(chances)
    return celled.join(chances, list(DIMENSIONS)).where(draw(F.col("row.doc_id")) < F.col("probability"))


def op2_source_mixing(spark, sf_dir):
    drawn = sample(documents(spark, sf_dir).select("doc_id", "source", "lang", "text"))
    return drawn.select("row.doc_id", *DIMENSIONS, "tokens", "weight", "residual", "probability")


def _sql() -> str:
    marks = " ".join(f"WHEN contains(coalesce(text, ''), '{mark}') THEN '{name}'" for mark, name in TOPICS)
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {marks} ELSE '{OTHER_TOPIC}' END AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMENSIONS:
        parts.append(f"t_{x} AS MATERIALIZED (SELECT {x}, n / sum(n) OVER () AS target_{x} FROM (SELECT {x}, power(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS n FROM cells GROUP BY {x}))")
    parts.append("w0 AS MATERIALIZED (SELECT cells.*, target_source, target_lang, target_topic, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS weight FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    step = 0
    for _ in range(SWEEPS):
        for x in DIMENSIONS:
            step += 1
            parts.append(f"w{step} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN margin > 0 THEN weight * target_{x} / margin ELSE 0.0 END AS weight) EXCLUDE (margin) FROM (SELECT *, sum(weight) OVER (PARTITION BY {x}) AS margin FROM w{step - 1}))".replace("SELECT * REPLACE (CASE", "SELECT * EXCLUDE (margin) REPLACE (CASE").replace(" EXCLUDE (margin) FROM (", " FROM ("))
    off = " UNION ALL ".join(f"SELECT max(abs(s - t)) AS off FROM (SELECT sum(weight) AS s, any_value(target_{x}) AS t FROM w{step} GROUP BY {x})" for x in DIMENSIONS)
    parts.append(f"o AS MATERIALIZED (SELECT round(coalesce(max(off), 0.0), {DIGITS}) AS residual FROM ({off}))")
    parts.append(f"r AS MATERIALIZED (SELECT source, lang, topic, weight, CASE WHEN tokens > 0 THEN weight * sum(tokens) OVER () / tokens ELSE 0.0 END AS ratio FROM w{step})")
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, round(weight, {DIGITS}) AS weight, round(CASE WHEN max(ratio) OVER () > 0 THEN ratio / max(ratio) OVER () ELSE 0.0 END, {DIGITS}) AS probability FROM r)")
    chosen = f"CAST(('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / {float(1 << 48)} < probability"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens, weight, residual, probability FROM d JOIN p USING (source, lang, topic), o WHERE {chosen}"


OP2_SQL = _sql()
