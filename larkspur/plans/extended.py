"""A round out of registered parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators.extensions import DATASETS, HOOKS, STRATEGIES, Hooks, run_round
from larkspur.plans.catalog import query
from larkspur.sources.tables import read


@DATASETS.register("labelled_vectors")
def labelled_vectors(spark, sf_dir, clients=8):
    """Vectors with their label as y, dealt out by id."""
    v = read(spark, sf_dir, "embeddings")
    return v.select((F.col("vec_id") % clients).alias("client_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))


@HOOKS.register("turned_client")
class TurnedClient(Hooks):
    """An attack: one client sends the opposite of what it has learnt."""

    def __init__(self, client: int = 0):
        self.client = client

    def upload_begin(self, params, round_):
        return params.withColumn("value", F.when(F.col("client_id") == self.client, -F.col("value")).otherwise(F.col("value")))


@HOOKS.register("clipped")
class Clipped(Hooks):
    """A defence: what clients send is cut to a range."""

    def __init__(self, most: float):
        self.most = most

    def aggregate_begin(self, params, round_):
        return params.withColumn("value", F.greatest(F.least("value", F.lit(self.most)), F.lit(-self.most)))


@query("""with c as (select vec_id % 8 as client_id, cast(k - 1 as int) as pos, avg(cast(label as double) * cast(embedding[k] as double)) * 0.5 as v, count(*) as n from embeddings, (select unnest(range(1, 65)) as k) group by all)
select 0 as layer, pos, round(sum(greatest(least(case when client_id = 0 then -v else v end, 0.05), -0.05) * n) / sum(n), 6) as value from c group by pos""")
def q2_registered_round(spark, sf_dir):
    """A gradient step from zero under an attack and a defence, all found by name."""
    samples = DATASETS.get("labelled_vectors")(spark, sf_dir)
    host = samples.select(F.posexplode("x").alias("pos", "_v")).select(F.lit(0).alias("layer"), "pos", F.lit(0.0).alias("value")).distinct()
    made = run_round(samples, host, STRATEGIES.get("gradient_step")(0.5), [HOOKS.get("turned_client")(0), HOOKS.get("clipped")(0.05)])
    return made.select("layer", "pos", F.round("value", 6).alias("value"))
