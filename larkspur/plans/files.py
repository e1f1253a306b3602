"""Queries through array and matrix files."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.plans.catalog import query
from larkspur.sources import arrays
from larkspur.sources.tables import read
from larkspur.streaming.client_state import own_folder


@query("""with x as (select vec_id, k - 1 as col, cast(embedding[k] as double) as value from embeddings, (select unnest(range(1, 65)) as k)),
o as (select *, cast(case when col < 22 then 0 when col < 43 then 1 else 2 end as bigint) as client_id from x)
select client_id, vec_id as row, round(sum(value), 6) as total, count(*) as width from o where client_id = 1 and vec_id between 100 and 299 group by all""")
def k2_s18_r7_matrix_files(spark, sf_dir):
    """Columns of three owners as row-range files; one owner's rows 100 to 299 read back."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("e"))
    parts = F.array(*[F.struct(F.lit(k).alias("client_id"), F.slice("e", a + 1, b - a).alias("x")) for k, (a, b) in enumerate(((0, 22), (22, 43), (43, 64)))])
    path = own_folder(spark, "matrix")
    arrays.save_matrix(v.select("row", F.explode(parts).alias("p")).select("p.client_id", "row", "p.x"), path)
    back = arrays.load_matrix(spark, path, client=1, first=100, end=300, rows_per_partition=64)
    return back.select("client_id", "row", F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("x").cast("long").alias("width"))
