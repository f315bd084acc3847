"""What DuckDB rounds to -0.0 is -0.0 here as well."""

import math

import duckdb

from quern.plans import catalog

def test_small_negative_means_keep_their_sign(spark, tmp_path):
    rows = [(i, [(-4e-7 if j % 2 else 4e-7) * i for j in range(64)], 0) for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("k04_direction",):
        theirs = con.execute(catalog.oracle_sql()[name]).fetchall()
        ours = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert [(r[0], [str(x) for x in r[1]]) for r in ours] == [(r[0], [str(x) for x in r[1]]) for r in theirs]
        assert any(x == 0 and math.copysign(1, x) < 0 for x in ours[0][1])
