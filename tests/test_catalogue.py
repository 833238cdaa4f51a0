"""Every catalogue query against DuckDB over the same tables."""

import datetime
import math

import pytest

from lodestone.plans import catalogue, service  # noqa: F401  both register their queries


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in catalogue.ORACLES:
        assert rows
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in cols]) for r in rows) == want


def test_label_hit_rate_asks_every_vector(spark, tmp_path):
    """Of these only 20 is divisible by 20, and it alone would give 1 and 1; the last has no label, so no hit rate."""
    import duckdb

    rows = [(20, [1.0, 0.0], 0), (21, [0.9, 0.1], 0), (22, [0.0, 1.0], 1), (23, [0.1, 0.9], 2), (24, [0.5, 0.5], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["label_hit_rate"](spark, str(tmp_path)).collect()] == [(0.5, 0.4)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert con.execute(catalogue.ORACLES["label_hit_rate"]).fetchall() == [(0.5, 0.4)]
    assert all("q.vec_id % 20 = 0" in catalogue.ORACLES[name] for name in ("cosine_topk", "cosine_filtered", "indexed_cosine"))
