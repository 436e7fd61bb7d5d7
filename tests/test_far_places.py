"""Places beyond 180 degrees, and latitudes on a limit, against the SQL twins."""

import duckdb
import pytest

from smokelake.plans import ORACLES, QUERIES

from .compare import connection, duck_rows, spark_rows
from .conftest import DATA


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(user_id + 885000 AS BIGINT) AS user_id) FROM '{DATA}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(c_custkey + 1450 AS BIGINT) AS c_custkey) FROM '{DATA}/customer.parquet') TO '{folder}/customer.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["b16_pixel_to_ground", "b17_static_position", "i07_localize_stream", "j03_geodesic_functions"])
def test_far_from_the_meridian(spark, far, name):
    got = spark_rows(QUERIES[name](spark, far))
    assert got[1] and got == duck_rows(connection(far), ORACLES[name])
