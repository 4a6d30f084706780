import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest test tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query with its SQL, all rows and column names."""
    import duckdb

    def compare(query, sql, folder):
        con = duckdb.connect()
        for f in Path(folder).glob("*.parquet"):
            con.sql(f"create view {f.stem} as select * from '{f}'")
        ours, theirs = query(spark, folder).toArrow(), con.sql(sql).to_arrow_table()
        names = sorted(ours.column_names)
        assert names == sorted(theirs.column_names)
        ours, theirs = ours.select(names), theirs.select(names)
        con.register("ours", ours)
        con.register("theirs", theirs)
        assert ours.num_rows == theirs.num_rows
        assert con.sql("(from ours except all from theirs) union all (from theirs except all from ours)").limit(3).fetchall() == []
        return ours.num_rows

    return compare
