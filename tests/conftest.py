import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def kept(spark, tmp_path_factory):
    """Writes a table and reads it again, so that plans stay small."""
    folder, number = tmp_path_factory.mktemp("kept"), iter(range(1000))

    def keep(df):
        path = str(folder / str(next(number)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    return keep
