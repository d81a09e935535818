import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    return local_session(8, partitions=4, app="quire-tests")


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column expression over one text."""
    from pyspark.sql import functions as F

    def run(build, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
        return df.select(build(*[F.col(n) for n in names]).alias("out")).first()["out"]

    return run
