import tempfile

import pytest

from shelfwise.session import ROCKSDB, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="6g", **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB})
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def frame(spark):
    """Rows with a DDL schema; timestamps may be given as text."""
    from pyspark.sql import functions as F

    def make(rows, ddl):
        fields = [f.strip().rsplit(" ", 1) for f in ddl.split(";")]
        raw = ", ".join(f"{n} {'string' if t.startswith(('decimal', 'timestamp')) else t}" for n, t in fields)
        df = spark.createDataFrame([tuple(None if v is None else (str(v) if t.startswith(("decimal", "timestamp")) else v)
                                          for v, (_, t) in zip(r, fields)) for r in rows], raw)
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])

    return make
