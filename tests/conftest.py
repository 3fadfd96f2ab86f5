import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from watchloom.session import get_session

    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def records(spark):
    """Raw records from dictionaries."""
    def make(*dicts):
        rows = [(i, {k: None if v is None else str(v) for k, v in d.items()}) for i, d in enumerate(dicts)]
        return spark.createDataFrame(rows, "row_id bigint, raw map<string,string>")

    return make


@pytest.fixture(scope="session")
def accept(records):
    """(accepted rows, quarantine) of records of one event type."""
    from watchloom.operators.normalize import flatten_data, normalize, route_event_type

    def run(name, event_type, *dicts, settings=None):
        from watchloom.operators.settings import Settings

        raw = records(*[{"event_type": event_type, **d} for d in dicts])
        return normalize(route_event_type(flatten_data(raw)), name, settings or Settings())

    return run
