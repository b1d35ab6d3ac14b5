import itertools
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerspark.operators import contract  # noqa: E402
from ledgerspark.schema import RAW_COLUMNS  # noqa: E402
from ledgerspark.session import local_session, shared_folder  # noqa: E402

LOADED_AT = datetime(2025, 2, 3, 14, 30)
# One sound line; a test names the fields in which its lines differ from it.
SOUND = dict(
    zip(
        RAW_COLUMNS,
        ("700001", "52017", "\tbrass kettle ", "4", "2009-12-05 10:20:00", "3.25", "20417.0", " Norway"),
    )
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def folder(spark, request):
    """A folder of the shared store that no other test writes to."""
    from uuid import uuid4

    return f"{shared_folder(spark)}/tests/{request.node.name[:40].split('[')[0]}-{uuid4().hex}"


@pytest.fixture(scope="session")
def raw_frame(spark):
    """A frame of raw lines, one for each dictionary of fields that differ from ``SOUND``."""

    def frame(*differing, sheet="Year 2009-2010", types=None, numbers=None):
        kinds = dict.fromkeys(RAW_COLUMNS, T.StringType()) | (types or {})
        schema = T.StructType().add("source_sheet", "string").add("source_row_number", "long")
        for name in RAW_COLUMNS:
            schema = schema.add(name, kinds[name])
        differing = list(differing) or [{}]
        numbers = numbers or itertools.count(2)
        data = []
        for number, fields in zip(numbers, differing):
            line = SOUND | fields
            data.append([sheet, number] + [line[name] for name in RAW_COLUMNS])
        return spark.createDataFrame(data, schema)

    return frame


@pytest.fixture(scope="session")
def classified(raw_frame):
    """Collected classified rows in source order."""

    def run(*overrides, **kwargs):
        df = contract.classify(raw_frame(*overrides, **kwargs), LOADED_AT)
        return df.orderBy("source_row_number").collect()

    return run
