import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import get_spark
    s = get_spark("local[4]", app="quillspark-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="quill-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture
def fixture_path():
    return lambda name: os.path.join(FIXTURES, name)
