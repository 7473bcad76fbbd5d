import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from entiforge.session import local_session

    s = local_session(4, 2, "tests")
    # tiny tables: planning each stage anew costs more than it saves
    s.conf.set("spark.sql.adaptive.enabled", "false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
