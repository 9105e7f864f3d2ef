import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marketlake.session import session

    s = session("tests", master="local[4]", shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()
