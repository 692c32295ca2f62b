import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pagesift.session import get_session
    s = get_session("local[4]", app="pagesift-tests", shuffle_partitions=4)
    # tests set their own checkpoint folder only because none is configured
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt")))
    yield s


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")
