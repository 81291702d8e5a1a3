import os
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkinsight.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=8,
                    conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="si-test-ckpt-")})
    yield s


@pytest.fixture(scope="session")
def sample_df(spark):
    """200 x 5 frame: age, salary, dept, churn, score (seed 42)."""
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({
        "age": rng.integers(18, 70, 200),
        "salary": rng.normal(55000, 15000, 200),
        "dept": rng.choice(["Sales", "Eng", "HR", "Finance"], 200),
        "churn": rng.choice([0, 1], 200, p=[0.75, 0.25]),
        "score": rng.uniform(0, 100, 200),
    })
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="session")
def dirty_df(spark):
    rows = [(1.0, "cat", 10), (2.0, "dog", 20), (None, None, 30), (4.0, "cat", 40),
            (5.0, "bird", 50), (5.0, "dog", 20), (1000.0, "cat", 10)]
    return spark.createDataFrame(rows, "A double, B string, C bigint")
