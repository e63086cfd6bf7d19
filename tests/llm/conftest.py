import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


@pytest.fixture(autouse=True)
def package(spark):
    from termtide.llm.common import shipped

    shipped(spark)
