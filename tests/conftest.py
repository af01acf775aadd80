import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storyloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    texts = [
        "The cat sat. The dog ran away. The cat slept.",
        "A dog ran. A cat sat down. The end came. Bye now.",
        "One sentence only",
        ". . .",
        "The cat sat. The zebra ran away. The end.",
        "the the the. cat cat. dog.",
    ]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")
