import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliant.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("foliant-tests", 4, {"spark.checkpoint.dir": shared, "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("FOLIANT_TESTDATA", "/root/testdata") + "/sf0.001"


FILE_COLUMNS = (
    "id long, file_path string, file_name string, description string, text_content string, transcript_text string,"
    " tags string, needs_review int, indexed_at long"
)


@pytest.fixture(scope="session")
def make_files(spark):
    """``files`` relation out of short rows (path, name, description, text[, transcript[, tags]])."""

    def make(rows):
        full = []
        for i, row in enumerate(rows, 1):
            path, name, description, text, *rest = row
            transcript, tags = (list(rest) + ["", ""])[:2]
            full.append((i, path, name, description, text or "", transcript, tags, 0, 1000 + i))
        return spark.createDataFrame(full, FILE_COLUMNS)

    return make
