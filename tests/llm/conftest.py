import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))

from plain import TEXTS  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with those of results and of intermediate steps."""
    names = ["score", "SCORE_", "n_words", "n_removed", "kept_text", "lang_pred", "has_letter", "owner", "lost_hashes", "row", "component_id", "text_hash", "piece_ids", "lossless", "labels", "host", "template", "bucket", "__id", "source", "n_chars", "predicted", "rule", "verdict", "t", "d", "i"]
    rows = [(d, t, "en" if n % 2 else None, *[f"{c}{n}" for c in names]) for n, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", "lang string", *(f"`{c}` string" for c in names)]))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf001():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the synthetic tables aren't here")
    return path
