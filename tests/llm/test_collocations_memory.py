"""What a batch of a relation's rows holds."""

import numpy as np

from gleanery.llm import collocations


def test_a_batch_of_rows_is_small():
    codes = np.arange(1, 200_001, dtype=np.uint64)
    codes[::8] = 0
    rows = collocations.rows_of(codes)
    assert rows.flatten().to_numpy().view(np.uint64).tolist() == codes.tolist()
    # Spark and Python hold batches of 10,000 rows, one for each task that runs.
    assert max(rows.value_lengths().to_pylist()) * 8 * 10_000 <= 12 << 20
