"""End-to-end corpus preparation: score filter -> (top-N) -> pairing join
-> HTML cleaning -> length filter -> leakage-safe grouped split.

The cleaned pairs are written once to the shared checkpoint folder before
the split: the split reads them several times (distinct titles, bucket
counts, boundary ranks, the rows themselves), and re-deriving them would
re-run the join and the HTML cleaning each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import prep, split
from ..session import materialize


def prepare_corpus(questions: DataFrame, answers: DataFrame, *, min_score: int = 5,
                   max_samples: int | None = 200, test_size: float = 0.14, val_size: float = 0.06,
                   seed: int = 42, require_rows: bool = False) -> DataFrame:
    """Q&A pairs with a ``split`` column in {train, test, val}."""
    qa = materialize(prep.load_qa_pairs(questions, answers, min_score=min_score, max_samples=max_samples),
                     "qa-pairs")
    if require_rows:
        prep.require_nonempty(qa, "No Q&A pairs after filtering. Try lowering min_score.")
    return split.grouped_split(qa, test_size=test_size, val_size=val_size, seed=seed)
