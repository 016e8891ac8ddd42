"""Shingle sets of batches with fewer words than a shingle."""

import pyarrow as pa
import pytest

from tidegauge.llm.words import shingle_sets, words_of


@pytest.mark.parametrize("size", [4, 5])
@pytest.mark.parametrize("texts", [["a"], ["a b"], ["a b c"], ["a", None, "b c"], [""], [None]])
def test_few_words_in_a_batch(texts, size):
    """A text alone in its batch has the set that it has among others."""
    alone, among = (shingle_sets(words_of(pa.array(x, pa.string())), size) for x in (texts, [*texts, "p q r s t u v w"]))
    assert [x.tolist() for x in alone] == [x.tolist() for x in among[:-1]]
    assert [len(x) for x in alone] == [int(bool(x)) for x in texts]
