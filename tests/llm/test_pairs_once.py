"""Pairs of documents that share many cells."""

import random

import numpy as np
import pyarrow as pa

from chronolith.llm import ngram_join, pivots


def test_a_pair_is_compared_in_its_least_cell(spark, monkeypatch):
    """Two groups of near copies with a passage in common share many cells, in which none of a group links with one of the other."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(70)]
    texts = []
    for _ in range(2):
        base = [*passage, *(word() for _ in range(60))]
        for _ in range(6):
            own = list(base)
            own[rng.randrange(75, 130)] = word()
            texts.append(" ".join(own))
    made = []
    once = pivots.dealt

    def dealt(tiles, run, buckets):
        out = once(tiles, run, buckets)
        made.append(sorted(map(tuple, out.collect())))
        return out

    monkeypatch.setattr(pivots, "dealt", dealt)
    got = ngram_join.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == [0] * 6 + [6] * 6
    assert all(len(set(x)) == len(x) for x in made)


def test_cells_of_lists_cut_short():
    """A pair is left out here only where a lesser cell of both is known; lists may be shorter or longer than what is known."""
    own = pa.array([[1, 5, 9], [5], [9], [2, 9]], pa.list_(pa.int64()))
    lists = pivots.cell_lists(pa.table({"own": own}))
    assert lists.shape == (4, pivots.KNOWN)
    others = np.array([1, 2, 3])
    assert pivots.first_here(lists, 0, others, 5).tolist() == [True, True, True]
    assert pivots.first_here(lists, 0, others, 9).tolist() == [False, True, True]
