import numpy as np
import pyarrow as pa
import pytest

from stratafold.llm import arrowtext as at


@pytest.mark.parametrize("limit", [5, 1000])
def test_remembered_words_have_their_own_rows(limit, monkeypatch):
    """However many are forgotten on the way."""
    monkeypatch.setattr(at.WordTable, "LIMIT", limit)
    made = []
    table = at.WordTable(lambda words: made.extend(words) or np.array([[len(w), ord(w[0])] for w in words], float).reshape(-1, 2))
    rng = np.random.default_rng(0)
    vocabulary = [chr(97 + i % 26) * (1 + i // 26) for i in range(60)]
    for _ in range(40):
        words = list(dict.fromkeys(rng.choice(vocabulary, int(rng.integers(0, 12)))))
        assert table.of(pa.array(words, pa.string())).tolist() == [[len(w), ord(w[0])] for w in words]
        assert len(table.known) == len(table.rows) == len(table.met) <= limit + 12
    assert (len(made) == len(set(made))) == (limit == 1000)


def test_slices_cover_all_texts_in_order():
    texts = pa.array(["a" * n for n in (5, 0, 100, 3, 3, 3)])
    assert list(at.slices(texts, 10)) == [(0, 2), (2, 1), (3, 3)] and list(at.slices(texts.slice(0, 0))) == []
    words = at.words_of(pa.array([" a b", "", "b\tc ", "\n"]))
    assert np.array(words.distinct)[words.index].tolist() == ["a", "b", "b", "c"] and words.begin.tolist() == [0, 2, 2, 4, 4] and words.owner().tolist() == [0, 0, 2, 2]
