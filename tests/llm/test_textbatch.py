import numpy as np

from quern.llm import textbatch as tb


def test_hashes_do_not_depend_on_stretches():
    for text in (b"ab cd " + b"x" * 1_500_000, b"ab " * 10 + b" " * 1_200_000, b"q" * 900_000 + b" zz " + b" " * 900_000 + b"k ", b"one two " * 100_000):
        data = np.frombuffer(text, np.uint8)
        w = tb.words_of(tb.Texts(0, 1, data, np.array([0, len(data)])))
        assert len(data) > 2 * tb.STRETCH
        assert (tb.span_hashes(data, w.start, w.end) == tb._span_hashes(data, w.start, w.end)).all()
