import tracemalloc

from inciflow.llm.quality import Features


def test_remembered_words_stay_small():
    """Two workers share an executor's memory with what packing remembers there."""
    features = Features()
    tracemalloc.start()
    try:
        for i in range(240_000):
            features[b"word%dx" % i]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70e6, peak
