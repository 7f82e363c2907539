"""Segments that come again and again are encoded once, whatever else passes through the cache."""

import numpy as np

from blockframe.llm.segments import SegmentEncoder


def test_frequent_segments_stay():
    asked = []

    def encode(segments):
        asked.extend(segments)
        return [[*s] for s in segments]

    own = SegmentEncoder(encode, lambda flat: flat == 32, most=60)
    frequent = b"".join(b" often%d" % i for i in range(20))
    for k in range(40):
        text = frequent + b"".join(b" rare%dx%d" % (k, i) for i in range(15))
        ids, at = own.texts([text, b"", text])
        assert bytes(ids.astype(np.uint8)) == text + text and at.tolist() == [0, len(text), len(text), 2 * len(text)]
    assert max(asked.count(b" often%d" % i) for i in range(20)) == 1
    assert len(own.known) < 160
