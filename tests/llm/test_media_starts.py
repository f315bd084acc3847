from types import SimpleNamespace

import numpy as np

from quern.llm import media


def test_features_list_every_shot():
    found = media._features(np.ones((40, media.BINS), np.int64), np.arange(0, 40, 2), SimpleNamespace(seconds_per_frame=1.0))
    assert "shots=20;" in found and len(found.split("starts=")[1].split(",")) == 20
