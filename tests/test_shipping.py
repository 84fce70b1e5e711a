"""Worker code must load where this package is not installed."""

from __future__ import annotations

import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

import samplewright  # noqa: F401
from samplewright.operators import images
from samplewright.sources.archives import ZipMembers


def test_functions_carry_their_code(tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps((images.raw_decoder, images.resize_bilinear, ZipMembers)))
    script = (
        "import sys, pickle, numpy as np; decode, resize, lister = pickle.load(open('f', 'rb')); "
        "assert not any(m.startswith('samplewright') for m in sys.modules); "
        "print(resize(decode(2, 2, 3, bytes(range(12)))[None], (1, 1)).ravel().tolist())"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    want = images.resize_bilinear(np.arange(12, dtype=np.uint8).reshape(1, 2, 2, 3), (1, 1)).ravel().tolist()
    assert done.stdout.strip() == str(want), done.stderr
