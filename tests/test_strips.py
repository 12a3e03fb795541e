"""Components over strips against components of whole pictures."""

import numpy as np
import pytest

from partloom.operators import imaging, strips


def pictures():
    r = np.random.default_rng(4)
    out = {k: (r.random((90, 70)) < p).astype(np.uint8) for k, p in enumerate((0.3, 0.55, 0.62, 0.7))}
    spiral = np.zeros((120, 60), np.uint8)
    for k in range(0, 28, 4):
        spiral[k : 120 - k, k], spiral[k : 120 - k, 59 - k], spiral[119 - k, k : 60 - k] = 1, 1, 1
        spiral[k, k : 60 - k] = 1
        spiral[k, k + 2] = 0
    return out | {10: spiral, 11: np.zeros((5, 8), np.uint8), 12: np.ones((65, 9), np.uint8)}


@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_strips_give_whole_components(spark, rows):
    held = pictures()
    df = spark.createDataFrame([(k, bytearray(imaging.g4_encode(p)), p.shape[1], p.shape[0]) for k, p in held.items()] + [(99, None, 5, 5)], "section_id long, diagram binary, width int, height int")
    got = sorted(tuple(r) for r in strips.component_boxes(strips.picture_runs(df), rows).collect())
    want = sorted((k, *map(int, b)) for k, p in held.items() for b in imaging.boxes_of(*imaging.components(p != 0)))
    assert got == want and len(got) > 1000


def test_bands_of_one_picture(spark):
    """A picture coded in bands, which no task decodes as a whole."""
    p = pictures()[2]
    bands = [(1, bytearray(imaging.g4_encode(p[y : y + 20])), 70, len(p[y : y + 20]), y) for y in range(0, 90, 20)]
    df = spark.createDataFrame(bands, "section_id long, diagram binary, width int, height int, top int")
    got = sorted(tuple(r)[1:] for r in strips.component_boxes(strips.picture_runs(df), 8).collect())
    assert got == sorted(tuple(map(int, b)) for b in imaging.boxes_of(*imaging.components(p != 0)))
