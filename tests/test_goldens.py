"""Numbers of published edit plans."""

import numpy as np
import pytest

from spliceflow.operators import editing, similarity, structure

#: Duration, overlap with the clip before, and start of each clip of one plan, in seconds.
PLAN = [(11.003310657596371, 0.0, 0.0), (6.005170068027211, 0.07696145124716554, 10.926349206349206), (0.35147392290249435, 0.07696145124716554, 16.85455782312925)]
PLAN_END = 17.206031746031748


def test_timeline_of_a_published_plan(spark):
    clips = spark.createDataFrame([("r", k, d, o, 0.0) for k, (d, o, _) in enumerate(PLAN)], "run_id string, clip long, duration double, overlap_before double, gap_after double")
    got = editing.timeline(clips).orderBy("clip").collect()
    assert all(abs(r.timeline_start - s) < 1e-9 for r, (_, _, s) in zip(got, PLAN)) and abs(got[-1].timeline_end - PLAN_END) < 1e-9


#: Published segments of two minutes (start, end, label, confidence, cluster) and the labels that are left of them; the clips last 60 seconds.
STRUCTURES = [
    ([(1.907, 18.327, "chorus", 0.8, 0), (18.327, 32.651, "chorus", 0.8, 0), (32.651, 51.119, "chorus", 0.8, 0), (51.119, 60.291, "outro", 0.8, 0)], ["intro", "outro"]),
    ([(1.103, 18.202, "chorus", 0.8, 0), (18.202, 41.735, "chorus", 0.8, 0), (41.735, 60.479, "chorus", 0.8, 0)], ["outro"]),
]


def consolidated(spark, rows, duration=60.0, **how):
    s = spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], "track long, seg long, start double, end double, label string, confidence double, cluster long")
    d = spark.createDataFrame([(0, duration)], "track long, duration double")
    return structure.consolidate(s, d, **how).orderBy("seg").collect()


@pytest.mark.parametrize("rows,labels", STRUCTURES)
def test_labels_of_published_structures(spark, rows, labels):
    got = consolidated(spark, rows)
    assert [r.label for r in got] == labels and got[0].start == 0.0 and got[-1].end == 60.0
    assert all(a.end == b.start for a, b in zip(got, got[1:])) and all(abs(r.confidence - 0.8) < 1e-12 for r in got)


def test_rules_of_consolidation(spark):
    seg = lambda sizes, labels, conf=None: [(float(sum(sizes[:k])), float(sum(sizes[: k + 1])), lab, conf[k] if conf else 0.5, k) for k, lab in enumerate(labels)]
    names = lambda got: [(r.label, r.end - r.start) for r in got]
    # a bridge of up to 8 between equals goes, one of 9 stays; other labels go under 7.5
    assert names(consolidated(spark, seg([40, 8, 40, 40], ["verse", "bridge", "verse", "chorus"]), 200.0)) == [("intro", 88.0), ("chorus", 112.0)]
    assert len(consolidated(spark, seg([40, 9, 40, 40], ["verse", "bridge", "verse", "chorus"]), 200.0)) == 4
    assert len(consolidated(spark, seg([40, 7, 40, 40], ["verse", "solo", "verse", "chorus"]), 200.0)) == 2
    assert len(consolidated(spark, seg([40, 8, 40, 40], ["verse", "solo", "verse", "chorus"]), 200.0)) == 4
    # confidences: pairwise for neighbours of one label, the mean of three around a short one; the left one's cluster stays
    got = consolidated(spark, seg([40, 40, 40, 5, 40, 60], ["a", "a", "a", "b", "a", "c"], [1.0, 0.0, 0.5, 0.2, 0.9, 0.4]), 300.0)
    assert abs(got[0].confidence - (0.5 + 0.2 + 0.9) / 3) < 1e-12 and got[0].cluster == 0
    # over the most: the shortest inner one to the longer side, the right one of equals
    got = consolidated(spark, seg([50, 30, 20, 30, 70], list("abcde")), 400.0, most=4)
    assert names(got)[1:3] == [("b", 30.0), ("d", 50.0)]
    got = consolidated(spark, seg([50, 40, 20, 30, 70], list("abcde")), 400.0, most=4)
    assert names(got)[1:3] == [("b", 60.0), ("d", 30.0)]
    got = consolidated(spark, seg([50, 30, 20, 30, 70], list("abcbe")), 400.0, most=4)
    assert names(got) == [("intro", 50.0), ("b", 80.0), ("e", 270.0)]


@pytest.mark.parametrize("shift,n", [(-17, 400), (23, 400), (0, 400), (5, 400), (0, 31)])
def test_published_shifts_are_found(spark, shift, n):
    """Noise moved by a known number of samples; under 32 samples nothing is moved."""
    x = np.random.default_rng(8).normal(size=n + 200)
    a, b = x[100 : 100 + n], x[100 - shift : 100 - shift + n]
    d = spark.createDataFrame([(0, a.tolist(), b.tolist())], "track long, wa array<double>, wb array<double>")
    got = similarity.align_shift(d, 64).first()
    assert abs(got["shift"]) == abs(shift)
