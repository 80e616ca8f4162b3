"""Known results of one published run with twelve systems."""

import pytest

from gridscore.operators import reports
from gridscore.operators.grid import participants

# Per system the mean penalty and ok samples in en, ja and zh-Hans, then the overall
# mean and the normalised macro mean they lead to.
RUN = [
    ("a", (0.9259259259259259, 216), (1.9351851851851851, 216), (1.8703703703703705, 216), 1.577160, 0.213161),
    ("b", (0.7870370370370371, 216), (1.6805555555555556, 216), (1.5925925925925926, 216), 1.353395, 0.175628),
    ("c", (2.2372093023255815, 215), (3.240740740740741, 216), (3.7777777777777777, 216), 3.086553, 0.488167),
    ("d", (0.10185185185185185, 216), (0.4861111111111111, 216), (0.4722222222222222, 216), 0.353395, 0.009941),
    ("e", (0.18981481481481483, 216), (0.5648148148148148, 216), (0.4074074074074074, 216), 0.387346, 0.014364),
    ("f", (1.2222222222222223, 216), (13.48611111111111, 216), (2.486111111111111, 216), 5.731481, 0.577137),
    ("g", (3.4131455399061035, 213), (3.3472222222222223, 216), (4.990610328638498, 213), 3.914330, 0.671877),
    ("h", (2.8703703703703702, 216), (2.365740740740741, 216), (2.861111111111111, 216), 2.699074, 0.450829),
    ("i", (0.37962962962962965, 216), (1.0, 216), (0.3333333333333333, 216), 0.570988, 0.035422),
    ("j", (4.264150943396227, 212), (3.511737089201878, 213), (3.3943661971830985, 213), 3.722571, 0.630000),
    ("k", (1.6157407407407407, 216), (2.2175925925925926, 216), (1.7546296296296295, 216), 1.862654, 0.267361),
    ("l", (0.3888888888888889, 216), (1.337962962962963, 216), (0.8379629629629629, 216), 0.854938, 0.080947),
]


def test_language_means_lead_to_the_published_scores(spark):
    """Every mean is a penalty sum over its samples: one row carries the sum, the others zero."""
    rows = []
    for person, *cells, _, _ in [(r[0], *r[1:]) for r in RUN]:
        for lang, (mean, samples) in zip(("en", "ja", "zh-Hans"), cells):
            rows += [(f"s{i}", lang, person, "ok", round(mean * samples) if i == 0 else 0) for i in range(samples)]
    judged = spark.createDataFrame(rows, "source_id string, target_language string, participant_id string, status string, total_penalty bigint")
    people = participants([r[0] for r in RUN])
    means = {r.participant_id: r.mean_penalty for r in reports.mean_penalties(judged, people).collect()}
    macro = {r.participant_id: r.normalized_macro_mean_penalty for r in reports.normalized_macro_mean(reports.language_leaderboard(judged, people)).collect()}
    for person, *_, mean, normalized in RUN:
        assert means[person] == pytest.approx(mean, abs=1e-6)
        assert macro[person] == pytest.approx(normalized, abs=1e-6)
