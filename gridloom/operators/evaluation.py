"""From sample cells to scores per filler and to the stratified report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridloom.config import SampleConfig
from gridloom.operators import metrics, reports, samples
from gridloom.schemas import SAMPLE_KEY
from gridloom.sources.workspace import cut

Filler = Callable[[DataFrame], DataFrame]


def score_fillers(cells: DataFrame, fillers: dict[str, Filler], c: SampleConfig) -> DataFrame:
    """The four scores of each sample and filler, the filler's name as ``model``.

    A filler turns sample cells into cells with ``pred_*`` beside truth and validity. ``cells`` is
    read once per filler, so it should be written.
    """
    scored = {
        name: metrics.score(fill(cells), SAMPLE_KEY, list(c.bands), c.patch) for name, fill in fillers.items()
    }
    return reports.stack_models(scored).select("model", *SAMPLE_KEY, "rmse", "psnr", "ssim", "sam")


def evaluate(
    cube: DataFrame, planned: DataFrame, difficulty: DataFrame, fillers: dict[str, Filler], times: int, c: SampleConfig,
    shape: tuple[int, int] | None = None, split: str = "test",
) -> dict[str, DataFrame]:
    """Scores of one split's samples, their means over all, and per stratum of difficulty.

    ``difficulty`` has the strata of ``intrinsic.with_strata``. The sample cells and the scores are written
    once to the shared folder when this is called; the reports are small summaries of the scores.
    """
    wanted = planned.filter(planned["split"] == split)
    cells = cut(samples.build_samples(cube, wanted, times, c, shape), "samples")
    scores = cut(score_fillers(cells, fillers, c), "scores")
    strata = reports.by_strata(reports.join_difficulty(scores, difficulty))
    return {"scores": scores, "overall": reports.overall_table(scores), "strata": strata}
