import pytest

from cinderplan.llm import quality_lm


@pytest.fixture(autouse=True)
def few_waves(monkeypatch, request):
    """Small tables are judged in fewer parts; tests that ask for all_waves keep the number of production."""
    if "all_waves" not in request.keywords:
        monkeypatch.setattr(quality_lm, "WAVES", quality_lm.FOLDS)
