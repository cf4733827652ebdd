"""Scorers of model files, whose libraries are imported on the workers when they are used."""

from __future__ import annotations

from collections.abc import Callable


def fasttext_scorer(path: str, label: str | None = None) -> tuple[Callable[[], object], Callable[[object, list[str]], list[float]]]:
    """(setup, score) for ``model_score``: the probability of a label, or of the best one."""

    def setup() -> object:
        import fasttext

        return fasttext.load_model(path)

    def score(model: object, texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            labels, values = model.predict(t.replace("\n", " "), k=-1 if label else 1)
            by = dict(zip(labels, values, strict=True))
            out.append(float(by.get(label, 0.0) if label else values[0]))
        return out

    return setup, score


def kenlm_perplexity_scorer(path: str) -> tuple[Callable[[], object], Callable[[object, list[str]], list[float]]]:
    """(setup, score) for ``model_score``: perplexity by an n-gram model."""

    def setup() -> object:
        import kenlm

        return kenlm.Model(path)

    return setup, lambda model, texts: [float(model.perplexity(" ".join(t.split()))) for t in texts]
