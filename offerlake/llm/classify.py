"""What the two document classifiers share: metrics of the logistic link and the sample's bounds."""

from __future__ import annotations

import numpy as np

#: Bounds of the labelled sample that a model is fitted on.
SAMPLE_PER_CLASS = 1600
SAMPLE_MAX_CHARS = 12_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class Adam:
    """Adam steps over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.turn = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for name, g in grads.items():
            self.first[name] = 0.9 * self.first[name] + 0.1 * g
            self.second[name] = 0.999 * self.second[name] + 0.001 * g * g
            m = self.first[name] / (1 - 0.9**self.turn)
            v = self.second[name] / (1 - 0.999**self.turn)
            self.params[name] -= self.rate * m / (np.sqrt(v) + 1e-8)


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression; (coefficients, intercept)."""
    params = {"w": np.zeros(x.shape[1]), "b": np.zeros(1)}
    adam, total = Adam(params, rate), max(weight.sum(), 1e-9)
    for _ in range(rounds):
        error = weight * (sigmoid(x @ params["w"] + params["b"][0]) - y) / total
        adam.step({"w": x.T @ error + ridge * params["w"], "b": np.array([error.sum()])})
    return params["w"], float(params["b"][0])
