"""What the two convolutional networks share: Adam, the logistic loss and calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, slopes: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in slopes.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            step = self.mean[k] / (1 - 0.9**self.step) / (np.sqrt(self.square[k] / (1 - 0.99**self.step)) + 1e-8)
            self.weights[k] -= (self.rate * step).astype(self.weights[k].dtype)


def calibrate(logits: np.ndarray, labels: np.ndarray, prior: float | None = None, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of Platt's scaling, by Newton's steps with his smoothed targets. prior: the share of label 1
    where the scores will be used, if the given labels have another share."""
    n1 = float(labels.sum())
    n0 = len(labels) - n1
    target = np.where(labels > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.ones(len(labels)) if prior is None or not n1 or not n0 else np.where(labels > 0.5, prior / n1, (1 - prior) / n0) * len(labels)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * logits + b)
        error, curve = weight * (p - target), weight * p * (1 - p) + 1e-9
        g = np.array([(error * logits).sum() + 1e-3 * (a - 1), error.sum()])
        h = np.array([[(curve * logits**2).sum() + 1e-3, (curve * logits).sum()], [(curve * logits).sum(), curve.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(a), 1e-3), float(b)
