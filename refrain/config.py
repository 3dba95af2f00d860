"""Detection parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectConfig:
    """Parameters that the detectors share.

    ``strict`` counts distinct sequences where the historical behaviour (``strict=False``)
    counts rows.
    """

    threshold: int = 3
    min_duration: float = 10.0
    similarity_threshold: float = 0.75
    sample_rate: float = 5.0
    audio_rate: float = 1.0
    quick: bool = False
    video_algorithm: str = "current"
    audio_algorithm: str = "chromaprint"
    audio_only: bool = False
    window_frames: int | None = None
    strict: bool = True

    @property
    def max_distance(self) -> int:
        """Hamming radius of the similarity threshold."""
        return int(64 * (1 - self.similarity_threshold))


def effective_threshold(requested: int, inputs: int) -> int:
    """FLT-11: at least 1, at most the number of inputs; unchanged without inputs."""
    return requested if inputs == 0 else max(1, min(requested, inputs))


def window_size(min_frames: int, min_duration: float, kind: str = "video") -> int:
    """WIN-5: frames in a window, from the shortest sequence and the least duration."""
    least = 3 if kind == "audio" or (kind == "video" and min_frames < 20) else 10
    return max(int(min_duration), least)
