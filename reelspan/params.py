"""Typed settings. Every default is a fixed value of the published behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ClipParams:
    target_count: int = 8
    min_duration_sec: float = 18.0
    max_duration_sec: float = 48.0
    preferred_duration_sec: float = 28.0
    avoid_cutting_sentences: bool = True
    ending_strategy: str = "complete_sentence"
    cliffhanger_min_duration_sec: float = 14.0
    cliffhanger_max_duration_sec: float = 28.0
    cliffhanger_preferred_duration_sec: float = 21.0
    pad_before_sec: float = 0.35
    pad_after_sec: float = 0.45
    min_score: float = 70.0

    @property
    def pool_size(self) -> int:
        return max(self.target_count * 20, 120)


@dataclass(frozen=True)
class SuggestionParams:
    max_window_sec: float = 120.0
    overlap_sec: float = 20.0


@dataclass(frozen=True)
class SpeakerParams:
    max_speakers: int = 4
    min_segment_sec: float = 0.6
    distance_threshold: float = 0.22


@dataclass(frozen=True)
class CaptionParams:
    max_words_per_line: int = 3


@dataclass(frozen=True)
class EditParams:
    enabled: bool = True
    profile: str = "story"
    max_pause_sec: float = 0.65
    punch_zoom_enabled: bool = True
    max_punch_zoom_per_10_sec: int = 3
    pattern_interrupt_every_sec: float = 3.2
    scene_guard_sec: float = 0.90
    hook_title_enabled: bool = False
    progress_bar_enabled: bool = False
    audio_normalization_enabled: bool = True


@dataclass(frozen=True)
class RenderParams:
    width: int = 1080
    height: int = 1920
    fps: int = 30
    end_card_sec: float = 1.0
    expect_audio: bool = True


@dataclass(frozen=True)
class LearningParams:
    enabled: bool = True
    min_feedback: int = 12
    min_metrics: int = 8
    personal_score_weight: float = 0.35
    save_training_rows: bool = True


@dataclass(frozen=True)
class Params:
    clips: ClipParams = field(default_factory=ClipParams)
    suggestions: SuggestionParams = field(default_factory=SuggestionParams)
    speakers: SpeakerParams = field(default_factory=SpeakerParams)
    captions: CaptionParams = field(default_factory=CaptionParams)
    edits: EditParams = field(default_factory=EditParams)
    render: RenderParams = field(default_factory=RenderParams)
    learning: LearningParams = field(default_factory=LearningParams)
