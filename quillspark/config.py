"""Settings and fixed values of the style-analytics operators."""

from __future__ import annotations

from dataclasses import dataclass, field

EPSILON = 1e-12
THRESHOLD_PAD = 1e-6
DIMENSIONS = 96
SEPARATOR = "\x1f"
RISK_HIGH, RISK_MODERATE = 0.92, 0.84
GATE_MAX_FPR = 0.15
STRICT_FLOOR = 0.05
UNCERTAIN_BAND = 0.05
ACCEPTANCE = {"roc_auc": 0.90, "balanced_accuracy": 0.85, "recall": 0.85, "false_positive_rate": 0.15}
CONTROL_TYPES = ("same_topic_generic_ai_near_miss", "attempted_lookalike")
SOURCE_TYPES = ("user_supplied", "licensed", "public_domain", "openly_licensed", "api_authorized")
# Word lists that results depend on.
LEAK_STOPWORDS = "a an and are as at be but by for from i if in is it me my of on or so the that this to was were have has had did does do you your".split()
TOPIC_STOPWORDS = "that with this when what your from have just like will never there they them because".split()
IMAGE_STOPWORDS = "feel think know want need".split()
BANNED_TOPIC_WORDS = "style tone quality genre rhyme structure diction voice poetic well-written catchy".split()
FIRST_PERSON = "i i'm i've i'll me my mine myself".split()
SECOND_PERSON = "you you're you've you'll your yours yourself".split()
# Model ids, in the order that breaks ties.
MODELS = (
    "residual_margin",
    "residual_margin_dual_gate",
    "residual_margin_strict_dual_gate",
    "residual_near_miss_contrast",
    "residual_near_miss_contrast_strict",
    "raw_margin",
    "residual_target_similarity",
    "raw_target_similarity",
)
# Section types of domains that have names for them; all others have sections.
SECTION_TYPES = {
    "lyrics": ("verse", "chorus", "bridge"),
    "essay": ("introduction", "body", "conclusion"),
    "fiction": ("scene", "dialogue", "description"),
    "screenplay": ("scene", "action", "dialogue"),
}


@dataclass(frozen=True)
class Config:
    """One run's settings; every path and limit that the reference's environment variables set is a field."""

    data_root: str = "data"
    target_root: str = "target-corpus"
    background_root: str = ""
    candidate_root: str = ""
    domain: str = "lyrics"
    seed: int = 137
    section_types: tuple[str, ...] = ()
    min_contrast_margin: float = STRICT_FLOOR
    embedding_provider: str = "hash"
    topic_provider: str = "local"
    min_target_works: int = 12
    min_background_works: int = 50
    experiment_id: str = "experiment"
    target_name: str = "target"
    extra: dict = field(default_factory=dict)

    def sections(self) -> tuple[str, ...]:
        return self.section_types or SECTION_TYPES.get(self.domain, ("section",))
