"""Every constant of the transcript, clip and framing operators, with the defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists that decide results.
BANNED_OPENERS = ("and", "but", "so", "because", "or", "that", "which", "if", "when", "while", "though", "since", "as", "for", "also", "plus", "then", "actually", "basically", "like", "really", "just", "maybe", "cause", "uh", "um", "yeah", "okay", "ok", "right", "well")
BANNED_PAIRS = (("i", "mean"), ("you", "know"))
DANGLERS = ("a", "an", "the", "my", "your", "his", "her", "its", "our", "their", "to", "of", "in", "on", "at", "for", "with", "from", "and", "or", "but", "is", "was", "that", "this")
INCOMPLETE_TAILS = ("a", "an", "the", "and", "or", "but", "so", "because", "if", "when", "while", "to", "of", "in", "on", "for", "with", "as", "at", "from", "by", "into", "that", "which", "who", "whom", "whose", "my", "our", "your", "their", "it's", "its", "we're", "i've", "i'm", "that's", "there's", "just", "very", "this", "these", "those", "also", "then", "than", "like", "about")
MORE_STOPWORDS = ("i", "we", "you", "he", "she", "it", "they", "me", "us", "them", "be", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "did", "does", "not", "no", "yes", "can", "could", "would", "should", "will", "what", "how", "where", "why", "who", "all", "each", "more", "some", "any", "out", "up", "down", "over", "really", "kind", "get", "got", "go", "going")
SCORE_KEYS = ("hook", "engagement", "value", "shareability")
NTSC_RATES = ((23.976, 24), (29.97, 30), (59.94, 60))
SETTINGS = {"caption_color": "#7C5CFF", "caption_font": "default", "default_mode": "shorts", "clip_count": "auto"}
#: Patterns of words that begin a new topic, or go on with the old one; a speaker's own phrases can be given instead.
TOPIC_START = r"(?i)^\s*(anyway |another |meanwhile |i'?ve been |right now )"
CONTINUE_START = r"(?i)^\s*(that's |that is |and |because |which |so that |to be |to choose |i choose |connecting |we need )"


@dataclass(frozen=True)
class Blocks:
    """Tolerances of words and onsets in speech blocks, in seconds, and the test of a degenerate map."""

    before: float = 0.15
    after: float = 0.05
    onset_before: float = 0.05
    least: float = 0.05
    most_speech: float = 0.95
    tiny: float = 0.4
    tiny_share: float = 0.7
    tiny_blocks: int = 10


@dataclass(frozen=True)
class Windows:
    length: float = 90.0
    overlap: float = 30.0
    stretch: float = 1.25
    lead: float = 0.01
    full_rate: float = 3.2


@dataclass(frozen=True)
class Clips:
    """Candidate validation: durations in seconds, frames of a collapsed join."""

    min_dur: float = 15.0
    max_dur: float = 60.0
    under: float = 0.9
    over: float = 1.08
    teaser: tuple[float, float] = (1.0, 4.0)
    collapsed: int = 3
    lead_in: float = 0.06
    lead_out: float = 0.10
    guard: float = 0.02
    longform: bool = False

    @classmethod
    def long(cls) -> Clips:
        return cls(min_dur=120.0, max_dur=360.0, longform=True)


@dataclass(frozen=True)
class Captions:
    glitch: float = 4.0
    capped: float = 2.5
    max_words: int = 7
    hard_words: int = 10
    max_seconds: float = 5.0
    pause: float = 0.7
    min_seconds: float = 0.8
    before: float = 0.02
    inside: float = 0.005


@dataclass(frozen=True)
class Thoughts:
    breath: float = 0.70
    idea: float = 2.15
    scene: float = 8.50
    min_words: int = 5
    shortest: float = 15.0
    longest: float = 180.0
    prefer: float = 85.0
    topic_start: str = TOPIC_START
    continue_start: str = CONTINUE_START


@dataclass(frozen=True)
class Gaps:
    margin: float = 0.06
    least: float = 0.35
    evidence: float = 0.8
    floor_db: float = -38.0


@dataclass(frozen=True)
class Framing:
    dead_zone: float = 0.055
    sticky: float = 0.11
    settle: float = 0.012
    omega: float = 2.6
    damping: float = 1.15
    max_speed: float = 0.085
    max_accel: float = 0.16
    fast_p90: float = 0.55
    fast_median: float = 0.22
    hold: float = 0.85
    size_ratio: float = 1.28
    jumps: float = 0.38
    wide_span: float = 0.52
    cluster: float = 0.18
    camera_fps: float = 24.0
    sample_fps: float = 3.0
    pane: float = 1080 / 960
    column: float = 9 / 16


@dataclass(frozen=True)
class Params:
    blocks: Blocks = field(default_factory=Blocks)
    windows: Windows = field(default_factory=Windows)
    clips: Clips = field(default_factory=Clips)
    captions: Captions = field(default_factory=Captions)
    thoughts: Thoughts = field(default_factory=Thoughts)
    gaps: Gaps = field(default_factory=Gaps)
    framing: Framing = field(default_factory=Framing)
