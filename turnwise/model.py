"""Data model: column names, fixed lookup values and default thresholds.

Everything here is plain data.  The values under "Fixed values" have to be what
they are for results to come out right (tool names, phrases, keyword patterns,
band limits); callers may pass their own instead wherever a function takes them.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------- columns

KEY = "session_key"
CHUNK = "chunk"
SEQ = "seq"

#: Rows of one session that share a chunk stay together in ordered operators.  A
#: chunk is the unit of ordered work, so one huge session is spread over
#: rows / span tasks instead of being one window partition.
CHUNK_SPAN = 65_536

#: ``seq`` of a normalised event is line_no * BLOCKS_PER_LINE + block_no.
BLOCKS_PER_LINE = 1 << 24

KINDS = ("tool_call", "tool_result", "assistant", "user", "thinking", "system")

LEGACY_ROOT = "root-legacy"

# ----------------------------------------------------------- fixed values

# Raw tool name -> canonical tool name.
TOOL_ALIASES = {
    "Bash": "bash",
    "BashTool": "bash",
    "Edit": "edit",
    "EditFile": "edit",
    "Glob": "glob",
    "Grep": "grep",
    "GrepTool": "grep",
    "LS": "ls",
    "ListDirectory": "ls",
    "MultiEdit": "multi_edit",
    "NotebookEdit": "notebook_edit",
    "Read": "read",
    "ReadFile": "read",
    "Task": "task",
    "TodoWrite": "todo_write",
    "View": "read",
    "WebFetch": "web_fetch",
    "WebSearch": "web_search",
    "Write": "write",
    "WriteFile": "write",
    "bash_tool": "bash",
}

# Canonical tools by metric category; all others are "other".
READ_TOOLS = ("read", "view")
RESEARCH_TOOLS = ("glob", "grep", "web_fetch", "web_search")
MUTATION_TOOLS = ("edit", "multi_edit", "notebook_edit", "write")
WRITE_TOOLS = ("write",)

# Canonical tools as the turn labels see them (no notebook_edit).
TURN_MUTATION_TOOLS = ("edit", "multi_edit", "write")
TURN_LOOKUP_TOOLS = ("glob", "read")

# Line kinds that carry no event and are not drift.
STRUCTURAL_KINDS = (
    "attachment",
    "file-history-snapshot",
    "last-prompt",
    "permission-mode",
    "progress",
    "queue-operation",
)

# Top-level line shapes known to be healthy, as key -> JSON type.
KNOWN_SHAPES = (
    {"type": "str", "timestamp": "str", "session_id": "str", "message": "dict"},
    {"type": "str", "timestamp": "str", "session_id": "str", "subtype": "str"},
    {"role": "str", "ts": "str", "session": "str", "content": "list"},
    {"type": "str", "timestamp": "str", "session_id": "str", "text": "str"},
    {"type": "str", "timestamp": "str", "session_id": "str", "tool": "str", "tool_input": "dict"},
    {"type": "str", "timestamp": "str", "session_id": "str", "tool_result": "str"},
)

TASK_LABELS = ("exploration", "mutation_heavy", "debug_loop", "planning", "mixed")

# Words in the opening prompt that decide a turn's label, in order.
TASK_KEYWORDS = (
    (
        "debug_loop",
        "fix|debug|broken|failing|error|exception|crash|traceback|why is|not working|"
        "failing test|reproduce|regression",
    ),
    (
        "mutation_heavy",
        "implement|add|create|build|write|generate|scaffold|port|migrate|convert|"
        "refactor|rename|move|delete|remove|update",
    ),
    (
        "exploration",
        "why|investigate|explore|understand|look at|walk me through|show me|what does|"
        "how does|explain|trace|find where|where is|which file|map out",
    ),
    (
        "planning",
        "plan|design|architect|outline|propose|think through|approach|strategy|"
        "how should|what would|should we|tradeoff|option|compare|consider",
    ),
)


@dataclass(frozen=True)
class Phrase:
    """One text marker. ``mode`` is word, substring or regex."""

    text: str
    category: str = "custom"
    intent: str | None = None
    mode: str = "word"


# Markers of an assistant stopping early or passing work back.
STOP_PHRASES = (
    Phrase(
        "not caused by my changes",
        "ownership_dodging",
        "deflects responsibility for breakage onto pre-existing state",
    ),
    Phrase("pre-existing", "ownership_dodging", "hedges by labelling a problem pre-existing"),
    Phrase("existing issue", "ownership_dodging", "frames a fresh failure as an existing issue"),
    Phrase(
        "outside the scope",
        "ownership_dodging",
        "punts a problem as out of scope without justification",
    ),
    Phrase("should I continue", "permission_seeking", "hands the next decision to the user mid-task"),
    Phrase(
        "want me to keep going",
        "permission_seeking",
        "invites the user to greenlight already-implied work",
    ),
    Phrase("shall I proceed", "permission_seeking", "asks for permission instead of executing"),
    Phrase("would you like me to", "permission_seeking", "opens a yes/no instead of acting"),
    Phrase("good stopping point", "premature_stopping", "declares premature completion"),
    Phrase("natural checkpoint", "premature_stopping", "frames a halt as a natural checkpoint"),
    Phrase("let's pause here", "premature_stopping", "invites a halt without finishing the work"),
    Phrase(
        "this should work for now", "premature_stopping", "hedges with a temporary should-work claim"
    ),
    Phrase("known limitation", "known_limitation", "labels a fixable problem as a known limitation"),
    Phrase("future work", "known_limitation", "defers the open issue to vague future work"),
    Phrase("out of scope", "known_limitation", "punts work without scope justification"),
    Phrase("beyond the scope", "known_limitation", "similar punt phrasing"),
)

# Markers of an assistant correcting itself.
LOOP_PHRASES = (
    Phrase("actually", "reasoning_loop", "self-correction marker"),
    Phrase("oh wait", "reasoning_loop", "explicit reversal of previous step"),
    Phrase("no wait", "reasoning_loop", "immediate course correction"),
    Phrase("let me reconsider", "reasoning_loop", "opens a re-evaluation of the prior plan"),
    Phrase("let me rethink", "reasoning_loop", "opens a re-evaluation of the prior plan"),
    Phrase("hmm actually", "reasoning_loop", "hedging plus self-correction"),
    Phrase("i was wrong", "reasoning_loop", "acknowledged prior error"),
    Phrase("on second thought", "reasoning_loop", "explicit reconsideration"),
    Phrase("i made an error", "reasoning_loop", "acknowledged prior error"),
    Phrase("correction:", "reasoning_loop", "formal correction marker", "substring"),
)


@dataclass(frozen=True)
class MetricConfig:
    """Band limits and window lengths of the session metrics (fixed defaults)."""

    window_size: int = 50
    blind_edit_window: int = 20
    tracking_floor: float = 0.95
    ratio_min_calls: int = 10
    ratio_warn: float = 4.0
    ratio_critical: float = 2.0
    stop_warn: float = 1.0
    stop_critical: float = 3.0
    loop_warn: float = 10.0
    loop_critical: float = 20.0
    loop_min_calls: int = 20
    confidence_window: int = 200
    health_min_lines: int = 50
    health_critical: float = 0.9
    stale_after: int = 300
    evict_after: int = 2100


DEFAULTS = MetricConfig()

METRICS = ("parse_health", "read_edit_ratio", "stop_phrase", "reasoning_loop", "thinking", "prompts")

# Metric -> (warn, critical, lower_is_worse) for stored reports.
HISTORY_THRESHOLDS = {
    "parse_health": (0.9, 0.9, True),
    "read_edit_ratio": (4.0, 2.0, True),
    "reasoning_loop": (10.0, 20.0, False),
    "stop_phrase": (1.0, 3.0, False),
}

# Metric -> (warn, critical, lower_is_worse) for cohort cells.
COHORT_THRESHOLDS = {
    "parse_health": (None, 0.9, True),
    "reasoning_loop": (10.0, 20.0, False),
    "stop_phrase": (1.0, 3.0, False),
}

MIN_CELL_N = 5
MIN_PAIRS = 30
ALPHA = 0.05
BOOTSTRAP_SESSIONS = 10
AGREEMENT_GATE = 0.85

SEVERITY_RANK = {"critical": 0, "warn": 1, "ok": 2}
