"""Settings, enumerations and labels shared by every operator.

Fixed values: names and numbers below are part of the result contract, so they are stated
as they are and not derived.
"""

# Actions by restrictiveness.
ACTION_RANK = {"allow": 0, "log": 1, "hold": 2, "block": 3}

# Job states and scan tiers.
JOB_STATES = (
    "inspecting",
    "released",
    "held",
    "blocked",
    "released_by_analyst",
    "denied_by_analyst",
    "failed_open",
    "released_then_flagged",
    "error",
)
SCAN_TIERS = ("text", "ocr_pending", "ocr_complete", "unreadable")
STATE_OF_ACTION = {"allow": "released", "log": "released", "hold": "held", "block": "blocked"}
PRINTED_STATES = ("released", "released_by_analyst", "failed_open", "released_then_flagged")
STOPPED_STATES = ("held", "blocked", "denied_by_analyst", "released_by_analyst")
PREVIEW_STATES = ("held", "inspecting")

# Policy vocabulary.
FAIL_MODES = ("open", "closed")
POLICY_MODES = {
    "enforce": {"deep_scan_required": True, "on_unreadable": "hold"},
    "monitor": {"deep_scan_required": False, "on_unreadable": "log"},
}
DEFAULT_POLICY = {
    "deep_scan_required": False,
    "fail_mode": "open",
    "on_unreadable": "log",
    "rule_tags": ["*"],
    "description": "",
}

# Default settings.
MIN_TEXT_CHARS = 20
SHINGLE_WORDS = 5
WINNOW_WINDOW = 4
CONTAINMENT_THRESHOLD = 0.35
RETENTION_DAYS = 90
GRANT_TTL_HOURS = 2
MAX_BODY_BYTES = 200 * 1024 * 1024
DASHBOARD_ROWS = 25
QUEUE_VIEW_ROWS = 200
AUDIT_VIEW_ROWS = 300
RULE_REVISION_ROWS = 100
POLICY_REVISION_ROWS = 200
REASON_MIN_CHARS, REASON_MAX_CHARS = 3, 1000
SEVERITY_MIN, SEVERITY_MAX = 0, 10
