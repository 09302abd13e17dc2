"""Schemas, fill values and the feature catalogue."""

from __future__ import annotations

#: The canonical event, in order.
EVENT = {
    "timestamp": "timestamp", "user_id": "string", "action": "string", "resource": "string", "ip_address": "string", "region": "string",
    "status": "string", "session_id": "string", "session_start": "timestamp", "session_end": "timestamp", "user_agent": "string",
}
#: What privileged access adds to it.
PRIVILEGED = {
    "privileged_account_used": "string", "vault_name": "string", "session_duration_seconds": "double", "is_privileged_session": "boolean",
    "policy_violation": "boolean", "reason_for_access": "string", "ticket_id": "string",
}
TEXT_COLUMNS = ("user_id", "action", "resource", "ip_address", "region", "status", "user_agent")
REQUIRED = ("timestamp", "user_id", "action", "ip_address", "status")
UNKNOWN = "unknown"
#: Fill values of the feature extractors, by column.
SENTINELS = {c: f"unknown_{c.removesuffix('_id')}" for c in ("user_id", "action", "resource", "status", "session_id", "region", "user_agent")}

FEATURES = {
    "time": ("hour", "day_of_week", "is_weekend", "is_working_hour", "time_since_last_access", "hour_sin", "hour_cos", "session_duration"),
    "ip": ("is_private_ip", "ip_frequency", "ip_changes_in_session"),
    "behaviour": ("success_count", "failure_count", "success_ratio", "actions_per_minute", "unique_actions_per_hour", "unique_resources_per_hour"),
    "session": ("actions_per_session", "distinct_actions_per_session", "time_between_actions_in_session", "average_time_between_actions_in_session"),
    "region": ("region_frequency", "region_changes_in_session"),
    "agent": ("user_agent_frequency", "user_agent_changes_in_session"),
    "sequence": ("action_entropy", "common_transition_prob", "unique_transitions"),
    "advanced": ("action_velocity", "is_burst", "resource_diversity"),
    "temporal": ("is_early_morning", "is_morning", "is_afternoon", "is_evening", "hours_from_mean", "session_hour_span"),
    "privileged": (
        "priv_duration_min", "priv_duration_max", "priv_duration_mean", "priv_duration_std", "is_long_session", "is_short_session",
        "policy_violation_count", "policy_violation_ratio", "is_privileged", "missing_reason", "missing_ticket",
    ),
}
#: The 48 fixed features, in order; pivots and one-hot columns come on top.
FIXED_FEATURES = tuple(f for group in FEATURES.values() for f in group)
#: Columns that are no features even where they are numeric.
NOT_FEATURES = (
    *EVENT, *PRIVILEGED, "row_id", "role", "is_anomaly", "minute", "session_start_hour", "session_end_hour", "total_actions_count",
    "top_ip", "top_region", "top_user_agent", "os", "browser", "top_priv_account", "top_vault",
)
