"""The SQL side of the events adapter, shared by the oracle queries."""

from __future__ import annotations

from vigilframe.sources.events import ACCOUNTS, AGENTS, REGIONS, RESOURCES, ROLES, VAULTS


def _pick(options: tuple[str, ...], at: str) -> str:
    return f"([{', '.join(repr(o) for o in options)}])[({at}) % {len(options)} + 1]"


EV = f"""ev0 AS (
  SELECT event_id AS row_id, ts AS "timestamp", user_id AS uid, 'user_' || user_id AS user_id, event_type AS action, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
), ev AS (
  SELECT row_id, "timestamp", user_id, action, {_pick(RESOURCES, "k")} AS resource,
         CASE WHEN k % 4 = 0 THEN '203.0.' ELSE '192.168.' END || (k + 21) || '.' || (uid % 254) AS ip_address,
         {_pick(REGIONS, "uid + k")} AS region, CASE WHEN action = 'error' THEN 'failure' ELSE 'success' END AS status,
         user_id || '_' || strftime("timestamp", '%Y%m%d') AS session_id, {_pick(AGENTS, "k")} AS user_agent, {_pick(ROLES, "uid")} AS role,
         k % 2 = 0 AS is_privileged_session, value::DOUBLE AS session_duration_seconds, k % 10 = 0 AS policy_violation,
         'acct_' || (k % {ACCOUNTS}) AS privileged_account_used, 'vault_' || (k % {VAULTS}) AS vault_name,
         CASE WHEN k % 3 <> 0 THEN 'T' || row_id END AS ticket_id, CASE WHEN k % 7 <> 0 THEN 'maintenance' END AS reason_for_access,
         min("timestamp") OVER (PARTITION BY user_id || '_' || strftime("timestamp", '%Y%m%d')) AS session_start,
         max("timestamp") OVER (PARTITION BY user_id || '_' || strftime("timestamp", '%Y%m%d')) AS session_end
  FROM ev0
)"""
WU = 'PARTITION BY user_id ORDER BY "timestamp", row_id'
WS = 'PARTITION BY session_id ORDER BY "timestamp", row_id'


def over_events(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join([EV, *ctes]) + " " + select
