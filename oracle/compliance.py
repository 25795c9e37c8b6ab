"""Statements for the security benchmark."""

from fleetlens.operators.compliance import RULES

from .common import sql

INPUTS = (
    "instances instance_options instance_properties service_accounts principals permissions server_role_members "
    "database_flags database_security assemblies audit_actions proxy_grants"
)

ADMINS = """, adm AS (SELECT DISTINCT instance_guid, lower(regexp_extract(value, '"([^"]*)"', 1) || chr(92) || regexp_extract(property, '"([^"]*)"', 1)) AS k FROM service_accounts WHERE hierarchy ILIKE '%Win32\\_GroupUser/Local\\_Admins%' ESCAPE '\\'),
acc AS (SELECT s.instance_guid, CASE WHEN hierarchy ILIKE '%SQLService/MSSQL$%' OR hierarchy ILIKE '%SQLService/MSSQLSERVER%' THEN '3.5' WHEN hierarchy ILIKE '%SQLService/SQLAgent%' OR hierarchy ILIKE '%SQLService/SQLSERVERAGENT%' THEN '3.6'
    WHEN hierarchy ILIKE '%SQLService/MSSQLFDLauncher%' THEN '3.7' END AS rule_id, value AS account
  FROM service_accounts s WHERE property = 'StartName' AND EXISTS (SELECT 1 FROM adm WHERE adm.instance_guid = s.instance_guid AND adm.k = lower(s.value)))"""

sql("cis_admin_accounts", "service_accounts", ADMINS + " SELECT * FROM acc WHERE rule_id IS NOT NULL")

_EVIDENCE = {
    "guest_connect": "kind = 'permission' AND name = 'guest' AND permission_name = 'CONNECT' AND database_name NOT IN ('master','msdb','tempdb')",
    "orphan_users": "kind = 'orphan'",
    "contained_logins": "kind = 'principal' AND lower(name) NOT IN ('dbo','information_schema','sys','guest') AND principal_type IN ('U','S','G') AND authentication_type = 2",
    "weak_symmetric": "kind = 'symmetric' AND algorithm_desc NOT IN ('AES_128','AES_192','AES_256') AND database_id > 4",
    "weak_asymmetric": "kind = 'asymmetric' AND key_length < 2048 AND database_id > 4",
}
EVIDENCE = "SELECT instance_guid, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _EVIDENCE.items()) + " FROM database_security GROUP BY 1"
sql("cis_cross_db_evidence", "database_security", " " + EVIDENCE)

_OFF = "ad hoc distributed queries|2.1,clr enabled|2.2,cross db ownership chaining|2.3,database mail xps|2.4,ole automation procedures|2.5,remote access|2.6,remote admin connections|2.7,scan for startup procs|2.8"
_parts = []
for _pair in _OFF.split(","):
    _name, _rule = _pair.split("|")
    _parts.append(f"SELECT instance_guid, '{_rule}' AS rule_id, value_in_use <> 1 AS pass, CAST(value_in_use AS VARCHAR) AS value FROM instance_options WHERE lower(name) = '{_name}'")
for _name, _rule in (("clr strict security", "2.17"), ("default trace enabled", "5.2")):
    _parts.append(f"SELECT instance_guid, '{_rule}', value_in_use = 1, CAST(value_in_use AS VARCHAR) FROM instance_options WHERE lower(name) = '{_name}'")
for _rule, _name, _test in (
    ("2.10", "Shared Memory", "value <> 'True'"), ("2.11", "TcpPort", "value <> '1433'"), ("2.12", "HideInstance", "value <> 'False'"),
    ("3.1", "IsIntegratedSecurityOnly", "value <> '0'"), ("5.3", "audit level", "value = 'failure'"),
):
    _parts.append(f"SELECT DISTINCT instance_guid, '{_rule}', {_test}, value FROM instance_properties WHERE property = '{_name}'")
_parts.append("SELECT DISTINCT instance_guid, '8.1', value = '4', value FROM instance_properties WHERE property = 'StartMode' AND hierarchy ILIKE '%SQLBrowser'")
_parts.append("""SELECT i.instance_guid, '5.1', coalesce(CAST(p.value AS INT), 6) >= 12, CAST(coalesce(CAST(p.value AS INT), 6) AS VARCHAR) FROM instances i
  LEFT JOIN (SELECT instance_guid, value FROM instance_properties WHERE property = 'NumErrorLogs') p USING (instance_guid)""")


def counted(rule: str, table: str, where: str, join: str = "", n: str = "count(*)") -> str:
    return f"""SELECT i.instance_guid, '{rule}', coalesce(c.n, 0) = 0, CAST(coalesce(c.n, 0) AS VARCHAR) FROM instances i
      LEFT JOIN (SELECT t.instance_guid, {n} AS n FROM {table} t {join} WHERE {where} GROUP BY 1) c USING (instance_guid)"""


_parts += [
    counted("2.9", "database_flags", "is_trustworthy_on AND name <> 'msdb' AND state = 0"),
    counted("2.15", "database_flags", "containment <> 0 AND is_auto_close_on"),
    counted("3.2", "database_security", _EVIDENCE["guest_connect"]),
    counted("3.3", "database_security", _EVIDENCE["orphan_users"]),
    counted("3.4", "database_security", _EVIDENCE["contained_logins"]),
    counted("7.1", "database_security", _EVIDENCE["weak_symmetric"]),
    counted("7.2", "database_security", _EVIDENCE["weak_asymmetric"]),
    counted("3.8", "permissions", """grantee = 'public' AND state_desc LIKE 'GRANT%' AND NOT (state_desc = 'GRANT' AND permission_name = 'VIEW ANY DATABASE' AND class_desc = 'SERVER')
      AND NOT (state_desc = 'GRANT' AND permission_name = 'CONNECT' AND class_desc = 'ENDPOINT' AND major_id IN (2, 3, 4, 5))"""),
    counted("3.9", "principals", "t.name ILIKE 'BUILTIN%'", "JOIN permissions q ON q.instance_guid = t.instance_guid AND q.principal_id = t.principal_id"),
    counted("3.10", "principals", "t.type_desc = 'WINDOWS_GROUP' AND lower(t.name) LIKE lower(h.machine_name) || '%'",
            "JOIN permissions q ON q.instance_guid = t.instance_guid AND q.principal_id = t.principal_id JOIN instances h ON h.instance_guid = t.instance_guid"),
    counted("3.11", "proxy_grants", "grantee = 'public'"),
    counted("4.1", "principals", "type_desc = 'SQL_LOGIN' AND (NOT is_policy_checked OR NOT is_expiration_checked) AND name NOT IN ('##MS_PolicyTsqlExecutionLogin##','##MS_PolicyEventProcessingLogin##')"),
    counted("4.2", "(SELECT p.instance_guid FROM principals p JOIN server_role_members r USING (instance_guid, principal_id) WHERE type_desc = 'SQL_LOGIN' AND NOT is_expiration_checked AND role_name = 'sysadmin' "
            "UNION ALL SELECT p.instance_guid FROM principals p JOIN permissions q USING (instance_guid, principal_id) WHERE type_desc = 'SQL_LOGIN' AND NOT is_expiration_checked AND permission_name = 'CONTROL SERVER' AND state_desc LIKE 'GRANT%')", "TRUE"),
    counted("4.3", "principals", "type_desc = 'SQL_LOGIN' AND NOT is_policy_checked"),
    counted("6.2", "assemblies", "is_user_defined AND permission_set_desc <> 'SAFE_ACCESS'"),
    "SELECT instance_guid, '2.13', is_disabled, CAST(CAST(is_disabled AS INT) AS VARCHAR) FROM principals WHERE is_builtin_admin",
    "SELECT instance_guid, '2.14', name <> 'sa', name FROM principals WHERE is_builtin_admin",
    "SELECT instance_guid, '2.16', NOT EXISTS (SELECT 1 FROM principals p WHERE p.instance_guid = i.instance_guid AND lower(p.name) = 'sa'), CASE WHEN EXISTS (SELECT 1 FROM principals p WHERE p.instance_guid = i.instance_guid AND lower(p.name) = 'sa') THEN 'sa' ELSE '0' END FROM instances i",
    """SELECT i.instance_guid, '5.4', a.n IS NOT NULL, CAST(coalesce(a.n, 0) AS VARCHAR) FROM instances i LEFT JOIN (SELECT instance_guid, max(n) AS n FROM (
      SELECT instance_guid, audit_name, count(*) AS n FROM audit_actions WHERE audit_action_id IN ('CNAU','LGFL','LGSD') AND specification_enabled AND audit_enabled GROUP BY 1, 2) GROUP BY 1) a USING (instance_guid)""",
    "SELECT instance_guid, rule_id, FALSE, account FROM acc WHERE rule_id IS NOT NULL",
    "SELECT i.instance_guid, r.rule_id, TRUE, '0' FROM instances i, (VALUES ('3.5'), ('3.6'), ('3.7')) r(rule_id) WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.instance_guid = i.instance_guid AND acc.rule_id = r.rule_id)",
]
_titles = ", ".join("('{}', '{}', {})".format(i, t.replace("'", "''"), s) for i, t, s in RULES)
CIS = ADMINS + ", found AS (" + "\nUNION ALL ".join(_parts) + f"), titles(rule_id, title, scored) AS (VALUES {_titles}), cis AS (SELECT f.instance_guid, f.rule_id, t.title, t.scored, f.pass, f.value FROM found f JOIN titles t USING (rule_id))"

sql("cis_rules", INPUTS, CIS + " SELECT * FROM cis")
sql("cis_filter_failed", INPUTS, CIS + " SELECT * FROM cis WHERE scored AND NOT pass")
sql("cis_filter_notscored", INPUTS, CIS + " SELECT * FROM cis WHERE NOT scored")
sql("cis_score", INPUTS, CIS + """, s AS (SELECT instance_guid, count(*) FILTER (WHERE scored AND pass) AS passed, count(*) FILTER (WHERE scored) AS total, count(*) FILTER (WHERE NOT scored) AS not_scored FROM cis GROUP BY 1)
SELECT *, total - passed AS failed, 'Total Score = ' || passed || '/' || total || '  Failed = ' || (total - passed) || '  Not Scored = ' || not_scored AS summary FROM s""")
