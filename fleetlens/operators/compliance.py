"""Security benchmark rules scored for every instance.

Every input becomes evidence rows for the rules it feeds; one aggregate over
their union decides all rules.  No rule runs a job of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import KEY

# fixed values: rule id, title, scored
RULES: tuple[tuple[str, str, bool], ...] = (
    ("2.1", "Ad Hoc Distributed Queries Server Configuration Option to 0", True),
    ("2.2", "CLR Enabled Server Configuration Option to 0", True),
    ("2.3", "Set the Cross DB Ownership Chaining Server Configuration Option to 0", True),
    ("2.4", "Set the Database Mail XPs Server Configuration Option to 0", True),
    ("2.5", "Set the Ole Automation Procedures Server Configuration Option to 0", True),
    ("2.6", "Set the Remote Access Server Configuration Option to 0", True),
    ("2.7", "Set the Remote Admin Connections Server Configuration Option to 0", True),
    ("2.8", "Set the Scan For Startup Procs Server Configuration Option to 0", True),
    ("2.9", "Set the Trustworthy Database Property to Off", True),
    ("2.10", "Disable Unnecessary SQL Server Protocols – ‘Shared Memory and TCP/IP Protocol is enabled’", False),
    ("2.11", "Configure SQL Server to use non-standard ports", False),
    ("2.12", "Set the Hide Instance option to Yes for Production SQL Server instances", True),
    ("2.13", "Disable the sa Login Account", True),
    ("2.14", "Rename the sa Login Account", True),
    ("2.15", "Ensure 'AUTO_CLOSE OFF' is set on contained databases", True),
    ("2.16", "Ensure no login exists with the name 'sa'", True),
    ("2.17", "Set 'clr strict security' Server Configuration Option to 1", True),
    ("3.1", "Set The Server Authentication Property To Windows Authentication mode", True),
    ("3.2", "Revoke CONNECT permissions on the guest user within all SQL Server databases excluding the master, msdb and tempdb", True),
    ("3.3", "Drop Orphaned Users From SQL Server Databases", True),
    ("3.4", "Do not use SQL Authentication in contained databases", True),
    ("3.5", "Ensure the SQL Server's MSSQL Service Account is Not an Administrator", True),
    ("3.6", "Ensure the SQL Server's SQLAgent Service Account is Not an Administrator", True),
    ("3.7", "Ensure the SQL Server's Full-Text Service Account is Not an Administrator", True),
    ("3.8", "Ensure only the default permissions specified by Microsoft are granted to the public server role", True),
    ("3.9", "Ensure Windows BUILTIN groups are not SQL Logins", True),
    ("3.10", "Ensure Windows local groups are not SQL Logins", True),
    ("3.11", "Ensure the public role in the msdb database is not granted access to SQL Agent proxies", True),
    ("4.1", "Set the MUST_CHANGE Option to ON for All SQL Authenticated Logins", False),
    ("4.2", "Set the CHECK_EXPIRATION Option to ON for All SQL Authenticated Logins Within the Sysadmin Role", True),
    ("4.3", "Set the CHECK_POLICY Option to ON for All SQL Authenticated Logins", True),
    ("5.1", "Set the Maximum number of error log files setting to greater than or equal to 12", False),
    ("5.2", "Set the Default Trace Enabled Server Configuration Option to 1", True),
    ("5.3", "Set Login Auditing to failed logins", False),
    ("5.4", "Use SQL Server Audit to capture both failed and successful logins", True),
    ("6.2", "Set the CLR Assembly Permission Set to SAFE_ACCESS for All CLR Assemblies", True),
    ("7.1", "Ensure Symmetric Key encryption algorithm is AES_128 or higher in non-system databases", True),
    ("7.2", "Ensure asymmetric key size is greater than or equal to 2048 in nonsystem databases", True),
    ("8.1", "SQL Server Browser Service Disabled", False),
)

# fixed values: server option and the rule that wants it off (or on)
OPTIONS_OFF = {
    "ad hoc distributed queries": "2.1", "clr enabled": "2.2", "cross db ownership chaining": "2.3",
    "database mail xps": "2.4", "ole automation procedures": "2.5", "remote access": "2.6",
    "remote admin connections": "2.7", "scan for startup procs": "2.8",
}
OPTIONS_ON = {"clr strict security": "2.17", "default trace enabled": "5.2"}

# fixed values: service hierarchies and the rule on their account
SERVICE_RULES = {
    "3.5": ("SQLService/MSSQL$", "SQLService/MSSQLSERVER"),
    "3.6": ("SQLService/SQLAgent", "SQLService/SQLSERVERAGENT"),
    "3.7": ("SQLService/MSSQLFDLauncher",),
}
POLICY_LOGINS = ("##MS_PolicyTsqlExecutionLogin##", "##MS_PolicyEventProcessingLogin##")
AUDIT_ACTIONS = ("CNAU", "LGFL", "LGSD")
STRONG_CIPHERS = ("AES_128", "AES_192", "AES_256")
LAST_SYSTEM_DATABASE = 4


def cis_admin_accounts(service_eav: DataFrame) -> DataFrame:
    """Services whose account is a local administrator: (instance, rule_id, account).

    An administrator is listed as quoted domain (value) and quoted name
    (property); the account of a service is `domain\\name`.
    """
    quoted = '"([^"]*)"'
    admins = service_eav.filter(F.col("hierarchy").ilike("%Win32\\_GroupUser/Local\\_Admins%")).select(
        KEY,
        F.lower(
            F.concat(
                F.regexp_extract("value", quoted, 1), F.lit("\\"), F.regexp_extract("property", quoted, 1)
            )
        ).alias("account_key"),
    ).distinct()
    rule = None
    for rule_id, prefixes in SERVICE_RULES.items():
        hit = None
        for prefix in prefixes:
            one = F.lower("hierarchy").contains(prefix.lower())
            hit = one if hit is None else hit | one
        rule = F.when(hit, rule_id) if rule is None else rule.when(hit, rule_id)
    services = service_eav.filter(F.lower("property") == "startname").select(
        KEY, rule.alias("rule_id"), F.col("value").alias("account"), F.lower("value").alias("account_key")
    )
    return (
        services.filter(F.col("rule_id").isNotNull())
        .join(admins, [KEY, "account_key"], "left_semi")
        .select(KEY, "rule_id", "account")
    )


def cis_cross_db_evidence(database_security: DataFrame) -> DataFrame:
    """Findings inside databases, counted per instance.

    `database_security` has one row per finding candidate, `kind` telling
    orphan, permission, principal, asymmetric or symmetric.
    """
    kind = F.col("kind")
    user_database = F.col("database_id") > LAST_SYSTEM_DATABASE
    return database_security.groupBy(KEY).agg(
        F.count_if(
            (kind == "permission") & (F.lower("name") == "guest") & (F.col("permission_name") == "CONNECT")
            & ~F.lower("database_name").isin("master", "msdb", "tempdb")
        ).alias("guest_connect"),
        F.count_if(kind == "orphan").alias("orphan_users"),
        F.count_if(
            (kind == "principal") & ~F.lower("name").isin("dbo", "information_schema", "sys", "guest")
            & F.col("principal_type").isin("U", "S", "G") & (F.col("authentication_type") == 2)
        ).alias("contained_logins"),
        F.count_if(
            (kind == "symmetric") & ~F.col("algorithm_desc").isin(*STRONG_CIPHERS) & user_database
        ).alias("weak_symmetric"),
        F.count_if((kind == "asymmetric") & (F.col("key_length") < 2048) & user_database).alias("weak_asymmetric"),
    )


# fixed values: properties whose presence is judged, and how
PROPERTY_RULES = {
    "shared memory": "2.10", "tcpport": "2.11", "hideinstance": "2.12", "isintegratedsecurityonly": "3.1",
    "audit level": "5.3", "startmode": "8.1",
}
BAD_PROPERTY = {"2.10": "True", "2.11": "1433", "2.12": "False", "3.1": "0"}
GOOD_PROPERTY = {"5.3": "failure", "8.1": "4"}

# rules that count violations; every instance reports them, if only with 0
COUNTED = (
    "2.9", "2.15", "2.16", "3.2", "3.3", "3.4", "3.8", "3.9", "3.10", "3.11", "4.1", "4.2", "4.3",
    "6.2", "7.1", "7.2",
)
LOG_FILES, AUDITS = "5.1", "5.4"
FINDINGS = {
    "guest_connect": "3.2", "orphan_users": "3.3", "contained_logins": "3.4", "weak_symmetric": "7.1",
    "weak_asymmetric": "7.2",
}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _evidence(rule: str | Column, n: Column | int = 1, text: Column | None = None) -> list[Column]:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    n = F.lit(n) if isinstance(n, int) else n
    text = F.lit(None).cast("string") if text is None else text
    return [F.col(KEY), rule.alias("rule_id"), n.cast("long").alias("n"), text.alias("text")]


def _named(column: str, rules: dict[str, str]) -> Column:
    """Rule of a name, NULL for names no rule looks at."""
    return _lookup(F.lower(column), rules)


def _login_evidence(principals, permissions, server_role_members, instances) -> DataFrame:
    """Evidence on logins; grants and roles are counted per login before the joins."""
    grants = permissions.groupBy(KEY, "principal_id").agg(
        F.count("*").alias("granted"),
        F.count_if(
            (F.col("permission_name") == "CONTROL SERVER") & F.col("state_desc").startswith("GRANT")
        ).alias("control"),
    )
    sysadmins = server_role_members.filter(F.col("role_name") == "sysadmin").select(
        KEY, "principal_id", F.lit(1).alias("sysadmin")
    ).distinct()
    login = (
        principals.join(grants, [KEY, "principal_id"], "left")
        .join(sysadmins, [KEY, "principal_id"], "left")
        .join(instances.select(KEY, "machine_name"), KEY)
    )
    name, nothing = F.lower("name"), F.lit(None).cast("string")
    is_sql = F.col("type_desc") == "SQL_LOGIN"
    lax, unchecked = ~F.col("is_expiration_checked"), ~F.col("is_policy_checked")
    granted = F.coalesce("granted", F.lit(0))
    powers = F.coalesce("sysadmin", F.lit(0)) + F.coalesce("control", F.lit(0))

    def found(rule: str, condition: Column, n: Column | int = 1, text: Column = nothing) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.when(
            condition,
            F.struct(F.lit(rule).alias("rule_id"), n.cast("long").alias("n"), text.alias("text")),
        )

    is_local = F.startswith(name, F.lower("machine_name"))
    rows = F.array(
        found("2.13", F.col("is_builtin_admin"), F.col("is_disabled").cast("int")),
        found("2.14", F.col("is_builtin_admin"), 0, F.col("name")),
        found("2.16", name == "sa"),
        found("3.9", name.startswith("builtin"), granted),
        found("3.10", (F.col("type_desc") == "WINDOWS_GROUP") & is_local, granted),
        found("4.1", is_sql & (unchecked | lax) & ~F.col("name").isin(*POLICY_LOGINS)),
        found("4.2", is_sql & lax, powers),
        found("4.3", is_sql & unchecked),
    )
    return login.select(KEY, F.explode(F.array_compact(rows)).alias("r")).select(KEY, "r.*")


def cis_rules(
    instances: DataFrame, instance_options: DataFrame, instance_properties: DataFrame,
    service_eav: DataFrame, principals: DataFrame, permissions: DataFrame,
    server_role_members: DataFrame, database_flags: DataFrame, database_security: DataFrame,
    assemblies: DataFrame, audit_actions: DataFrame, proxy_grants: DataFrame,
) -> DataFrame:
    """(instance, rule_id, title, scored, pass, value), one row per finding.

    A rule about an inventory property has a row for each of its values, so that
    a failing port isn't hidden by a good one.

    Every input is narrowed to evidence rows (instance, rule, n, text).  Their
    union goes through one aggregate, combined map-side, so an instance with a
    third of the rows costs no more than its partial counts.
    """
    option = _named("name", {**OPTIONS_OFF, **OPTIONS_ON})
    judged_property = _named("property", PROPERTY_RULES)
    is_browser = F.lower("hierarchy").endswith("sqlbrowser")
    property_rule = F.when((judged_property != "8.1") | is_browser, judged_property)
    plain_grant = F.col("state_desc") == "GRANT"
    default_grant = plain_grant & (
        ((F.col("permission_name") == "VIEW ANY DATABASE") & (F.col("class_desc") == "SERVER"))
        | (
            (F.col("permission_name") == "CONNECT") & (F.col("class_desc") == "ENDPOINT")
            & F.col("major_id").between(2, 5)
        )
    )
    audited = audit_actions.filter(
        F.col("audit_action_id").isin(*AUDIT_ACTIONS) & F.col("specification_enabled") & F.col("audit_enabled")
    ).groupBy(KEY, "audit_name").agg(F.count("*").alias("events"))
    inside = cis_cross_db_evidence(database_security).select(
        KEY,
        F.explode(
            F.array(*[
                F.struct(F.lit(rule).alias("rule_id"), F.col(c).alias("n"), F.lit(None).cast("string").alias("text"))
                for c, rule in FINDINGS.items()
            ])
        ).alias("r"),
    ).select(KEY, "r.*")
    always = F.explode(F.array(*[F.lit(r) for r in (*COUNTED, LOG_FILES, AUDITS)]))
    parts = [
        instances.select(KEY, always.alias("rule_id"), F.lit(0).cast("long").alias("n"),
                         F.lit(None).cast("string").alias("text")),
        instance_options.select(*_evidence(option, F.col("value_in_use"))),
        instance_properties.select(*_evidence(property_rule, 0, F.col("value"))),
        instance_properties.filter(F.lower("property") == "numerrorlogs").select(
            *_evidence(LOG_FILES, 0, F.col("value"))
        ),
        database_flags.filter(
            F.col("is_trustworthy_on") & (F.lower("name") != "msdb") & (F.col("state") == 0)
        ).select(*_evidence("2.9")),
        database_flags.filter((F.col("containment") != 0) & F.col("is_auto_close_on")).select(*_evidence("2.15")),
        permissions.filter(
            (F.col("grantee") == "public") & F.col("state_desc").startswith("GRANT") & ~default_grant
        ).select(*_evidence("3.8")),
        proxy_grants.filter(F.col("grantee") == "public").select(*_evidence("3.11")),
        assemblies.filter(
            F.col("is_user_defined") & (F.col("permission_set_desc") != "SAFE_ACCESS")
        ).select(*_evidence("6.2")),
        audited.select(*_evidence(AUDITS, F.col("events"))),
        inside,
        _login_evidence(principals, permissions, server_role_members, instances),
    ]
    evidence = parts[0]
    for part in parts[1:]:
        evidence = evidence.unionByName(part)
    rule = F.col("rule_id")
    each_value = F.when(rule.isin(*PROPERTY_RULES.values()), F.col("text")).alias("each")
    summed = evidence.filter(rule.isNotNull()).groupBy(KEY, "rule_id", each_value).agg(
        F.sum("n").alias("total"), F.max("n").alias("largest"), F.max("text").alias("text")
    )
    total, largest, text = F.col("total"), F.col("largest"), F.col("text")
    logs = F.coalesce(text.try_cast("int"), F.lit(6))
    bad, good = _lookup(rule, BAD_PROPERTY), _lookup(rule, GOOD_PROPERTY)
    passed = (
        F.when(rule.isin(*OPTIONS_OFF.values()), largest != 1)
        .when(rule.isin(*OPTIONS_ON.values(), "2.13"), largest == 1)
        .when(rule == "2.14", F.lower(text) != "sa")
        .when(rule == LOG_FILES, logs >= 12)
        .when(rule == AUDITS, largest > 0)
        .when(bad.isNotNull(), F.coalesce(text != bad, F.lit(True)))
        .when(good.isNotNull(), F.coalesce(text == good, F.lit(False)))
        .otherwise(total == 0)
    )
    shown = (
        F.when(rule == "2.16", F.when(total > 0, "sa").otherwise("0"))
        .when(rule == LOG_FILES, logs.cast("string"))
        .when((rule == "2.14") | bad.isNotNull() | good.isNotNull(), text)
        .when(rule.isin(*COUNTED), total.cast("string"))
        .otherwise(largest.cast("string"))
    )
    found = summed.select(KEY, "rule_id", passed.alias("pass"), shown.alias("value"))

    # one row per administrator account, or one passing row
    admins = cis_admin_accounts(service_eav).select(
        KEY, "rule_id", F.lit(False).alias("pass"), F.col("account").alias("value")
    )
    wanted = instances.select(KEY, F.explode(F.array(*[F.lit(r) for r in SERVICE_RULES])).alias("rule_id"))
    clean = wanted.join(admins.select(KEY, "rule_id").distinct(), [KEY, "rule_id"], "left_anti").select(
        KEY, "rule_id", F.lit(True).alias("pass"), F.lit("0").alias("value")
    )
    title = _lookup(F.col("rule_id"), {rule_id: name for rule_id, name, _ in RULES})
    scored = F.col("rule_id").isin(*[rule_id for rule_id, _, counts in RULES if counts])
    return found.unionByName(admins).unionByName(clean).select(
        KEY, "rule_id", title.alias("title"), scored.alias("scored"), "pass", "value"
    )


def cis_score(rules: DataFrame) -> DataFrame:
    """Passed, total, failed and not-scored counts per instance."""
    scored = F.col("scored")
    counts = rules.groupBy(KEY).agg(
        F.count_if(scored & F.col("pass")).alias("passed"),
        F.count_if(scored).alias("total"),
        F.count_if(~scored).alias("not_scored"),
    )
    failed = F.col("total") - F.col("passed")
    return counts.select(
        KEY, "passed", "total", failed.alias("failed"), "not_scored",
        F.concat(
            F.lit("Total Score = "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"),
            F.lit("  Failed = "), failed.cast("string"),
            F.lit("  Not Scored = "), F.col("not_scored").cast("string"),
        ).alias("summary"),
    )


def cis_filter(rules: DataFrame, mode: str | None = None) -> DataFrame:
    """`failed` scored rules, `notscored` rules, or all of them."""
    if mode is None:
        return rules
    if mode.lower() == "failed":
        return rules.filter(F.col("scored") & ~F.col("pass"))
    if mode.lower() == "notscored":
        return rules.filter(~F.col("scored"))
    raise ValueError("mode must be 'failed', 'notscored' or None")
