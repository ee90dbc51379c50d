"""Constructed rows: envelopes, tokens, machine events, alerts, review requests, results and rendered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .scoring import bodies, generated_files

VERSION, TOKEN_LIFE, REVIEW_LIFE, MOST_PAYLOAD = "1.0.0", 7200, 3600, 50 << 20


def envelope(kind: str, sender: str, recipient: str, task: Column, now: Column | None = None) -> Column:
    """struct: a random id, type, roles, task, time and schema version."""
    at = now if now is not None else F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    return F.struct(F.expr("uuid()").alias("message_id"), F.lit(kind).alias("message_type"), F.lit(sender).alias("sender_role"), F.lit(recipient).alias("recipient_role"), task.alias("task_id"), at.alias("timestamp"), F.lit(VERSION).alias("schema_version"))


def token(key: str, agent: Column, machine: Column, issued: Column, life: int = TOKEN_LIFE) -> Column:
    """agent|machine|expiry|mac with the first 16 digits of the mac."""
    body = F.concat_ws("|", agent, machine, (issued + life).cast("long").cast("string"))
    return F.concat_ws("|", body, F.substring(S.hmac_sha256(key, body), 1, 16))


def token_valid(given: Column, now: Column, key: str | None = None) -> Column:
    """Whether a token's expiry lies ahead and, with a key, its mac is right; malformed ones are not valid."""
    part = lambda i: F.get(F.split(given, "\\|"), F.lit(i))
    valid = part(2).try_cast("long") > now
    if key is not None:
        valid = valid & (part(3) == F.substring(S.hmac_sha256(key, F.concat_ws("|", part(0), part(1), part(2))), 1, 16))
    return F.coalesce(valid, F.lit(False))


def gateway(senders: list[str], key: str, now: Column, age: int = 60, skew: int = 5, most: int = MOST_PAYLOAD) -> Column:
    """The first thing wrong with a message (columns sender, ts, payload, signature, token_expires), null if nothing is.

    In order: an unknown sender, an expired token (a malformed expiry is let pass), a time that is no number, too old
    or ahead of now, a signature that does not fit, an empty payload, one that is too large."""
    c, sent, expiry = F.col, F.col("ts").try_cast("long"), F.col("token_expires").try_cast("double")
    signed = S.signature(key, c("sender"), c("ts"), c("payload"))
    return (
        F.when(~F.coalesce(c("sender").isin(*senders), F.lit(False)), "UnknownSender").when(expiry < now, "TokenExpired").when(sent.isNull(), "SignatureMismatch")
        .when(~S.fresh(sent, now, age, skew), "SignatureExpired").when(~c("signature").eqNullSafe(signed), "SignatureMismatch").when(F.octet_length("payload") == 0, "EmptyPayload").when(F.octet_length("payload") > most, "PayloadTooLarge")
    )


def machine_rows(states: DataFrame) -> DataFrame:
    """Created and terminated events of machines; a termination for a violation is an error."""
    made = states.where("created IS NOT NULL").select("key", F.lit("vm_created").alias("type"), F.col("created").alias("ts"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("reason"))
    ended = states.where("ended IS NOT NULL").select("key", F.lit("vm_terminated").alias("type"), F.col("ended").alias("ts"), F.when(F.lower("reason").contains("violation"), "error").otherwise("info").alias("severity"), "reason")
    return made.union(ended)


def task_terminations(machines: DataFrame, task: str) -> DataFrame:
    """How many machines a task's end terminates; those ended before count too."""
    return machines.agg(F.count_if(F.col("task_id") == task).alias("terminated"))


def review_requests(decisions: DataFrame, now: Column) -> DataFrame:
    """A request for each decision that a person must look at: flags once each, a recommendation and an expiry."""
    due = decisions.where("hitl_required")
    return due.select("task_id", F.array_distinct("flags").alias("flags"), F.slice(F.array_distinct("flags"), 1, 10).alias("shown"), F.when(F.col("aggregate_risk") > 0.7, "REJECT").otherwise("APPROVE_WITH_CONSTRAINTS").alias("recommendation"), (now + REVIEW_LIFE).alias("expires_at"), F.lit("pending").alias("status"))


def risk_summary(decisions: DataFrame) -> DataFrame:
    """Adds a text: decision, risk, files, and a line for each triggered rule."""
    head = F.format_string("Decision: %s\nAggregate Risk: %.2f%%\nFiles Analyzed: %d\nHigh-Risk Files: %d\nRules Triggered: %d/%d", F.col("decision"), F.col("aggregate_risk") * 100, F.col("total_files"), F.col("high_risk_file_count"), F.col("rules_triggered"), F.col("rules_evaluated"))
    rules = F.array_join(F.transform("triggered", lambda r: F.concat(F.lit("\n  ["), F.upper(r["severity"]), F.lit("] "), r["rule_id"])), "")
    return decisions.withColumn("risk_summary", F.concat(head, F.when(F.col("rules_triggered") > 0, F.concat(F.lit("\nTriggered Rules:"), rules)).otherwise("")))


def results(decisions: DataFrame, summaries: DataFrame) -> DataFrame:
    """One final row a task."""
    return decisions.join(summaries, "task_id", "left").select("task_id", F.lit("complete").alias("status"), "decision", "confidence", "aggregate_risk", F.col("high_risk_file_count").alias("high_risk_files"), "rules_triggered", "constraints", "hitl_required", *[c for c in summaries.columns if c != "task_id" and c not in decisions.columns])


def final(strategies: DataFrame, files: DataFrame, counted: DataFrame, pending: DataFrame, intelligence: DataFrame, key: str = "task_id") -> DataFrame:
    """The final row of each task with all its keys.

    strategies: decisions with their strategy. files: key, file, body. counted: key, clean_files, killed_files, seconds.
    pending: key, hitl_pending. intelligence: a row a task, which becomes a struct. Tasks that a table lacks have no
    files, counts of 0 and no intelligence. A task of which files were killed needs review whatever its decision."""
    ansible = F.col("file").endswith(".yml")
    entries = lambda of: F.map_from_entries(F.array_sort(F.collect_list(F.when(of, F.struct("file", "body")))))  # noqa: E731  a task's files are few
    made = files.groupBy(key).agg(entries(~ansible).alias("terraform_contents"), entries(ansible).alias("ansible_contents"))
    told = intelligence.select(key, F.struct(*[c for c in intelligence.columns if c != key]).alias("intelligence"))
    every = strategies.join(made, key, "left").join(counted, key, "left").join(pending, key, "left").join(told, key, "left")
    none, zero = F.create_map().cast("map<string,string>"), F.lit(0)
    contents = {k: F.coalesce(F.col(k), none) for k in ("terraform_contents", "ansible_contents")}
    killed = F.coalesce("killed_files", zero)
    return every.select(
        key, F.lit("complete").alias("status"), "decision", "confidence", "aggregate_risk", "total_files", F.coalesce("clean_files", zero).alias("clean_files"), killed.alias("killed_files"), F.col("high_risk_file_count").alias("high_risk_files"), F.col("anomalous_pattern_count").alias("anomalous_patterns"),
        (F.col("hitl_required") | (killed > 0)).alias("hitl_required"), F.coalesce("hitl_pending", zero).alias("hitl_pending"), "constraints", F.col("method").alias("deployment_method"), (F.col("method") != "none").alias("deployment_success"),
        F.array_sort(F.map_keys(contents["terraform_contents"])).alias("terraform_files"), F.array_sort(F.map_keys(contents["ansible_contents"])).alias("ansible_files"), *[v.alias(k) for k, v in contents.items()], "intelligence", F.round("seconds", 2).alias("duration_seconds"),
    )


def activity(tasks: DataFrame) -> DataFrame:
    """Counters over tasks."""
    d, s = F.col("decision"), F.col("status")
    return tasks.agg(F.count("*").alias("tasks"), F.count_if(s == "running").alias("running"), F.count_if(s == "failed").alias("failed"), F.count_if(d == "REJECT").alias("rejected"), F.count_if(F.col("hitl_required")).alias("pending_reviews"))


# Names of the variables that every bundle declares, and of those that a constraint adds.
VARIABLES = "subscription_id location app_name environment allowed_cidr state_resource_group state_storage_account".split()
VARIABLES_IF = {"monitoring_required": "action_group_id", "network_isolation": "key_vault_id", "sandboxed_execution": "app_image", "privilege_restriction": "keyvault_name"}
#: Lines of feedback that a second attempt carries.
MOST_FEEDBACK = 20
#: Our own short renderings; {places} are columns.
TEMPLATES = {
    "main.tf": '# task {task_id}, attempt {attempt}\n{feedback}terraform {\n  required_version = ">= 1.5"\n}\n\nresource "azurerm_resource_group" "main" {\n  name     = "rg-{task_id}"\n  location = var.location\n  tags     = { isolated = "{isolated}", sandboxed = "{sandboxed}" }\n}\n\nresource "azurerm_virtual_network" "main" {\n  name          = "vnet-{task_id}"\n  address_space = ["10.0.0.0/16"]\n}\n\nresource "azurerm_subnet" "main" {\n  name             = "subnet-{task_id}"\n  address_prefixes = ["10.0.1.0/24"]\n}\n',
    "nsg.tf": 'resource "azurerm_network_security_group" "main" {\n  name = "nsg-{task_id}"\n  tags = { isolated = "{isolated}" }\n\n  security_rule {\n    name      = "deny-inbound"\n    priority  = 4096\n    direction = "Inbound"\n    access    = "Deny"\n  }\n\n  security_rule {\n    name      = "deny-outbound"\n    priority  = 4096\n    direction = "Outbound"\n    access    = "Deny"\n  }\n}\n',
    "variables.tf": "".join(f'variable "{name}" {{\n  type = string\n}}\n\n' for name in VARIABLES) + "{declared}",
    "outputs.tf": 'output "resource_group" {\n  value = azurerm_resource_group.main.name\n}\n',
    "container.tf": 'resource "azurerm_container_group" "main" {\n  name           = "box-{task_id}"\n  os_type        = "Linux"\n  restart_policy = "Never"\n}\n',
    "monitoring.tf": 'resource "azurerm_log_analytics_workspace" "main" {\n  name = "logs-{task_id}"\n}\n\nresource "azurerm_monitor_activity_log_alert" "main" {\n  name = "alert-{task_id}"\n}\n',
    "private_endpoint.tf": 'resource "azurerm_private_endpoint" "main" {\n  name = "endpoint-{task_id}"\n}\n\nresource "azurerm_private_dns_zone" "main" {\n  name = "internal-{task_id}"\n}\n',
    "rbac.tf": 'resource "azurerm_role_assignment" "main" {\n  role_definition_name = "Reader"\n}\n',
    "keyvault_access.tf": 'resource "azurerm_key_vault_access_policy" "main" {\n  key_permissions = ["Get"]\n}\n',
    "site.yml": "# task {task_id}\n- name: Harden hosts\n  hosts: all\n  become: true\n  roles: [hardening]\n",
    "roles/hardening/tasks/main.yml": "- name: Disable root login\n  ansible.builtin.lineinfile:\n    path: /etc/ssh/sshd_config\n    line: PermitRootLogin no\n  notify: Restart ssh\n",
    "roles/hardening/handlers/main.yml": "- name: Restart ssh\n  ansible.builtin.service:\n    name: sshd\n    state: restarted\n",
    "deploy.sh": "#!/usr/bin/env bash\nset -euo pipefail\n# task {task_id}\naz group create --name rg-{task_id} --location \"$LOCATION\"\naz network vnet create --resource-group rg-{task_id} --name vnet-{task_id}\naz network nsg create --resource-group rg-{task_id} --name nsg-{task_id}\n",
}


def rendered(strategies: DataFrame, attempt: int = 1, feedback: str | None = None) -> DataFrame:
    """task_id, ord, file, body of every file that a strategy calls for.

    A variable is declared for each constraint that needs one. From the second attempt on, main.tf begins with the lines of the column
    `feedback`, at most MOST_FEEDBACK, as comments."""
    has = lambda k: F.array_contains("constraints", k)
    declared = F.concat(*[F.when(has(k), F.lit(f'variable "{v}" {{\n  type = string\n}}\n\n')).otherwise("") for k, v in VARIABLES_IF.items()])
    lines = F.transform(F.slice(F.split(F.coalesce(F.col(feedback), F.lit("")), "\n"), 1, MOST_FEEDBACK), lambda x: F.concat(F.lit("# "), x)) if feedback else None
    told = F.when(F.coalesce(F.col(feedback), F.lit("")) != "", F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("") if feedback and attempt > 1 else F.lit("")
    flags = strategies.select("task_id", has("network_isolation").alias("isolated"), has("sandboxed_execution").alias("sandboxed"), F.lit(attempt).alias("attempt"), declared.alias("declared"), told.alias("feedback"))
    files = generated_files(strategies, ["task_id"]).join(flags, "task_id")
    return bodies(files, TEMPLATES, task_id="task_id", attempt="attempt", isolated="isolated", sandboxed="sandboxed", declared="declared", feedback="feedback").select("task_id", "ord", "file", "body")
