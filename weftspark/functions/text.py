"""String functions, built of Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: hosts in string literals.
HOST = r"(?i)(?:https?|ws|wss)://([a-z0-9][a-z0-9.\-]*(?::\d{2,5})?)"
#: Calls that name a topic, by position and in an object.
TOPIC_POSITIONAL = r"(?i)\b([a-z_][a-z0-9_]*)\s*\.\s*(publish|produce|send|sendToQueue|sendMessage|consume|subscribe|receiveMessage|psubscribe)\s*\(\s*['\"`]([^'\"`\s,)]+)['\"`]"
TOPIC_OBJECT = r"(?i)\b([a-z_][a-z0-9_]*)\s*\.\s*(publish|produce|send|sendToQueue|sendMessage|consume|subscribe|receiveMessage|psubscribe)\s*\(\s*\{[^}]*?\b(?:topic|QueueUrl|TopicArn)\s*:\s*['\"`]([^'\"`]+)['\"`]"
#: Methods that consume; case counts.
CONSUMES = ("consume", "subscribe", "receiveMessage", "psubscribe")
#: Source extensions, in the order in which modules are sought.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx"}
SKIPPED_DIRS = ("node_modules", "dist", "build", "coverage", "vendor")
#: Kinds of change by git status letter.
CHANGE_KINDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed"}
#: Decorators that make endpoints and their parameters.
HTTP_METHODS = {"Get": "GET", "HttpGet": "GET", "Post": "POST", "HttpPost": "POST", "Put": "PUT", "HttpPut": "PUT", "Patch": "PATCH", "HttpPatch": "PATCH", "Delete": "DELETE", "HttpDelete": "DELETE", "Options": "OPTIONS", "Head": "HEAD", "All": "ALL"}
HTTP_PARAMS = {"Param": "path", "Body": "body", "Query": "query", "Headers": "header"}


def looked_up(value: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, value), F.lit(otherwise))


def env_name(member: Column) -> Column:
    """FOO of ``env.FOO.bar``; null for anything else."""
    return F.nullif(F.regexp_extract(member, r"^env\.([^.]*)", 1), F.lit(""))


def hosts_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HOST), 1)


def before(value: Column, sign: str) -> Column:
    """What stands before the first ``sign``, unless that comes first."""
    return F.when(F.instr(value, sign) > 1, F.substring_index(value, sign, 1)).otherwise(value)


def normal_name(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit("_"), F.lit("-"))


def name_prefixes(value: Column) -> Column:
    """A name and what stands before each of its hyphens: names match when one is among the other's."""
    parts = F.split(normal_name(value), "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))


def names_match(a: Column, b: Column) -> Column:
    a, b = normal_name(a), normal_name(b)
    return (a != "") & (b != "") & ((a == b) | F.startswith(a, F.concat(b, F.lit("-"))) | F.startswith(b, F.concat(a, F.lit("-"))))


def broker_of(callee: Column) -> Column:
    c = F.lower(callee)
    return (
        F.when(c.startswith("kafka") | c.isin("producer", "consumer"), "kafka")
        .when(c.startswith("rabbit") | (c == "channel"), "rabbitmq")
        .when(c.startswith("sqs"), "sqs")
        .when(c.startswith("sns"), "sns")
        .when(c.startswith("redis"), "redis")
        .when(c.startswith("pubsub"), "pubsub")
        .otherwise("unknown")
    )


def topic_name(raw: Column, broker: Column) -> Column:
    """The last part of a queue's URL or a topic's ARN, if there is one."""
    url, arn = F.substring_index(raw, "/", -1), F.substring_index(raw, ":", -1)
    return F.when((broker == "sqs") & (url != ""), url).when((broker == "sns") & (arn != ""), arn).otherwise(raw)


def person_key(name: Column, email: Column) -> Column:
    mail = F.lower(F.trim(email))
    return F.coalesce(F.nullif(mail, F.lit("")), F.concat(F.lit("anon-"), F.trim(name)))


def person_id(name: Column, email: Column) -> Column:
    return F.concat(F.lit("person:"), F.sha1(person_key(name, email).cast("binary")))


def stored_email(email: Column, policy: str = "plain") -> Column:
    """``plain`` keeps an address, ``hash`` its sha256, ``none`` nothing."""
    mail = F.lower(F.trim(email))
    if policy == "hash":
        return F.when(mail != "", F.concat(F.lit("sha256:"), F.sha2(mail.cast("binary"), 256))).otherwise("")
    if policy == "none":
        return F.lit("")
    if policy != "plain":
        raise ValueError(f"email policy {policy!r}")
    return mail


def change_kind(status: Column) -> Column:
    return looked_up(F.substring(status, 1, 1), CHANGE_KINDS, "touched")


def package_name(spec: Column) -> Column:
    return F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def alias_capture(spec: Column, prefix: Column, suffix: Column, wildcard: Column) -> Column:
    """What ``*`` stands for in ``prefix*suffix``; null if the alias doesn't fit."""
    fits = F.startswith(spec, prefix) & F.endswith(spec, suffix) & (F.length(spec) >= F.length(prefix) + F.length(suffix))
    held = F.substring(spec, F.length(prefix) + 1, F.length(spec) - F.length(prefix) - F.length(suffix))
    return F.when(wildcard & fits, held).when(~wildcard & (spec == prefix), F.lit(""))


def clean_path(path: Column) -> Column:
    """A relative path without empty parts, ``.`` and ``..`` where it can be taken back."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    back = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.nullif(F.array_join(back, "/"), F.lit(""))


def candidate_files(path: Column) -> Column:
    """Files that a module path may mean, in order of preference."""
    stem = F.regexp_extract(path, r"^(.*)\.(?:jsx?|mjs|cjs)$", 1)
    others = F.when(stem != "", F.array(*(F.concat(stem, F.lit(e)) for e in EXTENSIONS))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(path), others, F.array(*(F.concat(path, F.lit(e)) for e in EXTENSIONS)), F.array(*(F.concat(path, F.lit("/index" + e)) for e in EXTENSIONS)))


def http_path(base: Column, own: Column) -> Column:
    """Paths of a controller and a method joined by one slash."""
    lead = lambda x: F.when((x != "") & ~x.startswith("/"), F.concat(F.lit("/"), x)).otherwise(x)
    a, b = F.regexp_replace(lead(F.trim(base)), "/$", ""), lead(F.trim(own))
    return F.coalesce(F.nullif(F.concat(a, b), F.lit("")), F.lit("/"))


def app_key(app_id: Column) -> Column:
    return F.regexp_replace(app_id, "^app:(?=.)", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    return F.when(F.contains(base_name(path), F.lit(".")) & ~path.endswith(".d.ts"), looked_up(F.substring_index(path, ".", -1), LANGUAGES))


def readable(path: Column) -> Column:
    """Whether a relative path is a source file outside of skipped and hidden folders."""
    skipped = "|".join(SKIPPED_DIRS)
    return language_of(path).isNotNull() & ~path.rlike(rf"(^|/)({skipped}|\.[^/]+)/")


def range_text(commits: Column, limit: Column, rev: Column) -> Column:
    """What part of a history is read, in words: a range of commits where there is one, else a revision; null counts as empty and as no limit."""
    capped = F.coalesce(limit, F.lit(0)) > 0
    number = limit.cast("string")
    ranged = F.concat(commits, F.when(capped, F.concat(F.lit(" (limit "), number, F.lit(")"))).otherwise(""))
    whole = F.concat(F.lit("rev="), F.coalesce(rev, F.lit("")), F.when(capped, F.concat(F.lit(" limit="), number)).otherwise(""))
    return F.when(F.coalesce(commits, F.lit("")) != "", ranged).otherwise(whole)
