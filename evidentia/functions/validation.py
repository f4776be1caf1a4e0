"""Validators and classifiers of single values as column expressions; a null is never valid and gives no class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds in bytes, runners of scripts, what marks credentials.
MAX_ID_BYTES, MAX_TEXT_BYTES, MAX_REVISION_BYTES, MAX_REFERENCE_BYTES = 128, 8192, 128, 1024
RUNNERS = ("tsx", "ts-node", "ts-node-esm", "node", "bun")
RUN_COMMANDS = ("bun", "deno")
CREDENTIAL_MARKERS = ("password=", "token=", "secret=", "private_key", "authorization:")


def _bounded(value: Column, most: int) -> Column:
    return F.octet_length(value).between(1, most)


def is_id(value: Column) -> Column:
    """A stable identifier: ASCII letters, digits and ``._:-``, bounded."""
    return F.coalesce(_bounded(value, MAX_ID_BYTES) & value.rlike(r"\A[A-Za-z0-9._:-]+\z"), F.lit(False))


def is_text(value: Column) -> Column:
    """Bounded text with something but white space, without NUL."""
    return F.coalesce(_bounded(value, MAX_TEXT_BYTES) & value.rlike(r"(?U)\S") & ~value.contains("\0"), F.lit(False))


def is_revision(value: Column) -> Column:
    """One bounded token without shell characters."""
    return F.coalesce(_bounded(value, MAX_REVISION_BYTES) & ~value.rlike(r"(?U)[\s;|&`\x00]"), F.lit(False))


def is_reference(value: Column) -> Column:
    """An evidence reference: bounded, on one line, without credentials."""
    return F.coalesce(_bounded(value, MAX_REFERENCE_BYTES) & ~value.rlike(r"[\r\n\x00]") & ~holds_credentials(value), F.lit(False))


def holds_credentials(value: Column) -> Column:
    low = F.lower(value)
    found = F.lit(False)
    for marker in CREDENTIAL_MARKERS:
        found = found | low.contains(marker)
    return found


def is_changed_source(path: Column, flow_in_focus: Column) -> Column:
    """Whether a changed path counts: TypeScript always, the package manifest only with a flow in focus."""
    return path.endswith(".ts") | path.endswith(".tsx") | ((path == "package.json") & flow_in_focus)


def script(command: Column) -> Column:
    """Struct (runner, target, reason) of a package script; without a supported runner, runner and target are null and reason says why."""
    tokens = F.filter(F.split(command, r"(?U)\s+"), lambda t: t != "")
    runs = (F.size(tokens) == 3) & F.get(tokens, F.lit(0)).isin(*RUN_COMMANDS) & (F.get(tokens, F.lit(1)) == "run")
    direct = (F.size(tokens) == 2) & F.get(tokens, F.lit(0)).isin(*RUNNERS)
    reason = (
        F.when((command == "") | command.rlike(r"[&|;><`$\n\r]"), "script-command-complex-or-shell-composed")
        .when(F.exists(tokens, lambda t: t.startswith("-") | t.contains('"') | t.contains("'")), "script-command-flags-or-quoting-unsupported")
        .when(direct | runs, "")
        .when(command.isNotNull(), "unsupported-script-runner-or-arity")
    )
    name = F.when(runs, F.concat(F.get(tokens, F.lit(0)), F.lit(" run"))).otherwise(F.get(tokens, F.lit(0)))
    return F.struct(F.when(reason == "", name).alias("runner"), F.when(reason == "", F.element_at(tokens, -1)).alias("target"), reason.alias("reason"))
