"""Column functions on references, headings, statuses and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.model import SEVERITY

#: Patterns of the requirement format (fixed values).
TRACE_ITEM = r"^([A-Za-z0-9._-]+/)?[A-Z][A-Z0-9]*(-[A-Z0-9]+)*-[0-9]+(~[0-9]+)?$"
HEURISTIC_ID = r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-[0-9]{3,}(?:~[0-9]+)?\b"
MARKED_ID = r"^([a-z0-9_-]+/)?[A-Z][A-Z0-9-]+(~[0-9]+)?$"

_PIN = r"(?s)^(.*)~([+-]?[0-9]+)$"


def pin(ref: Column) -> Column:
    """The version after the last ``~``; null unless it is a 64-bit integer."""
    return F.when(ref.rlike(_PIN), F.regexp_extract(ref, _PIN, 2).try_cast("bigint"))


def strip_pin(ref: Column) -> Column:
    """The reference without its pin; unchanged if it has none."""
    return F.when(pin(ref).isNotNull(), F.regexp_extract(ref, _PIN, 1)).otherwise(ref)


def qualifier(bare: Column) -> Column:
    """What stands before the first ``/``; null for an unqualified reference."""
    return F.when(F.instr(bare, "/") > 0, F.substring_index(bare, "/", 1))


def local_id(bare: Column) -> Column:
    at = F.instr(bare, "/")
    return F.when(at > 0, bare.substr(at + 1, F.length(bare))).otherwise(bare)


def heading_id(heading: Column) -> Column:
    """ID before the first ``: ``, trimmed; the whole heading if there is none."""
    at = F.instr(heading, ": ")
    return F.trim(F.when(at > 0, heading.substr(F.lit(1), at - 1)).otherwise(heading))


def heading_title(heading: Column) -> Column:
    at = F.instr(heading, ": ")
    return F.trim(F.when(at > 0, heading.substr(at + 2, F.length(heading))).otherwise(F.lit("")))


def effective_status(status: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("approved"))


def is_provider(status: Column, ignore_status: Column) -> Column:
    """Whether a requirement counts as coverage: approved in any case, or its document ignores statuses."""
    return F.coalesce(ignore_status, F.lit(False)) | (F.lower(effective_status(status)) == "approved")


def severity(outcome: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(outcome == kv[0], kv[1]), list(SEVERITY.items())[1:], F.when(outcome == "pass", 1)).otherwise(0)


def outcome_of(sev: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(sev == kv[1], kv[0]), list(SEVERITY.items())[1:], F.when(sev == 1, "pass"))


def suppressed(suppressions: Column, check: str) -> Column:
    return F.coalesce(F.array_contains(suppressions, check), F.lit(False))


def short_sha(sha: Column) -> Column:
    return F.left(sha, F.lit(7))


def status_hash(status: Column) -> Column:
    """h * 33 + c over the characters from 5381, modulo 2^32."""
    codes = F.transform(F.filter(F.split(status, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))


def ctrf_outcome(status: Column, flaky: Column) -> Column:
    """Test-report status to outcome; a flaky test is inconclusive whatever its status."""
    return (
        F.when(F.coalesce(flaky, F.lit(False)), "inconclusive").when(status == "passed", "pass").when(status == "failed", "fail")
        .when(status.isin("skipped", "pending"), "skipped").otherwise("inconclusive")
    )


def epoch_ms(stop: Column, start: Column) -> Column:
    return F.timestamp_millis(F.when(stop > 0, stop).when(start > 0, start))


def case_key(suite: Column, name: Column) -> Column:
    return F.concat_ws("/", F.nullif(suite, F.lit("")), name)


def marked_traces(text: Column) -> Column:
    """Ids on ``<tool>:trace`` directive lines, comma-separated or one a line; first seen first, invalid ones skipped."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[a-z]+:trace[ \t]+(.+?)$"), F.lit(1))
    ids = F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), lambda x: F.trim(x))
    return F.array_distinct(F.filter(ids, lambda x: x.rlike(MARKED_ID)))


def heuristic_traces(text: Column) -> Column:
    """Bare ids in a text that no directive names."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(HEURISTIC_ID), F.lit(0))), marked_traces(text))
