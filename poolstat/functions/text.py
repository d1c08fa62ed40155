"""Text, reply and transport functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cuts, scales and the phrases and codes by which refusals to bill are known.
DETAIL_CHARS, SNIPPET_CHARS = 1400, 240
AXES, AXIS_LOW, AXIS_HIGH = ["originality", "feasibility"], 1, 10
BILLING_MESSAGES = r"credit balance is too low|plans\s*&\s*billing|exceeded your current quota|check your plan and billing details"
BILLING_CODES = "insufficient_quota"
TRANSIENT_KINDS = ["rate_limited", "timeout", "transport_error", "budget_exceeded", "harness_error"]
INTRINSIC_KINDS = ["parse_failure", "empty_pool", "refusal"]
PAYMENT_KINDS = ["payment_required"]
FAILURE_KINDS = [*INTRINSIC_KINDS, *TRANSIENT_KINDS, *PAYMENT_KINDS]


def normalize_title(c: Column) -> Column:
    """Lower case, runs of all but a-z and 0-9 become one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_id(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def strip_mapping_extension(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)\.(json|txt)$", ""))


def title_line(text: Column) -> Column:
    """What follows `Title:` on the first line, or null."""
    first = F.regexp_extract(F.regexp_extract(text, r"^([^\r\n]*)", 1), r"(?i)^\s*Title:\s*(.+?)\s*$", 1)
    return F.when(first != "", first)


def csv_escape(c: Column) -> Column:
    """Quoted where the value holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_escape(c: Column) -> Column:
    out = c.cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def truncated_detail(c: Column, limit: int = DETAIL_CHARS) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def reason_category(detail: Column) -> Column:
    """Text before the first colon, trimmed; none is `unknown`."""
    return F.when(F.coalesce(detail, F.lit("")) == "", "unknown").otherwise(F.trim(F.substring_index(detail, ":", 1)))


def is_transient(kind: Column) -> Column:
    return F.coalesce(kind.isin(TRANSIENT_KINDS), F.lit(False))


def is_payment(kind: Column) -> Column:
    return F.coalesce(kind.isin(PAYMENT_KINDS), F.lit(False))


def expand_kinds(selectors: list[str]) -> list[str]:
    """Kinds named by selectors; `transient`, `intrinsic` and `payment` stand for their groups, an unknown name is refused."""
    from poolstat.errors import check

    groups = {"transient": TRANSIENT_KINDS, "intrinsic": INTRINSIC_KINDS, "payment": PAYMENT_KINDS}
    out: dict[str, None] = {}
    for s in selectors:
        check(s in groups or s in FAILURE_KINDS, f"unknown failure kind {s!r}")
        out.update(dict.fromkeys(groups.get(s, [s])))
    return list(out)


def summarize_reply(text: Column, stop_reason: Column, output_tokens: Column, parsed: Column, found: Column, dropped: Column) -> Column:
    """Diagnostics of one reply: `parsed` tells a direct parse (null: not parsed at all), `found` its objects."""
    t = F.coalesce(text, F.lit(""))
    parse = F.when(parsed.isNull(), "unparsed").when(parsed, "ok").when(found > 0, "salvaged").otherwise("failed")
    return F.struct(
        stop_reason.alias("stop_reason"), F.coalesce(stop_reason == "max_tokens", F.lit(False)).alias("truncated"),
        F.coalesce(output_tokens, F.lit(0)).alias("output_tokens"), F.length(t).alias("text_length"), parse.alias("parse"),
        F.coalesce(found, F.lit(0)).alias("candidates"), F.coalesce(dropped, F.lit(0)).alias("dropped"),
        F.substring(t, 1, SNIPPET_CHARS).alias("head"), F.when(F.length(t) > SNIPPET_CHARS, F.right(t, F.lit(SNIPPET_CHARS))).otherwise("").alias("tail"),
    )


def is_billing_refusal(message: Column, codes: Column) -> Column:
    return F.coalesce(message.rlike(BILLING_MESSAGES), F.lit(False)) | F.coalesce(codes.contains(BILLING_CODES), F.lit(False))


def transport_kind(status: Column, message: Column, codes: Column) -> Column:
    return F.when(is_billing_refusal(message, codes), "payment_required").when(status == 429, "rate_limited").otherwise("transport_error")


def failure_kind(payment: Column, timed_out: Column, limited: Column, transport: Column, fallback: Column) -> Column:
    """The first of the flags in order of precedence."""
    return F.when(payment, "payment_required").when(timed_out, "timeout").when(limited, "rate_limited").when(transport, "transport_error").otherwise(fallback)


def finish_reason(vendor: Column) -> Column:
    return F.when(vendor == "length", "max_tokens").when(vendor == "content_filter", "refusal").when(vendor == "stop", "end_turn").when(vendor == "", F.lit(None)).otherwise(vendor)


def block_text(blocks: Column) -> Column:
    """Joined text of the text blocks of a message; none is empty."""
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return F.coalesce(F.array_join(F.transform(texts, lambda b: b["text"]), ""), F.lit(""))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds of a retry header: seconds, or an HTTP date after `now`; null where it says neither."""
    seconds = F.when(header.rlike(r"^\s*\d+(\.\d+)?\s*$"), header.cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    until = (F.unix_millis(date) - F.unix_millis(now)).cast("double")
    return F.coalesce(seconds * 1000, F.when(until < 0, 0.0).otherwise(until))


def results_expired(submitted: Column, retention_ms: Column, now: Column) -> Column:
    """Whether a batch is older than its retention; an absent or unreadable time is not."""
    return F.coalesce(F.unix_millis(now) - F.unix_millis(F.try_to_timestamp(submitted)) > retention_ms, F.lit(False))


def agents_realized(attempted: Column, failed: Column) -> Column:
    """attempted - failed, or null where the counts make no sense."""
    return F.when((attempted >= 0) & (failed >= 0) & (failed <= attempted), attempted - failed)


def pool_failure(replies: Column, truncated: Column, refused: Column, unparseable: Column, all_refused: Column) -> Column:
    """struct(kind, cause) of an empty pool, from counts of its replies."""
    pick = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("cause"))
    return (
        F.when((replies > 0) & (refused == replies), pick("refusal", "refusal")).when(truncated > 0, pick("parse_failure", "truncated"))
        .when(unparseable > 0, pick("parse_failure", "unparseable_complete")).when(all_refused, pick("refusal", "agents_all_failed"))
        .when(replies == 0, pick("empty_pool", "no_replies")).otherwise(pick("empty_pool", "genuinely_empty"))
    )


def undersized_pool(agents_failed: Column, idle: Column, truncated: Column, refused: Column, unparseable: Column) -> Column:
    """struct(kind, cause) of a pool some agents did not add to; null for a whole one."""
    pick = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("cause"))
    return F.when(
        (F.coalesce(agents_failed, F.lit(0)) > 0) | (idle > 0),
        F.when(truncated > 0, pick("parse_failure", "partial_truncated")).when(refused > 0, pick("refusal", "partial_refusal"))
        .when(unparseable > 0, pick("parse_failure", "partial_unparseable_complete")).otherwise(pick("harness_error", "partial_unexplained")),
    )


def axis_scores(text: Column) -> Column:
    """struct of both axes of a judge's JSON reply (a code fence is dropped); anything but two numbers on the scale raises."""
    body = F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    got = F.from_json(body, "struct<" + ",".join(f"{a}:double" for a in AXES) + ">", {"mode": "PERMISSIVE"})
    ok = F.lit(True)
    for a in AXES:
        ok = ok & F.coalesce(got[a].between(AXIS_LOW, AXIS_HIGH), F.lit(False)) & ~F.coalesce(F.get_json_object(body, f"$.{a}").rlike("^[^-0-9]"), F.lit(True))
    return F.when(ok, got).otherwise(F.raise_error(F.concat(F.lit("not two scores on the scale: "), F.substring(F.coalesce(text, F.lit("null")), 1, 80))))


def seed_list(seeds: Column) -> Column:
    """Numbered lines of shared ideas."""
    lines = F.transform(seeds, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(s, F.lit(""))))
    return F.when(F.coalesce(F.size(seeds), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("(no prior ideas were shared)")


def template(text: str, **fields: Column) -> Column:
    """A text with {name} replaced by columns."""
    out = F.lit(text)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def max_tokens(ideas: Column, rate: Column, floor: int, headroom: float = 2.5, usual: int = 6) -> Column:
    """Token bound of a request: enough for the ideas with headroom, never under the floor."""
    n = F.when(F.coalesce(ideas, F.lit(0)) > 0, ideas).otherwise(usual)
    return F.greatest(F.lit(floor), F.ceil(n * rate * headroom)).cast("long")


def candidate_text(plain: Column, nested: Column) -> Column:
    return F.coalesce(plain, nested)
