"""Form outcomes, abandonment, and rules that decide whether a submission is good."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions import money
from donorlake.functions.text import browser_length, look_up


def _events(rows: DataFrame, total: Column, errors: Column, empties: Column | None = None, prefix: str = "") -> DataFrame:
    """Explode form rows into (action, label, value). ``total`` is the event for the form as a whole."""
    entry = lambda action, label, value: F.struct(
        action.alias("action"), label.alias("label"), value.cast("bigint").alias("value")
    )
    per_field = lambda names, action: F.transform(
        names, lambda f: entry(F.lit(action), F.concat(f, F.lit(" | "), F.col("form_action")), F.lit(None))
    )
    whole = F.array(total)
    parts = [whole, per_field(errors, f"{prefix}error")]
    if empties is not None:
        parts.append(per_field(empties, f"{prefix}empty"))
    return rows.select(F.explode(F.concat(*parts)).alias("_e")).select("_e.*")


def _whole(action: Column, value: Column) -> Column:
    return F.struct(action.alias("action"), F.col("form_action").alias("label"), value.cast("bigint").alias("value"))


def submit_events(submits: DataFrame) -> DataFrame:
    """submit:success, or submit:failure with its error count and one submit:error per error."""
    n = F.size("errors")
    action = F.when(n > 0, "submit:failure").otherwise("submit:success")
    return _events(submits, _whole(action, F.when(n > 0, n)), F.col("errors"), prefix="submit:")


def abandoned(opens: DataFrame, submits: DataFrame) -> DataFrame:
    """Forms that were left without a submit: the form's last state on each page view that has no submit."""
    last = opens.groupBy("pageview_id").agg(
        F.max_by(F.struct("form_action", "errors", "empties"), F.struct("ts", "event_id")).alias("_s")
    )
    left = last.join(submits.select("pageview_id").distinct(), "pageview_id", "left_anti")
    return left.select("pageview_id", "_s.*")


def abandonment_events(forms: DataFrame) -> DataFrame:
    """abandoned with its error count, one abandoned:error per error, one abandoned:empty per empty field."""
    whole = _whole(F.lit("abandoned"), F.size("errors"))
    return _events(forms, whole, F.col("errors"), F.col("empties"), prefix="abandoned:")


def event_report(events: DataFrame) -> DataFrame:
    return events.groupBy("action", "label").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("total_value")
    )


def top_labels(events: DataFrame, actions: Sequence[str], k: int) -> DataFrame:
    """The k labels that occur most, ties by label."""
    return (
        events.where(F.col("action").isin(*actions))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "label")
        .limit(k)
    )


# --- submission quality -------------------------------------------------------------------------------------------


def amount_rule(entered: Column, selected: Column, currency: Column) -> Column:
    """The first rule an amount breaks, or "ok". An entered 0 counts as nothing entered."""
    typed = F.coalesce(entered, F.lit(0)) != 0
    return (
        F.when(entered > money.max_amount(currency), "above maximum")
        .when(~typed & (F.coalesce(selected, F.lit(0)) == 0), "no amount")
        .when(typed & (entered < 1), "below minimum")
        .otherwise("ok")
    )


def preset_amounts(country_group: Column, monthly: bool = False) -> Column:
    """Preset buttons of a country group."""
    kind = "monthly" if monthly else "one-off"
    as_array = lambda values: F.array(*[F.lit(v) for v in values])
    chain = None
    for group, lists in fixed.PRESET_AMOUNTS.items():
        if group != "default":
            chain = (chain or F).when(country_group == group, as_array(lists[kind]))
    return chain.otherwise(as_array(fixed.PRESET_AMOUNTS["default"][kind]))


def preselected_amount(country_group: Column, override: Column) -> Column:
    """The button that is pressed at first: the experiment's, if it has one, else the group's."""
    return F.coalesce(
        override, look_up(country_group, fixed.PRESELECTED_AMOUNT, fixed.DEFAULT_PRESELECTED_AMOUNT)
    )


def is_preset(amount: Column, country_group: Column, override: Column, monthly: bool = False) -> Column:
    """Whether an amount is one of the buttons shown: the experiment's values, if it has any, else the group's."""
    shown = F.coalesce(override, preset_amounts(country_group, monthly))
    return F.exists(shown, lambda v: v.cast("decimal(18,2)") == amount)


# --- field rules ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """A rule over one column. A disabled field is always valid; otherwise all the parts that are set must hold.

    ``profile`` is a SQL predicate of the site's own.
    """

    rule_id: str
    column: str
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    profile: str | None = None
    disabled: bool = False

    def holds(self) -> Column:
        value = F.coalesce(F.col(self.column).cast("string"), F.lit(""))
        parts = [F.lit(True)]
        if not self.disabled:
            if self.profile:
                parts.append(F.coalesce(F.expr(self.profile), F.lit(False)))
            if self.required:
                parts.append(value != "")
            if self.min_length:
                parts.append(browser_length(value) >= self.min_length)
            if self.max_length:
                parts.append(browser_length(value) <= self.max_length)
            if self.pattern:
                parts.append(value.rlike(self.pattern))
        result = parts[0]
        for part in parts[1:]:
            result = result & part
        return result


def rules_from_rows(rows: Sequence[dict]) -> tuple[FieldRule, ...]:
    """Rules kept as rows of a small table."""
    return tuple(FieldRule(**row) for row in rows)


def rule_report(df: DataFrame, rules: Sequence[FieldRule], by: Sequence[str] = ()) -> DataFrame:
    """Valid and invalid rows per rule, all rules in one pass over the table."""
    passed = [F.sum(r.holds().cast("bigint")).alias(r.rule_id) for r in rules]
    one_row = df.groupBy(*by).agg(F.count("*").alias("n_rows"), *passed)
    each = F.explode(
        F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(r.rule_id).alias("n_valid")) for r in rules])
    )
    return one_row.select(*by, "n_rows", each.alias("_r")).select(
        *by, "_r.rule_id", "_r.n_valid", (F.col("n_rows") - F.col("_r.n_valid")).alias("n_invalid")
    )


def decline_messages(failures: DataFrame) -> DataFrame:
    """What the payer is told, by how often.

    A declined card is looked up by its decline code, other card errors by their code; whatever is not known gets the
    generic message. Failures are counted by their codes before any text is attached.
    """
    counted = failures.groupBy("error_type", "code", "decline_code").agg(F.count("*").alias("n"))
    declined = F.coalesce(
        look_up(F.col("decline_code"), fixed.DECLINE_MESSAGES), F.lit(fixed.DECLINE_MESSAGES["generic_decline"])
    )
    known = F.when(F.col("code") == "card_declined", declined).otherwise(
        look_up(F.col("code"), fixed.CARD_ERROR_MESSAGES)
    )
    message = F.coalesce(F.when(F.col("error_type") == "card_error", known), F.lit(fixed.GENERIC_ERROR_MESSAGE))
    return counted.groupBy(message.alias("message")).agg(F.sum("n").alias("n"))
