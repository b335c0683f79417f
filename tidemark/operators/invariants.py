"""Invariants of outcomes, metrics, signals, receipts, series and telemetry as named conditions.

A contract is a name for each condition, written over columns of a table with one row a record; `violations` of
`routing` reports the records that break one (a condition that is unknown is broken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scoring import first_true

OUTCOME_INPUTS = {
    "evaluated_after_due": "evaluated >= due",
    "knowledge_includes_evaluation": "known >= evaluated",
    "observations_known": "start_available <= known and end_available <= known",
    "start_before_prediction": "start_date <= as_of and start_available <= cutoff",
    "end_after_due": "end_date >= due",
    "action_in_period": "action_date is null or (action_date >= as_of and action_available <= known)",
    "own_instrument": "start_instrument = instrument and end_instrument = instrument",
    "own_currency": "start_currency = currency and end_currency = currency",
}
METRIC_RESULT = {
    "as_of_within_cutoff": "as_of <= cutoff",
    "points_unique": "n_points = n",
    "inputs_unique": "n_inputs = n",
    "inputs_available": "last_available <= cutoff",
    "inputs_not_later": "last_effective <= as_of",
    "points_sorted": "n_unsorted = 0",
}
SIGNAL_RESULT = {
    "all_dimensions_traced": "n_dimensions = 3",
    "opportunity_is_its_traces": "opportunity = greatest(0, least(100, sum_opportunity))",
    "risk_is_its_traces": "risk = greatest(0, least(100, sum_risk))",
    "confidence_is_its_traces": "confidence = greatest(0, least(100, sum_confidence))",
    "insufficient_is_unclassified": "(label = 'Insufficient evidence') = (profile = 'unclassified')",
    "no_recommendation": "n_prohibited = 0",
}
# Words that no explanation of a signal may hold.
PROHIBITED = r"(?i)\b(?:buy|sell|guaranteed?|probabilit(?:y|ies)|trade instruction)\b"
OUTCOME_BATCH = {
    "evaluated_after_close": "evaluated >= target_close",
    "appended_after_evaluation": "appended >= evaluated",
    "attempts_before_evaluation": "last_completed is null or last_completed <= evaluated",
    "attempts_unique": "n_ids = n_attempts",
    "attempt_numbers_unique": "n_numbers = n_attempts",
    "completed_ends_in_success": "status <> 'completed' or (n_attempts > 0 and last_status = 'succeeded')",
    "unavailable_ends_in_failure": "status <> 'unavailable' or (n_attempts > 0 and last_status = 'terminal_failure')",
    "completed_has_returns": "status <> 'completed' or (asset_return is not null and benchmark_return is not null and n_limitations = 0)",
    "unavailable_has_none": "status <> 'unavailable' or (asset_return is null and benchmark_return is null and n_limitations > 0)",
    "returns_recompute": "asset_return is null or benchmark_return is null or relative_return = asset_return - benchmark_return",
}
FINANCING_TERM = {
    "evidence_unique": "n_evidence = n_distinct_evidence",
    "money_bases_unique": "n_bases = n_distinct_bases",
    "reported_proceeds_have_an_amount": "(proceeds_status = 'reported') = has_proceeds",
    "exercise_price_is_of_warrants": "exercise_price is null or instrument in ('warrant', 'warrant_repricing', 'warrant_exercise_inducement')",
    "previous_price_is_of_repricing": "previous_price is null or instrument = 'warrant_repricing'",
    "conversion_price_is_of_convertibles": "conversion_price is null or instrument in ('convertible_debt', 'preferred_equity')",
    "maturity_is_of_debt": "maturity is null or instrument in ('convertible_debt', 'debt')",
    "rate_is_of_debt": "rate is null or instrument in ('convertible_debt', 'debt')",
    "closes_after_announcement": "closing is null or announced is null or closing >= announced",
}
CHANGE_AND_ROUTE = {
    "distinct_accessions": "prior_accession <> accession",
    "distinct_manifests": "prior_manifest <> manifest",
    "partition_of_changes": "n_selected + n_omitted = n_changes",
    "ready_has_changes": "(disposition = 'delta_ready') = (n_changed > 0 and delta_sha is not null)",
    "ready_has_a_size": "(disposition = 'delta_ready') = (delta_characters > 0)",
    "ready_removes_nothing": "disposition <> 'delta_ready' or n_removed = 0",
    "reason_fits": "(disposition = 'delta_ready' and reason = 'reliable_section_delta') or (disposition = 'no_selected_delta' and reason = 'selected_evidence_unchanged') or (disposition = 'full_reanalysis' and reason in ('missing_section_manifest', 'removed_relevant_section', 'delta_exceeds_budget', 'ruleset_changed'))",
    "evidence_hash_and_size": "(evidence_sha is not null) = (evidence_characters > 0)",
    "no_model_takes_nothing": "route <> 'no_model' or (model = 'none' and evidence_sha is null and evidence_characters = 0 and output_limit = 0)",
    "model_stays_bounded": "route = 'no_model' or (model <> 'none' and evidence_sha is not null and evidence_characters between 1 and 3600 and output_limit = 768)",
    "richer_is_shadow": "(route = 'richer_bounded') = (deployment = 'shadow_only')",
}
REPORT_COUNTS = {
    "favorable_within_available": "favorable <= available and available <= sample",
    "empty_has_no_rate": "available > 0 or rate is null",
    "rate_within_one": "available = 0 or (rate between 0 and 1 and low between 0 and 1 and high between 0 and 1)",
    "coverage_counts": "available + unavailable = sample",
    "split_counts": "splits = sample",
    "coverage_rate": "coverage = available * 1.0 / sample",
}
ACTION_SERIES = {
    "one_instrument": "n_other_instruments = 0",
    "within_request": "first_date >= start_date and last_date <= end_date",
    "available": "last_available <= cutoff",
    "unique": "n_ids = n",
    "sorted": "n_unsorted = 0",
    "row_count": "row_count = n",
    "coverage": "coverage_start = first_date and coverage_end = last_date",
}
TELEMETRY_EVENT = {
    "accession_of_candidates_only": "is_candidate = (accession is not null)",
    "category_of_failures_only": "is_failure = (failure_category is not null)",
    "poll_has_its_run": "stage <> 'sec_poll_attempted' or run_id is not null",
    "idle_detector_is_not_assessed": "invoked or status = 'not_assessed'",
    "only_positive_escalates": "not contributed or (invoked and status = 'positive')",
}


def snapshot_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: rows of an earlier snapshot that a later one lacks (removed) or holds with other values (changed)."""
    others = [c for c in before.columns if c != key]
    a = before.select(key, F.xxhash64(*others).alias("ha"), F.struct(*others).alias("xa"))
    b = after.select(key, F.struct(*others).alias("xb"), F.lit(True).alias("there"))
    j = a.join(b, key, "left")
    change = F.when(F.col("there").isNull(), "removed").when(~F.col("xa").eqNullSafe(F.col("xb")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def pair_append(incoming: DataFrame, receipts: DataFrame, routing: DataFrame, key: str) -> DataFrame:
    """key, outcome of appending receipt and routing row together: appended, replayed, conflict or broken_pair.

    incoming: key, receipt_sha, routing_sha; receipts and routing: key, sha.  Both halves are written or neither is; a
    pair that is there already is accepted only if both halves are the same.
    """
    j = incoming.join(receipts.select(key, F.col("sha").alias("a")), key, "left").join(routing.select(key, F.col("sha").alias("b")), key, "left")
    a, b = F.col("a"), F.col("b")
    same = (a == F.col("receipt_sha")) & (b == F.col("routing_sha"))
    return j.select(key, first_true([("appended", a.isNull() & b.isNull()), ("broken_pair", a.isNull() | b.isNull()), ("replayed", same)], "conflict").alias("outcome"))


def link_binding(filings: DataFrame, fetches: DataFrame) -> DataFrame:
    """accession, binding: whether a filing's primary document is listed by its index and its bytes are those once fetched.

    filings: accession, primary_name, index_html, body, viewer_url; fetches: accession, body_sha.
    """
    j = filings.join(fetches, "accession", "left")
    rules = [
        ("not_indexed", ~F.contains("index_html", F.concat(F.lit("/"), "primary_name"))),
        ("not_fetched", F.col("body_sha").isNull()),
        ("hash_mismatch", F.col("body_sha") != F.sha2("body", 256)),
        ("bound_with_viewer", F.col("viewer_url").isNotNull()),
    ]
    return j.select("accession", first_true(rules, "bound").alias("binding"))


def amendment_delta(prior: DataFrame, current: DataFrame, rules_changed: DataFrame, key: str, budget: int = 3_600) -> DataFrame:
    """key, disposition, reason, changed, removed, delta_characters: whether an amendment can be read by its changed sections.

    prior and current: key, section, sha, characters; rules_changed: keys whose manifests were made by other rules.
    """
    a = prior.select(key, "section", F.col("sha").alias("sa"), F.col("characters").alias("ca"))
    b = current.select(key, "section", F.col("sha").alias("sb"), F.col("characters").alias("cb"))
    new = F.col("sb").isNotNull() & ~(F.col("sa").eqNullSafe(F.col("sb")) & F.col("ca").eqNullSafe(F.col("cb")))
    by = a.join(b, [key, "section"], "full_outer").groupBy(key).agg(F.count("sa").alias("n_prior"), F.count("sb").alias("n_current"), F.count_if(F.col("sb").isNull()).alias("removed"), F.count_if(new).alias("changed"), F.coalesce(F.sum(F.when(new, F.col("cb"))), F.lit(0)).alias("characters"))
    by = by.join(rules_changed.select(key, F.lit(True).alias("other_rules")), key, "left")
    reason = first_true(
        [
            ("ruleset_changed", F.col("other_rules").isNotNull()),
            ("missing_section_manifest", (F.col("n_prior") == 0) | (F.col("n_current") == 0)),
            ("removed_relevant_section", F.col("removed") > 0),
            ("selected_evidence_unchanged", F.col("changed") == 0),
            ("delta_exceeds_budget", F.col("characters") > budget),
        ],
        "reliable_section_delta",
    )
    out = by.withColumn("reason", reason)
    ready = F.col("reason") == "reliable_section_delta"
    disposition = F.when(ready, "delta_ready").when(F.col("reason") == "selected_evidence_unchanged", "no_selected_delta").otherwise("full_reanalysis")
    return out.select(key, disposition.alias("disposition"), "reason", F.when(ready, F.col("changed")).otherwise(0).alias("changed"), F.when(F.col("reason") == "removed_relevant_section", F.col("removed")).otherwise(0).alias("removed"), F.when(ready, F.col("characters")).otherwise(0).alias("delta_characters"))


def arbitration(reports: DataFrame, concerns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, approved, challenges, refuted: what stays of a verifier's challenges once provable facts are looked at.

    reports: keys, challenges (array), identity_concern, unsupported, missing_risk, missing_catalyst, omissions,
    uncertainty (booleans), support; concerns: keys, token, claim, evidence, cited.  A number that stands in the claim and
    in the record that it cites refutes a numeric concern.
    """
    bare = lambda c: F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3})", "")
    token = bare(F.col("token"))
    stands = lambda c: F.concat(F.lit(" "), F.regexp_replace(bare(F.col(c)), r"[^0-9.%-]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), token, F.lit(" ")))
    by = concerns.withColumn("refuted", F.col("cited") & stands("claim") & stands("evidence")).groupBy(*keys).agg(F.count_if("refuted").alias("refuted"), F.count_if(~F.col("refuted")).alias("open"))
    j = reports.join(by, keys, "left").na.fill(0, ["refuted", "open"])
    added = {
        "identity_concern": F.col("identity_concern"),
        "numeric_concern": F.col("open") > 0,
        "unsupported_interpretation": F.col("unsupported") | (F.col("support") == "insufficient"),
        "missing_material_risk": F.col("missing_risk"),
        "missing_material_catalyst": F.col("missing_catalyst"),
        "missing_counterevidence": F.col("omissions"),
        "uncertainty_overstated": F.col("uncertainty"),
        "classification_too_bullish": F.col("support") == "too_bullish",
        "classification_too_bearish": F.col("support") == "too_bearish",
    }
    # these two stand only if they are shown again
    own = F.filter("challenges", lambda c: ~c.isin("identity_concern", "numeric_concern"))
    every = F.array_sort(F.array_distinct(F.concat(own, F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in added.items()])))))
    return j.select(*keys, (F.size(every) == 0).alias("approved"), F.array_join(every, ",").alias("challenges"), "refuted")


def lifecycle(snapshots: DataFrame, prior_snapshots: int = 64) -> DataFrame:
    """accession, disposition, reason, prior: a snapshot against the latest compatible one of its issuer's last ones.

    snapshots: accession, issuer, family, available_at, manifest.  Snapshots of one family are compatible.
    """
    w = Window.partitionBy("issuer").orderBy("available_at", "accession").rowsBetween(-prior_snapshots, -1)
    before = F.collect_list(F.struct("available_at", "accession", "family", "manifest")).over(w)
    s = snapshots.withColumn("before", before)
    earlier = F.filter("before", lambda x: x["available_at"] < F.col("available_at"))
    s = s.select("accession", "manifest", F.size(earlier).alias("n"), F.array_max(F.filter(earlier, lambda x: x["family"] == F.col("family"))).alias("p"))
    same = F.col("p.manifest") == F.col("manifest")
    rules = [("no_prior_snapshot", F.col("n") == 0), ("no_compatible_prior", F.col("p").isNull()), ("selected_sections_unchanged", same)]
    s = s.withColumn("reason", first_true(rules, "changed_sections_selected"))
    disposition = F.when(F.col("p").isNull(), "snapshot_only").when(same, "no_selected_change").otherwise("selection_recorded")
    return s.select("accession", disposition.alias("disposition"), "reason", F.col("p.accession").alias("prior"))


def interrupted(attempts: DataFrame, now: F.Column, lease_days: int, max_attempts: int = 6) -> DataFrame:
    """parent, attempt, closure, parent_status: open attempts whose lease is over are closed, and their parent queued or failed.

    attempts: parent, attempt, started_at, finished, parent_active.
    """
    late = ~F.col("finished") & (F.date_add(F.to_date("started_at"), lease_days) < now)
    again = F.col("parent_active") & (F.col("attempt") < max_attempts)
    closed = attempts.where(late).select("parent", "attempt", F.when(again, "interrupted_retryable").otherwise("interrupted_terminal").alias("closure"), F.when(~F.col("parent_active"), "unchanged").when(again, "queued").otherwise("failed").alias("parent_status"))
    return closed
