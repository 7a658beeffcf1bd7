"""Governed rules and the state of work: traceability, frozen snapshots, lifecycles, stages and what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import MONEY, zero_sum

# What a calculation's or a deduction's state says of the whole transaction, the former first.
BY_CALCULATION = {
    "RULE_NOT_FOUND": "RULE_NOT_FOUND",
    "INSUFFICIENT_DATA": "INSUFFICIENT_DATA",
    "REVIEW_REQUIRED": "REVIEW_REQUIRED",
    "LAW_NOT_DETERMINABLE": "REVIEW_REQUIRED",
}
BY_DEDUCTION = {
    "ACTUAL_TDS_NOT_PROVIDED": "ACTUAL_TDS_NOT_PROVIDED",
    "SHORT_DEDUCTION": "SHORT_DEDUCTION",
    "EXCESS_DEDUCTION": "EXCESS_DEDUCTION",
    "COMPLIANT": "MATCHED",
}
# What a frozen due-date snapshot must hold, and the marks of a provisional one.
SNAPSHOT = {"policy_kind": "CONTRACTOR_DEPOSIT_DUE_DATE", "active": True, "lifecycle": "ACTIVE", "source_traceability_status": "VERIFIED"}
PROVISIONAL = {
    "policy_status": "PROVISIONAL_UAT",
    "ca_approved": False,
    "environment": "isolated_e2e_only",
    "assumption_status": "PROVISIONAL",
    "source_gap": True,
    "ca_review_required": True,
    "approved_at": None,
    "approved_by": None,
}
# Fields that a traced rule needs.
TRACED = (
    "source_authority",
    "document_title",
    "legal_provision_reference",
    "effective_from",
    "effective_to",
    "retrieved_at",
    "verification_evidence",
    "verified_at",
)
# Forms by the words that name them, the first that occurs.
FORMS = {r"\bFORM\s*140\b": "FORM_140", r"\bFORM\s*144\b": "FORM_144", r"\b26Q\b": "26Q", r"\b27Q\b": "27Q"}
# The order of the identity queue, and results that a party is asked about.
QUEUE = {"REVIEW_REQUIRED": 0, "UNMAPPED": 1, "HIGH_CONFIDENCE": 2, "EXACT": 3}
FOLLOWED = ("MISSING_IN_26AS", "AMOUNT_MISMATCH", "MATCHED_NOT_CLAIMABLE", "IDENTITY_UNMAPPED")


def _lookup(values: dict[str, object], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def _filled(c: Column) -> Column:
    """The column as text, null where it is empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def _present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def _holds(row: Column, values: dict[str, object]) -> Column:
    out = F.lit(True)
    for name, value in values.items():
        out = out & row[name].eqNullSafe(F.lit(value))
    return out


def transaction_status(calculation: Column, deduction: Column, compliance: Column) -> Column:
    """The calculation's state where it says that there is none to trust, else the deduction's, else what compliance says."""
    return F.coalesce(_lookup(BY_CALCULATION, calculation), _lookup(BY_DEDUCTION, deduction), _filled(compliance), F.lit("NOT_DETERMINABLE"))


def due_date_error(status: Column, reason: Column, due: Column, snapshot: Column, branch_inputs: Column) -> Column:
    """Why a frozen due-date decision can't be used, null if it can.  The live policies are never read.

    snapshot: a struct with the fields of SNAPSHOT and PROVISIONAL, rule_id and rule_version; null where nothing was frozen.
    """
    approved = _present(snapshot["approved_at"]) & _present(snapshot["approved_by"])
    governed = approved | _holds(snapshot, PROVISIONAL)
    sound = snapshot.isNotNull() & _holds(snapshot, SNAPSHOT) & _present(snapshot["rule_id"]) & _present(snapshot["rule_version"]) & governed & branch_inputs.isNotNull() & due.isNotNull()
    undecided = ~status.eqNullSafe(F.lit("DETERMINED"))
    return F.when(undecided, F.coalesce(_filled(reason), F.lit("DUE_DATE_POLICY_NOT_CONFIGURED"))).when(~sound, "DUE_DATE_POLICY_SNAPSHOT_INVALID")


def traceability(rules: DataFrame) -> DataFrame:
    """The rules with missing_fields, validation_errors, traceability (VERIFIED or VERIFICATION_REQUIRED) and approval.

    rules: text columns source_authority, source, source_provision_reference, provision_reference, section_reference,
    source_url, source_document_filename, source_document_sha256, source_document_title, effective_from, effective_to,
    source_retrieved_at, source_verification_evidence, source_verified_at, lifecycle, approved_at, approved_by,
    approval_reference, approval_authority.  Only what is given can be malformed; what is absent is missing.
    """
    c = F.col
    fields = {
        "source_authority": F.coalesce(_filled(c("source_authority")), _filled(c("source"))),
        "document_title": c("source_document_title"),
        "legal_provision_reference": F.coalesce(*(_filled(c(x)) for x in ("source_provision_reference", "provision_reference", "section_reference"))),
        "effective_from": c("effective_from"),
        "effective_to": c("effective_to"),
        "retrieved_at": c("source_retrieved_at"),
        "verification_evidence": c("source_verification_evidence"),
        "verified_at": c("source_verified_at"),
    }
    locator = _present(c("source_url")) | (_present(c("source_document_filename")) & _present(c("source_document_sha256")))
    missing = [F.when(~_present(fields[x]), x) for x in TRACED] + [F.when(~locator, "source_locator")]
    url, digest = F.trim("source_url"), F.trim("source_document_sha256")
    errors = [
        F.when(_present(url) & ~url.rlike(r"^(?i:https)://[^/?#]"), "source_url must be an absolute https URL"),
        F.when(_present(digest) & ~digest.rlike(r"\A[A-Fa-f0-9]{64}\z"), "source_document_sha256 must be a SHA-256 hex digest"),
    ]
    for name in ("source_retrieved_at", "source_verified_at"):
        day = F.trim(name)
        is_day = day.rlike(r"\A\d{4}-\d\d-\d\d\z") & day.try_cast("date").isNotNull()
        errors.append(F.when(_present(day) & ~is_day, f"{name} must use YYYY-MM-DD"))
    approval = c("lifecycle").isin("APPROVED", "ACTIVE")
    for name in ("approved_at", "approved_by", "approval_reference", "approval_authority"):
        approval = approval & (F.coalesce(c(name), F.lit("")) != "")
    out = rules.withColumns({"missing_fields": F.array_compact(F.array(*missing)), "validation_errors": F.array_compact(F.array(*errors))})
    clean = (F.size("missing_fields") == 0) & (F.size("validation_errors") == 0)
    return out.withColumns({
        "traceability": F.when(clean, "VERIFIED").otherwise("VERIFICATION_REQUIRED"),
        "approval": F.when(approval, "CA_APPROVAL_RECORDED").otherwise("CA_APPROVAL_NOT_RECORDED"),
    })


def lifecycles(events: DataFrame) -> DataFrame:
    """(family, rule, state, refused) of every rule after its events (family, rule, at, action); ``at`` orders all events.

    A draft is SUBMITTED, then APPROVED, then ACTIVATED; an approved or active rule can be DEACTIVATED.  Any other action is
    refused and changes nothing.  A rule that becomes active supersedes the family's rule that was active until then.
    """
    # From which state an action leads where.
    steps = {
        "DRAFT SUBMITTED": "PENDING_APPROVAL",
        "PENDING_APPROVAL APPROVED": "APPROVED",
        "APPROVED ACTIVATED": "ACTIVE",
        "APPROVED DEACTIVATED": "DEACTIVATED",
        "ACTIVE DEACTIVATED": "DEACTIVATED",
    }
    table = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair))

    def step(so_far: Column, event: Column) -> Column:
        new = F.element_at(table, F.concat_ws(" ", so_far["state"], event["action"]))
        accepted = lambda state: F.when(new == state, event["at"])
        return F.struct(
            F.coalesce(new, so_far["state"]).alias("state"), (so_far["refused"] + new.isNull().cast("int")).alias("refused"),
            F.coalesce(so_far["active_at"], accepted("ACTIVE")).alias("active_at"), F.coalesce(so_far["ended_at"], accepted("DEACTIVATED")).alias("ended_at"),
        )

    none = F.lit(None).cast("long")
    start = F.struct(F.lit("DRAFT").alias("state"), F.lit(0).alias("refused"), none.alias("active_at"), none.alias("ended_at"))
    acted = F.filter(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "action")), lambda e: e["action"].isNotNull())
    own = events.groupBy("family", "rule").agg(F.aggregate(F.array_sort(acted), start, step).alias("own")).select("family", "rule", "own.*")
    # the family's next activation; rules that were never active come last and take no part
    after = F.lead("active_at").over(Window.partitionBy("family").orderBy(F.asc_nulls_last("active_at"), "rule"))
    replaced = F.col("active_at").isNotNull() & F.col("after").isNotNull() & F.coalesce(F.col("after") < F.col("ended_at"), F.lit(True))
    late = F.when(replaced & F.col("ended_at").isNotNull(), 1).otherwise(0)  # a superseded rule can't be deactivated any more
    out = own.withColumn("after", after)
    return out.select("family", "rule", F.when(replaced, "SUPERSEDED").otherwise(F.col("state")).alias("state"), (F.col("refused") + late).alias("refused"))


def stage(available: Column, complete: Column, blocked: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(blocked), "BLOCKED").when(yes(complete), "COMPLETED").when(yes(available), "IN_PROGRESS").otherwise("NOT_STARTED")


def workspace_stages(assignments: DataFrame, versions: DataFrame) -> DataFrame:
    """(assignment, stage, status) of all stages of every assignment.

    assignments: (assignment, status); versions: (assignment, kind, version, rows, open), of which the latest of each kind
    counts; kinds: ledger, calculation, deposit, interest, government_evidence, government_verification; open: rows that
    are unclassified or under review.
    """
    kinds = ("ledger", "calculation", "deposit", "interest", "government_evidence", "government_verification")
    latest = versions.groupBy("assignment").agg(*(F.max_by(F.when(F.col("kind") == k, F.struct("rows", "open")), F.when(F.col("kind") == k, F.col("version"))).alias(k) for k in kinds))
    rows = assignments.join(latest, "assignment", "left")
    has = lambda k: F.col(k).isNotNull()
    no, locked = F.lit(False), F.coalesce(F.col("status") == "LOCKED", F.lit(False))
    opened = lambda k: F.coalesce(F.col(f"{k}.open"), F.lit(0)) > 0
    reviewed = lambda k: stage(has(k), has(k) & ~opened(k), has(k) & opened(k))
    stages = {
        "assignment": F.lit("COMPLETED"),
        "data_collection": stage(has("ledger"), has("ledger"), no),
        "classification": stage(has("ledger"), (F.col("ledger.rows") > 0) & ~opened("ledger"), has("ledger") & opened("ledger")),
        "tds_review": reviewed("calculation"),
        "deposit": reviewed("deposit"),
        "interest": reviewed("interest"),
        "government_evidence": stage(no, has("government_evidence"), no),
        "government_evidence_verification": stage(no, has("government_verification"), no),
        "return_compliance": F.lit("NOT_STARTED"),
        "ca_review": stage(has("calculation"), locked, no),
        "approval": stage(no, locked, no),
        "lock": stage(no, locked, no),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), v.alias("status")) for k, v in stages.items())))
    return rows.select("assignment", each.alias("s")).select("assignment", "s.*")


def relationship_issues(identity: Column, amount: Column, tds: Column) -> Column:
    """What is open in a relationship: the states of identity, amount and tax that are not as they should be."""
    open_ = lambda c, good, absent: F.when(~F.coalesce(c.isin(*good), F.lit(False)), F.coalesce(_filled(c), F.lit(absent)))
    return F.array_compact(F.array(
        open_(identity, ["CONFIRMED"], "UNMAPPED"), open_(amount, ["AMOUNT_MATCHED"], "AMOUNT_NOT_DETERMINABLE"), open_(tds, ["MATCHED", "TDS_MATCHED"], "TDS_NOT_DETERMINABLE")
    ))


def return_form(text: Column, filename: Column) -> Column:
    """The form that a return names in its file name or its first 8000 characters."""
    source = F.upper(F.concat(F.coalesce(filename, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 8000)))
    return F.coalesce(*(F.when(source.rlike(pattern), form) for pattern, form in FORMS.items()))


def is_tds_payment(*texts: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    return joined.contains("tds payment") | joined.rlike(r"\btds\s+paid\b")


def missing_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing): how many rows lack each field; one pass, a row for each field."""
    one = rows.agg(*(F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f) for f in fields))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields))).alias("x")).select("x.*")


def identity_queue(items: DataFrame) -> DataFrame:
    """The items in the order in which they are to be reviewed, with queue_rank."""
    ranked = items.withColumn("queue_rank", _lookup(QUEUE, F.col("status")))
    return ranked.orderBy("queue_rank", F.desc(F.coalesce("total_tax_deducted", F.lit(0))))


def party_followup(results: DataFrame) -> DataFrame:
    """The results that a party is to be asked about, as the report shows them."""
    tans = F.when(F.size("matched_tans") > 0, F.array_join("matched_tans", ", ")).otherwise(F.col("tan"))
    return results.filter(F.col("result").isin(*FOLLOWED)).select(
        F.coalesce(_filled(F.col("customer")), F.col("deductor")).alias("customer"), tans.alias("tans"), "transaction_id",
        F.coalesce(_filled(F.col("books_quarter")), F.col("statement_quarter")).alias("quarter"), "expected", "deducted", "difference", F.col("result").alias("issue"),
    )


def exception_report(results: DataFrame, states: DataFrame) -> DataFrame:
    """All results but the matched and claimable ones, with their amount and the state of their review."""
    own = states.select("id", F.col("status").alias("_status"), F.col("notes").alias("_notes"))
    return results.filter(~F.col("result").eqNullSafe(F.lit("MATCHED_CLAIMABLE"))).join(own, "id", "left").select(
        "id", "severity", F.coalesce(_filled(F.col("books_quarter")), F.col("statement_quarter")).alias("quarter"), F.coalesce("expected", "deducted").alias("amount"), "result",
        F.coalesce("_status", F.lit("OPEN")).alias("status"), F.coalesce(F.array_join("_notes", " | "), F.lit("")).alias("notes"),
    )


def statement_only_summary(rows: DataFrame) -> DataFrame:
    """One row: deductors, totals with null as zero, and how many rows have each status."""
    total = lambda c: zero_sum(F.col(c)).cast(MONEY)
    count = lambda v: F.count_if(F.col("status") == v)
    return rows.agg(
        F.count("*").alias("results"), F.countDistinct(_filled(F.col("tan"))).alias("deductors"), total("expected").alias("expected_total"), total("deducted").alias("deducted_total"),
        (total("expected") - total("deducted")).cast(MONEY).alias("difference"), count("CONSISTENT_WITH_CONFIGURED_RULE").alias("consistent"),
        count("TDS_DIFFERENCE").alias("differing"), count("NOT_DETERMINABLE").alias("not_determinable"),
    )


def unmapped_reasons(results: DataFrame) -> DataFrame:
    """(reason, rows) of the unmapped relationships, by whether sales were found for them."""
    lacks = F.when(F.size("sales_ids") > 0, "MISSING_TDS_LEDGER_COUNTERPART").otherwise("MISSING_SALES_AND_TDS_COUNTERPART")
    return results.filter(F.col("identity") == "UNMAPPED").groupBy(lacks.alias("reason")).agg(F.count("*").alias("rows"))
