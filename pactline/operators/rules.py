"""Rule libraries over effective claims: risk rubric, adversarial patterns, asymmetry, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import dims
from ..shipping import spread


def effective(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("superseded_by").isNull())


def of_types(claims: DataFrame, *types: str) -> DataFrame:
    return effective(claims).where(F.col("clause_type").isin(*types))


def against_us() -> Column:
    return F.col("party_favored") == "counterparty"


def _type(*names: str) -> Column:
    return F.col("clause_type").isin(*names)


def contributions(claims: DataFrame, contracts: DataFrame) -> DataFrame:
    """contract_id, axis, points, rule, claim_id: every rule that fires."""
    live = effective(claims).join(contracts.select("contract_id", "our_role", "annual_value"), "contract_id")
    av, yes = F.nullif("annual_value", F.lit(0.0)), lambda c: F.coalesce(F.col(c), F.lit(False))
    days = F.nullif(F.col("days").cast("int"), F.lit(0))
    fires = [
        ("liability", "cap_below_half_annual_value", _type("liability_cap") & (F.col("amount") < av * 0.5)),
        ("liability", "cap_below_annual_value", _type("liability_cap") & (F.col("amount") >= av * 0.5) & (F.col("amount") < av)),
        ("liability", "uncapped_exposure_on_us", _type("uncapped_liability_carveout") & against_us()),
        ("liability", "indemnity_against_us", _type("indemnification") & against_us()),
        ("liability", "indemnity_survives_forever", _type("indemnification") & against_us() & yes("survives_termination")),
        ("lockin", "auto_renewal_present", _type("auto_renewal")),
        ("lockin", "notice_window_over_90_days", _type("notice_period", "auto_renewal") & (days > 90)),
        ("lockin", "notice_window_over_60_days", _type("notice_period", "auto_renewal") & (days > 60) & (days <= 90)),
        ("lockin", "unilateral_termination_by_them", _type("termination_for_convenience") & yes("unilateral") & against_us()),
        ("lockin", "early_termination_fee", _type("early_termination_fee")),
        ("financial", "uncapped_price_increase", _type("price_increase") & (F.col("percent").isNull() | yes("unilateral"))),
        ("financial", "price_increase_over_5pct", _type("price_increase") & ~yes("unilateral") & (F.col("percent") > 5)),
        ("financial", "payment_terms_under_30_days", _type("payment_terms") & (F.col("our_role") == "buyer") & (days < 30)),
        ("compliance", "breach_notification_over_72h", _type("breach_notification") & (days * 24 > 72)),
        ("compliance", "no_subprocessor_consent", _type("subprocessors") & (yes("unilateral") | against_us())),
        ("compliance", "data_deletion_over_60_days", _type("data_retention_deletion") & (days > 60)),
        ("operational", "sla_below_99_9", _type("sla") & (F.col("uptime_percent") < 99.9)),
        ("operational", "sla_credit_requires_claim", _type("sla_credit") & days.isNotNull()),
        ("operational", "unilateral_amendment", _type("unilateral_amendment")),
        ("operational", "unilateral_audit", _type("audit_rights") & (yes("unilateral") | against_us())),
        ("operational", "assignment_blocked_on_change_of_control", _type("assignment", "change_of_control") & against_us()),
        ("operational", "non_compete_present", _type("non_compete", "exclusivity") & against_us()),
        ("operational", "feedback_licence_perpetual", _type("license_grant") & against_us() & F.contains(F.lower("quote"), F.lit("perpetual"))),
    ]
    hit = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(axis).alias("axis"), F.lit(dims.RUBRIC[rule]).alias("points"), F.lit(rule).alias("rule"))) for axis, rule, cond in fires)))
    per_claim = live.select("contract_id", F.explode(hit).alias("x"), "claim_id", "seq").select("contract_id", "x.*", "claim_id", "seq")
    # a buyer without a way out: no termination for convenience that favours us or both
    tfc = of_types(claims, "termination_for_convenience")
    free = tfc.where(F.col("party_favored").isin("us", "mutual")).select("contract_id").distinct()
    first = tfc.groupBy("contract_id").agg(F.min_by("claim_id", "seq").alias("claim_id"), F.min("seq").alias("seq"))
    stuck = contracts.where(F.col("our_role") == "buyer").join(free, "contract_id", "left_anti").join(first, "contract_id", "left")
    rule = "no_termination_for_convenience"
    return per_claim.unionByName(stuck.select("contract_id", F.lit("lockin").alias("axis"), F.lit(dims.RUBRIC[rule]).alias("points"), F.lit(rule).alias("rule"), "claim_id", "seq"))


def axes(found: DataFrame, contracts: DataFrame) -> DataFrame:
    """Score of every axis of every contract: points summed, at most 100."""
    every = contracts.select("contract_id", F.explode(F.array(*map(F.lit, dims.AXES))).alias("axis"))
    sums = found.groupBy("contract_id", "axis").agg(F.least(F.sum("points"), F.lit(100)).cast("int").alias("score"))
    return every.join(sums, ["contract_id", "axis"], "left").select("contract_id", "axis", F.coalesce("score", F.lit(0)).alias("score"))


def overall(axis_scores: DataFrame) -> DataFrame:
    """The worst axis and its band."""
    return axis_scores.groupBy("contract_id").agg(F.coalesce(F.max("score"), F.lit(0)).alias("overall")).withColumn("band", X.band(F.col("overall")))


SPAN = ("doc_id", "char_start", "char_end", "quote")


def patterns(claims: DataFrame) -> DataFrame:
    """contract_id, key, severity, evidence (spans), seq.  Keys may repeat in a contract."""
    live = effective(claims)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    days = F.nullif(F.col("days").cast("int"), F.lit(0))
    one = [
        ("blank_cheque", "critical", _type("unilateral_amendment"), F.lit("blank_cheque")),
        ("long_notice", "high", _type("auto_renewal", "notice_period") & (days >= 90), F.concat(F.lit("long_notice_"), days.cast("string"))),
        ("immortal_indemnity", "high", _type("indemnification", "uncapped_liability_carveout") & yes("survives_termination") & against_us(), F.lit("immortal_indemnity")),
        ("uncapped_pricing", "high", _type("price_increase") & (yes("unilateral") | F.col("percent").isNull()), F.lit("uncapped_pricing")),
        ("acceleration", "high", _type("early_termination_fee") & (F.contains(F.lower("quote"), F.lit("immediately due")) | (F.col("percent") >= 50)), F.lit("acceleration")),
        ("one_way_exit", "high", _type("termination_for_convenience") & yes("unilateral") & against_us(), F.lit("one_way_exit")),
    ]
    span = F.struct(*SPAN)
    hits = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(key.alias("key"), F.lit(sev).alias("severity"))) for _, sev, cond, key in one)))
    single = live.select("contract_id", F.explode(hits).alias("x"), F.array(span).alias("evidence"), "seq").select("contract_id", "x.key", "x.severity", "evidence", "seq")
    vague = live.where(F.col("quote").rlike(r"(?i)\bsole\s+discretion\b")).groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", span.alias("s")))), 1, 5), lambda x: x["s"]).alias("evidence"), F.min("seq").alias("seq"))
    vague = vague.where("n >= 2").select("contract_id", F.lit("discretion_creep").alias("key"), F.lit("medium").alias("severity"), "evidence", "seq")
    venue = live.where(_type("venue")).groupBy("contract_id").agg(F.min_by(span, "seq").alias("venue"))
    small = live.where(_type("liability_cap") & (F.col("amount") <= 50000)).join(venue, "contract_id").select("contract_id", F.lit("uneconomic_remedy").alias("key"), F.lit("medium").alias("severity"), F.array(span, F.col("venue")).alias("evidence"), "seq")
    return single.unionByName(vague).unionByName(small)


def asymmetry(claims: DataFrame) -> DataFrame:
    """Rights of each side, index = theirs / all, severity of the finding (null below 0.7), and what to ask for."""
    label = F.create_map(*(F.lit(x) for kv in dims.RIGHTS.items() for x in kv))[F.col("clause_type")]
    both = (F.col("party_favored") == "mutual") & ~F.coalesce(F.col("unilateral"), F.lit(False))
    theirs, ours = (F.col("party_favored") == "counterparty") | both, (F.col("party_favored") == "us") | both
    g = of_types(claims, *dims.RIGHTS).groupBy("contract_id").agg(F.count_if(ours).alias("our_rights"), F.count_if(theirs).alias("their_rights"), F.collect_set(F.when(theirs, label)).alias("t"), F.collect_set(F.when(ours, label)).alias("o"))
    index = F.coalesce(F.try_divide(F.col("their_rights"), F.col("our_rights") + F.col("their_rights")), F.lit(0.0))
    severity = F.when((index >= 0.85) & (F.col("their_rights") > 0), "high").when((index >= 0.7) & (F.col("their_rights") > 0), "medium")
    return g.select("contract_id", "our_rights", "their_rights", index.alias("index"), severity.alias("severity"), F.array_sort(F.array_except("t", "o")).alias("asks"))


def playbook(spark) -> DataFrame:
    return spark.createDataFrame([(t, c, s) for t, p in dims.PLAYBOOKS.items() for c, s in p.items()], "contract_type string, clause_type string, severity string")


def silence(claims: DataFrame, contracts: DataFrame) -> DataFrame:
    """Expected clauses that a contract lacks; a seller is not held to what only buyers need.  No evidence: absence is
    the finding."""
    expected = contracts.join(F.broadcast(playbook(contracts.sparkSession)), "contract_type").where(~((F.col("our_role") == "seller") & F.col("clause_type").isin(*dims.BUYER_ONLY)))
    present = effective(claims).select("contract_id", "clause_type").distinct()
    return expected.join(present, ["contract_id", "clause_type"], "left_anti").select("contract_id", "clause_type", "severity", X.severity_rank(F.col("severity")).alias("severity_rank"))


def coverage(claims: DataFrame, contracts: DataFrame) -> DataFrame:
    """Share of the playbook's clauses that are there; 1 where nothing is expected."""
    wanted = playbook(contracts.sparkSession).groupBy("contract_type").agg(F.collect_set("clause_type").alias("wanted"))  # a row a type
    # dealt out first, as a scan's task would hold all contracts of its lines else, and joined by the contract alone
    there = spread(effective(claims).select("contract_id", "clause_type"), "contract_id").groupBy("contract_id").agg(F.collect_set("clause_type").alias("there"))  # a contract's types
    held = contracts.select("contract_id", "contract_type").join(F.broadcast(wanted), "contract_type", "left").join(there.hint("merge"), "contract_id", "left")
    here = F.when(F.col("there").isNull(), F.lit(0)).otherwise(F.size(F.array_intersect("wanted", "there")))
    return held.groupBy("contract_id").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("wanted").isNotNull(), here)), F.sum(F.when(F.col("wanted").isNotNull(), F.size("wanted")))), F.lit(1.0)).alias("coverage"))
