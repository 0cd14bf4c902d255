"""Fixed values of the domain: vocabularies, rubric, playbooks, dimensions, aliases, patterns."""

# Axes and the points of each risk rule.
AXES = ("financial", "lockin", "liability", "compliance", "operational")
RUBRIC = {
    "cap_below_half_annual_value": 40, "cap_below_annual_value": 25, "uncapped_exposure_on_us": 35, "indemnity_against_us": 20,
    "indemnity_survives_forever": 10, "notice_window_over_90_days": 25, "notice_window_over_60_days": 15, "auto_renewal_present": 10,
    "no_termination_for_convenience": 20, "unilateral_termination_by_them": 20, "early_termination_fee": 15, "uncapped_price_increase": 25,
    "price_increase_over_5pct": 12, "payment_terms_under_30_days": 8, "unilateral_amendment": 30, "unilateral_audit": 10,
    "assignment_blocked_on_change_of_control": 15, "breach_notification_over_72h": 15, "no_subprocessor_consent": 12,
    "data_deletion_over_60_days": 10, "sla_below_99_9": 15, "sla_credit_requires_claim": 8, "non_compete_present": 15, "feedback_licence_perpetual": 5,
}
BANDS = ((70, "critical"), (45, "high"), (20, "medium"), (0, "low"))
SEVERITIES = ("critical", "high", "medium", "low", "info")

# Clause types that may stand side by side, that measure something, that are no contract value.
MULTI_INSTANCE = ("uncapped_liability_carveout", "indemnification", "confidentiality", "license_grant")
MEASURED = ("amount", "days", "months", "percent", "uptime_percent")
NOT_VALUE = ("liability_cap", "uncapped_liability_carveout", "insurance", "early_termination_fee", "indemnification")
ANNUAL = r"(?i)\b(annual|per\s+year|yearly|per\s+annum|subscription\s+fee)\b"

# Expected clauses by contract type, with the severity of their absence.
_COMMERCIAL = {"liability_cap": "critical", "term": "high", "termination_for_cause": "high", "governing_law": "medium", "indemnification": "medium", "confidentiality": "high"}
_SERVICE = {"sla": "high", "sla_credit": "medium", "support_response": "low"}
_DATA = {"data_protection": "high", "breach_notification": "critical", "data_retention_deletion": "high", "subprocessors": "medium"}
_NDA = {"confidentiality": "critical", "term": "high", "data_retention_deletion": "medium", "governing_law": "medium", "liability_cap": "high"}
PLAYBOOKS = {
    "msa": {**_COMMERCIAL, **_SERVICE, **_DATA}, "sow": {**_COMMERCIAL, **_SERVICE}, "dpa": {**_DATA, "audit_rights": "medium"},
    "order_form": {"term": "high"}, "nda": _NDA, "amendment": {}, "unknown": _COMMERCIAL,
}
BUYER_ONLY = ("sla", "sla_credit", "support_response", "breach_notification", "data_retention_deletion", "subprocessors", "data_protection")

# Clause types that give one party a right.
RIGHTS = {
    "termination_for_convenience": "terminate for convenience", "unilateral_amendment": "amend the agreement unilaterally",
    "audit_rights": "audit the other party", "assignment": "assign the agreement", "change_of_control": "act on a change of control",
    "price_increase": "raise prices", "subprocessors": "appoint subprocessors", "early_termination_fee": "charge an early termination fee",
    "exclusivity": "demand exclusivity", "non_compete": "restrain the other party's activity",
}

# Gap dimensions (key, clause type, field, outbound worse if, unit, severity).
GAPS = [
    ("uptime", "sla", "uptime_percent", "gt", "%", "critical"),
    ("breach_notice", "breach_notification", "days", "lt", "hours", "critical"),
    ("deletion", "data_retention_deletion", "days", "lt", "days", "high"),
    ("liability", "liability_cap", "amount", "gt", "currency", "critical"),
    ("subprocessor_notice", "subprocessors", "days", "gt", "days", "medium"),
]
# Compare dimensions (key, clause types, field, unit, higher is better for a buyer, rule kind, rule anchor).
COMPARE = [
    ("liability_cap", ("liability_cap",), "amount", "currency", True, None, None),
    ("notice_days", ("notice_period", "auto_renewal"), "days", "days", False, "notice", "term_end"),
    ("uptime", ("sla",), "uptime_percent", "percent", True, None, None),
    ("payment_days", ("payment_terms",), "days", "days", True, None, None),
    ("breach_notice", ("breach_notification",), "days", "days", False, None, None),
    ("deletion_days", ("data_retention_deletion",), "days", "days", False, None, None),
    ("price_increase", ("price_increase",), "percent", "percent", False, None, None),
    ("term_months", ("term",), "months", "months", False, None, None),
    ("early_exit_fee", ("early_termination_fee",), "percent", "percent", False, None, None),
    ("support_response", ("support_response",), "days", "days", False, None, None),
]
COMPARE_ALIASES = {
    "liability": "liability_cap", "cap": "liability_cap", "notice": "notice_days", "renewal": "notice_days", "sla": "uptime",
    "availability": "uptime", "payment": "payment_days", "terms": "payment_days", "breach": "breach_notice", "incident": "breach_notice",
    "deletion": "deletion_days", "retention": "deletion_days", "price": "price_increase", "uplift": "price_increase", "term": "term_months",
    "duration": "term_months", "exit": "early_exit_fee", "termination_fee": "early_exit_fee", "support": "support_response",
}

# Words for parties, rule kinds and anchors.
BUYER_WORDS = ("customer", "client", "buyer", "licensee", "subscriber", "recipient")
SELLER_WORDS = ("provider", "vendor", "supplier", "licensor", "seller", "contractor", "processor", "company")
MUTUAL_WORDS = ("mutual", "both", "both parties", "either", "either party", "each", "each party", "reciprocal")
US_WORDS = ("us", "we", "our", "ours", "self")
THEM_WORDS = ("counterparty", "them", "their", "other", "other party", "the other party", "third party")
NO_WORDS = ("", "na", "n/a", "none", "unknown")
KINDS = ("renewal", "notice", "expiry", "payment", "report", "cure")
KIND_ALIASES = {
    "termination": "notice", "non-renewal": "notice", "nonrenewal": "notice", "non_renewal": "notice", "notice_period": "notice",
    "termination_notice": "notice", "auto_renewal": "renewal", "auto-renewal": "renewal", "renew": "renewal", "expiration": "expiry",
    "term": "expiry", "termination_date": "expiry", "invoice": "payment", "payment_terms": "payment", "fee": "payment",
    "reporting": "report", "deliverable": "report", "usage_report": "report", "insurance_certificate": "report", "insurance": "report",
    "certificate": "report", "audit": "report", "compliance": "report", "remedy": "cure", "cure_period": "cure", "breach": "cure",
}
ANCHORS = ("effective_date", "term_end", "signature_date", "anniversary", "month_end", "quarter_end", "invoice_date", "breach_date", "event")
ANCHOR_ALIASES = {
    "term_start": "effective_date", "start_date": "effective_date", "commencement": "effective_date", "commencement_date": "effective_date",
    "end_of_term": "term_end", "term_expiry": "term_end", "expiry": "term_end", "renewal_date": "term_end", "current_term_end": "term_end",
    "then-current_term_end": "term_end", "renewal": "term_end", "effective_date_anniversary": "anniversary", "anniversary_date": "anniversary",
    "annual": "anniversary", "yearly": "anniversary", "end_of_month": "month_end", "calendar_month_end": "month_end", "month": "month_end",
    "monthly": "month_end", "end_of_quarter": "quarter_end", "calendar_quarter_end": "quarter_end", "quarter": "quarter_end",
    "quarterly": "quarter_end", "invoice": "invoice_date", "invoice_receipt": "invoice_date", "invoice_issue": "invoice_date",
    "breach": "breach_date", "breach_notice": "breach_date", "notice_date": "breach_date", "notice_of_breach": "breach_date",
    "execution_date": "signature_date", "signing": "signature_date",
}
IMPLIED_RECURRENCE = {"anniversary": 12, "quarter_end": 3, "month_end": 1}

# Language that addresses an automated reader, and what it does.
INJECTION = [
    (r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+instructions", "discards instructions"),
    (r"disregard\s+(?:all\s+|any\s+)?(?:previous|prior|above|the\s+foregoing)\s+(?:instructions|analysis|rules)", "disregards instructions"),
    (r"\b(?:system|assistant|user)\s*(?:note|prompt|message|instruction)\b", "poses as a system role"),
    (r"(?:you\s+are|act\s+as)\s+(?:an?\s+)?(?:ai|assistant|language\s+model)", "gives the reader a persona"),
    (r"report\s+(?:the\s+)?(?:overall\s+)?risk(?:\s+score)?\s+as\b", "dictates a risk score"),
    (r"(?:do\s+not|don't|never)\s+(?:extract|mention|summari[sz]e|flag|report|analyz)", "suppresses analysis"),
    (r"(?:output|respond\s+with|return|print)\s+only\b", "dictates the output"),
    (r"(?:pre-?approved|approved)\s+by\s+(?:[\w']+\s+){0,3}counsel.{0,60}(?:no\s+further|requires?\s+no)", "asserts approval"),
    (r"\bautomated\s+(?:review\s+)?(?:tools?|systems?|agents?)\b", "addresses automated review"),
    (r"(?:mark|classify|score|treat)\s+(?:this|the)\s+(?:agreement|contract|document)\s+as\s+(?:low|no|zero)\s*[- ]?\s*risk", "dictates a classification"),
]
BRACKETED = r"(\[[^\]]{40,400}\]|<!--.{20,400}?-->|\{\{.{20,400}?\}\})"
DIRECTIVE = r"\b(ignore|disregard|report|output|do not|must not|never|always|instruct|you\s+(?:are|must|should))\b"

# Words that search leaves out; passage search also leaves out "shall".
STOPWORDS = (
    "the a an of to in for on and or is are we our us i do does did what which how when who whom any all with that this it be by at from as if "
    "can have has there their they"
).split()
PASSAGE_STOPWORDS = [*STOPWORDS, "shall"]
WORD = r"[a-z0-9$%.]+"

# Words of a question that raise or lower kinds of records.
TIME_WORDS = ("when", "deadline", "due", "date", "soon", "days", "month", "expire", "expiry")
RENEWAL_WORDS = ("renew", "renewal", "auto-renew", "notice", "cancel", "terminate", "get out", "exit", "non-renewal")
ABSENCE_WORDS = ("missing", "absent", "without", "lack", "no ", "not have", "isn't", "does not", "silent", "nothing about")
RISK_WORDS = ("risk", "worst", "worry", "concern", "dangerous", "problem", "attention", "exposed", "exposure", "uncovered", "underwrit", "liable", "on the hook")
CROSS_WORDS = ("across", "portfolio", "chain", "flow-down", "flow down", "downstream", "upstream", "both sides", "supplier", "customers", "everything", "all contracts")
MONEY_WORDS = ("cost", "pay", "fee", "price", "spend", "value", "much", "worth", "annual")
SUPPLIER_WORDS = ("supplier", "provider", "vendor", "they give us", "we buy", "our provider", "upstream")
CUSTOMER_WORDS = ("customer", "client", "we promise", "we sell", "we give", "downstream", "we owe")
