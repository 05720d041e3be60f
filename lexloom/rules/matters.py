"""Allowed values and prices of the case-management tables."""

# Fixed values.
MATTER_TYPES = [
    "civil_suit", "criminal_complaint", "cheque_bounce", "consumer_complaint",
    "arbitration", "writ_petition", "appeal", "matrimonial", "property_dispute",
    "employment", "contract_dispute", "rti", "tax", "company_insolvency",
    "notice_only", "advisory", "other",
]
MATTER_STATUSES = [
    "open", "pending_filing", "in_court", "reserved", "disposed", "closed", "on_hold",
]
FINISHED_STATUSES = ["disposed", "closed"]

# Price of one call, in rupees.
CALL_PRICES = {"search": 0.50, "document": 0.20, "fragment": 0.05, "metadata": 0.05}
