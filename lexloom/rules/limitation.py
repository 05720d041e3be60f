"""Limitation periods by kind of claim."""

LIMITATION_ACT = "Limitation Act, 1963"
NI_ACT = "Negotiable Instruments Act, 1881"
CONSUMER_ACT = "Consumer Protection Act, 2019"
ARBITRATION_ACT = "Arbitration and Conciliation Act, 1996"
RTI_ACT = "Right to Information Act, 2005"

# Fixed values: (key, claim, period, unit, time runs from, authority, Act, condonable).
LIMITATION_RULES = [
    ("goods_sold", "Price of goods sold and delivered", 3, "years", "the date of delivery of the goods", "Article 14", LIMITATION_ACT, False),
    ("work_done", "Money payable for work done for the defendant", 3, "years", "the date the work was done", "Article 18", LIMITATION_ACT, False),
    ("money_lent", "Money lent", 3, "years", "the date the loan was made", "Article 19", LIMITATION_ACT, False),
    ("money_lent_on_demand", "Money lent under an agreement that it is payable on demand", 3, "years", "the date the loan was made", "Article 21", LIMITATION_ACT, False),
    ("deposit_on_demand", "Money deposited under an agreement that it is payable on demand", 3, "years", "the date the demand is made", "Article 22", LIMITATION_ACT, False),
    ("money_had_and_received", "Money had and received to the plaintiff's use", 3, "years", "the date the money was received", "Article 24", LIMITATION_ACT, False),
    ("breach_of_contract", "Compensation for breach of any contract", 3, "years", "the date the contract was broken, or where there are successive breaches, the date of each breach", "Article 55", LIMITATION_ACT, False),
    ("specific_performance", "Specific performance of a contract", 3, "years", "the date fixed for performance, or if no date is fixed, the date the plaintiff had notice that performance was refused", "Article 54", LIMITATION_ACT, False),
    ("declaration", "Suit to obtain any other declaration", 3, "years", "the date the right to sue first accrues", "Article 58", LIMITATION_ACT, False),
    ("cancel_instrument", "Suit to cancel or set aside an instrument or decree", 3, "years", "the date the facts entitling the plaintiff to have the instrument cancelled become known to the plaintiff", "Article 59", LIMITATION_ACT, False),
    ("possession_title", "Possession of immovable property based on title", 12, "years", "the date the defendant's possession becomes adverse to the plaintiff", "Article 65", LIMITATION_ACT, False),
    ("possession_dispossession", "Possession of immovable property on dispossession", 12, "years", "the date of dispossession", "Article 64", LIMITATION_ACT, False),
    ("mortgage_money", "Suit to enforce payment of money secured by a mortgage", 12, "years", "the date the money sued for becomes due", "Article 62", LIMITATION_ACT, False),
    ("residuary", "Any suit for which no period is provided elsewhere", 3, "years", "the date the right to sue accrues", "Article 113", LIMITATION_ACT, False),
    ("tort_compensation", "Compensation for a tort not otherwise provided for", 3, "years", "the date the right to sue accrues (usually when the damage occurs)", "Article 113", LIMITATION_ACT, False),
    ("malicious_prosecution", "Compensation for malicious prosecution", 1, "years", "the date the plaintiff is acquitted or the prosecution is otherwise terminated", "Article 74", LIMITATION_ACT, False),
    ("defamation_libel", "Compensation for libel", 1, "years", "the date of publication", "Article 75", LIMITATION_ACT, False),
    ("defamation_slander", "Compensation for slander", 1, "years", "the date the words are spoken, or if special damage is the cause of action, when the damage occurs", "Article 76", LIMITATION_ACT, False),
    ("appeal_hc_decree", "Appeal to a High Court from a decree or order", 90, "days", "the date of the decree or order", "Article 116(a)", LIMITATION_ACT, True),
    ("appeal_other_court", "Appeal to any court other than a High Court from a decree or order", 30, "days", "the date of the decree or order", "Article 116(b)", LIMITATION_ACT, True),
    ("restore_dismissed_suit", "Application to restore a suit dismissed for default", 30, "days", "the date of dismissal", "Article 122", LIMITATION_ACT, True),
    ("set_aside_ex_parte", "Application to set aside an ex parte decree", 30, "days", "the date of the decree, or where the summons was not duly served, the date the applicant had knowledge of the decree", "Article 123", LIMITATION_ACT, True),
    ("review", "Application for review of judgment", 30, "days", "the date of the decree or order", "Article 124", LIMITATION_ACT, True),
    ("execution", "Application for execution of a decree", 12, "years", "the date the decree becomes enforceable", "Article 136", LIMITATION_ACT, False),
    ("ni_138_complaint", "Complaint for dishonour of cheque", 1, "months", "the date on which the 15-day period after service of the statutory notice expires without payment", "section 142(b), Negotiable Instruments Act, 1881", NI_ACT, True),
    ("ni_138_notice", "Statutory notice demanding payment on a dishonoured cheque", 30, "days", "the date the drawer receives information from the bank that the cheque has been returned unpaid", "proviso (b) to section 138, Negotiable Instruments Act, 1881", NI_ACT, False),
    ("consumer_complaint", "Consumer complaint", 2, "years", "the date on which the cause of action arises", "section 69, Consumer Protection Act, 2019", CONSUMER_ACT, True),
    ("arbitration_set_aside", "Application to set aside an arbitral award", 3, "months", "the date on which the party making the application received the award, or the date a request under section 33 is disposed of", "section 34(3), Arbitration and Conciliation Act, 1996", ARBITRATION_ACT, True),
    ("rti_first_appeal", "First appeal under the Right to Information Act", 30, "days", "the date of the decision, or the expiry of the period for a response", "section 19(1), Right to Information Act, 2005", RTI_ACT, True),
    ("rti_second_appeal", "Second appeal to the Information Commission", 90, "days", "the date on which the first appeal decision was made or should have been made", "section 19(3), Right to Information Act, 2005", RTI_ACT, True),
    ("suit_against_government", "Suit against the Government or a public officer for an act done in official capacity", 3, "years", "the date the right to sue accrues", "Article 113 with section 80 CPC", LIMITATION_ACT, False),
]

# Thresholds in days for the urgency labels.
LIMITATION_CRITICAL_DAYS = 30
LIMITATION_SOON_DAYS = 90
CHEQUE_CRITICAL_DAYS = 7
CHEQUE_SOON_DAYS = 21
ALERT_HORIZON_DAYS = 60
IMMINENT_HEARING_DAYS = 7

# The three clocks of a dishonoured cheque.
NOTICE_DAYS = 30
PAYMENT_DAYS = 15
COMPLAINT_MONTHS = 1
