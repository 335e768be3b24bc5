"""Rules over account types, events and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display group of each account type.
TYPE_GROUPS = {
    "Banking": ("checking", "savings"),
    "Credit Cards": ("credit_card",),
    "Investments & Retirement": ("brokerage", "rsu", "ira", "roth_ira", "pension", "401k"),
    "Real Estate": ("real_estate",),
    "Vehicles": ("vehicle",),
    "Collectibles": ("collectible",),
    "Loans": ("loan", "mortgage"),
}
# Words in a payment that deserves a reminder, and the amount that does.
REMINDER_WORDS = ("credit card", "card payment", "mortgage", "loan", "property", "fee", "rent", "tax", "council", "school", "tuition", "fcu", "amex", "visa", "mastercard")
REMINDER_AMOUNT = 500
# Words of the event classifier.
PAYMENT_WORDS = ("payment", "pymt", "pmt", "autopay", "auto pay", "thank you", "online pmt", "ach payment")
FEE_PHRASES = ("service charge", "annual fee", "late fee", "interest charge", "overdraft fee", "maintenance fee", "atm fee", "wire fee", "monthly fee", "account fee")
TAX_PHRASES = ("tax payment", "estimated tax", "irs", "hmrc")
PAYROLL_WORDS = ("payroll", "salary", "wages", "direct deposit", "net pay", "employer")
REFUND_WORDS = ("refund", "return", "reversal", "chargeback", "rebate", "cashback", "cash back", "goodwill", "statement credit", "credit adjustment")
PLAN_WORDS = ("instalment plan", "installment plan", "plan it", "pay over time")
CARD_FEE_PHRASES = ("plan fee", "interest charge", "annual fee", "late fee", "foreign transaction fee", "cash advance fee", "membership fee")
# Events that are not spend, and the spend type of the others that are not lifestyle.
NOT_SPEND = (
    "external_income", "payroll_income", "employer_benefit", "internal_transfer", "card_payment_settlement", "mortgage_principal", "investment_contribution",
    "investment_withdrawal", "investment_flow", "asset_flow", "rental_income", "owner_distribution", "deferred_rent_liability",
)
DEBT_COSTS = ("liability_payment", "mortgage_payment", "mortgage_interest", "fee")
#: Days or months of each frequency.
DAY_STEPS = {"weekly": 7, "biweekly": 14}
MONTH_STEPS = {"monthly": 1, "quarterly": 3, "annually": 12}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-case text contains one of the words."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def type_group(kind: Column) -> Column:
    out = F.lit("Other")
    for group, kinds in TYPE_GROUPS.items():
        out = F.when(kind.isin(*kinds), group).otherwise(out)
    return out


def flag_level(amount: Column, kind: Column, source: Column, description: Column, override: Column) -> Column:
    """``reminder`` or ``auto``; a known override wins."""
    text = F.lower(F.coalesce(description, F.lit("")))
    bank = kind.isin("checking", "savings") & (has_any(text, REMINDER_WORDS) | (F.abs(amount) >= REMINDER_AMOUNT))
    remind = (amount > 0) | kind.isin("loan", "mortgage") | (source == "statement") | bank
    return F.when(override.isin("auto", "reminder"), override).when(F.coalesce(remind, F.lit(False)), "reminder").otherwise("auto")


def classify_event(amount: Column, description: Column, kind: Column, is_transfer: Column, row_type: Column) -> Column:
    """Economic role of a row, from its account's type, sign and wording; the first rule that fits."""
    text = F.lower(F.coalesce(description, F.lit("")))
    word = lambda w: text.rlike(rf"\b{w}\b")
    card_fee = has_any(text, CARD_FEE_PHRASES) | word("interest") | word("fee")
    card = (
        F.when((amount <= 0) & card_fee, "fee")
        .when(amount <= 0, "card_purchase")
        .when(has_any(text, REFUND_WORDS), "merchant_refund")
        .when((row_type == "payment") | has_any(text, PAYMENT_WORDS), "card_payment_settlement")
        .when(card_fee, "fee")
        .when(has_any(text, PLAN_WORDS), "card_credit")
        .otherwise("merchant_refund")
    )
    return (
        F.when(is_transfer, "internal_transfer")
        .when(kind == "credit_card", card)
        .when(kind == "mortgage", F.when(amount > 0, "mortgage_payment").when(word("interest"), "mortgage_interest").otherwise("fee"))
        .when(kind == "loan", F.when(amount > 0, "liability_payment").otherwise("fee"))
        .when(kind.isin("brokerage", "ira", "roth_ira", "pension", "401k"), F.when(amount > 0, "investment_contribution").otherwise("investment_withdrawal"))
        .when(kind.isin("real_estate", "vehicle", "collectible"), "asset_flow")
        .when(has_any(text, FEE_PHRASES) | word("fee"), "fee")
        .when(has_any(text, TAX_PHRASES) | word("tax"), "tax_payment")
        .when((amount >= 0) & has_any(text, PAYROLL_WORDS), "payroll_income")
        .when(amount >= 0, "external_income")
        .otherwise("lifestyle_expense")
    )


def spend_metadata(event: Column) -> tuple[Column, Column]:
    """(spend type, counts as spend) of an event; unknown events are lifestyle spend."""
    kind = F.when(event.isin(*NOT_SPEND), "non_spend_cash_use").when(event.isin(*DEBT_COSTS), "debt_cost").when(event == "tax_payment", "tax").otherwise("lifestyle")
    return kind, F.coalesce(~event.isin(*NOT_SPEND), F.lit(True))


def step_date(day: Column, frequency: Column, n: Column) -> Column:
    """``n`` periods after ``day``; month steps keep the day, clamped to the month's end; unknown frequencies stay."""
    out = day
    for name, days in DAY_STEPS.items():
        out = F.when(frequency == name, F.date_add(day, n * days)).otherwise(out)
    for name, months in MONTH_STEPS.items():
        out = F.when(frequency == name, F.add_months(day, n * months)).otherwise(out)
    return out
