"""Rule sets as data, compiled to one CASE WHEN."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.text import DATE_SHAPE, ascii_edges

# The categories and their tiers.
TIERS = {
    "PERSON": 1, "ACCOUNT_ID": 1, "GOV_ID": 1, "CONTACT": 1, "CASE_REF": 1,
    "RELATIONSHIP": 2, "LOCATION_FINE": 2, "EMPLOYER": 2, "LIFE_EVENT": 2, "PROTECTED_ATTR": 2, "HEALTH": 2, "ORG_THIRD_PARTY": 2,
    "AMOUNT": 3, "DATE": 3, "MERCHANT": 3, "TEMPORAL": 3,
}


@dataclass(frozen=True)
class Rule:
    category: str
    side: str  # "left", "right" or "self"
    pattern: str


def _rules(side: str, listed: list[tuple[str, str]]) -> list[Rule]:
    return [Rule(category, side, "(?i)" + pattern) for category, pattern in listed]


# What the words round a marker say about it. Each set is tried in its order.
_SHAPE = [Rule("DATE", "self", DATE_SHAPE)]
_COUNTED = r"^\s*(points?|days?|months?|years?|weeks?|hours?|minutes?|times?|dollars?|bureaus?|%|percent|cfr|usc|u\.s\.c|credit\s+score|fico)\b"
_BEHIND = [
    ("LOCATION_FINE", r"^\s+(branch|store|location|office|atm)\b"),
    ("PERSON", r"^\s+(said|told|stated|informed|assured|promised|refused|answered|hung\s+up)\b"),
    ("PERSON", r"^\s*,?\s+(the\s+)?(supervisor|manager|agent|representative|rep)\b"),
    ("ORG_THIRD_PARTY", r"^\s+(bank|credit\s+union|agency|bureau|company)\b"),
    ("EMPLOYER", r"^\s*,?\s+(where\s+i\s+work|my\s+employer)\b"),
    ("CONTACT", r"^\s*@\s*\w"),
    ("ACCOUNT_ID", r"^\s+(account|card)\b"),
]
_BEFORE = [
    ("ACCOUNT_ID", r"(ending|ends|end)\s+(in|with)\s+$"),
    ("ACCOUNT_ID", r"(account|acct|card)\s*(number|no|#|num)?\s*:?\s*$"),
    ("ACCOUNT_ID", r"(last|final)\s+(four|4|digits?)\s*(of|are|is)?\s*$"),
    ("CASE_REF", r"(case|claim|complaint|reference|ref|confirmation|ticket|dispute)\s*(number|no|#)?\s*:?\s*$"),
    ("GOV_ID", r"(ssn|social\s+security|driver'?s?\s+licen[cs]e|passport|tax\s*id)\s*(number|no|#)?\s*:?\s*$"),
    ("CONTACT", r"(phone|tel|telephone|fax|mobile|cell)\s*(number|no|#)?\s*:?\s*$"),
    ("CONTACT", r"(e-?mail|email)\s*(address|at)?\s*:?\s*$"),
    ("CONTACT", r"(mail(ed)?|sent|write|wrote)\s+(it\s+)?to\s+$"),
    ("CONTACT", r"(reside|live|living|address)\s+(at|in|is)\s*$"),
    ("PERSON", r"(named|name\s+(is|was)|called\s+himself)\s*$"),
    ("PERSON", r"\b(mr|mrs|ms|miss|dr|sir|madam)\.?\s*$"),
    ("PERSON", r"(sincerely|regards|thank\s+you,?|signed)\s*,?\s*$"),
    ("PERSON", r"(supervisor|manager|agent|representative|rep|employee|associate)\s+(named\s+)?$"),
    ("RELATIONSHIP", r"\bmy\s+(ex[-\s]?)?(husband|wife|spouse|son|daughter|mother|father|mom|dad|brother|sister|partner|fianc|boyfriend|girlfriend|in[-\s]law|aunt|uncle|cousin|nephew|niece|grand\w+)\w*\s*(,|'s)?\s*$"),
    ("RELATIONSHIP", r"\bmy\s+(ex|late)\s*$"),
    ("EMPLOYER", r"(work(ed|ing)?\s+(at|for)|employer|employed\s+by|job\s+(at|with)|retire[d]?\s+from)\s+(the\s+)?$"),
    ("HEALTH", r"(surgery|medical|dental|dentist|vet|veterinar\w+|procedure|treatment|diagnos\w+|prescri\w+|therapy|hospital)\s+(for|of|at)?\s*$"),
    ("HEALTH", r"(care\s*credit|carecredit)\s+(for|to)\s+$"),
    ("LIFE_EVENT", r"(divorce[d]?|marriage|married|widow\w*|passed\s+away|died|death\s+of|discharged?|deployed|bankrupt\w*|foreclos\w+|laid\s+off)\s+(from|in|of|after)?\s*$"),
    ("PROTECTED_ATTR", r"(i\s+am|i'?m|as)\s+(a|an)\s+$"),
    ("PROTECTED_ATTR", r"(disab\w+|veteran|handicap\w*|race|religion|ethnic\w*)\s+(status\s+)?(of|is|with)?\s*$"),
    ("LOCATION_FINE", r"(branch|store|office|location|atm)\s+(in|at|on|near)\s+(the\s+)?$"),
    ("LOCATION_FINE", r"(in|at|near|from|to)\s+(the\s+)?(city|town|state|county|neighborhood)\s+(of\s+)?$"),
    ("LOCATION_FINE", r"(moved|relocat\w+|travel\w*|drove|flew)\s+(to|from)\s+$"),
    ("LOCATION_FINE", r"\b(live[sd]?|living|reside[sd]?)\s+in\s+$"),
    ("ORG_THIRD_PARTY", r"(called|contacted|spoke\s+(with|to)|filed\s+with|reported\s+to|through)\s+(the\s+)?$"),
    ("ORG_THIRD_PARTY", r"(bank|lender|creditor|agency|bureau|company|merchant|retailer|collector)\s+(called|named)?\s*$"),
    ("AMOUNT", r"(\$|amount\s+of|charge[d]?\s+(me\s+)?|paid|balance\s+of|fee\s+of)\s*\$?\s*$"),
    ("DATE", r"\b(on|since|until|from|by|before|after|dated|due)\s+$"),
    ("TEMPORAL", r"\bat\s+(around\s+)?$"),
    ("MERCHANT", r"(bought|purchase[d]?|shop(ped)?|order(ed)?|charge\s+(at|from)|transaction\s+(at|with))\s+(something\s+)?(at|from|with)?\s*$"),
]
_ROUGH_COUNTED = r"^\s*(points?|days?|months?|years?|weeks?|hours?|times?|bureaus?|%|percent)\b"
_ROUGH = [
    ("ACCOUNT_ID", r"(ending|ends)\s+(in\s+)?$|account\s+(#\s*)?$|card\s+(#\s*)?$"),
    ("CASE_REF", r"(case|claim|complaint|reference|ref|confirmation)\s*#?\s*$"),
    ("CONTACT", r"(phone|call(ed)?\s+at|number\s+of|fax|email)\s*$"),
    ("PERSON", r"(named|name\s+is|sincerely|regards|mr|mrs|ms|dr)\.?\s*$"),
    ("ORG_OR_PERSON", r"(called|contacted|spoke\s+(with|to)|with|from|at)\s+$"),
    ("LOCATION", r"(in|at|to|from)\s+(the\s+)?(city|state|branch|store)\s+(of\s+)?$"),
    ("AMOUNT_OR_COUNT", r"(\$|of\s+\$?)\s*$"),
]
_CERTAIN = [
    ("ACCOUNT_ID", r"(ending|ends|end)\s+(in|with)\s*$"),
    ("ACCOUNT_ID", r"(account|acct|card)\s*(number|no|#)\s*:?\s*$"),
    ("ACCOUNT_ID", r"last\s+(four|4)\s+(digits?\s*)?(of\s+)?(my\s+)?(account|card)?\s*(is|are|:)?\s*$"),
    ("CASE_REF", r"(case|claim|complaint|dispute|reference|ref|confirmation|ticket)\s*(number|no|#)\s*:?\s*$"),
    ("GOV_ID", r"(social\s+security|ssn|tax\s*id|driver'?s?\s+licen[cs]e|passport)\s*(number|no|#)?\s*:?\s*$"),
    ("CONTACT", r"(phone|telephone|fax|mobile|cell)\s*(number|no|#)\s*:?\s*$"),
    ("CONTACT", r"(e-?mail)\s*(address)?\s*(is|:|at)?\s*$"),
    ("AMOUNT", r"[${]\s*$"),
]

# Both sides of a marker, 60 and 40 characters: what follows may rule personal data out, then the shape of the marker, then what follows, then what comes before.
CONTEXT_RULES = [*_rules("right", [("NOT_PII", _COUNTED)]), *_SHAPE, *_rules("right", _BEHIND), *_rules("left", _BEFORE)]
# The rougher estimate: shape, then a unit within 20 characters, then 40 characters before.
ROUGH_RULES = [*_SHAPE, *_rules("right", [("NOT_PII_ESTIMATED", _ROUGH_COUNTED)]), *_rules("left", _ROUGH)]
# Only what leaves no choice, within 48 characters before.
CERTAIN_RULES = [*_SHAPE, *_rules("left", _CERTAIN)]


def slot_field(category: Column, left: Column, before: Column) -> Column:
    """The field that fills a marker of a category: left is what stands 40 characters before it, before the whole sentence up to it."""
    low = F.lower(left)
    has = lambda *words: reduce(or_, [low.contains(w) for w in words])
    contact = F.when(has("email", "e-mail", "@"), "email").when(has("address", "mail", "live", "reside"), "address").otherwise("phone")
    account = F.when(low.rlike(r"(ending|ends|last\s*(four|4))\s*(in|with)?\s*$"), "last4").otherwise("account_num")
    amount = F.when(before.rlike(r"[${]\s*$"), "amount_bare").otherwise("amount")
    plain = F.element_at(F.create_map(*[F.lit(x) for pair in SLOTS.items() for x in pair]), category)
    return F.when(category == "AMOUNT", amount).when(category == "CONTACT", contact).when(category == "ACCOUNT_ID", account).otherwise(plain)


# The field that fills a slot of each category unless its context says otherwise.
SLOTS = {
    "PERSON": "person_full", "ACCOUNT_ID": "last4", "GOV_ID": "ssn", "CONTACT": "phone", "CASE_REF": "case_ref", "RELATIONSHIP": "relationship", "LOCATION_FINE": "city", "EMPLOYER": "employer",
    "LIFE_EVENT": "life_event", "PROTECTED_ATTR": "protected", "HEALTH": "health", "ORG_THIRD_PARTY": "bank", "AMOUNT": "amount", "DATE": "date", "MERCHANT": "merchant", "TEMPORAL": "weekday",
}


def classify(rules: list[Rule], left: Column, itself: Column, right: Column, other: str = "UNKNOWN") -> tuple[Column, Column]:
    """(category, side that decided) by the first rule that holds."""
    category, side = F.lit(other), F.lit("none")
    sides = {"left": left, "right": right, "self": F.trim(itself)}
    for rule in reversed(rules):
        holds = sides[rule.side].rlike(ascii_edges(rule.pattern))
        category = F.when(holds, rule.category).otherwise(category)
        side = F.when(holds, rule.side).otherwise(side)
    return category, side


def tier(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), category)


def reject_reason(cases: list[tuple[str, Column]]) -> Column:
    """The first reason that holds, null for rows that pass."""
    out = F.lit(None).cast("string")
    for reason, holds in reversed(cases):
        out = F.when(holds, reason).otherwise(out)
    return out


def is_exact(value: Column, category: str) -> Column:
    """1 where the normalised value equals the category; containing it is not enough."""
    return F.when(F.lower(F.trim(value)) == category.lower(), 1).otherwise(0)
