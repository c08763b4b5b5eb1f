"""Cases in which a looser reading of a definition would give another result."""

import datetime

import pytest
from pyspark.sql import functions as F

from umbra.functions import detectors, rules, spans, tags
from umbra.functions import text as T
from umbra.operators import generate, linkage, utility
from umbra.plans.text_queries import contexts


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("v")).first()["v"]


def test_merged_markers_take_the_year_and_spaces(spark):
    text = "On XX/XX/2023, XXXX XXXX / XX / 2021 and XX-XX or XX/XX5 or XXXXL"
    got = one(spark, text, lambda t: spans.locate(t, T.MERGED_MARKER))
    assert [text[s["start"] : s["end"]] for s in got] == ["XX/XX/2023", "XXXX XXXX / XX / 2021", "XX", "XX", "XX"]


def test_date_shapes(spark):
    shapes = {"XX/XX/2023": True, "XX / XX / XXXX": True, "XX/21": True, "1/2": False, "XX": False, "XX/XX/XX": True}
    rows = spark.createDataFrame([(s,) for s in shapes], "s string").select("s", F.col("s").rlike(T.DATE_SHAPE).alias("v")).collect()
    assert {r["s"]: r["v"] for r in rows} == shapes


def test_adjacent_dates_and_spaced_amounts(spark):
    got = one(spark, "1/2/2024 3/4/2024 5/6/24 7/8/24 13/1/2024 2/30/24", T.dates)
    assert got == [datetime.date(2024, 1, 2), datetime.date(2024, 3, 4), datetime.date(2024, 5, 6), datetime.date(2024, 7, 8)]
    assert one(spark, "$ 50.00, $1,234.56, $7.5 and {$3.00}", T.amounts_in_cents) == [5000, 123456, 300]


@pytest.mark.parametrize(
    "kind,text,found",
    [
        ("CONTACT_PHONE", "call 555-123-4567 or (555) 123-4567.", 2),
        ("LOCATION_ZIP", "in 12345 and 12345-6789, not 123456", 2),
        ("LOCATION_STREET", "at 12 Oak Blvd and 7 Elm St", 2),
        ("ACCOUNT_ID", "4111-1111 1111 1111 and 4111111111111", 2),
        ("GOV_ID", "123-45-6789, not 1123-45-6789", 1),
        ("CONTACT_URL", "https://a.example/x?y=1.", 1),
        ("CONTACT_EMAIL", "a.b+c@d-e.org", 1),
        ("AMOUNT", "$ 50.00 and $1,000.25", 2),
    ],
)
def test_structured_patterns(spark, kind, text, found):
    assert one(spark, text, lambda t: T.count_of(t, T.ascii_edges(detectors.WITH_MONEY[kind]))) == found


CASES = [
    ("XXXX points were lost", "NOT_PII"),
    ("on XX/XX/2023 it came", "DATE"),
    ("the XXXX branch", "LOCATION_FINE"),
    ("then XXXX told me", "PERSON"),
    ("at XXXX credit union", "ORG_THIRD_PARTY"),
    ("for XXXX, where I work", "EMPLOYER"),
    ("write XXXX@mail", "CONTACT"),
    ("my XXXX card", "ACCOUNT_ID"),
    ("card ending in XXXX now", "ACCOUNT_ID"),
    ("case number XXXX now", "CASE_REF"),
    ("my passport number XXXX now", "GOV_ID"),
    ("my cell XXXX now", "CONTACT"),
    ("a man named XXXX now", "PERSON"),
    ("my ex-husband XXXX now", "RELATIONSHIP"),
    ("I worked for XXXX now", "EMPLOYER"),
    ("surgery for XXXX now", "HEALTH"),
    ("divorced from XXXX now", "LIFE_EVENT"),
    ("I am a XXXX now", "PROTECTED_ATTR"),
    ("moved to XXXX now", "LOCATION_FINE"),
    ("filed with XXXX now", "ORG_THIRD_PARTY"),
    ("a fee of $XXXX now", "AMOUNT"),
    ("it came on XXXX then", "DATE"),
    ("it was at XXXX then", "TEMPORAL"),
    ("I bought XXXX then", "MERCHANT"),
    ("nothing XXXX known", "UNKNOWN"),
]


def test_every_category_can_come_out(spark):
    rows = contexts(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id int, text string"), "doc_id")
    got = {r["doc_id"]: r["c"] for r in rows.select("doc_id", rules.classify(rules.CONTEXT_RULES, F.col("lhs"), F.col("mid"), F.col("rhs"))[0].alias("c")).collect()}
    assert got == {k: c for k, (_, c) in enumerate(CASES)}
    assert set(rules.TIERS) <= set(got.values())


def test_rough_and_certain_rules(spark):
    texts = ["account XXXX x", "ref XXXX x", "phone XXXX x", "dr. XXXX x", "called XXXX x", "in the city of XXXX x", "of $XXXX x", "XXXX days", "XX/XX/2020", "hm XXXX x", "ssn XXXX x", "e-mail is XXXX x", "ticket # XXXX x"]
    rows = contexts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id").orderBy("doc_id")
    rough, sure = (rules.classify(r, F.col(side), F.col("mid"), F.col("rhs20"))[0] for r, side in ((rules.ROUGH_RULES, "lhs40"), (rules.CERTAIN_RULES, "lhs48")))
    got = [tuple(r) for r in rows.select(rough, sure).collect()]
    assert [g[0] for g in got[:10]] == ["ACCOUNT_ID", "CASE_REF", "CONTACT", "PERSON", "ORG_OR_PERSON", "LOCATION", "AMOUNT_OR_COUNT", "NOT_PII_ESTIMATED", "DATE", "UNKNOWN"]
    assert [g[1] for g in got[8:]] == ["DATE", "UNKNOWN", "GOV_ID", "CONTACT", "CASE_REF"]


def test_greedy_keeps_the_stored_order(spark):
    kind = "struct<start:int,end:int,category:string>"
    row = spark.createDataFrame([([(4, 10, "B"), (0, 6, "A")], [(2, 7, "G"), (0, 5, "H")])], f"t array<{kind}>, g array<{kind}>")
    got = row.select(spans.greedy_pairs(F.col("t"), F.col("g")).alias("p")).first()["p"]
    assert [(p["truth"]["category"], p["guess"]) for p in got] == [("B", 0), ("A", 1)]


def test_tags():
    assert tags.parse("a<PERSON>b<DATE>c</DATE>d</PERSON>e") == ("abcde", [(1, 4, "PERSON"), (2, 3, "DATE")])
    assert tags.parse("<PERSON>b<DATE>c</PERSON></DATE>") == ("bc", [(1, 2, "DATE")])
    assert tags.parse("</DATE><NOPE>x</NOPE><AMOUNT></AMOUNT>") == ("<NOPE>x</NOPE>", [])


def test_recovery():
    text = "0123456789" * 20
    assert tags.recover(text, text[:50] + "<DATE>" + text[50:60] + "</DATE>" + text[60:]) == ([(50, 60, "DATE")], 0, False)
    # a span whose first character is not in the original goes; its neighbour moves
    spoilt = text[:50] + "<DATE>?" + text[50:60] + "</DATE>" + "<PERSON>" + text[60:70] + "</PERSON>" + text[70:]
    assert tags.recover(text, spoilt) == ([(60, 70, "PERSON")], 0, False)
    assert tags.recover(text, " \n ") == ([], 200, True)
    assert tags.recover(text, "<DATE>" + text[:190] + "</DATE>") == ([], 10, True)
    assert tags.recover(text, "<DATE>" + text[3:9] + "</DATE>" + text[9:]) == ([(3, 9, "DATE")], 3, False)


def test_five_candidates_are_not_a_small_set(spark):
    docs = spark.createDataFrame([(4, 100), (5, 100)], "doc_id int, customer_id int")
    listed = linkage.configuration_list({"f": ["amount"]}, [(0, 0)])
    hits = spark.createDataFrame([(0, n, 100 + k, 1 + (k == 0)) for n in (4, 5) for k in range(n)], "config_id int, doc_id int, customer_id int, hits int")
    got = {r["doc_id"]: (r["u"], r["k"], r["r"]) for r in linkage.verdicts(docs, hits, linkage.configurations(spark, listed)).collect()}
    assert got == {4: (0, 1, 1), 5: (0, 0, 1)}


def test_the_grid():
    listed = linkage.configuration_list()
    assert len(listed) == 28 and {c[6] for c in listed} == {0, 100, 500, 2500} and {c[7] for c in listed} == {0, 1, 3, 7}


def test_sentence_sources(spark):
    long = lambda k: f"This is sentence number {k} and it is long enough to be looked up by its text{'!' * (k % 2)}"
    originals = spark.createDataFrame([(k, long(k) + ". Short one. " + long(50) + ".") for k in (3, 1, 2)], "doc_id int, text string")
    altered = spark.createDataFrame([(10, "New text. " + long(2).upper() + ". And  more."), (11, "  ".join(long(k) + " longer than what is known." for k in range(60, 66)) + " " + long(1) + "."), (12, long(50) + ".")], "doc_id int, text string")
    got = {r["doc_id"]: r["source_id"] for r in utility.sentence_sources(altered, originals).collect()}
    assert got == {10: 2, 12: 1}  # the six longest of 11 are unknown, so it is not matched


def test_carriers(spark):
    parted = spark.createDataFrame(
        [
            (1, 0, "My card ending in XXXX was charged twice."),
            (1, 1, "I sent an email to me at email address XXXX again."),
            (1, 2, "They took {$5.00} from card number XXXX last week."),
            (2, 0, "Short XXXX."),
            (2, 1, "No marker in this sentence at all, none."),
            (2, 2, "I spoke with XXXX about the thing they did."),
            (2, 3, "My card number XXXX and XXXL shirts were there."),
        ],
        "doc_id int, at int, text string",
    )
    got = {(r["doc_id"], r["at"]): (r["reason"], r["template"] if r["reason"] is None else None) for r in generate.carriers(parted, contexts).collect()}
    assert got == {
        (1, 0): (None, "My card ending in [[last4]] was charged twice."),
        (1, 1): (None, "I sent an email to me at email address [[email]] again."),
        (1, 2): ("formatting", None),
        (2, 0): ("length", None),
        (2, 1): ("markers", None),
        (2, 2): ("context", None),
        (2, 3): ("leftover marker", None),
    }
