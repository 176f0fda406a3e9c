"""Addresses by RFC 3986, clicks between pages, and the state machine of outreach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftline.functions import outreach as O
from siftline.functions.links import resolved
from siftline.operators import graphs

# Examples of RFC 3986, section 5.4, without fragments.
BASE = "http://a/b/c/d;p?q"
EXAMPLES = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "mailto:x@y": None, "javascript:void(0)": None, "HTTPS://B.Example/X": "https://b.example/X", " /t ": "http://a/t",
}


def test_rfc_examples(spark):
    df = spark.createDataFrame([(h, BASE) for h in EXAMPLES], "h string, b string")
    assert {r.h: r.u for r in df.select("h", resolved(F.col("h"), F.col("b")).alias("u")).collect()} == EXAMPLES
    odd = spark.createDataFrame([("x", "no-address"), ("x", "https://h"), ("//", "https://h/"), (None, "https://h/")], "h string, b string")
    assert [r.u for r in odd.select(resolved(F.col("h"), F.col("b")).alias("u")).collect()] == [None, "https://h/x", None, None]


def test_clicks_on_a_long_chain_with_cycles(spark):
    edges = [(i, i + 1) for i in range(15)] + [(15, 0), (3, 1), (7, 7), (100, 101), (0, 20), (20, 14)]
    got = {r.page_id: r.clicks for r in graphs.clicks(spark.createDataFrame(edges * 2, "src long, dst long"), spark.createDataFrame([(0,), (0,)], "page_id long")).collect()}
    assert got == {i: i for i in range(14)} | {14: 2, 15: 3, 20: 1}
    assert graphs.clicks(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "page_id long")).count() == 0


def test_contact_channels(spark):
    pages = [
        (1, "https://www.acme.example.net/", '<a href="team">Team</a> hello@acme.example.net'), (2, "https://acme.example.net/team", '<a href="/people/x">write to us: Contact</a>'), (3, "https://www.acme.example.net/team", '<a href="./people/../people/x">CONTACT</a> jobs@acme.example.net'),
        (4, "https://www.acme.example.net/people/x", "jobs@acme.example.net press@mail.acme.example.net x@else.example.net"), (5, "https://lone.example.net/a", None), (6, "not an address", "x"),
    ]
    got = {r.host: (r.root, r.pages, r.contact_page, r.clicks, r.emails) for r in graphs.contact_channels(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {"acme.example.net": (1, 3, 4, 2, ["jobs@acme.example.net", "hello@acme.example.net", "press@mail.acme.example.net"]), "lone.example.net": (5, 1, None, None, [])}


DAY = dt.timedelta(days=1)
T0 = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize(("events", "after", "want"), [
    ([], 0, None), ([("DRAFT", 0)], 9, ("CONTACT", "Send your intro", True, 2, None)), ([("SEND", 0)], 2, ("AWAIT", "Follow up in 1 day", False, 1, 2)), ([("SEND", 0)], 3, ("FOLLOW_UP", "Follow up — no reply yet", True, 2, 3)), ([("SEND", 0)], 6, ("FOLLOW_UP", "Follow up — no reply yet", True, 3, 6)),
    ([("SEND", 0), ("SEND", 3)], 7, ("AWAIT", "Follow up in 1 day", False, 1, 4)), ([("SEND", 0), ("SEND", 3)], 8, ("FOLLOW_UP_2", "Second nudge is due", True, 2, 5)), ([("SEND", 0), ("SEND", 3), ("SEND", 9)], 40, ("RESTING", "Two nudges sent — let it rest", False, 0, 31)),
    ([("DRAFT", 0), ("SEND", 1), ("AUTO", 2), ("REPLY", 3), ("SEND", 4)], 5, ("REPLIED", "Replied — take it forward", True, 3, None)), ([("REPLY", 0), ("SEND", 1), ("ARCHIVE", 2), ("SEND", 3)], 9, ("NONE", "", False, 0, None)),
])
def test_outreach(spark, events, after, want):
    df = spark.createDataFrame([(1, T0 + d * DAY, n, e) for n, (e, d) in enumerate(events)][::-1], "k long, at timestamp, seq int, event string")
    s = O.contact_states(df, "k")
    got = s.select(O.next_action(*(F.col(c) for c in ("status", "contacted_at", "last_nudge_at", "nudges")), F.lit(T0 + after * DAY)).alias("x")).first()
    assert (tuple(got.x) if got else None) == want
