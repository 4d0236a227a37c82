import datetime as dt

import pytest

from cairnflow.operators import units as U

MINOR = {"USD": 2, "EUR": 2, "GBP": 2, "JPY": 0, "KWD": 3, "BTC": 8, "CNY": 2, "INR": 2, "CHF": 2, "RUB": 2, "MXN": 2}
NAMES = {"us dollar": "USD", "usd": "USD", "euro": "EUR", "eur": "EUR", "uk pound": "GBP", "gbp": "GBP", "yen": "JPY", "jpy": "JPY", "bitcoin": "BTC", "btc": "BTC"}


@pytest.mark.parametrize("text, want", [
    ("USD ", ("USD", 0)), ("US cents", ("USD", 2)), ("¢ US", ("USD", 2)), ("kUSD", ("USD", -3)), ("USD (thousands)", ("USD", -3)), ("US$ millions", ("USD", -6)), ("Mio. EUR", ("EUR", -6)),
    ("TEUR", ("EUR", -3)), ("GBp", ("GBP", 2)), ("GBP", ("GBP", 0)), ("GBX", ("GBP", 2)), ("£k", ("GBP", -3)), ("£m", ("GBP", -6)), ("man-yen", ("JPY", -4)), ("JPY 10k", ("JPY", -4)),
    ("lakh INR", ("INR", -5)), ("INR crore", ("INR", -7)), ("jiao (CNY)", ("CNY", 1)), ("mBTC", ("BTC", 3)), ("µBTC", ("BTC", 6)), ("satoshi", ("BTC", 8)), ("minor units (BTC)", ("BTC", 8)),
    ("minor units (JPY)", ("JPY", 0)), ("тыс. руб.", ("RUB", -3)), ("коп.", ("RUB", 2)), ("KWD fils", ("KWD", 3)), ("MDP MXN", ("MXN", -6)), ("Tsd. US Dollar", ("USD", -3)), (None, (None, None)), ("  ", (None, None)), ("lunch", (None, None)),
])
def test_read_unit(text, want):
    assert U.read_unit(text, MINOR, NAMES) == want


def test_read_note():
    assert U.read_note("Paid amounts are quoted in thousands, received amounts in full.", "p", "", MINOR)["EUR"] == -3
    assert U.read_note("Paid amounts are quoted in thousands, received amounts in full.", "r", "", MINOR) == {}
    assert U.read_note("Replays older files once a thousand of them have piled up.", "p", "", MINOR) == {}
    assert U.read_note("Cut-off 23:00; minor outages are retried.", "p", "", MINOR) == {}
    assert U.read_note("All figures are whole minor units.", "r", "", MINOR)["JPY"] == 0
    assert U.read_note("Bis 10.04.2024 alle Beträge in Hundertsteln.", "r", ">", MINOR) == {}


TRANS = "trans_id long, timestamp timestamp_ntz, from_bank string, from_account string, to_bank string, to_account string, amount_received double, currency_received string, amount_paid double, currency_paid string, feed_id int, memo string, paid_src string"


def tables(spark, rows):
    t0 = dt.datetime(2024, 3, 1)
    full = [(i, t0 + dt.timedelta(minutes=i), "1", f"A{i}", "2", f"B{i}", *r, "clash") for i, r in enumerate(rows)]
    feeds = spark.createDataFrame([(1, None), (9, "Paid amounts are quoted in thousands, received amounts in full.")], "feed_id int, note string")
    units = spark.createDataFrame([("US Dollar", "USD", 2, 1.0), ("Euro", "EUR", 2, 1.09), ("Yen", "JPY", 0, 0.0067)], "currency string, iso_code string, minor_digits int, usd_per_unit double")
    return spark.createDataFrame(full, TRANS), feeds, units


def test_sums_memos_nulls_and_clashing_columns(spark):
    rows = [(10.0 + i, "US Dollar", 10.0 + i, "US Dollar", 1, None) for i in range(30)]
    rows += [
        (5.0, "US Dollar", 500.0, "USc", 1, None),  # 30: paid in cents
        (1200.0, "US Dollar", 1.2, "US Dollar", 1, "payer sent 1,200.00 US Dollar"),  # 31: the memo's sum is right
        (7.0, "US Dollar", 700.0, "US Dollar", 1, "paid side in US cents"),  # 32
        (None, "US Dollar", None, None, 1, None),  # 33
        (5.0, "US Dollar", 5.0, "US Dollar", 1, "debited: 5.00 USD"),  # 34: the same as the memo says
        (0.0, None, 0.0, "US Dollar", None, ""),  # 35
        (900.0, "Yen", 900.0, "Yen", 1, "received side in minor units (JPY)"),  # 36: the unit is the whole one
    ]
    trans, feeds, units = tables(spark, rows)
    got = {r["trans_id"]: r for r in U.harmonise(trans, feeds, units).collect()}
    odd = {(i, s) for i, r in got.items() for s in ("paid", "received") if r[f"{s}_x"] is not None and r[f"{s}_odd"]}
    assert odd == {(30, "paid"), (31, "paid"), (32, "paid")}
    assert abs(got[30]["paid_usd"] - 5) < 1e-9 and abs(got[31]["paid_usd"] - 1200) < 1e-9 and abs(got[32]["paid_usd"] - 7) < 1e-9
    assert got[33]["paid_usd"] is None and got[35]["paid_usd"] == 0.0


def test_links_find_a_silent_scale(spark):
    # nothing in the text says that feed 9 pays in thousands; the other side does
    rows = [(100.0 + i, "US Dollar", 100.0 + i, "US Dollar", 1, None) for i in range(20)] + [(1000.0 + i, "US Dollar", 1.0 + i / 1000, "US Dollar", 9, None) for i in range(20)]
    trans, feeds, units = tables(spark, rows)
    # the received side of feed 9 is anchored by one payment delivered again through feed 1
    again = trans.where("trans_id = 25").selectExpr("1000L as trans_id", *[c for c in trans.columns if c not in ("trans_id", "feed_id", "amount_paid")], "1 as feed_id", "amount_received as amount_paid").select(trans.columns)
    more = trans.unionByName(again).unionByName(again.selectExpr("1001L as trans_id", *trans.columns[1:]))
    g = {r["source"]: r for r in U.source_graph(U.statements(more, feeds), feeds, units).collect()}
    assert g["T|9||p|US Dollar"]["power"] == -3 and g["T|9||r|US Dollar"]["power"] == 0


def test_weak_links_to_anchors_count_beside_many_strong_ones(spark):
    # 70 partners that settle nothing have more links each than the only fixed point has; feed 9 pays in millions, not as its note says
    t0 = dt.datetime(2024, 3, 1)
    rows = [(1.0, f"lunch {i % 70}", 5.0, "US Dollar", 9) for i in range(280)] + [(None, None, 3.0 + i, "US Dollar", 9) for i in range(3)]
    rows += [(None, None, (3.0 + i) * 1e6, "US Dollar", 1) for i in range(3)]
    full = [(i, t0 + dt.timedelta(minutes=i - 3 * (i >= 283)), "1", "A", "2", "B", *r, None, "clash") for i, r in enumerate(rows)]
    _, feeds, units = tables(spark, [])
    trans = spark.createDataFrame(full, TRANS)
    g = {r["source"]: r for r in U.source_graph(U.statements(trans, feeds), feeds, units).collect()}
    assert g["T|9||p|US Dollar"]["power"] == -6 and g["T|9||p|US Dollar"]["estimated"] and g["T|9||p|US Dollar"]["links"] == 3


def test_too_many_pairs_raise(spark, monkeypatch):
    trans, feeds, units = tables(spark, [(5.0, "US Dollar", 5.0, x, 1, None) for x in ("USD", "Usd", "usd", "us dollar", "US dollar")])
    monkeypatch.setattr(U, "MAX_PAIRS", 4)
    with pytest.raises(ValueError, match="pairs"):
        U.source_graph(U.statements(trans, feeds), feeds, units)


def test_empty(spark):
    trans, feeds, units = tables(spark, [])
    assert U.harmonise(trans, feeds, units).count() == 0
