from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.operators import enrich, kpi, offers, pages, quality, share
from perkloom.operators.skew import skew_lookup
from perkloom.plans import registry
from perkloom.schemas import BENEFIT, COLLECTED
from perkloom.sources import catalog, collected, store


def read(spark, *headlines):
    df = spark.createDataFrame([(i, "עסק", h) for i, h in enumerate(headlines)], "i int, merchant_name string, headline string")
    return offers.read_headlines(df).orderBy("i").collect()


@pytest.mark.parametrize(
    "headline, type_, value, confidence",
    [
        # one line per rule, with figures of its own
        ("Kettle House • 7.25% הנחה בקופה", "percent", 7.25, 0.8),
        ("8% החזר כספי על כל תה", "cashback", 8.0, 0.8),
        ("בית תה • 1 + 1 על קנקנים", "bogo", 0.0, 0.72),
        ("שובר בשווי 120₪ ב-90₪", "gift_card", 120.0, 0.45),
        ("450% הנחה", "percent", 0.0, 0.3),
        *[(f"סדנת תה • הטבה: 35 {unit} הנחה", "fixed", 35.0, 0.75) for unit in ("ש״ח", 'ש"ח', "שח", "שקל")],
        ("עלים • 100% אורגני • 6% הנחה", "percent", 6.0, 0.8),
        ("עלים • 100% כשר • 9% הנחה", "percent", 9.0, 0.8),
        ('קנקנים • תו קניה "חליטה 100%" בשווי ₪80', "gift_card", 80.0, 0.75),
        ("Teapots • 2.5%", "percent", 2.5, 0.8),
        ("Teapots • 15% על שלושה קנקנים", "percent", 15.0, 0.8),
        ("סדנת תה • עד 44% הנחה", "percent", 44.0, 0.5),
        ("11% הנחה בתוקף עד 30/11/2028", "percent", 11.0, 0.8),
        ("החל מ 65₪ הנחה", "fixed", 65.0, 0.45),
    ],
)
def test_headlines(spark, headline, type_, value, confidence):
    r = read(spark, headline)[0]
    assert (r.type, r.value, r.confidence_score) == (type_, value, confidence)


def test_headlines_without_a_value(spark):
    rows = read(spark, "בית תה • כשר", "", None, "בית תה • גינה • 100% טבעוני", "שוברים לתה")
    assert [r.type for r in rows] == [None] * 5
    df = spark.createDataFrame([("עסק", "כשר")], "merchant_name string, headline string")
    assert offers.skipped_offers(offers.read_headlines(df)).first().reason == V.REASON_NO_VALUE


def test_stated_conditions_only(spark):
    dated, dangling, impossible, short, online = read(
        spark, "11% הנחה בתוקף עד 30/11/2028", "12% הנחה בתוקף עד -", "13% הנחה עד 30/2/2028",
        "14% הנחה עד 9.7.27", "15% קאשבק אונליין",
    )
    end = lambda r: r.valid_until and r.valid_until.strftime("%Y-%m-%d %H:%M")
    assert [end(r) for r in (dated, dangling, impossible, short)] == [
        "2028-11-30 20:59", None, None, "2027-07-09 20:59",
    ]
    assert (online.channel, dated.channel, dated.requires_voucher) == ("online", None, None)
    assert "תקרה" in read(spark, "סדנת תה • עד 44% הנחה")[0].confidence_reason
    df = spark.createDataFrame([("Leaf", "15% קאשבק אונליין")], "merchant_name string, headline string")
    out = offers.extracted_offers(offers.read_headlines(df)).first()
    stated = {k: v for k, v in out.conditions.asDict().items() if v is not None}
    assert stated == {"channel": "online", "raw_text_summary": "15% קאשבק אונליין"}


DOMAINS = [
    ("pots", "pots.example", 1), ("cups", "cups.example", 2), ("mall_shop", "shop.mall.example", 3),
    ("mall", "mall.example", 4), ("long_name", "www.POTS.example", 5), ("second", "mall.example", 6),
]


def test_lookup_keeps_every_row_whatever_is_split(spark):
    left = spark.createDataFrame(
        [(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 7}") for i in range(200)], "i int, k string"
    )
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 3), ("unused", 4)], "k string, v int")
    for how in ("left", "inner"):
        plain = left.join(right, "k", how).select("i", "k", "v")
        split = skew_lookup(left, right, ["k"], ["i"], how, piece_rows=9).select("i", "k", "v")
        assert sorted(plain.collect(), key=str) == sorted(split.collect(), key=str)


@pytest.mark.parametrize("bounds", [{}, {"piece_rows": 1}])
def test_share_resolution(spark, bounds):
    texts = {
        "https://eu.pots.example/t/3": "long_name", "https://shop.mall.example/basket": "mall_shop",
        "https://mall.example/map": "mall", "https://teapots.example": None, "https://other.example": None,
        "no link": None, "this one http://WWW.Cups.example?q=2 please": "cups",
    }
    shares = spark.createDataFrame([(t,) for t in texts], "text string")
    domains = spark.createDataFrame(DOMAINS, "merchant_id string, domain string, seq int")
    got = share.resolve_shares(shares, domains, **bounds).collect()
    assert {r.text: r.merchant_id for r in got} == texts


def test_kpi(spark):
    kinds = ["notification_sent"] * 4 + ["notification_opened"] + ["share_resolved"]
    events = spark.createDataFrame(
        [(i, 1, k) for i, k in enumerate(kinds)] + [(9, 2, "benefit_redeemed")], "event_id int, user_id int, kind string"
    )
    got = {r.user_id: r for r in kpi.against_target(kpi.kpis(events, ["user_id"])).collect()}
    assert got[1].decision_impact_ratio == 0.25 and not got[1].met and got[1].points_below == 5
    assert got[2].decision_impact_ratio is None and got[2].points_below is None and got[2].fill == 0.0
    assert got[None].decision_impact_ratio == 0.5 and got[None].met


def test_collected_lines(spark, tmp_path):
    line = lambda **k: json.dumps({"site": "s", **k}, ensure_ascii=False)
    text = "\n".join(
        [
            line(offer_url="u1", terms_text="first", content_hash="a", verified_at="2026-08-08T21:49:14.206Z"), "",
            line(offer_url="u2", terms_text="other", sections={"חשוב לדעת": "x"}, extra=1),
            line(offer_url="u1", terms_text="last", content_hash="b"), line(offer_url="u3"),
            line(terms_text="no address"), "5", '{"offer_url":"u4","terms_te',
        ]
    )
    (tmp_path / "Fly-Card.jsonl").write_text(text, encoding="utf-8")
    (tmp_path / "Unknown.jsonl").write_text(line(offer_url="u1", terms_text="elsewhere"), encoding="utf-8")
    rows = collected.read_collected(spark, str(tmp_path))
    assert {(r.list, r.offer_url, r.terms_text) for r in rows.collect()} == {
        ("Fly-Card", "u1", "last"), ("Fly-Card", "u2", "other"), ("Unknown", "u1", "elsewhere"),
    }
    mapped = collected.with_program(rows, collected.list_programs(spark))
    assert {(r.offer_url, r.program_id) for r in mapped.collect()} == {("u1", "fly_card"), ("u2", "fly_card")}


def test_line_order_holds_across_file_splits(spark, tmp_path):
    text = "\n".join(json.dumps({"offer_url": f"u{i % 3}", "terms_text": f"{i}"}) for i in range(3000))
    (tmp_path / "a.jsonl").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = collected.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        got = {r.offer_url: r.terms_text for r in collected.read_collected(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"u0": "2997", "u1": "2998", "u2": "2999"}


def test_listing_rows(spark):
    rows = spark.createDataFrame(
        [("L", 7, "חנות", None, "5% הנחה", ""), ("L", 8, "ב", "קפה", "נחמד", "רחוב"), ("L", 9, "ג", "קפה", "מתנה", "רחוב")],
        "list string, id int, bizname string, category string, bestsubcat string, address string",
    )
    got = collected.from_listing(rows).orderBy("offer_url").collect()
    assert [r.offer_url[-6:] for r in got] == ["page/7", "page/9"]
    text = "בית העסק: חנות\nקטגוריה: \nההטבה כפי שמופיעה באיזי: 5% הנחה"
    assert got[0].terms_text == text
    assert got[0].content_hash == hashlib.sha256(text.encode()).hexdigest()
    assert got[1].terms_text.endswith("\nכתובת: רחוב")


def test_binding_terms_lead_the_page(spark):
    row = {f.name: None for f in COLLECTED.fields} | {
        "merchant_name": "חנות", "terms_text": "הכל", "sections": {"על": "א", "חשוב לדעת": "מינימום 100"},
    }
    df = spark.createDataFrame([tuple(row[f.name] for f in COLLECTED.fields)], COLLECTED)
    assert pages.offer_page_text(df).first().page_text == (
        "בית העסק: חנות\n\nחשוב לדעת:\nמינימום 100\n\nעל:\nא\n\nטקסט מלא של העמוד:\nהכל"
    )


def test_extraction_files(spark, tmp_path):
    offer = {"merchant_name": "x", "type": "percent", "value": 5, "confidence_score": 0.9,
             "confidence_reason": "r", "conditions": {"raw_text_summary": "t", "valid_days": [1]}}
    (tmp_path / "one.json").write_text(json.dumps({"page_summary": "p", "benefits": [offer, offer]}, indent=1))
    rows = collected.read_extraction(spark, str(tmp_path)).collect()
    assert [(r.seq, r.value, r.conditions.valid_days) for r in rows] == [(0, 5.0, [1]), (1, 5.0, [1])]
    sources = spark.createDataFrame([("riders",)], "program_id string")
    with pytest.raises(ValueError):
        collected.select_program(sources, "nobody")


def _catalog(folder, **benefit):
    base = {"id": "b1", "program_id": "p", "merchant_id": "m", "merchant_name": "M", "type": "percent", "value": 5,
            "conditions": {"raw_text_summary": "t"}, "source_url": "https://x", "confidence_score": 0.9,
            "last_verified_at": "2026-08-01T10:00:00Z"}
    tables = {
        "benefits": [{**base, **benefit}], "programs": [{"id": "p", "name": "P", "category": "credit_card"}],
        "merchants": [{"id": "m", "name": "M", "domains": ["m.il"], "venue_ids": ["v"], "branches": [{"lat": 32.0, "lng": 34.8}], "categories": []}],
        "venues": [{"id": "v", "name": "V", "city": "C", "lat": 32.0, "lng": 34.8, "radius_m": 200}],
    }
    for name, rows in tables.items():
        (folder / f"{name}.json").write_text(json.dumps(rows, indent=1))


def test_strict_catalog(spark, tmp_path):
    _catalog(tmp_path)
    tables = catalog.read_catalog(spark, str(tmp_path))
    row = tables["benefits"].first()
    assert row.reviewed_by_human is False and row.conditions.min_spend is None
    assert catalog.branches_of(tables["merchants"]).count() == 1
    assert catalog.domains_of(tables["merchants"]).first().domain == "m.il"
    assert catalog.members_of(tables["merchants"]).first().venue_id == "v"


@pytest.mark.parametrize("fault, said", [
    ({"type": "odd"}, "benefits.type: 1"), ({"surprise": 1}, "surprise"), ({"value": -1}, "benefits.value: 1"),
    ({"conditions": {"raw_text_summary": "t", "whim": 2}}, "conditions.whim"),
    ({"conditions": {"raw_text_summary": "t", "valid_hours": {"from": "09:00", "to": "10:00", "tz": "x"}}}, "valid_hours.tz"),
    ({"id": "", "merchant_name": ""}, "2 faults"),
])
def test_a_malformed_catalog_fails_the_load(spark, tmp_path, fault, said):
    _catalog(tmp_path, **fault)
    with pytest.raises(catalog.CatalogError, match=said):
        catalog.read_catalog(spark, str(tmp_path))


def test_a_catalog_abroad_loads_and_is_only_doubtful(spark, tmp_path):
    """Bounds of the country, of percentages and of addresses are not the reader's."""
    _catalog(tmp_path, value=140, source_url="ftp://x")
    venues = [{"id": "v", "name": "V", "city": "C", "lat": 48.0, "lng": 2.0, "radius_m": 5000}]
    (tmp_path / "venues.json").write_text(json.dumps(venues))
    tables = catalog.read_catalog(spark, str(tmp_path))
    doubts = quality.row_rules(tables["benefits"], tables["programs"], tables["venues"])
    assert {r["rule"] for r in doubts.collect()} == {"percent_over_100", "source_url", "lat", "lng", "radius"}


def test_every_fault_of_a_catalog_is_kept(spark, tmp_path):
    _catalog(tmp_path)
    rows = [{"id": f"m{i}", "name": "", "categories": ["nonsense"]} for i in range(40)]
    (tmp_path / "merchants.json").write_text(json.dumps(rows))
    with pytest.raises(catalog.CatalogError, match="80 faults") as error:
        catalog.read_catalog(spark, str(tmp_path))
    folder = str(error.value).rsplit("all of them in ", 1)[1]
    assert spark.read.parquet(folder).count() == 80


def test_store_versions(spark, tmp_path):
    root = f"{tmp_path}/benefits"
    assert store.read_table(spark, root, BENEFIT).isEmpty()
    from tests.helpers import benefit, catalog as rows

    first = rows(spark, benefit(1)).drop("seq")
    store.replace_table(first, root)
    # The next version is computed from the one it replaces.
    again = store.read_table(spark, root, BENEFIT)
    store.replace_table(again.unionByName(rows(spark, benefit(2)).drop("seq")), root)
    assert {r.id for r in store.read_table(spark, root, BENEFIT).collect()} == {"b1", "b2"}


def test_an_incomplete_crawl_replaces_nothing(spark, tmp_path):
    root = f"{tmp_path}/lists"
    rows = lambda *r: spark.createDataFrame(r, "list string, offer_url string")
    crawl = lambda *r: spark.createDataFrame(r, "list string, complete boolean")
    store.write_lists(rows(("a", "1"), ("b", "2"), ("c", "3")), crawl(("a", True), ("b", True), ("c", True)), root)
    store.write_lists(rows(("a", "9"), ("b", "8")), crawl(("a", True), ("b", False), ("c", True)), root)
    got = {(r.list, str(r.offer_url)) for r in spark.read.parquet(root).collect()}
    assert got == {("a", "9"), ("b", "2"), ("c", "3")}


def test_mint_programs(spark):
    titles = spark.createDataFrame(
        [(1, "HAPPY-hour", "x"), (2, "My-MAX", "My MAX"), (3, "Old", "x"), (4, "shopClub", "חנות"), (5, "shop-club", "שני")],
        "seq int, slug string, title string",
    )
    programs = spark.createDataFrame([("old",)], "id string")
    got = {r.id: r for r in enrich.mint_programs(titles, programs).collect()}
    assert set(got) == {"my_max", "shop_club"}
    assert got["my_max"].parent_id == "max" and got["shop_club"].name == "חנות" and not got["shop_club"].sure


def test_registry_is_complete():
    assert set(registry.ORACLE) == set(registry.QUERIES)
    assert len(V.LIST_PROGRAMS) == 72
