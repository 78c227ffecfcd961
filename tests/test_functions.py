from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from placeweave.functions import geo, keys, labels, nearby, text, urls


def test_names_phones_and_addresses(one):
    assert one(text.fold_name(F.lit("割烹 朝霧庵 本店"))) == "朝霧庵"
    assert one(text.fold_phone(F.lit("+81 312-34-5678"))) == "0312345678"
    assert one(text.fold_phone(F.lit("０３１２−34−５６７８"))) == "0312345678"
    assert one(text.fold_text(F.lit("Straße ㍿ Ⅳ café"))) == "strasse株式会社ivcaf"
    assert one(text.fold_address(F.lit("〒314-0116 長野県松本市１番地２号"))) == "長野県松本市12"


@pytest.mark.parametrize("left,right", [
    ("tide", "diet"), ("diet", "tide"), ("abcdef", "abxdef"), ("", "a"), ("abc", "xabcx"), ("朝霧庵", "清水家"),
])
def test_likeness(one, left, right):
    if not left or not right:
        expected = 0.0
    elif left in right or right in left:
        short, long = sorted((len(left), len(right)))
        expected = 0.88 + 0.12 * short / long
    else:
        expected = SequenceMatcher(None, left, right).ratio()
    assert one(text.likeness(F.lit(left), F.lit(right))) == pytest.approx(expected)


def test_distance(one):
    metres = one(geo.distance_m(F.lit(35.0), F.lit(139.0), F.lit(35.001), F.lit(139.0)))
    assert metres == pytest.approx(111.2, rel=0.02)
    missing = F.lit(None).cast("double")
    assert one(geo.distance_m(missing, F.lit(139.0), F.lit(35.0), F.lit(139.0))) is None


def test_website_keys(one):
    assert one(urls.website_key(F.lit("HTTP://www.Example.com:80//a//b/?q#f"))) == "https://example.com/a/b"
    assert one(urls.website_key(F.lit("https://x.jp:8443/"))) == "https://x.jp:8443/"
    assert one(urls.website_key(F.lit("ftp://a"))) == ""
    assert one(urls.website_key(F.lit("http://a:b/"))) == ""


def test_listing_urls(one):
    page = "https://tabelog.com/tokyo/A1301/A130101/13000001/"
    assert one(urls.listing_url(F.lit("https://tabelog.com/en/tokyo/A1301/A130101/13000001/dtlrvwlst/"))) == page
    wrapped = "https://duckduckgo.com/l/?uddg=https%3A%2F%2Ftabelog.com%2Ftokyo%2FA1301%2FA130101%2F13000001%2F&rut=1"
    assert one(urls.listing_url(F.lit(wrapped))) == page
    assert one(urls.listing_url(F.lit("https://example.com/%zz"))) is None
    assert one(urls.area_path(F.lit(page))) == "tokyo/A1301/A130101"


def test_labels(one):
    said = "百名店二〇二四年，三千五百二十元，四點五分，一萬二千"
    assert one(labels.ascii_numerals(F.lit(said))) == "百名店2024年，3520元，4.5分，12000"
    assert one(labels.translate_label(F.lit("割烹・小料理、寿司"))) == "割烹／小料理、壽司"
    paid = one(labels.payment_of(F.lit("カード可（VISA） 電子マネー不可 QRコード決済可（PayPay）")))
    assert paid["cards"]["accepted"] and paid["cards"]["details"] == "VISA"
    assert not paid["electronic_money"]["accepted"] and paid["qr_code"]["details"] == "PayPay"
    entry = one(labels.award_entry(F.lit("食べログ ハンバーガー TOKYO 百名店 2023 選出店"), F.lit("")))
    assert (entry["category"], entry["area"], entry["year"]) == ("漢堡", "TOKYO", 2023)


def test_list_cards_and_stations(one):
    assert one(keys.list_name(F.lit("Noeud.TOKYO·開啟過的連結"))) == "Noeud.TOKYO"
    assert one(keys.list_name(F.lit("La Biographie···"))) == "La Biographie···"
    assert one(nearby.station_label(F.lit("JR山手線「新宿駅」"))) == "新宿站"
    assert one(nearby.locality(F.lit("東京都中央区銀座1-1"))) == "中央区"
    assert one(nearby.price_midpoint(F.lit("￥20,000～￥29,999"))) == 24999.5


def test_country(one):
    def country(address="", lat=None, lng=None, source="place"):
        return one(geo.country_of(F.lit(""), F.lit(""), F.lit(address), F.lit(lat), F.lit(lng), F.lit(source)))

    assert country("東京都中央区") == "japan"
    assert country(lat="51.5", lng="0.1") == "not_japan"
    assert country(lat="51.5", lng="0.1", source="viewport") == "unknown"
    assert country(lat="35.0", lng="139.0") == "unknown"


@pytest.mark.parametrize("number", ["5.0E-4", "-0.0007", "0.00012345678901234567", "0.0001", "0.00005", "-1.25e-7", "1e-12", "12345678.25", "0.5", "-35.75"])
def test_number_text_has_few_exponents(one, number):
    from placeweave.functions.numbers import number_text

    assert one(number_text(F.lit(number))) == repr(float(number))


def test_ratios_of_a_batch_equal_difflib():
    """All pairs at once, with ties, empty and long texts, and characters of every width."""
    import random

    from placeweave.functions.ratio import matching_ratios

    draw = random.Random(5)

    def texts(letters):
        return ["".join(draw.choices(letters, k=draw.choice([0, 1, 2, 9, 30, 120, 199, 200, 230]))) for _ in range(150)]

    for letters in ("ab", "abcdefgh 1", "鮨あい𠮷ab0", [chr(i) for i in range(32, 700)]):
        left, right = texts(letters), texts(letters)
        assert matching_ratios(left, right).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]
    assert matching_ratios([], []).size == 0
