"""Hosts of shared links, against what browsers make of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from perkloom.functions.share import shared_host

HOSTS = {
    # signs in the path that stricter parsers refuse
    "https://shop.co.il/100%-off": "shop.co.il",
    "https://shop.co.il/a?x={1}|2": "shop.co.il",
    "https://shop.co.il/sale[1]": "shop.co.il",
    "shop.co.il/sale 50% off": "shop.co.il",
    "https://shop.co.il?x": "shop.co.il",
    "https://shop.co.il#frag:1@x": "shop.co.il",
    "https://my_shop.co.il/x": "my_shop.co.il",
    # back slashes, missing and extra slashes
    "https://shop.co.il\\x": "shop.co.il",
    "https:///shop.co.il/x": "shop.co.il",
    "https:/\\/shop.co.il": "https",  # no link, so read as one without scheme
    # names, passwords, ports
    "https://user:pass@shop.co.il:8443/x": "shop.co.il",
    "https://a@b@shop.co.il/x": "shop.co.il",
    "https://shop.co.il:": "shop.co.il",
    "https://shop.co.il:00080/": "shop.co.il",
    "https://shop.co.il:65536/": None,
    "https://shop.co.il:8a/": None,
    "https://user@/x": None,
    "https://:80/x": None,
    "https://shop.co.il/x@other.example": "shop.co.il",
    # percent signs in the host
    "https://sh%6Fp.co.il/": "shop.co.il",
    "https://shop%2Eco.il/": "shop.co.il",
    "https://shop+x.co.il/": "shop+x.co.il",
    "https://sh%2Bop.co.il/": "sh+op.co.il",
    "https://sh%zzop.co.il/": None,
    "https://sh%20op.co.il/": None,
    "https://shop%.co.il/": None,
    # case, www, signs after the link
    "תראה https://WWW.Shop.CO.IL/web": "shop.co.il",
    "HTTPS://shop.co.il": "shop.co.il",
    "see https://shop.co.il, now": "shop.co.il,",
    "see https://shop.co.il. Now": "shop.co.il.",
    "(https://shop.co.il/x)": "shop.co.il",
    'a "https://shop.co.il" b': "shop.co.il",
    "https://shop.co.il\u00a0next": "shop.co.il",
    "https://shop.co.il\u3000next": "shop.co.il",
    "first http://a.example then http://b.example": "a.example",
    # international names
    "https://בוקר.co.il/x": "xn--5dbegf.co.il" if False else None,
    "https://bücher.example/": "xn--bcher-kva.example",
    "https://BÜCHER.example/": "xn--bcher-kva.example",
    "https://bu\u0308cher.example/": "xn--bcher-kva.example",
    "https://faß.example/": "xn--fa-hia.example",
    "https://b%C3%BCcher.example/": "xn--bcher-kva.example",
    "https://ｓｈｏｐ.co.il/": "shop.co.il",
    "https://shop\u3002co\uff0eil/": "shop.co.il",
    "https://sh\u00adop.co.il/": "shop.co.il",
    "https://xn--bcher-kva.example/": "xn--bcher-kva.example",
    "https://XN--BCHER-KVA.example/": "xn--bcher-kva.example",
    "https://xn--/": None,
    "https://xn--a.example": None,
    "https://日本.example/": "xn--wgv71a.example",
    "https://a\ufffdb.example/": None,
    "https://\u0301a.example/": None,
    "https://אב1a.example/": None,  # both directions in one label
    # numbers are addresses
    "https://192.168.0.1/x": "192.168.0.1",
    "https://192.168.1/": "192.168.0.1",
    "https://0x7f.1/": "127.0.0.1",
    "https://0300.0250.1/": "192.168.0.1",
    "https://2130706433/": "127.0.0.1",
    "https://1.2.3.4./": "1.2.3.4",
    "https://256.1.1.1/": None,
    "https://1.2.3.4.5/": None,
    "https://4294967296/": None,
    "https://09.1.1.1/": None,
    "https://shop.09/": None,
    "https://1.shop.co.il/": "1.shop.co.il",
    "50": "0.0.0.50",
    "https://[::1]:80/x": "[::1]",
    "https://[2001:DB8:0:0:1:0:0:1]/": "[2001:db8::1:0:0:1]",
    "https://[::1.2.3.4]/": "[::102:304]",
    "https://[::1": None,
    "https://[::g]/": None,
    "https://a[b].example/": None,
    # whole texts
    "terminalx.com": "terminalx.com",
    "  shop.co.il:8080/x \n": "shop.co.il",
    "sho\np.co.il": "shop.co.il",
    "שלום עולם": None,
    "hello": "hello",
    "a|b": None,
    "": None,
    "   ": None,
    "look: myapp://Host.Name/x": None,
    "myapp://Host.Name:80/x": "host.name",
    "myapp://a b/x": None,
    "myapp:///x": None,
    "1app://host/x": None,
    "file://Host/x": "host",
    "file://localhost/x": None,
    "file:///c:/x": None,
    "ftp://files.example/x": "files.example",
}
HOSTS["https://בוקר.co.il/x"] = "xn--" + "בוקר".encode("punycode").decode() + ".co.il"


def test_hosts(spark):
    df = spark.createDataFrame(list(HOSTS.items()), "text string, want string")
    wrong = df.withColumn("got", shared_host(F.col("text"))).where("NOT (got <=> want)").collect()
    assert not wrong


def test_nothing_and_long_texts(spark):
    texts = {
        None: None, "https://" + "a" * 100_000: "a" * 100_000, "https://" + "[" * 100_000: None,
        "https://" + "a@" * 50_000 + "shop.co.il": "shop.co.il", "x " * 100_000: None,
        "https://shop.co.il/" + "[%" * 50_000: "shop.co.il", "https://" + "0" * 5_000 + "1/": "0.0.0.1",
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.host for r in df.select("text", shared_host(F.col("text")).alias("host")).collect()}
    assert got == texts


@pytest.mark.parametrize("name", ["bücher", "日本語", "אבג", "ßa", "παράδειγμα", "a\u200bb"])
def test_international_names_come_back(name):
    from perkloom.functions.hosts import international

    shown = international(name)
    assert shown and shown.isascii()
    if shown.startswith("xn--"):
        assert international(shown) == shown
        assert shown[4:].encode().decode("punycode") == name


def test_plain_links_are_read_without_python(spark):
    from perkloom.functions import hosts

    links = [t for t in HOSTS if t.startswith("http")]
    df = spark.createDataFrame([(t,) for t in links], "url string")
    name = F.lower(F.regexp_extract("url", hosts.PLAIN, 1))
    plain = df.where((name != "") & ~name.rlike(hosts.NOT_PLAIN)).select("url", name.alias("name")).collect()
    assert len(plain) > 5
    assert all(hosts.host_of(r.url) == r.name for r in plain)
