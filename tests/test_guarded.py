"""Address ranges against the standard library, and fetching with refusals, errors and stored texts."""

import hashlib
import ipaddress
import random
import sys

from pyspark import cloudpickle

from sijill.sources import guarded as G

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors don't import this module


def closed(text):
    try:
        x = ipaddress.ip_address(text)
    except ValueError:
        return None
    x = getattr(x, "ipv4_mapped", None) or x
    return x.is_private or x.is_loopback or x.is_link_local or x.is_reserved or x.is_multicast


def spellings():
    rng = random.Random(4)
    newer = "3fff::/20"  # closed here; the library knows it only since a later release
    for block in (*[c for c in G.CLOSED if c != newer], *G.OPEN, "100.64.0.0/10", "2000::/3", "::ffff:0:0/96", "64:ff9b::/96"):
        n = ipaddress.ip_network(block)
        for k in (int(n[0]) - 1, int(n[0]), int(n[-1]), int(n[-1]) + 1):
            if 0 <= k < 1 << n.max_prefixlen:
                x = type(n[0])(k)
                yield from (str(x), x.exploded)
    for _ in range(300):
        x, y = ipaddress.IPv4Address(rng.getrandbits(32)), ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([(1 << 128) - 1, 0xFFFF << 112 | 0xFFFF, (1 << 64) - 1]))
        yield from (str(x), f"::ffff:{x}", f"::FFFF:{x}", f"64:ff9b::{x}", str(y), y.exploded.upper())
    yield from ("", "host", "1.2.3", "1.2.3.256", "01.2.3.4", "1.2.3.4.5", ":", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "::g", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::1.2.3.256", "::1.2.3", "1.2.3.4::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:")


def test_ranges_match_the_standard_library(spark):
    said = sorted(set(spellings()))
    found = {r["a"]: r["closed"] for r in G.closed(spark.createDataFrame([(x,) for x in [*said, None]], "a string"), "a").collect()}
    assert {x: found[x] for x in said if found[x] != closed(x)} == {x: closed(x) for x in said if found[x] != closed(x)} == {}
    assert found[None] is None and sum(v is True for v in found.values()) > 100 < sum(v is False for v in found.values())


def resolve(host):
    if host == "nowhere.a.org":
        raise OSError("no such host")
    return {"a.org": ["93.184.216.34", "2606:2800:220:1::1"], "inner.a.org": ["93.184.216.34", "10.0.0.7"], "mapped.a.org": ["::ffff:127.0.0.1"], "empty.a.org": [], "odd.a.org": ["not an address"]}[host]


def get(url, etag, modified):
    if url.endswith("down"):
        raise ConnectionError("refused")
    if etag == "e1" or modified == "m1":
        return 304, url, None, None, "e2" if etag else None, None
    if url.endswith("missing"):
        return 404, url, "text/html", b"no", None, None
    return 200, url + "/final.txt", "text/plain", b"new  text", "e9", "m9"


def test_collected_and_stored(spark):
    urls = ["https://a.org/new", "https://a.org/old", "https://a.org/dated", "https://a.org/down", "https://a.org/missing", "https://inner.a.org/x", "https://mapped.a.org/x", "https://nowhere.a.org/x", "https://empty.a.org/x", "https://odd.a.org/x"]
    urls += ["http://a.org/x", "https://b.org/x", "https://aa.org/x", "https://10.0.0.7/x", "https://[::1]/x", "ftp://a.org", "not a url", " ", None, "https://a.org/new"]
    old = [("https://a.org/old", "e1", "m0", "text/html", "kept", "h"), ("https://a.org/dated", None, "m1", "text/html", "kept too", "h2"), ("https://a.org/down", "x", None, None, "stays", "h3"), ("https://c.org", None, None, None, "other", "h4")]
    state = spark.createDataFrame(old, G.STATE)
    results = G.collected(spark.createDataFrame([(u,) for u in urls], "url string"), state, ("a.org", "10.0.0.7", "::1"), get, resolve).persist()
    found = {r["url"]: r for r in results.collect()}
    assert len(found) == len(set(urls)) == results.count()
    new = found["https://a.org/new"]
    assert (new["status"], new["final_url"], new["text"], new["etag"], new["modified"], new["sha256"]) == ("ok", "https://a.org/new/final.txt", "new text", "e9", "m9", hashlib.sha256(b"new text").hexdigest())
    assert [tuple(found[u][c] for c in ("status", "text", "etag", "modified", "sha256")) for u in ("https://a.org/old", "https://a.org/dated")] == [("not_modified", "kept", "e2", "m0", "h"), ("not_modified", "kept too", None, "m1", "h2")]
    assert (found["https://a.org/down"]["error_code"], found["https://a.org/down"]["warnings"]) == ("fetch_failed", ["Failed to fetch source URL: refused"])
    assert found["https://a.org/missing"]["error_code"] == "http_404" and found["https://a.org/missing"]["text"] is None
    assert found["https://odd.a.org/x"]["status"] == "ok"  # what isn't an address doesn't count
    assert {u for u in found if found[u]["error_code"] == "source_not_allowed"} == {*urls[5:9], *urls[10:17]}
    assert {found[u]["error_code"] for u in (" ", None)} == {"empty_source_url"}
    after = {r["url"]: (r["text"], r["etag"]) for r in G.stored(state, results).collect()}
    assert after == {"https://a.org/new": ("new text", "e9"), "https://odd.a.org/x": ("new text", "e9"), "https://a.org/old": ("kept", "e2"), "https://a.org/dated": ("kept too", None), "https://a.org/down": ("stays", "x"), "https://c.org": ("other", None)}
