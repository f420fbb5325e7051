"""Host, path and rule against a plain version; the model on labelled URLs that its fit has not seen."""

import random
import re
import zlib

from ledgerline.llm import url_filter


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = m.group(1).translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) if m else ""
    path = m.group(2) if m else ""
    fits = [(len(h + p), h + p) for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_host_path_and_rule(spark):
    r = random.Random(4)
    parts = ["http", "://", "A.net", "example.net", "M.example.net", "example.com", "xexample.com", "org", "q.org", "net", "/", "/en/", "/de/", "/fr/", "?", "#", "é", "", " ", "://"]
    urls = {i: None if i == 0 else "".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for i in range(400)}
    urls |= {400 + i: f"https://{h}{p}{q}" for i, (h, p, q) in enumerate((h, p, q) for h in ("net", "a.net", "www.Example.net", "example.com", "m.example.com", "b.org") for p in ("", "/", "/en/", "/en/x", "/de/y", "/fr/") for q in ("", "?/en/", "#t"))}
    got = {x.page_id: (x.host, x.path, x.rule) for x in url_filter.url_filter(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()}
    assert got == {i: plain(u) for i, u in urls.items()}
    assert {x[2] for x in got.values()} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}


def test_held_out_urls(spark):
    """A quarter of the table, by hash of the URL, is judged by a model of the rest.

    Other URLs with the same words are in the fit: this measures unseen hosts and paths, not unseen words."""
    out = lambda u: zlib.crc32(u.encode()) % 4 == 2
    held = [(u, y) for u, y in url_filter.LABELLED if out(u)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)], "page_id long, url string")
    got = {x.page_id: x.verdict == "block" for x in url_filter.url_filter(pages, labelled=[x for x in url_filter.LABELLED if not out(x[0])]).collect()}
    right = sum(got[k] == bool(y) for k, (_, y) in enumerate(held))
    print("held-out:", right, "of", len(held))
    assert len(held) >= 15 and right >= 0.7 * len(held)
