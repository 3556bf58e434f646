"""Site style trees and WARC archives."""

import base64
import hashlib
import math
import random

import pytest

from knownby.llm import site_style_tree as tree
from knownby.llm import warc

ARTICLE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/x>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1><p><b>One  two<br><p>three&nbsp;four<section class='comments'>me too</section></article><footer>end</footer></body></html>"


def test_article_without_its_surroundings():
    assert tree.extract(ARTICLE) == "Head & line\n\nOne two\n\nthree four"


def test_page_without_a_main_region():
    page = "<body><header>site</header><div class=sidebar>s</div><div><p>a &lt; b<p>c<ul><li>1<li>2</ul></div><form>f</form><div id=cookie-notice>ok?</div><footer>z"
    assert tree.extract(page) == "a < b\n\nc\n\n1\n\n2"


def test_broken_and_empty_markup():
    assert tree.extract("") == ""
    assert tree.extract("just text") == "just text"
    assert tree.extract("<p>cut &am") == "cut &am"
    assert tree.extract("<p>a</p></div></p><p title='x>y'>b</p><p") == "a\n\nb"
    assert tree.extract("<div>" * 3000 + "deep" + "<b>" * 3000 + "er") == "deeper"
    assert tree.extract("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert tree.extract("<script>never closed <p>x") == ""


def site(n):
    pick = random.Random(4)
    for i in range(n):
        body = " ".join(str(pick.random()) for _ in range(5))
        yield i, f"http://www.site.example/{i}", f"<body><div class=top>Welcome to the site</div><div class=text><p>{body}</p></div><div class=low>All rights reserved</div></body>"


def test_branches_that_are_alike_on_all_pages_of_a_host_go(llm):
    rows = [*site(30), (100, "http://other.example/", "<body><div class=top>Welcome to the site</div></body>"), (101, None, None), (102, "::bad", ""), (102, "::bad", "")]
    pages = llm.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, pruned string")
    got = {r.page_id: r for r in tree.extract_pages(pages).collect()}
    for i, _, html in site(30):
        assert got[i].text == html.split("<p>")[1].split("</p>")[0]
        assert got[i].n_chars == len(got[i].text)
    assert got[100].text == "Welcome to the site"  # one page tells nothing
    assert got[101].text == "" and got[102].n_chars == 0
    assert tree.extract_pages(pages).count() == len(rows)


def test_copies_of_an_article_are_kept(llm):
    pages = llm.createDataFrame([(i, f"http://a.example/{i}", ARTICLE) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in tree.extract_pages(pages).collect()} == {tree.extract(ARTICLE)}


def texts(llm, pages):
    table = llm.createDataFrame([(i, f"http://h.example/{i}", html) for i, html in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in tree.extract_pages(table).orderBy("page_id").collect()]


def test_main_text_among_many_constant_branches_stays(llm):
    same = "".join(f"<div class=c{k}><p>Constant {k}</p></div>" for k in range(12))
    plain = [f"<html><body><div class=wrap>{same}<div class=text><p>Body {i} <b>bold {i}</b> end</p></div></div></body></html>" for i in range(20)]
    assert texts(llm, plain) == [f"Body {i} bold {i} end" for i in range(20)]
    # Copies of one article: nothing around it varies but what is removed anyway.
    copies = [f"<html><body><div class=wrap>{same}<article><p>The article</p></article></div><footer>{i}</footer></body></html>" for i in range(20)]
    assert texts(llm, copies) == ["The article"] * 20


def test_constant_branches_inside_a_main_region_go(llm):
    pages = [f"<body><article><h1>Head {i}</h1><p>Body {i}</p><div class=licence><p>Text under licence</p></div></article><p>{i}</p></body>" for i in range(20)]
    assert texts(llm, pages) == [f"Head {i}\n\nBody {i}" for i in range(20)]
    # One article on many pages that differ around it is one text, and a region is never emptied.
    copies = [f"<body><div>Read {i} times</div><article><h1>Head</h1><p>Body</p></article></body>" for i in range(20)]
    assert texts(llm, copies) == ["Head\n\nBody"] * 20
    bare = [*pages, "<body><article><div class=licence><p>Text under licence</p></div></article><p>x</p></body>"]
    assert texts(llm, bare)[-1] == "Text under licence"


def test_any_depth_and_any_number_of_pages(llm):
    deep = [f"<body><div class=low>Notice</div>{'<div>' * 150}<p>Body {i}</p>" for i in range(12)]
    assert texts(llm, deep) == [f"Body {i}" for i in range(12)]
    assert texts(llm, deep[:2]) == ["Body 0", "Body 1"]
    assert texts(llm, deep[:1]) == ["Notice\n\nBody 0"]
    # A branch of few pages of a large host.
    rare = [f"<body>{'<div class=rare>Rare</div>' if i < 3 else ''}<p>Body {i}</p></body>" for i in range(12)]
    assert texts(llm, rare) == [f"Body {i}" for i in range(12)]
    # One of seven pages differs: not alike enough; one of 40 is.
    few, many = ([f"<body><div class=low>Notice{' today' if i == 3 else ''}</div><p>Body {i}</p></body>" for i in range(n)] for n in (7, 40))
    assert texts(llm, few)[0] == "Notice\n\nBody 0" and texts(llm, many)[0] == "Body 0"


def test_class_names_never_take_a_main_region():
    for page in ('<div class="site has-sidebar"><article>A b</article></div>', '<article class="post comments-open">A b</article>', '<main class="content no-banner">A b</main>',
                 '<div class=sidebar><p>x</p><div><article>A b</article></div></div><div class="sidebar-left">no</div>', '<div id=widget-1><div class="promo box"><main>A b</main></div></div>'):
        assert tree.extract(page) == "A b"
    assert tree.extract('<article>A b<div class="share-price">9</div><div class="share-buttons">tell</div></article>') == "A b\n\n9"
    assert tree.extract('<article>A<section class=comments><article class="comment">me</article></section></article>') == "A"
    assert tree.extract("<nav><article>in a menu</article></nav><p>b") == "b"


def test_lists_and_long_attributes_are_linear():
    import time

    began = time.perf_counter()
    assert tree.extract("<ul>" + "<li><b>x" * 40_000).count("x") == 40_000
    assert time.perf_counter() - began < 10
    before = tree._cached_traits.cache_info().currsize, tree._child_id.cache_info().currsize
    tree.extract("".join(f"<p class='{'k' * 5000}{i}' data-x='{i}'>y" for i in range(50)))
    after = tree._cached_traits.cache_info().currsize, tree._child_id.cache_info().currsize
    assert after[0] <= before[0] + 1 and after[1] <= before[1] + 60


def plain_pruned(pages, low):
    """Topmost low branches of one host's pages, straight from the definition."""
    seen = {node for html in pages for node in tree.page_nodes(html)}
    paths, own, kept, holds, parent = {}, {}, {}, {}, {}
    for path, above, has_text, held, style, content, shown in seen:
        paths.setdefault(path, set()).add((above, has_text, held, style, content, shown))
        parent[path] = above
        kept[path] = kept.get(path, False) or has_text
        holds[path] = holds.get(path, False) or held
    for path, rows in paths.items():
        def importance(kind):
            counts = {}
            for row in rows:
                counts[row[kind]] = counts.get(row[kind], 0) + 1
            m = len(rows)
            return 1.0 if m < 2 else -sum(n / m * math.log(n / m) for n in counts.values()) / math.log(m)
        own[path] = max(importance(3), importance(4))
    below = {}
    for path in parent:
        at, walked = path, []
        while at:
            walked.append(at)
            at = parent.get(at, 0)
        for a in walked:
            below.setdefault(a, []).append(path)
    judged = {p for p in parent if not holds[p] and max(own[x] for x in below[p]) < low - 1e-12}
    return frozenset(p for p in judged if parent[p] not in judged and any(kept[x] for x in below[p]))


def test_the_tree_decides_pages_without_a_main_region(llm):
    pick = random.Random(11)
    rows, by_host = [], {}
    for i in range(300):
        h, k = i % 10, i // 10
        parts = [f"<div class=top{h}>Welcome to {h}</div>", f"<ul class=links>{''.join(f'<li><a>{x}</a>' for x in range(h + 1))}</ul>"]
        parts += [f"<div class=lead><p>{' '.join(str(pick.random()) for _ in range(6))}</p></div>"]
        parts += [f"<section class=s{x}><p>Part {x} <i>of {k if x % 2 else 'all'}</i></p></section>" for x in range(pick.randrange(4))]
        parts += [f"<div class=end><p>Rights{' reserved' if k % 9 else ''}</p></div>"]
        html = f"<html><body><div class=wrap{h % 3}>{''.join(parts)}</div></body></html>"
        rows.append((i, f"http://host{h}.example:80/{k}", html))
        by_host.setdefault(h, []).append(html)
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    want = {h: plain_pruned(p, tree.LOW) for h, p in by_host.items()}
    got = {r.page_id: r.text for r in tree.extract_pages(pages).collect()}
    changed = 0
    for i, _, html in rows:
        assert got[i] == tree.extract(html, want[i % 10])
        changed += got[i] != tree.extract(html)
    assert changed > 250


def test_one_reading_of_hosts(llm):
    urls = ["//a.com/x", " http://a.com/x", "http://[::1]:80/x", "http://u:p@a@b.com/", None, "HTTP://A.Com:8080/x"]
    pages = llm.createDataFrame([(i, u, f"<body><div class=top>Same</div><p>Body {i % 7}</p></body>") for u in urls for i in range(7)], "page_id long, url string, html string")
    assert {r.text for r in tree.extract_pages(pages).collect()} == {f"Body {i}" for i in range(7)}


def test_empty_page_table(llm):
    pages = llm.createDataFrame([], "page_id long, url string, html string")
    assert tree.extract_pages(pages).collect() == []


def test_loser_tree_merges_runs():
    pick = random.Random(6)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((pick.randrange(20),) for _ in range(pick.randrange(6))) for _ in range(k)]
        merged = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert merged == sorted(x for run in runs for x in run)


def test_archives_give_back_every_capture_in_order(llm):
    rows = [(1, "http://b.example/x?q=1", "<p>é</p>"), (2, "http://a.b.example/", "<p>é</p>"), (3, None, None), (4, "http://a.b.example/", ""), (5, "bad url\r\nX: y", "two\r\n\r\nparts WARC/1.1\r\n\r\n"),
            (None, "http://z.example/", "<p>é</p>"), (6, "http://a.b.example/", "x" * 300_000), (6, "http://a.b.example/", "x" * 300_000)]
    pages = llm.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, payload_bytes int")
    found = warc.archive(warc.dated(pages)).collect()
    assert len(found) == len(rows)
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(page_id, largest.get(html or "", 0))
    by_id = {}
    for r in found:
        by_id.setdefault(r.page_id, []).append(r)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        for r in by_id[page_id]:
            assert r.payload_bytes == len(payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            revisit = page_id is not None and largest[html or ""] != page_id
            assert r.record_type == ("revisit" if revisit else "response")
            assert r.refers_to == (largest[html or ""] if revisit else None)
    ordered = sorted(found, key=lambda r: (r.range_no, r.position))
    keys = [(r.url_key, r.captured_at, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys)
    assert warc.archive(warc.dated(pages.limit(0))).count() == 0


def test_small_payloads_can_be_left_out_of_revisits(llm):
    pages = llm.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    found = {r.page_id: r.record_type for r in warc.archive(warc.dated(pages), minimum=3).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_an_altered_payload_is_noticed():
    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    headers = {"WARC-Record-ID": "<urn:capture:1>", "WARC-Type": "response", "WARC-Payload-Digest": f"sha1:{digest}"}
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    assert warc.entry("run", headers, http + b"abc", 0, 9)[6:8] == (3, digest)
    for altered in (b"abd", b"abcd"):
        with pytest.raises(ValueError):
            warc.entry("run", headers, http + altered, 0, 9)
