import random
import re

import numpy as np
import pytest

from papyra.llm import html_extract as H

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x='</p><article>no</article>';</script></head><body>"
    "<header><a href='/a>b'>Site</a></header><nav><ul><li><a>Home<li><a>News</ul></nav><!-- <p>gone</p> --><div class='cookie-notice'>We use cookies</div>"
    "<article class='post'><header><h1>T &lt;i&gt;</h1></header><p><b>Hello<br>wor&#108;d\n&nbsp; x<p>Second<script>y</script> part"
    "<form><input value='q'>Search</form><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><aside>see also</aside>"
    "<div id='comments'><p>first!</div><div hidden>secret</div><footer>By me</footer></article>"
    "<section class='comments'><article>c1</article></section><div class='sidebarAd'>Buy</div><footer>&copy; me"
)




def alone(source):
    """Main text of a page without any others of its host."""
    texts, _ = H.own_blocks(source)
    return H.cut(texts, lambda hashes: np.zeros(len(hashes), bool))


def test_blocks_of_an_article():
    assert alone(PAGE) == "T <i>\n\nHello world x\n\nSecond part\n\none\n\ntwo\n\na\n\nb\n\nc"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), ("plain  text &amp; more", "plain text & more"), ("<p>a<p>b</p>", "a\n\nb"), ("<div>a<span>b</span> c</div>d", "ab c\n\nd"),
        ("<main><p>in</p></main><p>out</p>", "in"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<main><h1>T</h1><p>Lead.</p><article>Teaser</article></main><p>o</p>", "T\n\nLead.\n\nTeaser"),
        ("<article><p>a</p><section class='related work'>b</section><div class='notice-period'>c</div><div class='related'>d</div></article>", "a\n\nb\n\nc"),
        ("<p>unclosed <b attr=\"x>y", "unclosed y"), ("<script>only", ""), ("<nav>menu</nav>", ""), ("<ARTICLE><P CLASS=x>Up</P></ARTICLE>", "Up"),
        ("<div role='main'>r</div><div>s</div>", "r"), ("</div></p>x", "x"), ("<p>&#x41;&#66;&bogus;&eacute;</p>", "AB&bogus;é"),
    ],
)
def test_pages(source, text):
    assert alone(source) == text


def brute(pages, least=H.LEAST, sparse=H.SPARSE, some=(H.PAGES, H.SHARE), own=(H.OWN_PAGES, H.OWN_SHARE)):
    """Text per (id, url, html): counts every prefix in the sparse array of every host by plain sets."""
    host_of = lambda u: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", u or "") or ["", ""])[1].lower()
    where, total = {}, {}
    for k, (_, url, source) in enumerate(pages):
        host = host_of(url)
        if host:
            total[host] = total.get(host, 0) + 1
            texts, _ = H.own_blocks(source or "")
            split = [t.split() for t in texts]
            stream = [w for ws in split for w in ws]
            at = H.suffixes(texts, least, sparse)[0].tolist()
            found = {tuple(stream[i : i + least]) for i in at} | {("b", *ws) for ws in split if len(ws) < least + sparse - 1}
            for f in found:
                where.setdefault((host, f), []).append(tuple(texts))
    out = []
    for i, url, source in pages:
        host = host_of(url)
        texts, marked = H.own_blocks(source or "")
        n, share = own if marked else some
        bad = lambda f: len(set(where.get((host, f), []))) >= n and len(where[host, f]) >= share * total[host]  # noqa: E731, B023
        split = [t.split() for t in texts]
        stream = [w for ws in split for w in ws]
        gone = [False] * len(stream)
        for p in H.suffixes(texts, least, sparse)[0].tolist():
            if bad(tuple(stream[p : p + least])):
                gone[p : p + least] = [True] * least
        kept, start = [], 0
        for text, ws in zip(texts, split):
            mask = gone[start : start + len(ws)]
            start += len(ws)
            if len(ws) < least + sparse - 1 and bad(("b", *ws)) or any(mask) and sum(mask) >= H.COVERED * len(ws):
                continue
            kept.append(" ".join(w for w, x in zip(ws, mask) if not x) if any(mask) else text)
        out.append((i, url, "\n\n".join(kept), len("\n\n".join(kept))))
    return sorted(out, key=str)


MENU = "Home News Sport Weather Contact About Imprint Privacy Terms Jobs Shop Radio Video Podcasts Archive Letters Staff Help Search Log"


def host_of_stories(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    say = lambda k: " ".join(word() for _ in range(k))
    shared = say(30)
    out = []
    for k in range(n):
        story = f"<h1>Story {k}</h1><p>{say(25)}</p><p>One sentence of them all {say(3)}.</p>"
        if k in (1, 2):
            story += f"<p>{shared}</p>"
        links = "".join(f"<li>{w}" for w in MENU.split())
        out.append((k, "http://News.example/%d" % k, f"<body><div><ul>{links}</ul></div>{story}<div>{say(2)} Share this with your friends and follow us now</div><div>{MENU} {say(40)}</div></body>"))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, pages, parts=4):
    return spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)


def test_repeated_runs_go_where_nothing_marks_the_article(spark):
    pages = host_of_stories(12)
    got = {r.page_id: r.text for r in H.extract(frame(spark, pages)).collect()}
    without = {i: alone(s) for i, _, s in pages}
    for k in range(12):
        first, second = re.findall(r"<p>(.*?)</p>", pages[k][2])[:2]
        assert got[k] != without[k] and "Home" not in got[k].split()[:3]
        assert got[k].startswith(f"Story {k}\n\n{first}\n\n{second}")
    # What two pages of twelve share is their own.
    shared = re.findall(r"<p>(.*?)</p>", pages[1][2])[2]
    assert shared in got[1] and shared in got[2]
    # The menu inside a longer block goes, what stands beside it stays.
    assert "Podcasts" not in got[3] and pages[3][2].rsplit("Log ", 1)[1][:100] in got[3]


@pytest.mark.parametrize("parts", [1, 7, 31])
def test_the_same_for_any_partitions(spark, parts, monkeypatch):
    pages = host_of_stories(9) + [(100 + i, u.replace("News", "other"), s) for i, u, s in host_of_stories(5, seed=4)]
    monkeypatch.setattr(H, "HELD_SUFFIXES", 1 if parts == 7 else 400_000)
    assert rows_of(H.extract(frame(spark, pages, parts))) == brute(pages)


def test_too_much_to_broadcast(spark):
    pages = host_of_stories(9) + [(200, None, "<p>" + MENU), (201, "odd", "<p>" + MENU), (3, "http://News.example/3", None)]
    assert rows_of(H.extract(frame(spark, pages + pages[:2]), broadcast_prefixes=0)) == brute(pages + pages[:2])


def test_copies_of_a_page_do_not_cover_each_other(spark):
    story = host_of_stories(1)[0][2]
    pages = [(k, f"http://news.example/{k}?utm={k}", story) for k in range(8)]
    got = rows_of(H.extract(frame(spark, pages)))
    assert [r[2] for r in got] == [alone(story)] * 8


def test_boilerplate_inside_articles_needs_more_pages(spark):
    notice = "Our newsletter brings you the best stories of the week straight to your inbox every single Friday morning at eight"
    pages = [(k, "http://a.example/", f"<article><h1>T{k}</h1><p>Body {k} {k * 7}.</p>{f'<p>{notice}</p>' if k < 6 else ''}</article>") for k in range(10)]
    got = {r.page_id: r.text for r in H.extract(frame(spark, pages)).collect()}
    assert got == {k: f"T{k}\n\nBody {k} {k * 7}." for k in range(10)}
    few = [(i, u, s if i < 4 else s.replace(notice, "x")) for i, u, s in pages]
    got = {r.page_id: r.text for r in H.extract(frame(spark, few)).collect()}
    assert all(notice in got[k] for k in range(4))


@pytest.mark.parametrize("seed", range(6))
def test_every_long_repeat_is_met(seed):
    """Two streams that share least + sparse - 1 tokens share a prefix in the sparse array."""
    r = random.Random(seed)
    for _ in range(40):
        shared = [r.choice("abcdef") for _ in range(H.LEAST + H.SPARSE - 1)]
        one, two = ([[r.choice("uvwxyz") for _ in range(r.randint(0, 30))] for _ in range(2)] for _ in range(2))
        found = [set(H.suffixes([" ".join(a + shared + b)])[1].tolist()) for a, b in (one, two)]
        assert found[0] & found[1]


def test_every_place_is_looked_at(spark, monkeypatch):
    """A run of the fewest tokens goes wherever it stands in a block; what follows a run in the next block stays."""
    r = random.Random(3)
    say = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    runs = [say(H.LEAST) for _ in range(20)]
    stories = [[(say(9), run, say(9)) for run in runs] for _ in range(6)]
    tell = lambda story: "".join(f"<p>{a} {run} {b}</p>" for a, run, b in story) + "<ul><li>Home<li>News<li>About us</ul><h1>Story of one</h1>"
    pages = [(k, "http://h.example/", tell(story) + f"<p>{say(3)}</p>") for k, story in enumerate(stories)]
    want = ["\n\n".join(f"{a} {b}" for a, _, b in story) for story in stories]
    for host_pages in (256, 1):
        monkeypatch.setattr(H, "HOST_PAGES", host_pages, raising=False)
        got = rows_of(H.extract(frame(spark, pages, 3)))
        assert [x[2].rsplit("\n\n", 1)[0] for x in got] == want and got == brute(pages)


def test_packed_prefixes_open_again():
    r = np.random.default_rng(1)
    keys = np.sort(np.concatenate([[0, (1 << H.KEY_BITS) - 1], r.integers(0, 1 << H.KEY_BITS, 500)]))
    places = r.integers(0, 4096, len(keys)).astype(np.uint16)
    for n in (0, 1, len(keys)):
        got = H._unpacked(H._packed(keys[:n], places[:n]))
        assert (got[0] == keys[:n]).all() and (got[1] == places[:n]).all()


def test_table(spark):
    rows = [
        (1, "http://a/x", PAGE), (2, "http://a/y", None), (2, "http://a/y", None), (None, None, "<p>x"), (3, "odd", ""),
        (4, "http://b/", "<article><p>" + "long text " * 50_000 + "</article>"), (5, "http://b/2", "<article>  </article>"),
    ]
    df = spark.createDataFrame([(*r, "n", 5) for r in rows], "page_id long, url string, html string, host string, key int")
    got = sorted((tuple(r) for r in H.extract(df).collect()), key=str)
    want = sorted(((i, u, (t := alone(h or "")), len(t)) for i, u, h in rows), key=str)
    assert got == want == brute(rows)
    assert H.extract(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    import html

    from papyra.llm._common import table

    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in H.op7(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
