"""URL filters, page texts and WARC archives; the queries and the pipeline as registered."""

import base64
import gzip
import hashlib
import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from retentia.llm import html_text, urls, warc
from retentia.llm.common import table
from retentia.llm.queries import ORACLES, QUERIES

PAGES = [
    (1, "https://WWW.Example.org/es/1?x=/en/1#f", "<article><h1>T &amp; U</h1><p>One  two\n three four five six.</p></article>"),
    (2, "http://a.example.org/en/12", None),
    (3, "no scheme.org/es/", ""),
    (4, None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx"),
    (5, "https://notexample.org/es/1", "same"),
    (6, "https://x.com/fr/1", "same"),
    (7, "https://x.com/de/1", "same"),
    (7, "https://x.com/de/1", "same"),
    (8, "ftp://com/fr/", "é" * 100_000),
    (9, "https://x.com?/fr/", ""),
    (None, "https://spam-casino.com/x", "same"),
    (10, "https://x.org.evil.net/es/", "<p>a < b</p>"),
]
KIND = "page_id bigint, url string, html string, key string, rule string, text string, digest int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, None, "x", "y", 1) for r in PAGES], KIND).repartition(3)


def slow_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_url_rules(spark, pages, sf_dir):
    for frame in (pages, table(spark, sf_dir, "pages")):
        got = urls.judge(frame).collect()
        source = sorted(((r.page_id, r.url) for r in frame.collect()), key=repr)
        assert len(got) == len(source)
        by_id = {r.page_id: r for r in got}
        for i, url in source:
            host, path, (rule, verdict) = slow_rule(url)
            r = by_id[i]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_trees_learn_held_out_labels(spark):
    random.seed(1)
    good = [f"https://{random.choice(['news', 'blog', 'docs'])}.site{i}.net/en/{i}" for i in range(300)]
    bad = [f"http://win-{random.choice(['x', 'y'])}-{i * 7919 % 99999}-now.biz/?a={i}&b={i}&c=3" for i in range(300)]
    labelled = spark.createDataFrame([(u, 0) for u in good[:200]] + [(u, 1) for u in bad[:200]], "url string, label int")
    test = spark.createDataFrame(list(enumerate(good[200:] + bad[200:])), "page_id bigint, url string")
    got = urls.judge(test, labelled=labelled).collect()
    assert sum((r.verdict == "block") == (r.page_id >= 100) for r in got) / len(got) > 0.95
    one = urls.judge(test, labelled=labelled.filter("label = 0")).collect()
    assert {r.verdict for r in one} == {"allow"}


def test_one_url_on_most_rows_does_not_empty_the_sample(spark):
    rows = [("https://one.site.net/en/1",)] * 20_000
    rows += [(f"https://docs{i}.site.net/en/{i}",) for i in range(100)] + [(f"http://casino.win{i}.biz/?a={i}&b=1&c=2",) for i in range(100)]
    frame = spark.createDataFrame(rows, "url string").repartition(4)
    sample = urls.label_by_names(frame, bound=200).groupBy("label").count().collect()
    # The distinct URLs are counted within two per cent.
    assert all(90 <= n <= 101 for n in (r["count"] for r in sample)) and len(sample) == 2
    test = spark.createDataFrame([(1, "http://casino.other.biz/?a=5&b=1&c=2"), (2, "https://docs.site.net/en/7")], "page_id bigint, url string")
    labelled = urls.label_by_names(frame, bound=200)
    assert [r.verdict for r in urls.judge(test, labelled=labelled, bound=10**6).orderBy("page_id").collect()] == ["block", "allow"]
    assert urls._bounded(labelled.withColumn("label", urls.F.lit(1)), 50).count() < 100


def test_suffix_counts_leave_out_the_own_fold(spark):
    train = spark.createDataFrame([(f"h{i}.net", float(i % 2)) for i in range(40)], "host string, label double")
    folds = urls._folds(train, urls.F.array(urls.F.lit("net")))
    assert folds[-1]["net"] == (40, 20)
    assert sum(40 - folds[f].get("net", (0, 0))[0] for f in range(urls.FOLDS)) == 40
    assert all(folds[f]["net"][0] < 40 for f in range(urls.FOLDS))


def test_page_texts(spark, pages, sf_dir):
    source = table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in html_text.main_text(source).collect()}
    for r in source.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)[^>]*>", inner)
        lines = [" ".join(html_text.entities.unescape(re.sub("<[^>]*(>|$)", " " if "<br" in p else "", p)).split()) for p in parts]
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert odd[1] == "T & U\nOne two three four five six." and odd[2] == odd[3] == "" and odd[10] == "a < b"
    assert html_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{}, None])
def test_page_parts_that_are_not_the_article(spark, sf_dir, weights):
    weights = html_text.fit(table(spark, sf_dir, "pages")) if weights is None else weights
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><header><p>site name</p></header><nav><a href=x>Home</a></nav>"
        "<div class='cookie-notice'><p>We use cookies here</p></div><main><h1>Head &lt;line</h1><p>One two <b>three</b> four five six seven.</p>"
        "<div class=ad>Buy this now</div><p>Eight<br>nine ten eleven twelve.<form><p>Your name<input></form><script>var x='<p>no</p>'</script>"
        "<ul><li>first item<li>second item</ul><section id=comments><p>Nice post friend</p></section></main>"
        "<aside><p>Related things to read</p></aside><footer>copyright</footer></body></html>"
    )
    assert html_text.extract(page, weights).split("\n") == [
        "Head <line", "One two three four five six seven.", "Eight nine ten eleven twelve.", "first item", "second item",
    ]
    for text in ("<b>" * 9000 + "</i>" * 9000, "<div>" * 9000 + "x", '<a href="' * 5000, "<" * 9000, "&" * 9000):
        html_text.extract(text, weights)


RUNNING = "<p>" + "One two three four five six seven eight nine ten. " * 3 + "</p>"
NAMED_LIKE_PARTS = (
    "social-history search-results-study login-info notice-of-award share-price related-work header-file-format comment-on-law "
    "banner-carriers menu-engineering cookie-recipe promotion-and-relegation navigation-acts alert-fatigue copyright-law "
    "subscribe-pattern footer-reflex sponsor-history advert-culture popup-theatre widget-theory dialog-of-plato reply-to-critics "
    "discussion-paper overlay-network modal-logic toolbar-design breadcrumb-sponge pagination-theory masthead-history "
    "complementary-angles signup-sheet-1900 newsletter-archive-1800 sharing-economy navbar-design ads-b-signals gdpr-text "
    "consent-theory notification-theory recommended-daily-intake"
).split()


@pytest.mark.parametrize("weights", [{}, None])
def test_names_that_only_contain_a_part_do_not_cut(spark, sf_dir, weights):
    weights = html_text.fit(table(spark, sf_dir, "pages")) if weights is None else weights
    nav = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
    line = " ".join(("One two three four five six seven eight nine ten. " * 3).split())
    assert len(NAMED_LIKE_PARTS) == 40
    for name in NAMED_LIKE_PARTS:
        for kind in ("class", "id"):
            inside = f"<article>{RUNNING}<p {kind}='{name}'>Some more of it.</p><div {kind}={name}>{RUNNING}</div></article>"
            got = html_text.extract(f"<body>{nav}{inside}<footer>c</footer></body>", weights)
            assert got.split("\n") == [line, "Some more of it.", line], name
    whole = f"<main><section id='social-history'><h2>Old</h2>{RUNNING}{RUNNING}</section></main>"
    assert html_text.extract(f"<body>{nav}{whole}</body>", weights) == f"Old\n{line}\n{line}"
    for head in ("", "<h1>Head</h1>"):
        form = f"<body><form id=aspnetForm>{nav}<div>{head}{RUNNING}{RUNNING}</div><footer>c</footer></form></body>"
        assert html_text.extract(form, weights).split("\n")[-2:] == [line, line]
    # Links, whole names and long reader comments are still cut.
    rest = (
        "<div class=related-posts><p>Read that</p></div><div class=share-this-story><a href=x>tweet it</a></div>"
        f"</article><section id=comments><article class=comment>{RUNNING * 9}</article></section>"
    )
    assert html_text.extract(f"<body><article>{RUNNING}{rest}</body>", weights) == line


def test_names_have_weights_from_labelled_pages(spark):
    inside = f"<article><div class='login-info'>{RUNNING}</div></article>"
    outside = f"<body><div class='ad-teaser'>{RUNNING}</div><article>{RUNNING}</article></body>"
    unmarked = [(i, f"<p>{i}</p>") for i in range(3_000)]
    frame = spark.createDataFrame([*unmarked, (4_000, inside), (4_001, outside), (4_002, outside)], "page_id bigint, html string")
    # The bound counts labelled pages only.
    weights = html_text.fit(frame, bound=3)
    assert weights["n", "info"] > 0 > weights["n", "teaser"]
    assert html_text.extract(f"<article>{RUNNING}<p class=teaser-ad>Not this.</p></article>", weights).count("Not") == 0
    assert html_text.extract(f"<article>{RUNNING}<p class=ad-info>But this.</p></article>", weights).count("But") == 1


def test_best_run_equals_brute_force():
    random.seed(3)
    for n in [0, 1, 2, *range(3, 40)] * 5:
        values = [random.choice((-2, -1, -0.5, 0, 0.5, 1, 3)) for _ in range(n)]
        a, b = html_text.best_run(values)
        assert sum(values[a:b]) == max([0, *(sum(values[i:j]) for i in range(n) for j in range(i + 1, n + 1))])


def test_archives_come_back_whole(spark, pages):
    got = warc.archive(pages).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        raw, f = (h or "").encode(), first.get(h or "")
        again = f is not None and f != i
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), digest, "revisit" if again else "response", f if again else None))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    order = [(r.key, r.time, r.page_id is None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert warc.archive(pages.limit(0)).count() == 0


def test_least_payload_and_payload_texts(spark, pages, tmp_path):
    path = warc.write(pages, f"file://{tmp_path}/w", least=5)
    rows = warc.read(spark, path, payloads=True).collect()
    assert {r.record_type for r in rows} == {"response"}  # all repeated payloads are shorter
    assert sorted(r.payload for r in rows) == sorted(h or "" for _, _, h in PAGES)


def test_url_keys_fold_the_host_only(spark):
    urls_ = ["HTTP://WWW.Example.ORG/Wiki?id=A#f", "http://example.org/wiki?id=a", None]
    frame = spark.createDataFrame([(u,) for u in urls_], "url string")
    assert [r[0] for r in frame.select(warc.url_key("url")).collect()] == ["org,example)/Wiki?id=A", "org,example)/wiki?id=a", ")"]


def test_index_ranges_grow_with_the_captures(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 1)
    got = warc.archive(pages, size=50_000).collect()
    order = [(r.key, r.time, r.page_id is None, r.page_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(PAGES)


def test_broken_archives_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[1] for x in warc.records(good * 2)] == [b"abc", b"abc"]
    for bad in (good[:-3], good.replace(b"3", b"2"), b"x" + good):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_an_offset_leads_to_its_record_alone(spark, tmp_path):
    """Records of 16 MB and more too, whose size does not end with a zero byte."""
    htmls = ["<p>é</p>", "", None, "x" * (17 << 20), "y" * (16 << 20), "\x00\x1f", "<p>é</p>"]
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string").withColumn("url", F.lit("http://a.org/"))
    rows = warc.archive(pages, f"file://{tmp_path}/w", size=1 << 20).collect()
    assert sorted(r.page_id for r in rows) == list(range(7))
    assert len({r.file for r in rows}) > 1
    for r in rows:
        with open(r.file.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            ((headers, block, start, length),) = warc.records(gzip.decompress(file.read(r.length)))
        assert headers["warc-record-id"] == f"<urn:capture:{r.page_id}>" and start == 0
        assert block.partition(b"\r\n\r\n")[2].decode() == ((htmls[r.page_id] or "") if r.record_type == "response" else "")
    for name in {r.file for r in rows}:
        with gzip.open(name.removeprefix("file:")) as file:
            assert len(list(warc.records(file.read()))) == sum(r.file == name for r in rows)


def test_members():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    one = gzip.compress(good, mtime=0)
    assert [x[1:] for x in warc.archived(one * 2)] == [(b"abc", 0, len(one)), (b"abc", len(one), len(one))]
    assert [x[1:] for x in warc.archived(good * 2)] == [(b"abc", 0, len(good) - 4), (b"abc", len(good), len(good) - 4)]
    for bad in (one[:-1], one + b"\x00", one + good, one[:-8] + bytes(8)):
        with pytest.raises(ValueError):
            list(warc.archived(bad))
    for size in (0, 1, 255, 65_536, (1 << 24) - 1, 1 << 24):
        packed = warc.member(bytes(size))
        assert packed[-1] == 0 and gzip.decompress(packed) == bytes(size)


def test_loser_tree():
    random.seed(1)
    for n in range(1, 18):
        runs = [sorted((random.randint(0, 30), i) for _ in range(random.randint(0, 25))) for i in range(n)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    want = oracle.connect(sf_dir).sql(ORACLES[name]).to_arrow_table()
    assert oracle.differences(QUERIES[name](spark, sf_dir).toArrow(), want) == []


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_pipeline_equals_its_operators(spark, sf_dir):
    """Each stage against brute force on what the stage before kept."""
    from test_dedup import plain, slow_components, slow_fingerprint

    docs = table(spark, sf_dir, "documents")
    names, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.collect()
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == names
        after = {r.doc_id for r in kept.collect()}
        assert after <= {r.doc_id for r in before}
        if name == "exact dedup":
            best = {}
            for r in before:
                best[plain(r.text)] = min(best.get(plain(r.text), (1, 0)), (-len(r.text), r.doc_id))
            assert after == {i for _, i in best.values()}
        if name == "SimHash near-dedup":
            before.sort(key=lambda r: r.doc_id)
            roots = slow_components([slow_fingerprint(r.text) for r in before])
            assert after == {before[k].doc_id for k in set(roots)}
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in got.collect()} == after


def test_pipeline_with_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "text", None, "s", 4), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, sf_dir).count() <= frame.count()
