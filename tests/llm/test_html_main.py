"""Main text: repeated substrings against plain n-grams, markup cases, shards and odd rows."""

import html as lib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusbank.llm import html_main as hm

SF = "/root/testdata/sf0.01"


def streams(pages):
    """(tokens, page numbers) with a token of its own at the end of every page."""
    tokens = [x for n, p in enumerate(pages) for x in [*p, 10**6 + n]]
    return (np.array(tokens, dtype=np.uint64),
            np.array([n for n, p in enumerate(pages) for _ in range(len(p) + 1)]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=6), st.sampled_from([1, 2, 4, 8]))
def test_repeated_against_all_grams(pages, depth):
    tokens, page = streams(pages)
    where = {}
    for n, p in enumerate(pages):
        for k in range(len(p) - depth + 1):
            where.setdefault(tuple(p[k:k + depth]), set()).add(n)
    want = []
    for p in pages:
        marks = [False] * (len(p) + 1)
        for k in range(len(p) - depth + 1):
            if len(where[tuple(p[k:k + depth])]) > 1:
                marks[k:k + depth] = [True] * depth
        want += marks
    assert hm.repeated(tokens, page, depth).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_order(tokens):
    place = hm.suffix_ranks(np.array(tokens), 64)
    assert np.argsort(place).tolist() == sorted(range(len(tokens)), key=lambda k: tokens[k:])


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain  text\n\nhere", "plain text here"), ("a &lt; b &amp;amp; &copy c", "a < b &amp; © c"),
    ("<p>one<p>two", "one\ntwo"), ("<article><h1>T</h1>x<br>y</article><p>no", "T\nx y"),
    ("<body><nav><ul><li><a href='/'>Home</a></ul></nav><main><p>Text</p></main>", "Text"),
    ("<article><p>in</p><aside>no</aside><form><p>no</form><p>in2</article>", "in\nin2"),
    ("<article><header><h1>T</h1></header><p>x</p><div class='comments'><p>no</p></div></article>",
     "T\nx"),
    ("<header><p>no</p></header><p>x</p><footer>no</footer>", "x"),
    ("<script>if (a < b) document.write('<p>no</p>')</script><p>x</p><style>p{}</style>", "x"),
    ("<p title='a > b'>x</p><p title=\"it's\">y", "x\ny"), ("<p>a<!-- <p>no -->b</p><!-- no", "ab"),
    ("<article><p>a</p><div class=ad>no</div><p>b <span class='share-box'>no</span>c</p></article>",
     "a\nb c"), ("<p>1 < 2 <3</p>", "1 < 2 <3"), ("<p>x</p><script>no", "x"), ("<title>no</title>x", "x"),
    ("<div class='post-content'><p>a</p></div><div><p>no</p></div>", "a"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<p>a&nbsp;b&#10;c&#x41;</p>", "a\xa0b cA"), ("<ARTICLE><P CLASS='x'>A</P></ARTICLE>", "A"),
    ("<article><p hidden>no</p><p>a</p><noscript><p>no</p></noscript></article>", "a"),
    ("<p>unclosed <b>bold<p>next</b> x", "unclosed bold\nnext x"), ("<p", ""), ("a</p>b</div>c", "a\nb\nc"),
])
def test_markup(page, want):
    assert hm.main_texts([page]) == [want]


def test_repetition_decides_where_markup_does_not():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    body = lambda: " ".join(rng.choice(words) for _ in range(60))
    menu = "<div><div>Home News Sport Weather Travel Shop Help Contact us today</div></div>"
    foot = "<div>Copyright of this site by its owners and all rights are reserved</div>"
    texts = [body() for _ in range(30)]
    pages = [f"{menu}<div>{t}</div>{foot}" for t in texts]
    assert hm.main_texts(pages) == texts
    assert hm.main_texts(pages[:1]) != texts[:1]  # nothing repeats on one page
    assert hm.main_texts([pages[0]] * 5)[0] == hm.main_texts(pages[:1])[0]  # nor on equal pages
    near = pages[0].replace("Help", "Info")  # a copy keeps its text
    assert all(texts[0] in t for t in hm.main_texts([pages[0], near]))
    article = [f"{menu}<article><p>{texts[0]}</p><p>{t}</p></article>{foot}" for t in texts]
    assert hm.main_texts(article) == [f"{texts[0]}\n{t}" for t in texts]


def plain(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>|<br>", re.sub(r"</?b>", "", body))
    clean = (re.sub(r"[\x20\x09-\x0d]+", " ", lib.unescape(p)).strip(" ") for p in parts)
    return "\n".join(t for t in clean if t)


def test_query(spark):
    got = {r.page_id: r for r in hm.op13_html_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, plain(p.html), len(plain(p.html)))


def test_boilerplate_is_found_by_repetition(spark):
    """Of the blocks that the markup names, most on large hosts are covered by repeats."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn(
        "host", hm.url_host(F.col("url")))
    host = rows.groupBy("host").count().orderBy(F.desc("count"), "host").first().host
    pages = [hm.blocks(r.html) for r in rows.filter(F.col("host") == host).collect()]
    counts, repeats = hm.covered_shares(pages)
    kinds = np.array([k for p in pages for _, k, _ in p])
    out = kinds == hm.OUT
    assert repeats[out].sum() > 0.8 * counts[out].sum()
    assert repeats[~out].sum() < 0.3 * counts[~out].sum()


def test_shards_and_odd_rows(spark):
    rng = random.Random(2)
    menu = "<div>Home News Sport Weather Travel Shop Help Contact us today</div>"
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(50)) for _ in range(200)]
    rows = [(k, f"http://hot.example/{k}", f"{menu}<div>{t}</div>") for k, t in enumerate(texts)]
    long = "<article>" + "<p>long &amp; text</p>" * 60_000 + "</article>"
    rows += [(900, "http://b.example/", long), (901, None, None), (None, "no host", "<p>x"),
             (902, "http://c.example/", ""), (None, "no host", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"text": F.lit(1), "_host": F.lit("x"), "_shard": F.lit("y")}).repartition(6)
    got = hm.main_text(df, shard=20_000).collect()
    assert sorted(r.text for r in got if (r.url or "").startswith("http://hot")) == sorted(texts)
    rest = sorted((r.page_id or 0, r.url, r.text) for r in got if not (r.url or "").startswith("http://h")
                  and r.page_id != 901)
    assert rest == [(0, "no host", "x")] * 2 + [
        (900, "http://b.example/", "\n".join(["long & text"] * 60_000)), (902, "http://c.example/", "")]
    assert [(r.url, r.text) for r in got if r.page_id == 901] == [(None, "")]
    assert hm.main_text(df.limit(0)).count() == 0


def test_size_and_dealing_change_no_result(spark):
    """Passages on only two pages of a host are found in any number of buckets and partitions."""
    rng = random.Random(5)

    def prose(n):
        return " ".join(str(rng.randrange(10**6)) for _ in range(n))

    rows = []
    for host in ("a", "b"):
        twice = [prose(12) for _ in range(30)]
        for k in range(60):
            page = f"<div>{twice[k // 2]}</div><div>{prose(40)}</div>"
            rows.append((host, len(rows), f"http://{host}.example/{k}", page))
        rows.append((host, len(rows), f"http://{host}.example/copy", page))
        rows.append((host, len(rows), f"http://{host}.example/named", f"<article>{twice[0]}</article>"))
    rows.append(("b", len(rows), "http://b.example/other", rows[0][3]))  # of the other host: its own
    want = {}
    for host in ("a", "b"):
        own = [r for r in rows if r[0] == host]
        want.update(zip([r[1] for r in own], hm.main_texts([r[3] for r in own])))
    assert sum("\n" in text for text in want.values()) == 1  # all but the page from the other host
    df = spark.createDataFrame([r[1:] for r in rows], "page_id long, url string, html string")
    for shard, parts in ((10**9, 1), (2_000, 7), (500, 3)):
        got = hm.main_text(df.repartition(parts), shard=shard).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packed_names(names):
    names = np.array(sorted(names), dtype=np.uint64)
    assert hm.unpacked(hm.packed(names)).tolist() == names.tolist()


def test_names_are_sent_in_few_bytes():
    """All names of distinct pages, in little more than half of the 12 bytes of a name and its tag."""
    rng = random.Random(6)
    pages = [f"<p>{' '.join(str(rng.randrange(10**6)) for _ in range(150))}</p>" for _ in range(2_000)]
    names = np.unique(hm.suffix_names([hm.blocks(p) for p in pages], ["h"] * len(pages))[-2])
    rows = pa.RecordBatch.from_pydict({
        "_html": pages, "_host": ["h"] * len(pages), "_copy": pa.array([None] * len(pages), pa.bool_())})
    for buckets in (1, 20):
        sent = list(hm._bucketed(buckets, hm.DEPTH)([rows]))
        assert sum(len(x.as_py()) for b in sent for c in ("_names", "_tags") for x in b[c]) < 7 * len(names)
        got = [hm.unpacked(x.as_py()) for b in sent for k, x in zip(b["_bucket"], b["_names"])
               if k.as_py() >= 0]
        assert np.array_equal(np.sort(np.concatenate(got)), names)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_copies_in_many_tasks(spark, monkeypatch, broadcast):
    """Copies of a page count as one page wherever they lie and however many names are sent together."""
    monkeypatch.setattr(hm, "SENT", 200)
    monkeypatch.setattr(hm, "CHUNK", 500)
    rng = random.Random(7)

    def prose(n):
        return " ".join(str(rng.randrange(10**6)) for _ in range(n))

    shared = [prose(12) for _ in range(8)]
    pages = [f"<div>{shared[k]}</div><div>{prose(40)}</div>" for k in range(8)] * 9
    pages += [f"<div>{shared[k]}</div><div>{prose(40)}</div>" for k in range(4)]
    pages += [f"<div>{shared[6]}</div><div>{prose(40)}</div>"] * 5  # only on copies, of two pages
    want = hm.main_texts(pages)
    assert sum("\n" in text for text in want) == 27  # three pages share nothing with another one
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = spark.createDataFrame([(n, "http://h.example/", p) for n, p in enumerate(pages)],
                                   "page_id long, url string, html string")
        for parts in (1, 6):
            got = hm.main_text(df.repartition(parts), shard=2_000).collect()
            assert {r.page_id: r.text for r in got} == dict(enumerate(want)) and len(got) == len(pages)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("short", [hm.SHORT, np.uint64(0xFF << 56)])
def test_named_pages_are_judged_by_their_repeats(spark, monkeypatch, short):
    """Pages whose markup names the article go the way of the others: repeated names, then the check.

    Names that agree in the bits compared first but differ count as different.
    """
    monkeypatch.setattr(hm, "SHORT", short)
    rng = random.Random(8)
    menu = "<div>Home News Sport Weather Travel Shop Help Contact us today</div>"
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(30)) for _ in range(12)]
    pages = [f"{menu}<article><p>{t}</p><p>{texts[0]}</p></article>" for t in texts]
    rows = pa.RecordBatch.from_pydict({
        "page_id": [*range(12)], "url": ["u"] * 12, "_html": pages, "_host": ["h"] * 12,
        "_copy": pa.array([None] * 12, pa.bool_())})
    frames = pa.Table.from_batches([f for part in (rows[:7], rows[7:]) for f in hm._framed([part])])

    def compared(names, how):
        return pa.Table.from_batches(how(names.sort_by("_bucket").to_batches()))

    def with_names(found, how):
        of = [pc.equal(t["_frame"], own) for t in (frames, found) for own in frames["_frame"]]
        return pa.concat_tables(how(frames.filter(a), found.filter(b)) for a, b in zip(of[:2], of[2:]))

    likely = compared(pa.Table.from_batches(hm._sent_short(3, hm.DEPTH)(frames.to_batches())), hm._repeated_names)
    wrong = compared(with_names(likely, hm._sent_likely(3, hm.DEPTH)), hm._wrong_names)
    assert (wrong.num_rows > 0) == (short != 0xFFFFFFFFFF000000)
    judged = []
    kept = hm.kept_blocks
    monkeypatch.setattr(hm, "kept_blocks", lambda *a: judged.append(a) or kept(*a))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    got = with_names(pa.concat_tables([likely, wrong]), hm._settled(schema, hm.DEPTH)).to_pylist()
    counts, shared = hm.covered_shares([hm.blocks(p) for p in pages])
    assert shared.sum() > 12 * 35
    assert np.concatenate([a[1] for a in judged]).tolist() == counts.tolist()
    assert np.concatenate([a[2] for a in judged]).tolist() == shared.tolist()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(hm.main_texts(pages))) == {
        k: f"{t}\n{texts[0]}" for k, t in enumerate(texts)}
    df = spark.createDataFrame([(1, "u", pages[0])], "page_id long, url string, html string")
    plan = hm.main_text(df)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName().startswith("FlatMapCoGroupsInArrow")
