"""Conversation repair, HTML extraction and fill-in-middle against brute force and planted cases."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonflow.llm import fim, html_extract, repair

# --- 11 conversation repair


def cheapest(initials, faults, most=3):
    """Every way of editing, tried out."""
    best = None

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < most:
            for r in "ua":
                go(i, cost + 3, audit + "I", roles + r, inserted + 1)
        if i < len(initials):
            go(i + 1, cost + 4, audit + "D", roles, inserted)
            if faults[i] != repair.DOOMED:
                more = 3 * (faults[i] == repair.CUT_OFF)
                go(i + 1, cost + more, audit + "K", roles + chr(initials[i]), inserted)
                for r in "ua":
                    go(i + 1, cost + 3 + more, audit + "R", roles + r, inserted)

    go(0, 0, "", "", 0)
    return best


def test_search_finds_the_least_cost_and_audit():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(6)
        initials, faults = bytes(rng.choice(b"ssuuuaaa ") for _ in range(n)), bytes(rng.choice([0, 0, 0, 1, 2]) for _ in range(n))
        cost, audit = repair.search(initials, faults)
        assert (cost, audit.decode()) == cheapest(initials, faults), (initials, faults)


def test_search_is_linear_in_the_turns():
    rng = random.Random(6)
    n = 60_000
    cost, audit = repair.search(bytes(rng.choice(b"sua ") for _ in range(n)), bytes(rng.choice([0, 1, 2]) for _ in range(n)))
    assert n <= len(audit) and cost > n


TURNS = "conv_id long, turn long, role string, text string, edit string"


def test_repair_of_nulls_ties_and_long_conversations_is_what_its_sql_says(spark, tmp_path):
    import duckdb

    rng = random.Random(7)
    rows = [(1, None, "user", "a.", ""), (1, None, "assistant", "b.", ""), (1, 1, None, None, ""), (None, 0, "user", "x", ""), (None, None, "assistant", "y!", ""), (None, 3, "system", "z.", "")]
    rows += [(2, 4, "user", "same.", "")] * 3 + [(3, 9, "", "empty role.", ""), (4, 0, "system", "only.", ""), (5, 0, "tool", "z?  \n", "")]
    # a conversation that the damage takes as a whole
    gone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "lost.", "")]
    rows += [(7, t, rng.choice(["user", "assistant", "system", "Tool"]), rng.choice(["hm", "yes.", " ", "no?", "x" * 50_000 + "."]) + (str(t) if t % 3 else ""), "") for t in range(90)]
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    df = repair.op11_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(repair.SQL["op11_conversation_repair"])
    names = [c[0] for c in cursor.description]
    got = {r["conv_id"]: r.asDict() for r in df.collect()}
    want = {r[names.index("conv_id")]: dict(zip(names, r, strict=True)) for r in cursor.fetchall()}
    assert got == want
    assert got[gone] == {"conv_id": gone, **dict.fromkeys(repair._COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(1, 0, "system", "be kind.", ""), (1, 1, "assistant", "hello.", ""), (1, 2, "assistant", "again", ""), (1, 3, "user", "?", ""), (1, 4, "user", "?", "")]
    rows = spark.createDataFrame(rows, TURNS)
    plans = repair.plan_repairs(rows)
    plan = plans.first()
    assert (plan["duplicate"], plan["truncated"], plan["illegal"], plan["gaps"]) == (1, 1, 3, 0)
    turns = sorted((r["position"], r["role"], r["text"], r["edit"]) for r in repair.apply_repairs(rows, plans).collect())
    assert re.fullmatch("(s?(ua)+)?", "".join(t[1][0] for t in turns))
    assert "".join(t[3] for t in turns) == plan["audit"].replace("D", "")
    empty = spark.createDataFrame([], TURNS)
    assert repair.plan_repairs(empty).count() == 0 and repair.apply_repairs(empty, plans.limit(0)).count() == 0


# --- 12 HTML extraction


def test_page_furniture_goes_and_text_stays():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no --> <div class="layout has-sidebar">
    <article><header><h1>Title &amp; more</h1><span>by me</span></header><p>One<br>line &lt;b&gt; &amp;amp; caf&eacute;<p><b>Two<p>Three</b> x<script>var t="</p>";</script> y
    <ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form><input value="q">Send</form><aside>side</aside><section id="comments"><p>first!</p></section>
    <article>a reader</article><div title="a > b">kept</div></article></div><footer>&copy; me</footer><p class="x>"""
    assert html_extract.main_text(page).split("\n") == ["Title & more", "One line <b> &amp; café", "Two", "Three x y", "a", "b", "c d", "kept"]
    assert html_extract.main_text("") == "" and html_extract.main_text("plain < text &am") == "plain < text &am"
    assert html_extract.main_text("<p>a<!-- never closed <p>b") == "a" and html_extract.main_text("<p>a</p><p>b<br/>c</p>tail") == "a\nb c\ntail"
    deep = "<div>" * 30_000 + "deep" + "</div>" * 30_000
    assert html_extract.main_text(deep) == "deep"
    assert html_extract.main_text("<p>" + "long text " * 200_000) == ("long text " * 200_000).strip()


def reference_text(page):
    """The article of pages like the given ones, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks += [""] if tag in ("p", "h1") else []
            self.blocks[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.blocks += [""] if tag in ("p", "h1", "article") else []

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)


def test_pages_of_the_tables_by_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: reference_text(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.op12_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and all(want.values())


def test_subtrees_on_many_pages_of_a_host_go(spark):
    box = "<div><p>Get our app today</p><b>now</b></div>"
    rng = random.Random(3)
    body = lambda i: "".join(f"<p>{html.escape(' '.join(f'w{rng.randrange(999)}' for _ in range(30)))} {i}</p>" for _ in range(3))
    rows = [(i, f"https://User@Site.example.com:80/{i}", f"<body>{body(i)}{box}</body>", "c") for i in range(20)]
    rows += [(100, "https://other.example.com/", f"<body>{body(100)}{box}</body>", "c")]  # one page of its host
    rows += [(200 + i, "http://copy.example.com/", f"<body><p>same page</p>{box}</body>", "c") for i in range(20)]  # copies of one page
    rows += [(300 + i, "http://art.example.com/", f"<article><p>shared passage</p>{body(i)}<div><a href=''>share this</a></div></article>", "c") for i in range(20)]
    rows += [(400, None, None, "c"), (None, "", "", "c"), (401, "x", "<p>no host</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)
    text = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    assert len(text) == len(rows)
    assert all("Get our app" not in text[i] and text[i].count("\n") == 2 for i in range(20))
    assert text[100].endswith("Get our app today\nnow") and text[219] == "same page\nGet our app today\nnow"
    assert all(text[i].startswith("shared passage\n") and "share this" not in text[i] for i in range(300, 320))
    assert (text[400], text[None], text[401]) == ("", "", "no host")
    assert html_extract.extract_text(pages.limit(0)).count() == 0


# --- 13 fill in middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_boundary_sets_select_like_sorted_lists():
    rng = np.random.default_rng(1)
    for values in (
        np.unique(rng.integers(0, 400_000, 3000)), np.unique(rng.integers(0, 140_000, 90_000)), np.arange(5, 200_000), np.zeros(0, np.int64), np.array([65_535, 65_536]),
        np.concatenate([np.arange(10, 20_000), np.unique(rng.integers(70_000, 131_000, 30_000)), np.array([900_000])]),
    ):
        found = fim.BoundarySet(values)
        assert len(found) == len(values)
        for k in {0, 1, len(values) // 2, len(values) - 1, *rng.integers(0, len(values) + 1, 40).tolist()}:
            if 0 <= k < len(values):
                assert found.select(k) == values[k]
        with pytest.raises(IndexError):
            found.select(len(values))
    kinds = {type(c) for v in (np.unique(rng.integers(0, 65_536, 40_000)), np.arange(60_000), np.array([1, 5, 9])) for c in fim.BoundarySet(v).containers}
    assert kinds == {fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer}


def test_fill_in_middle_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "a", " a b\t\n", "x<P>y z", "<S", "M> <", "héllo  wörld ☃ 😀 end ", "word " * 100_000, "  a b"]
    texts += ["".join(rng.choice("ab é😀\n <>PSM") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "null id here", "n"), (3, "a", "n"), (3, "a", "n")]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, n string"))
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text, h = r["text"], hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        tokens = TOKEN.findall(text)
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
        plain = text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50
        form = "plain" if plain else "spm" if h4 % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"], r["back"]) == (len(tokens), form, output, text)
        assert (r["prefix_end"], r["middle_end"]) == ((None, None) if plain else (len(p), len(p) + len(m)))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(empty).count() == 0
    letters = fim.fill_in_middle(spark.createDataFrame([(i, "abc def " * 20_000) for i in range(12)], "doc_id long, text string"), units="characters")
    letters = letters.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["n"] == 160_000 and r["back"] == r["text"] for r in letters) and any(r["form"] != "plain" for r in letters)
